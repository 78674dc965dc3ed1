"""The indicator table that reports flow into: plain Parquet folders.

``reports/batch=N`` has the reports of one batch, numbered on from those before; a batch
writes nothing else, however large the table is. ``merged/upto=N`` has the whole table after
batch N; ``compact`` writes one now and then. ``commits`` has a row for each folder that is
complete, written last. A version is the number of a batch: a reader of version N takes the
newest merged table up to N and the reports after it, so it sees the same rows whatever is
appended, merged or written again meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.iocs import latest_reports, replace_reported
from urlrisk.schemas import IOC
from urlrisk.sources.scratch import delete_folder

_COMMIT = "kind string, number long, rows long, last_id long"


@dataclass(frozen=True)
class IocTable:
    """Indicators in ``folder``, which begin as ``default``. One stream at a time appends."""

    spark: SparkSession
    folder: str
    default: DataFrame

    def commits(self) -> dict[tuple[str, int], Row]:
        """By kind (``reports``, ``merged``) and number; as many as there are folders."""
        try:
            found = self.spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {(r.kind, r.number): r for r in found}

    def version(self) -> int | None:
        """The newest batch, or None before the first."""
        return max((n for _, n in self.commits()), default=None)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The table, in the columns of ``IOC``, after batch ``version`` (-1: as it began), or
        now. Large tables are not shuffled for a few reports that are merged while reading.
        A version that ``compact`` has dropped is an error."""
        commits = self.commits()
        known = [n for kind, n in commits if version is None or n <= version]
        if version is not None and version >= 0 and not known and any(kind == "merged" for kind, _ in commits):
            raise ValueError(f"version {version} is no longer kept")
        merged = max((n for n in known if ("merged", n) in commits), default=None)
        base = self.default if merged is None else self.spark.read.schema(IOC).parquet(self._path("merged", merged))
        later = sorted({n for n in known if ("reports", n) in commits and (merged is None or n > merged)})
        if not later:
            return base
        reports = self.spark.read.schema(IOC).parquet(*(self._path("reports", n) for n in later))
        newest = reports.groupBy("indicator").agg(F.max_by(F.struct(*reports.columns), "id").alias("r")).select("r.*")
        return replace_reported(base, newest)

    def append(self, reports: DataFrame, number: int, order_col: str = "seq") -> None:
        """Batch ``number`` of reports (columns of ``IOC_UPDATE``), later than all before it.
        Done again, it writes the same rows under the same ids in place of its first try."""
        before = {n: r.last_id for (kind, n), r in self.commits().items() if n < number and r.last_id is not None}
        start = before[max(before)] if before else self.default.agg(F.max("id")).first()[0] or 0
        path = self._path("reports", number)
        latest_reports(reports, start, order_col).write.mode("overwrite").parquet(path)
        found = self.spark.read.schema(IOC).parquet(path).agg(F.count("*").alias("n"), F.max("id").alias("m")).first()
        self._commit("reports", number, found.n, start if found.m is None else found.m)

    def compact(self, keep: int = 2) -> None:
        """Merge all batches into one table. Once there are more than ``keep`` merged tables,
        delete what only versions before the newest ``keep`` need; readers of the versions
        since go on as before."""
        version = self.version()
        if version is None:
            return
        commits = self.commits()
        if ("merged", version) not in commits:
            self.snapshot(version).write.mode("overwrite").parquet(self._path("merged", version))
            n = self.spark.read.schema(IOC).parquet(self._path("merged", version)).count()
            self._commit("merged", version, n, commits["reports", version].last_id)
            commits = self.commits()
        merged = sorted(n for kind, n in commits if kind == "merged")
        for kind, n in commits:
            if len(merged) > keep and (n < merged[-keep] or n == merged[-keep] and kind == "reports"):
                delete_folder(self.spark, self._commit_path(kind, n))
                delete_folder(self.spark, self._path(kind, n))

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/reports/batch={number}" if kind == "reports" else f"{self.folder}/merged/upto={number}"

    def _commit_path(self, kind: str, number: int) -> str:
        return f"{self.folder}/commits/{kind}-{number}"

    def _commit(self, kind: str, number: int, rows: int, last_id: int) -> None:
        row = self.spark.createDataFrame([(kind, number, rows, last_id)], _COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(self._commit_path(kind, number))
