"""Verification of a stream of URLs, and indicators reported by a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from urlrisk.config import RiskConfig
from urlrisk.plans.verify import verify_urls
from urlrisk.sources.ioc_table import IocTable
from urlrisk.sources.reference import References
from urlrisk.sources.urls import split_accepted


def verify_stream(
    stream: DataFrame, iocs: DataFrame | IocTable, refs: References, sink: str, checkpoint: str, cfg: RiskConfig | None = None, **how
) -> StreamingQuery:
    """Verify an unbounded table of ``url_id, url``: each micro-batch is verified like a
    table and written to its own folder ``sink/batch=N``, so a repeated batch replaces
    what it had written. There is no event time and no state.

    With an ``IocTable`` a micro-batch sees the reports that were complete when it was first
    tried. That version is written to ``sink_versions/batch=N`` before, so a repeated batch
    sees the same (``pinned_versions``). ``how``: further arguments of ``verify_urls``.
    """

    def indicators(number: int) -> DataFrame:
        if isinstance(iocs, DataFrame):
            return iocs
        known = {r.batch: r.version for r in pinned_versions(iocs.spark, sink).where(F.col("batch") == number).collect()}
        if number not in known:
            version = iocs.version()
            known[number] = -1 if version is None else version
            row = iocs.spark.createDataFrame([(known[number],)], "version long")
            row.coalesce(1).write.mode("overwrite").parquet(f"{sink}_versions/batch={number}")
        return iocs.snapshot(known[number])

    def write(batch: DataFrame, number: int) -> None:
        accepted, _ = split_accepted(batch)
        verify_urls(accepted, indicators(number), refs, cfg, **how).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pinned_versions(spark: SparkSession, sink: str) -> DataFrame:
    """``batch, version``: the version of the indicators that each micro-batch saw; -1: before
    all reports."""
    schema = "version long, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{sink}_versions").select("batch", "version")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch long, version long")


def current_iocs(spark: SparkSession, table: str, default: DataFrame) -> DataFrame:
    """The indicator table in folder ``table`` as it is now, or ``default``."""
    return IocTable(spark, table, default).snapshot()


def ioc_report_stream(reports: DataFrame, table: str, default: DataFrame, checkpoint: str, compact_every: int = 100, order_col: str = "seq") -> StreamingQuery:
    """Fold reports (columns of ``IOC_UPDATE``) into the ``IocTable`` in folder ``table``: each
    micro-batch writes its own reports and nothing else, but that every ``compact_every``
    batches all are merged. A repeated batch writes the same again. Later
    batches, and readers of the table, see it."""
    into = IocTable(reports.sparkSession, table, default)

    def write(batch: DataFrame, number: int) -> None:
        into.append(batch, number, order_col)
        if (number + 1) % compact_every == 0:
            into.compact()

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(
    spark: SparkSession, df: DataFrame, folder: str, batches: int = 3, rows_per_file: int = 1_000_000, key: str | None = None, order_col: str | None = None
) -> DataFrame:
    """``df`` written to ``folder`` as files of a bounded size, by as many tasks as a shuffle
    has, and read back as a stream of about ``batches`` micro-batches. With ``key`` and
    ``order_col`` rows of one key arrive in their order: files are written range by range, and
    within a range all rows of a key by one task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.approxQuantile(order_col, [k / batches for k in range(1, batches)], 0.001) if order_col else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.where(F.col(order_col) > low)
        part = part if high is None else part.where(F.col(order_col) <= high)
        part = part.repartition(n, key).sortWithinPartitions(key, order_col) if order_col else part.repartition(n)
        part.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    files = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(folder)
