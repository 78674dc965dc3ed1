"""Helpers shared by the operators: the shared folder, written tables, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_KEY = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local session may leave that setting empty; it then gets a temporary folder.
    """
    base = spark.conf.get(SCRATCH_KEY, None) or spark.sparkContext.getConf().get(SCRATCH_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SCRATCH_KEY} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SCRATCH_KEY, base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts the
    lineage, so a lost executor costs a re-read and not a recomputation. Also its path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """As ``materialize_at``, without the path."""
    return materialize_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``materialize_at`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows, and about how many bytes, that a Python worker turns into objects at a time.
SLICE_ROWS, SLICE_BYTES = 1000, 16 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and, but for single rows, ``size`` bytes."""
    if batch.num_rows > rows or batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library only
        trim(0)


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, then ``give_back``: a Python worker serves many tasks, and would keep the most
    that any of them took."""

    def then_trim(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return then_trim


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES
) -> DataFrame:
    """Apply ``fn`` to ``slices`` of each Arrow batch of ``df``; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, size):
                if (out := fn(part)) is not None:
                    yield out

    return df.mapInArrow(giving_back(run), schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``edges(a long, b long)`` to ``(node, root)``.

    Alternates large-star and small-star steps: each keeps the components, adds no
    edge and halves distances to the smallest node, so it ends after a number of
    rounds logarithmic in the longest path. A step is a min per node (partial sums on
    the map side) and a join back, so a node with very many edges is one key of an
    inner join, which adaptive execution splits. Nodes without edges are not returned;
    self loops and repeated edges do no harm.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(small.where("a <> b").distinct(), "edges")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_rows(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``first(doc_id, h)`` names by their id and the hash of their
    text, one for each, and those of a null id."""
    i, h = unused(docs, "first_id"), unused(docs, "first_h")
    first = materialize(first.select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct(), "kept")
    same = (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h))
    kept = docs.join(first, same).dropDuplicates([i, h])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows that agree in the first ``n_keys`` columns; the rows
    must come sorted by them. A run may reach over batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield key, rows
