"""URL tables, URLs in messages, and the verdict sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.operators.normalize import suffix_sizes

#: A scheme, ``://`` and what follows up to white space or a closing sign.
URL_IN_TEXT = r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>\"']+"
_CLOSING = r"[.,;:!?)\]}]+$"


def split_accepted(df: DataFrame, url_col: str = "url", id_col: str = "url_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows as ``url_id, url``: null and empty URLs are rejected, blank
    ones are not."""
    rows = df.select(F.col(id_col).alias("url_id"), F.col(url_col).cast("string").alias("url"))
    good = F.col("url").isNotNull() & (F.col("url") != "")
    return rows.where(good), rows.where(~good)


def spread(urls: DataFrame) -> DataFrame:
    """``urls`` over at least as many partitions as the session has cores. A table of URLs
    is small for the work it takes, so a few files would leave most cores idle; one with
    partitions enough stays as it is."""
    cores = urls.sparkSession.sparkContext.defaultParallelism
    return urls if urls.isStreaming or urls.rdd.getNumPartitions() >= cores else urls.repartition(2 * cores)


#: What Spark calls a line of text that has not the form of the table.
_BROKEN = "_corrupt_record"


def read_urls(
    spark: SparkSession, path: str, fmt: str = "parquet", url_col: str = "url", id_col: str = "url_id", id_type: str = "long", **options
) -> tuple[DataFrame, DataFrame]:
    """A table of URLs in Parquet, CSV, JSON or any format that Spark reads, as
    ``split_accepted`` splits it. Lines of CSV and JSON that can't be read, or whose id is not
    of ``id_type``, are rejected too, with the whole line as ``url`` and no id; CSV without a
    header has the id first."""
    if fmt not in ("csv", "json"):
        return split_accepted(spark.read.format(fmt).options(**options).load(path), url_col, id_col)
    schema = f"`{id_col}` {id_type}, `{url_col}` string, {_BROKEN} string"
    rows = spark.read.format(fmt).schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN, **options).load(path)
    is_broken, url = F.col(_BROKEN).isNotNull(), F.col(url_col)
    rows = rows.select(F.when(~is_broken, F.col(id_col)).alias("url_id"), F.coalesce(_BROKEN, url_col).alias("url"), (~is_broken & url.isNotNull() & (url != "")).alias("_good"))
    return rows.where("_good").drop("_good"), rows.where("NOT _good").drop("_good")


#: Stands before each full URL while hosts are looked for around them.
_MARK = "\x01"
#: What may be a host without a scheme, or an e-mail address, with a port, a path or a query.
BARE_IN_TEXT = "[^\\s<>\"'()\\[\\]{},;:!?/\\\\|*=#`~“”„«»\x01]+(?::[0-9]{1,5})?(?:[/?#][^\\s<>\"'\x01]*)?"
#: A host of two labels or more, the last one not a number.
_HOST = "^(?:[^-_.@%+$&^](?:[^_.@%+$&^]*[^-_.@%+$&^])?\\.)+[^-_.@%+$&^0-9][^_.@%+$&^]*$"


def extract_urls(df: DataFrame, text_col: str = "text", id_col: str = "msg_id", suffix_rules: DataFrame | None = None) -> DataFrame:
    """``msg_id, pos int, url``: one row for each URL in a text, in order; closing marks
    after it are not part of it. Ids must be unique.

    With ``suffix_rules`` (a full list, as ``load_suffix_rules`` gives it), hosts without a
    scheme are found too, with the port, path and query that follow them: two labels or
    more, which end in a listed suffix and have a label before it, and are part of neither a
    full URL nor an e-mail address. Addresses in numbers need a scheme. The suffixes are
    joined to the distinct hosts.
    """
    text = F.col(text_col)
    if suffix_rules is None:
        found = F.regexp_extract_all(text, F.lit(f"({URL_IN_TEXT})"), 1)
        rows = df.select(F.col(id_col).alias("msg_id"), F.posexplode(found).alias("pos", "url"))
        return rows.withColumn("url", F.regexp_replace("url", _CLOSING, ""))
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), URL_IN_TEXT, f" {_MARK}$0 ")
    found = F.regexp_extract_all(marked, F.lit(f"({_MARK}[^\\s<>\"']+|{BARE_IN_TEXT})"), 1)
    kept = F.filter(found, lambda u: u.startswith(_MARK) | u.contains("."))
    rows = df.select(F.col(id_col).alias("msg_id"), F.posexplode(kept).alias("at", "u")).withColumn("u", F.regexp_replace("u", _CLOSING, ""))
    full = rows.where(F.col("u").startswith(_MARK)).select("msg_id", "at", F.substr("u", F.lit(2)).alias("url"))
    bare = rows.where(~F.col("u").startswith(_MARK)).withColumn("hostname", F.lower(F.regexp_extract("u", "^[^:/?#]+", 0))).where(F.col("hostname").rlike(_HOST))
    hosts = bare.select("hostname").distinct()
    good = suffix_sizes(hosts, suffix_rules).where(F.size(F.split("hostname", r"\.")) > F.col("n_suffix")).select("hostname")
    bare = bare.join(good, "hostname").select("msg_id", "at", F.col("u").alias("url"))
    place = F.row_number().over(Window.partitionBy("msg_id").orderBy("at")) - 1
    return full.unionByName(bare).select("msg_id", place.alias("pos"), "url")


def write_verdicts(
    verdicts: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", run: str | None = None, rows_per_file: int = 1_000_000
) -> None:
    """Write verdicts as a table partitioned by risk level.

    They are clustered by level and, if they have it, registered domain, each file holding a range of at
    most ``rows_per_file`` rows, so a reader of a few domains skips most files by their statistics
    and no task writes a file for each level. ``run`` names what is written: it goes to its own
    partition ``run=...`` and replaces what an earlier try of the same run left, and nothing else.
    """
    order = ["risk_level", *(c for c in ("registered_domain", "url_id") if c in verdicts.columns)]
    clustered = verdicts.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = clustered.write.option("maxRecordsPerFile", rows_per_file).partitionBy("risk_level").format(fmt)
    if run is None:
        writer.mode(mode).save(path)
    else:
        writer.mode("overwrite").save(f"{path}/run={run}")


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """``url_id, verdict``: each verdict as one JSON text with the fields of the contract."""
    fields = [c for c in verdicts.columns if c != "url_id"]
    return verdicts.select("url_id", F.to_json(F.struct(*fields)).alias("verdict"))
