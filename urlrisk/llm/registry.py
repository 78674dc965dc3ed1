"""The queries ``opN_<name>`` over the tables of a folder, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_dir
from .centroids import cluster
from .chat import format_chats
from .decontaminate import find_contaminated
from .embedding_copies import near_vectors
from .hard_negatives import mine
from .html_text import extract_text
from .language import predict_language
from .neighbours import nearest
from .packing import pack
from .pii import find_pii, summarize
from .quality import score_quality
from .simhash import near_duplicates
from .token_files import read_token_files, write_token_files


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=2)
    return read_token_files(spark, folder, digest=True)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(find_pii(_table(spark, sf_dir, "documents")))


#: How a speaker is marked in the transcripts of op7, by a hash of the conversation; one
#: turn in eight carries no mark.
_SPOKEN = """
CASE WHEN role IS NULL OR pmod(xxhash64(conv_id, turn), 8) = 0 THEN text
     WHEN pmod(xxhash64(conv_id), 3) = 0 THEN concat(initcap(role), ': ', text)
     WHEN pmod(xxhash64(conv_id), 3) = 1 THEN concat('### ', CASE role WHEN 'user' THEN 'Human' ELSE initcap(role) END, ': ', text)
     ELSE concat('[', upper(role), '] ', text) END
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SPOKEN).alias("text"))
    return format_chats(spoken)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(_table(spark, sf_dir, "embeddings").select("vec_id", other.alias("label"), "embedding"), "id % 100 = 0")


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_simhash": op2_simhash,
        "op3_html_text": op3_html_text,
        "op4_token_files": op4_token_files,
        "op5_neighbours": op5_neighbours,
        "op6_pii": op6_pii,
        "op7_chat": op7_chat,
        "op8_decontamination": op8_decontamination,
        "op9_quality": op9_quality,
        "op10_language": op10_language,
        "op11_centroids": op11_centroids,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_near_vectors": op13_near_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {}
