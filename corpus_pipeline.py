"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``. :func:`run` writes each stage's rows as Parquet in the shared folder
and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faunaflow.llm import packing, secret_scan
from faunaflow.llm.common import table, written
from faunaflow.llm.exact_dedup import exact_dedup
from faunaflow.llm.jaccard import jaccard_components
from faunaflow.llm.quality import quality
from faunaflow.llm.queries import pattern, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids. Rows that repeat an id share its decision."""
    return docs.join(ids.select(F.col("doc_id").alias("kept_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; nothing is shuffled."""
    return quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("q_keep").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the least id; the texts are shuffled once."""
    return exact_dedup(docs, columns=tuple(COLUMNS)).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the least id."""
    return _only(docs, jaccard_components(docs).where("doc_id <=> component_id"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; every document stays, a null text as an empty one."""
    masked = docs.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit("")))
    masked = masked.withColumn("spans", secret_scan.spans_of("text")).withColumn("text", secret_scan.redacted("text", "spans"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), pattern())


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Similarity components and packing are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
