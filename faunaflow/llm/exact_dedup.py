"""Exact deduplication by content sort, in DataFrame functions alone.

Sampled splitters range-partition the normalised texts; the external sort of each partition places
equal texts next to each other; the window over them compares whole neighbouring texts and keeps the
smallest id. Splitters hold the first characters and a hash, never whole texts, so what the driver
samples stays small. A text that is hot in a sample is dealt out over salts, and its totals come from
an aggregation that is combined before its shuffle: no task holds all copies of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.llm.common import SPACE, documents, sample_fraction, sha256

HEAD_CHARS = 32
SALTS = 256


def _hot(norm: DataFrame, sample_rows: int, hot_share: float) -> list[int]:
    """Hashes of the texts above ``hot_share`` of a sample: at most 1 / hot_share of them.

    They decide only how rows are dealt out, never what is returned.
    """
    part = norm.sample(False, sample_fraction(norm, sample_rows), seed=7)
    counts = part.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    least = max(8.0, hot_share * sample_rows / 2)
    return [r["h"] for r in counts.where(F.col("n") >= least).collect()]


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, ...] = (),
    sample_rows: int = 20_000,
    hot_share: float = 1e-3,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and ``row`` with these columns of df, if any.

    Texts are equal when identical after each run of ASCII white space became one space; null is empty.
    Of equal texts the smallest id stays; of rows that share text and id exactly one stays. Rows with a
    null id stay only where their whole group has none. Other columns are not read. An empty table
    gives no rows.
    """
    plain = F.regexp_replace("text", SPACE, " ").alias("norm")
    norm = documents(df, id_col, text_col).select("doc_id", plain)
    hot = _hot(norm, sample_rows, hot_share)
    tie = F.xxhash64("norm")
    salt = F.when(tie.isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0).cast("long")
    keys, row = ["head", "tie", "salt"], ["row"] if columns else []
    whole = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*columns).alias("row")] if columns else []))
    dealt = whole.select("*", plain).select(
        "doc_id", "text", *row, F.substring("norm", 1, HEAD_CHARS).alias("head"), tie.alias("tie"), salt.cast("long").alias("salt")
    )
    dealt = dealt.repartitionByRange(*keys).select("doc_id", *row, *keys, plain)
    equal = Window.partitionBy(*keys, "norm")
    rows = dealt.select(
        "doc_id",
        F.row_number().over(equal.orderBy(F.col("doc_id").asc_nulls_last())).alias("place"),
        F.min("doc_id").over(equal).alias("keep_id"),
        F.count(F.lit(1)).over(equal).alias("group_size"),
        sha256(F.col("norm")).alias("text_sha256"),
        *row,
    )
    if hot:
        # whole texts are compared here too; at most 1 / hot_share rows result
        totals = norm.where(tie.isin(hot)).groupBy("norm").agg(F.min("doc_id").alias("hot_id"), F.count(F.lit(1)).alias("hot_size"))
        totals = totals.select(sha256(F.col("norm")).alias("text_sha256"), "hot_id", "hot_size", F.lit(True).alias("is_hot"))
        rows = rows.join(F.broadcast(totals), "text_sha256", "left").select(
            "doc_id",
            "place",
            F.when(F.col("is_hot"), F.col("hot_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("hot_size", "group_size").alias("group_size"),
            "text_sha256",
            *row,
        )
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *row)
