"""Audit of corpus filters in every order, by a recursive CTE over the cells of their failure masks.

A document's mask has a bit for each filter that it fails, so all that an order of filters does follows from
the number of documents in each mask: one pass over the texts, then 2^k cells for each part. The recursion
starts with the empty prefix of every part; each level appends a letter that the prefix does not hold yet, joins the
part's cells and carries the bits applied so far, and its rows are the metrics of that step. Orders share
their prefixes: k letters have about e * k! of them, not k * k!.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faunaflow.llm.common import SPACE, sha256, written

#: Letters of the filters on one text; the last letter of an audit is that of repeated texts.
TEXT_FILTERS, REPEATED = "ABCD", "E"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(words: Column, text: Column) -> dict[str, Column]:
    """Whether a text fails: too few words, few distinct ones, many capitals, signs."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", "")).cast("long")
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask: one row for each document, written once; no text is shuffled.

    Of equal texts (null is empty), those with an id above the least fail the last filter: the least id of
    each digest comes from an aggregation that is combined before its shuffle, and is found again by digest and id, a
    key that no group of copies makes hot. A null id neither fails that filter nor makes others fail.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    fails = text_failures(F.col("words"), F.col("text"))
    mask = sum((F.when(fails[x], F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(TEXT_FILTERS)), F.lit(0))
    rows = written(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(sha256(F.col("text"))).alias("digest")))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(1 << len(TEXT_FILTERS))).otherwise(F.lit(0))
    return rows.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))


def part_cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cells: the documents of each mask (mask, n, good, toxic), at most 2^k structs for a part.

    A document is good, or toxic, if any label row of its id says so; repeated label rows count once.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    each = rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _over(value: str, condition: str) -> str:
    """The sum of a count over the cells that satisfy a condition."""
    return f"aggregate(cells, 0L, (s, c) -> s + if({condition}, c.{value}, 0L))"


def prefixes(cells: DataFrame, letters: str) -> DataFrame:
    """part, prefix, step and metrics of the last filter of every prefix of every order of the letters.

    Spark bounds the rows of a recursion, by default to a million; the prefixes grow with the parts, so that bound
    is lifted for the session, where no one has set it. Levels stay bounded by the number of letters.
    """
    spark = cells.sparkSession
    if spark.conf.get("faunaflow.set.recursion", None) is None:
        spark.conf.set("faunaflow.set.recursion", "true")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    now, before = "(c.mask & bit) <> 0", "(c.mask & applied) <> 0"
    removed = f"{now} and not {before}"
    values = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(letters))
    return spark.sql(
        f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {values}),
        walk(part, prefix, applied, step, {", ".join(METRICS)}) AS (
          SELECT part, '', 0, 0, {", ".join(["0L"] * len(METRICS))} FROM {{cells}}
          UNION ALL
          SELECT part, prefix || letter, applied | bit, step + 1,
                 {_over("n", "(c.mask & (applied | bit)) = 0")}, {_over("n", removed)}, {_over("n", f"{now} and {before}")},
                 {_over("n", "c.mask = bit")}, {_over("good", removed)}, {_over("toxic", removed)}
          FROM (SELECT walk.part, prefix, applied, step, letter, bit, cells
                FROM walk JOIN letters ON (applied & bit) = 0 JOIN {{cells}} AS own ON walk.part = own.part)
        )
        SELECT part, prefix, step, {", ".join(METRICS)} FROM walk WHERE step > 0
        """,
        cells=cells,
    )


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order of the five filters and step. Words lie between ASCII white space; null text and null part are empty;
    a text without words fails the first filter alone of the four on texts. Repeated rows count each; those of one id and text do not
    make each other repeats. An empty table gives no rows; other columns are not read. shapley is the number that the step's filter
    removes, summed over all orders. Texts are taken for equal by SHA-256.
    """
    letters = TEXT_FILTERS + REPEATED
    walk = written(prefixes(written(part_cells(masked(df, id_col, text_col, part_col), labels)), letters))
    orders = walk.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(walk.drop("step"), ["part", "prefix"])
    rows = rows.withColumn("filter", F.right("prefix", F.lit(1)))
    total = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "filter"]).select("part", "filter_order", "step", *METRICS, "shapley")
