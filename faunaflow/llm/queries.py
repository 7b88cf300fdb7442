"""The queries op1 to op13 over the given tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faunaflow.llm import bpe, chat_format, packing, secret_scan
from faunaflow.llm.common import sha256, table
from faunaflow.llm.divergence import source_divergence
from faunaflow.llm.exact_dedup import exact_dedup
from faunaflow.llm.filter_audit import filter_audit
from faunaflow.llm.fingerprints import edited_fingerprints
from faunaflow.llm.jaccard import jaccard_components
from faunaflow.llm.quality import quality
from faunaflow.llm.simhash import simhash_components
from faunaflow.llm.substrings import remove_repeats
from faunaflow.llm.toxicity import toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


#: Conversation -7: texts that hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    examples = chat_format.chat_examples(given.unionByName(extra))
    read = examples.select(
        "conv_id",
        "example",
        "formatted",
        chat_format.read_loss("formatted", "loss_start", "loss_end").alias("loss"),
    )
    each = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    close = F.lit(chat_format.CLOSE)
    return each.select(
        "conv_id",
        F.expr(f"(length(formatted) - length(replace(formatted, '</turn>', ''))) div {len(chat_format.CLOSE) - 1}").cast("long").alias("n_turns"),
        sha256(chat_format.read_turns("formatted")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256(F.col("loss")).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS n, role = 'assistant' OR row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends,
         4 + 5 + 8 + length(role || text) + length(regexp_replace(role || text, '[^\\#<]', '', 'g')) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), runs AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS through FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(through) FILTER (ends))::BIGINT AS formatted_chars
FROM runs GROUP BY conv_id
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id",
        F.col("q_held_out").alias("held_out"),
        F.col("q_evidence").alias("evidence"),
        F.col("q_host_rate").alias("host_rate"),
        F.col("q_path_rate").alias("path_rate"),
        F.col("q_score").alias("score"),
        F.col("q_keep").alias("keep"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pattern())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())
    return rows.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), each AS (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(*) >= 10),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM groups) g),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) JOIN langs USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
             FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(texts.doc_id) OVER (PARTITION BY t) < texts.doc_id, false)::INT AS mask
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM cells),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk AS (
  SELECT '' AS prefix, 0 AS applied, 0 AS step, 0 AS before, 0 AS bit
  UNION ALL
  SELECT prefix || letter, applied | l.bit, step + 1, applied, l.bit FROM walk JOIN letters l ON (applied & l.bit) = 0
), steps AS (
  SELECT part, prefix, step, coalesce(sum(n) FILTER ((mask & applied) = 0), 0) AS kept,
         coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0) AS removed,
         coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & before) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & before) = 0), 0) AS toxic_lost
  FROM walk, cells WHERE step > 0 GROUP BY ALL
)
SELECT part, o.prefix AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, right(steps.prefix, 1)))::BIGINT AS shapley
FROM (SELECT prefix FROM walk WHERE step = 5) o JOIN steps ON steps.prefix = o.prefix[1:step]
"""


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_fingerprints": op2_fingerprints,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_packing": op6_packing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_secret_scan": op9_secret_scan,
        "op10_bpe": op10_bpe,
        "op11_simhash": op11_simhash,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op8_chat_format": OP8_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_audit": OP13_SQL}
