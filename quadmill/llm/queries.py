"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.llm import bpe, classifier, jaccard, language, line_dedup, neighbours, packing, quality_rules, substrings, tool_calls
from quadmill.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def crc(column: str):
    """crc32 of a column's text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc("doc_id") % 5 != 0).select("doc_id", F.col("quality").alias("label"))
    scored = classifier.score(docs, classifier.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc("doc_id") % 4 != 2))
    labelled = language.label(docs, model, spans=False)
    return labelled.select("doc_id", F.coalesce(crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: The tool of op6's calls: a user's turn asks for a reply.
REPLY = {"reply": {"required": ["prompt", "turn"], "properties": {"prompt": "string", "turn": "integer"}}}


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn calls ``reply`` (depending on the call two turns before); the next turn's assistant text is its result."""
    turns = table(spark, sf_dir, "conversations")
    called = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id",
        called(0).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(called(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", called(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return tool_calls.link(calls, results, REPLY)


OP6_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
deep AS (
  SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL
  SELECT u.conv_id, u.turn, level + 1 FROM deep d JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 2
)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, 'c' || coalesce(u.conv_id, a.conv_id) || '-' || coalesce(u.turn, a.turn) AS call_id, u.turn AS turn, level,
  CASE WHEN u.conv_id IS NULL THEN 'orphan_result'
       WHEN u.text IS NULL THEN 'invalid_arguments'
       WHEN u.turn >= 2 AND level = 0 THEN 'missing_dependency'
       WHEN a.conv_id IS NULL THEN 'missing_result' ELSE 'ok' END AS status,
  '{' || concat_ws(',',
    CASE WHEN u.conv_id IS NOT NULL THEN '"arguments":{"prompt":' || to_json(u.text) || ',"turn":' || u.turn || '}' END,
    '"id":"c' || coalesce(u.conv_id, a.conv_id) || '-' || coalesce(u.turn, a.turn) || '"',
    CASE WHEN u.conv_id IS NOT NULL THEN '"name":"reply"' END,
    '"result":' || to_json(a.text)) || '}' AS json
FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn LEFT JOIN deep d ON d.conv_id = u.conv_id AND d.turn = u.turn
"""


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.k_nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH every AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line FROM documents
), held AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, k, line, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM held
), later AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, k) AS copy FROM runs WHERE next IS NOT NULL
), gone AS (
  SELECT doc_id, k FROM later WHERE copy > 1 UNION SELECT doc_id, k + 1 FROM later WHERE copy > 1
), marked AS (
  SELECT e.doc_id, e.place, e.line, h.k, g.k AS gone
  FROM every e LEFT JOIN held h ON e.doc_id = h.doc_id AND e.place = h.place LEFT JOIN gone g ON g.doc_id = h.doc_id AND g.k = h.k
), kept AS (
  SELECT doc_id, count(k) AS n_lines, count(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (gone IS NULL), '') AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(table(spark, sf_dir, "documents"), window=13)
    kept = F.when(F.col("kept").isNull(), F.col("words_sha256")).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return done.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_language": op5_language,
    "op6_tool_calls": op6_tool_calls,
    "op7_neighbours": op7_neighbours,
    "op8_line_dedup": op8_line_dedup,
    "op9_substrings": op9_substrings,
    "op10_jaccard": op10_jaccard,
}

ORACLES: dict[str, str] = {"op6_tool_calls": OP6_SQL, "op8_line_dedup": OP8_SQL}
