"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Quality rules drop documents, line dedup and substring dedup shorten texts (a document that loses all its words goes),
the Jaccard join keeps one document of each group, and packing turns what is left into pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.llm import jaccard, line_dedup, packing, quality_rules, substrings
from quadmill.llm.queries import tokenizer_path
from quadmill.llm.shared import Scope, keep
from quadmill.ship import ship


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as the texts now have, and the given columns."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (operator 4): documents that they reject go."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules.judge(docs, trusted).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 8): later copies of repeated runs of lines go."""
    # written once: a filter on the counts would cut the lines of every document again
    done = keep(line_dedup.dedup(docs), "lines")
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    return _recounted(done.where(left), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 10), five words and a similarity of 0.8: one document of each group stays."""
    found = jaccard.similar(docs, shingle=5, percent=80)
    others = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (operator 9): words in 13-word windows that an earlier document has go."""
    done = substrings.dedup(docs, window=13).where("n_removed > 0").select("doc_id", "kept", "words_sha256").dropDuplicates(["doc_id", "words_sha256"])
    # a text is known by its doc_id and the digest of its words
    df = docs.withColumn("words_sha256", F.sha2(F.array_join(quality_rules.words(F.col("text")), " ").cast("binary"), 256))
    df = df.join(done, ["doc_id", "words_sha256"], "left").withColumn("text", F.coalesce("kept", "text"))
    return _recounted(df.where(F.col("kept").isNull() | (F.col("kept") != "")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 1): the pieces of the documents that are left, and their places."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1, with_ids=False)


STAGES = [("quality rules", rules), ("line dedup", lines), ("near duplicates", near_duplicates), ("substring dedup", passages), ("packing", pack)]

#: SQL has no tokenizer; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, from the documents table to packed pieces."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scope(spark) as scope:
        for name, stage in STAGES[:-1]:
            last, docs = docs, scope.keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            scope.drop(last)
        # packing writes its pieces before it returns, so the last stage's documents are read
        return STAGES[-1][1](spark, docs, sf_dir)
