"""Line dedup: repeated runs of lines, found by a suffix array over line ids; later copies are deleted.

A document is the sequence of its lines that hold a word.  Suffixes (document, line) are ordered by distributed prefix
doubling: the ranks of runs of 2^j lines come from sorting the distinct pairs of ranks of their halves, and a suffix
whose run occurs once leaves the sort.  When runs are ``least_lines`` long, the suffixes of one rank are one interval of
the suffix array whose common prefix is at least that long.  Its first suffix, by document and line, is the original.
Suffixes that follow each other as their originals do make the maximal repeated runs (``repeated_runs``), and every line
of the later copies goes.

All DataFrame functions; the rounds are log2(least_lines) at most.  Only lines that occur twice
or more are sorted.  A rank's rows are never gathered: ranks come from aggregates, joined back by joins that Spark
may split where one line is very frequent.

Odd cases: a null or empty text has no lines and stays; a null doc_id takes no part; lines without a word stay, and are
not part of runs; rows that repeat a doc_id with the same text are one place in the order, so they do not delete each
other and get the same result; other texts of that doc_id come one after the other, by a hash, so a run stays in
the first of them; an empty table gives no rows.  Other columns, whatever their names, are passed through, but for n_lines and n_removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadmill.llm.shared import Scope

LEAST_LINES = 2
#: A suffix, and its order: rows may repeat a doc_id with another text.
PLACE = ["doc_id", "text_id", "k"]


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text, as rows may repeat a doc_id with another), k (place among the lines with a word), place (among all lines), line (its 64-bit id)."""
    every = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("place"), x.alias("line")))
    held = F.filter(every, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(held).alias("k", "x"))
    return rows.select("doc_id", "text_id", "k", F.col("x.place").alias("place"), F.xxhash64("x.line").alias("line"))


def ranked(rows: DataFrame, key: list[str], scope: Scope, tag: str) -> DataFrame:
    """The rows whose key occurs twice or more at different places, their key replaced by its rank in sorted order."""
    groups = rows.groupBy(*key).agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
    groups = groups.where(F.col("first") != F.col("last")).orderBy(*key)
    # ids that grow with the partition and within it: an order-preserving rank of distinct sorted keys; fixed by being written
    ranks = scope.keep(groups.select(*key, "first", F.monotonically_increasing_id().alias("rank")), f"{tag}-ranks")
    out = scope.keep(rows.join(ranks, key).drop(*key), tag)
    scope.drop(ranks)
    return out


def intervals(docs: DataFrame, least_lines: int, scope: Scope) -> DataFrame:
    """The suffixes whose first ``least_lines`` lines occur at two places: doc_id, text_id, k, rank (the interval of the
    suffix array, whose common prefix is at least that long) and first (its first suffix).

    The doubling ends when runs are ``least_lines`` long, or none is left that occurs twice."""
    suffixes = ranked(numbered_lines(docs), ["line"], scope, "lines")
    length = 1
    while length < least_lines and not suffixes.isEmpty():
        shift = min(length, least_lines - length)
        ahead = suffixes.select("doc_id", "text_id", (F.col("k") - shift).alias("k"), F.col("rank").alias("ahead")).distinct()
        pairs = suffixes.drop("first").join(ahead, PLACE)
        last, suffixes = suffixes, ranked(pairs.withColumnRenamed("rank", "own"), ["own", "ahead"], scope, f"runs{length + shift}")
        scope.drop(last)
        length += shift
    return suffixes


def repeated_runs(docs: DataFrame, least_lines: int, scope: Scope) -> DataFrame:
    """The maximal repeated runs: doc_id, text_id, k, length (in lines with a word), and the first copy's first_doc_id, first_text_id and first_k.

    Suffixes that follow each other and whose intervals' first suffixes do too are one run; as no longer run continues
    it on either side in step with its first copy, it is maximal."""
    later = intervals(docs, least_lines, scope).where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "first").distinct()
    later = later.select(*PLACE, *[F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE])
    # along a diagonal, neighbours have one difference of k and place in the order of k
    diagonal = ["doc_id", "text_id", "first_doc_id", "first_text_id", F.col("k") - F.col("first_k")]
    nth = F.col("k") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("k"))
    runs = later.withColumn("_run", nth).groupBy("doc_id", "text_id", "first_doc_id", "first_text_id", (F.col("k") - F.col("first_k")).alias("_diagonal"), "_run")
    runs = runs.agg(F.min("k").alias("k"), F.min("first_k").alias("first_k"), (F.count(F.lit(1)) + (least_lines - 1)).alias("length"))
    return runs.select(*PLACE, "length", "first_doc_id", "first_text_id", "first_k")


def deleted_lines(runs: DataFrame) -> DataFrame:
    """doc_id, text_id and the sorted places (among the lines with a word) of the lines in repeated runs."""
    gone = runs.select("doc_id", "text_id", F.explode(F.sequence(F.col("k"), (F.col("k") + F.col("length") - 1).cast("int"))).alias("k"))
    return gone.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("k")).alias("gone"))


def dedup(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """docs with text less its deleted lines, n_lines (lines with a word) and n_removed."""
    with Scope(docs.sparkSession) as scope:
        gone = scope.leave(scope.keep(deleted_lines(repeated_runs(docs, least_lines, scope)), "gone"))
    df = docs.drop("n_lines", "n_removed")
    own = list(df.columns)
    # names that no column of the caller has
    mark = "_"
    while any(c.startswith(mark) for c in own):
        mark += "_"
    text_id, places, all_lines, held = (mark + c for c in ("text_id", "gone", "lines", "held"))
    gone = gone.select(F.col("doc_id").alias(mark + "id"), F.col("text_id").alias(mark + "of"), F.col("gone").alias(places))
    df = df.withColumn(text_id, F.xxhash64("text"))
    # places grow with the corpus: the same join for any size, so what a small input shuffles tells of a large one
    df = df.join(gone.hint("merge"), (F.col("doc_id") == F.col(mark + "id")) & (F.col(text_id) == F.col(mark + "of")), "left")
    df = df.withColumn(all_lines, F.split("text", "\n")).withColumn(held, F.transform(all_lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    with_words = F.filter(F.sequence(F.lit(0), F.size(all_lines) - 1), lambda i: F.get(held, i))
    df = df.withColumn(held, F.when(F.col("text").isNotNull(), with_words))
    df = df.withColumn(mark + "n", F.coalesce(F.size(held), F.lit(0)).cast("long")).withColumn(mark + "r", F.coalesce(F.size(places), F.lit(0)).cast("long"))
    # the places among all lines; with none of them the text is as it was
    df = df.withColumn(held, F.when(F.col(places).isNotNull(), F.transform(places, lambda k: F.get(held, k))))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(held))
    rest = F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")
    text = F.when(F.col(places).isNotNull(), rest).otherwise(F.col("text")).alias("text")
    return df.select(*[text if c == "text" else c for c in own], F.col(mark + "n").alias("n_lines"), F.col(mark + "r").alias("n_removed"))
