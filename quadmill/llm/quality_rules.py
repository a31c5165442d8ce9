"""Quality rules: counts of words, symbols and repetition, and a hashed n-gram log-likelihood ratio.

All DataFrame functions.  A document's score is the mean, over its hashed word n-grams, of
log P(n-gram | trusted documents) - log P(n-gram | all documents), both multinomials over buckets whose number grows
with the n-grams of the corpus, smoothed alike and counted over the whole corpus.  A document whose score is under a fixed threshold, or that
fails the counts, is not kept; there is no sampling and no chance in it.

Up to DENSE buckets, the ratios are dense arrays, one row for each PART buckets, which are broadcast: a look-up is a place in an array,
and no n-gram is shuffled for it.  Beyond, n-grams and ratios are rows that are joined; results are the same.

Odd cases: a null or empty text has no words, fails the counts and is not kept; a null doc_id is kept as null and is
never trusted; without trusted documents (no labels, or none that match) every ratio is zero, and only the counts
decide; repeated rows are each judged; an empty table gives no rows.  Columns beyond those named are passed through
by ``judge``, but columns named like its output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadmill.llm.shared import Scope

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Words of a repeated window, a power of two.
WINDOW = 8
#: The fewest buckets, and the most n-grams of the corpus for each bucket: with more n-grams there are more buckets.
BUCKETS, LOAD = 1 << 18, 32
#: The most buckets whose ratios are broadcast as dense arrays (4 bytes a bucket, 128 MB), and how many an array holds.
DENSE, PART = 1 << 25, 1 << 10
#: Dense counts are made of one of so many shares of the documents at a time: what is shuffled for one is gone before the next.
PASSES = 3
#: The most trusted ids that are broadcast; more of them are joined by a shuffle.
TRUSTED = 1 << 20
#: The most buckets whose ratios are broadcast as rows; others are shuffled with the n-grams.
BROADCAST = 1 << 18
#: Mean log ratio under which a document is rejected.
LEAST_SCORE = -0.12
#: Counts added to each bucket, in trusted documents' counts.
PSEUDO = 10.0
#: Ratios are whole multiples of 1 / SCALE, so that sums do not depend on the order of addition.
SCALE = 1 << 20


def words(text: Column) -> Column:
    """The words of a text; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def n_grams(text: Column) -> Column:
    """How many n-grams (words and pairs, the last word's with the end) a text has."""
    return 2 * F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def least_buckets(n: int) -> int:
    """The least power of two that is at least BUCKETS and leaves at most LOAD of n n-grams a bucket (2^30 at most, as buckets are ints)."""
    return min(max(BUCKETS, 1 << max(-(-n // LOAD) - 1, 0).bit_length()), 1 << 30)


def buckets_for(docs: DataFrame) -> int:
    """``least_buckets`` for the n-grams of docs."""
    return least_buckets(docs.agg(F.sum(n_grams(F.col("text")))).first()[0] or 0)


def buckets_of(docs: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The keys and the buckets of each word (one) and of its pair with the next word (two; the last word's pair is with the end).

    ``buckets`` is a power of two.  Words are exploded before they are hashed, so all of it is generated code."""
    w = words(F.col("text"))
    rows = docs.select(*keys, w.alias("a")).withColumn("b", F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))))
    rows = rows.select(*keys, F.explode(F.arrays_zip("a", "b")).alias("x"))
    one = F.xxhash64("x.a").bitwiseAND(F.lit(buckets - 1)).cast("int")
    two = F.xxhash64("x.a", F.coalesce("x.b", F.lit(""))).bitwiseAND(F.lit(buckets - 1)).cast("int")
    return rows.select(*keys, one.alias("one"), two.alias("two"))


def grams(docs: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The keys and the bucket of each word and each pair of words."""
    return buckets_of(docs, keys, buckets).select(*keys, F.explode(F.array("one", "two")).alias("bucket"))


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts of docs, and 1 for those of trusted documents, 0 for the others."""
    good = trusted.select("doc_id").dropna().distinct().withColumn("trusted", F.lit(1))
    # the trusted ids grow with the corpus: beyond a size that is checked, texts are shuffled to meet them
    good = F.broadcast(good) if good.limit(TRUSTED + 1).count() <= TRUSTED else good.hint("merge")
    return docs.select("doc_id", "text").join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(0)).cast("long"))


def totals(rows: DataFrame) -> tuple[int, int]:
    """The n-grams of trusted documents and of all, given the rows of ``marked``."""
    n = n_grams(F.col("text"))
    found = rows.agg(F.sum(n * F.col("trusted")).alias("good"), F.sum(n).alias("raw")).first()
    return found["good"] or 0, found["raw"] or 0


def ratio_for(total: tuple[int, int]) -> Callable[[Column, Column], Column]:
    """The ratio of a bucket, given its trusted and all n-grams, in units of 1 / SCALE, for these ``totals``."""
    if not total[0]:
        return lambda good, raw: F.lit(0).cast("long")
    # both multinomials get PSEUDO trusted counts in each bucket: what was seen a few times says little either way
    share = total[0] / total[1]
    return lambda good, raw: F.round(F.log((good + PSEUDO) / (raw * share + PSEUDO)) * SCALE).cast("long")


def ratios(docs: DataFrame, trusted: DataFrame, scope: Scope, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio, raw) for every bucket that an n-gram falls in, raw being how many do."""
    rows = marked(docs, trusted)
    counts = grams(rows, ["trusted"], buckets).groupBy("bucket").agg(F.sum("trusted").alias("good"), F.count(F.lit(1)).alias("raw"))
    return scope.keep(counts.select("bucket", ratio_for(totals(rows))(F.col("good"), F.col("raw")).alias("ratio"), "raw"), "ratios")


def dense_parts(rows: DataFrame, total: tuple[int, int], scope: Scope, buckets: int) -> DataFrame:
    """(part, ratios): the ratios of buckets part * PART, part * PART + 1 and so on, up to the last one that an n-gram falls in,
    given the rows of ``marked`` and their ``totals``.

    Each share of the documents is counted into arrays of its own, whose sums over the shares are the counts of the corpus."""
    part, ratio, path = F.shiftright("bucket", PART.bit_length() - 1), ratio_for(total), None
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PASSES))
    before = lambda i: F.coalesce(F.get("found", i - 1)["slot"], F.lit(-1))
    filled = F.transform("found", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), x["slot"] - before(i) - 1), F.array(x["n"])))
    for i in range(PASSES):
        own = grams(rows.where(share == i), ["trusted"], buckets)
        # DENSE buckets hold at most LOAD * DENSE = 2^30 n-grams, so one sum holds both counts
        own = own.groupBy("bucket").agg(F.sum(F.lit(1) + F.shiftleft("trusted", 32)).alias("n"))
        own = own.select(part.alias("part"), F.struct((F.col("bucket") % PART).alias("slot"), "n").alias("at"))
        own = own.repartition("part").groupBy("part").agg(F.sort_array(F.collect_list("at")).alias("found"))
        path = scope.append(own.select("part", F.flatten(filled).alias("n")), path)
        scope.collect()
    none = F.array().cast("array<bigint>")
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    total = F.aggregate(F.collect_list("n"), none, lambda s, x: F.zip_with(s, x, add))
    both = scope.table(path).groupBy("part").agg(total.alias("n"))
    ratios = F.transform("n", lambda n: ratio(F.shiftright(n, 32), n.bitwiseAND((1 << 32) - 1)).cast("int"))
    return scope.keep(both.select("part", ratios.alias("ratios")), "ratios")


def dense_scores(docs: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """As ``scores``, by look-ups in the dense ratios."""
    rows = buckets_of(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "text_hash"], buckets)
    shift = PART.bit_length() - 1
    for c in ("one", "two"):
        own = parts.select(F.col("part").alias(f"{c}_part"), F.col("ratios").alias(f"{c}_ratios"))
        rows = rows.join(F.broadcast(own), F.shiftright(c, shift) == F.col(f"{c}_part"))
    ratio = sum(F.get(f"{c}_ratios", F.col(c).bitwiseAND(PART - 1)).cast("long") for c in ("one", "two"))
    each = rows.groupBy("doc_id", "text_hash").agg(F.sum(ratio).alias("ratio"), F.count(F.lit(1)).alias("n"))
    return each.select("doc_id", "text_hash", (F.col("ratio") / (2 * F.col("n") * float(SCALE))).alias("score"))


def scores(docs: DataFrame, table: DataFrame, buckets: int = BUCKETS, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, text_hash, score): the mean ratio of each text's n-grams; texts without words are left out."""
    rows = grams(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "text_hash"], buckets)
    found = [F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("n")]
    if buckets <= broadcast:
        each = rows.join(F.broadcast(table.select("bucket", "ratio")), "bucket").groupBy("doc_id", "text_hash").agg(*found)
    else:
        # at most ``broadcast`` buckets hold so many n-grams; of the others none is frequent enough to skew a join
        total = table.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
        frequent = F.col("raw") * broadcast >= total
        few = F.broadcast(table.where(frequent).select("bucket", "ratio"))
        rest = rows.join(few, "bucket", "left_anti").join(table.where(~frequent).select("bucket", "ratio").hint("merge"), "bucket")
        parts = [x.groupBy("doc_id", "text_hash").agg(*found) for x in (rows.join(few, "bucket"), rest)]
        each = parts[0].unionByName(parts[1]).groupBy("doc_id", "text_hash").agg(F.sum("ratio").alias("ratio"), F.sum("n").alias("n"))
    return each.select("doc_id", "text_hash", (F.col("ratio") / (F.col("n") * float(SCALE))).alias("score"))


def windows(half: Column, reach: int) -> Column:
    """Hashes of all runs of 2 * reach words, given those of all runs of reach words."""
    n = F.greatest(F.size(half) - reach, F.lit(0))
    return F.zip_with(F.slice(half, 1, n), F.slice(half, reach + 1, n), lambda a, b: F.xxhash64(a, b))


def counts(docs: DataFrame) -> DataFrame:
    """docs with w (words), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # hashes of windows of 2, then 4, then 8 words are of the two halves' hashes; those that reach past the end are cut
    df, reach = df.withColumn("_q", F.col("w")), 1
    while 2 * reach < WINDOW:
        df, reach = df.withColumn("_q", windows(F.col("_q"), reach)), 2 * reach
    # a window that comes again has reach + 1 half windows that do: few texts have so many, and only theirs are hashed further and sorted
    again = F.size("_q") - F.size(F.array_distinct("_q")) > reach
    df = df.withColumn("_h", F.when(again, windows(F.col("_q"), reach)))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_p", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    again = F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_lines", "_q", "_h", "_p")


def judge(docs: DataFrame, trusted: DataFrame, least_score: float = LEAST_SCORE, buckets: int | None = None, dense: int = DENSE) -> DataFrame:
    """docs with the counts, base_failed, score (the mean log ratio; 0 without words) and kept.  Without ``buckets``, ``least_buckets`` says how many."""
    rows = marked(docs, trusted)
    total = totals(rows)
    buckets = buckets or least_buckets(total[1])
    with Scope(docs.sparkSession) as scope:
        if buckets <= dense:
            each = dense_scores(docs, dense_parts(rows, total, scope, buckets), buckets)
        else:
            each = scores(docs, ratios(docs, trusted, scope, buckets), buckets)
        found = scope.leave(scope.keep(each.withColumnRenamed("doc_id", "_id"), "scores"))
    df = counts(docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "w", "text_hash")).drop("w")
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    df = df.withColumn("text_hash", F.xxhash64("text"))
    df = df.join(found, df["doc_id"].eqNullSafe(found["_id"]) & (df["text_hash"] == found["text_hash"]), "left").drop(found["text_hash"]).drop("text_hash", "_id")
    df = df.withColumn("score", F.coalesce("score", F.lit(0.0)))
    # one condition on both sides of the join: a filter on it is not pushed into the counts, where it would repeat them
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("score") >= least_score))
