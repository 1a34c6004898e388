"""Quality rules with a hashed n-gram likelihood ratio (operator 2).

Base rules count words, symbols, repeated lines and repeated three-word
windows.  What passes them is judged by how its words compare with a trusted
target: every word's last three characters are an n-gram, hashed to one of
BUCKETS; target (documents labelled good) and raw corpus are multinomials over
the buckets, and a text's score is the mean of
``log p_target - log p_raw`` over its n-grams.  A text stays when its score is
at least THRESHOLD; nothing is drawn at random.

DataFrame functions only.  The texts are read once; their measures and buckets
are written to the shared folder, and both count and score read those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.llm.common import stored, table

BUCKETS = 1 << 13
SUFFIX = 3
SMOOTHING = 0.5
THRESHOLD = -0.15
#: Trusted ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
_SYMBOLS = "#*$%&|<>"
_SEPARATORS = " \t\n\x0b\x0c\r"
_RUN = r"[ \t\n\x0B\f\r]+"


def words_of(text: Column) -> Column:
    """Words between space and U+0009..U+000D; none for null."""
    bare = F.btrim(text, F.lit(_SEPARATORS))
    return F.when(text.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, _RUN))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SEPARATORS)) != "")
    return F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long")


def measured(docs: DataFrame, suffix: int = SUFFIX, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base measures and each word's n-gram bucket of every row."""
    text = F.col("text")
    bare = F.translate(text, _SEPARATORS, "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"))
    rows = rows.select(
        "doc_id",
        words_of(text).alias("w"),
        F.coalesce(F.char_length(bare), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
    )
    n = F.size("w")
    # Hash of each word; three neighbours make a window.
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    places = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    window = F.transform(
        places, lambda i: F.xxhash64(F.element_at("h", i), F.element_at("h", i + 1), F.element_at("h", i + 2))
    )
    grams = F.transform("w", lambda x: F.pmod(F.xxhash64(F.right(x, F.lit(suffix))), F.lit(buckets)).cast("short"))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", grams.alias("grams"), window.alias("window")
    )
    # Windows in hash order, equal ones side by side.
    order = F.array_sort(F.transform("window", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    several = F.size("window") > F.size(F.array_distinct("window"))
    rows = rows.withColumn("s", F.when(several, order)).drop("window")
    at = F.transform(
        "s",
        lambda x, j: F.when(
            (F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]),
            x["i"],
        ),
    )
    rows = rows.withColumn("at", F.array_sort(F.filter(at, lambda i: i.isNotNull()))).drop("s")
    # A window covers three words, fewer where the next repeated one begins.
    reach = F.transform("at", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - i, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"), "grams"
    )


def ratios(measures: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with `weights`: log p_target - log p_raw of every bucket, by position.

    `trusted`: doc_id of the target's documents.  A bucket's raw probability is
    smoothed by a flat count, its target probability by the raw one, so that a
    small target differs from the corpus only where it has evidence.
    Counting is partial within each task.
    """

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    ids = trusted.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:  # beyond that, buckets are shuffled to the ids
        ids = F.broadcast(ids)
    target = measures.select("doc_id", "grams").join(ids, "doc_id", "left_semi")
    found = measures.sparkSession.range(buckets).select(F.col("id").cast("short").alias("bucket"))
    found = found.join(counts(measures, "raw"), "bucket", "left").join(counts(target, "target"), "bucket", "left").na.fill(0)
    found = found.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t")
    )
    mass = smoothing * buckets

    def weight(c):
        raw = (c["raw"] + smoothing) / (F.col("r") + mass)
        return F.log((c["target"] + mass * raw) / (F.col("t") + mass)) - F.log(raw)

    return found.select(F.transform("c", weight).alias("weights"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, measures, base_failed, score, kept for every row of `docs`.

    A null or empty text has no words and fails the base rules; its score is
    null.  Repeated rows are judged alike; other columns are ignored.  With an
    empty target all scores are 0.
    """
    measures = stored(measured(docs), "quality-measures")
    weights = stored(ratios(measures, trusted), "quality-weights").first()["weights"]  # BUCKETS numbers
    found = F.lit(weights) if weights else F.lit([0.0])
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.element_at(found, g.cast("int") + 1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = measures.withColumns({"score": F.when(F.col("n_words") > 0, total / F.col("n_words")), "base_failed": failed})
    return scored.drop("grams").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def op2_ngram_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    return judge(table(spark, sf_dir, "documents"), trusted)
