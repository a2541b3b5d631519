"""Quality rules: base text rules and a hashed n-gram log-likelihood ratio.

Everything is DataFrame functions; no Python runs on the executors.  A text
never leaves its row: word windows, repeated lines and the ratio are array
functions over the row's own words, so no document is shuffled for its features
and a very long one is only a longer array.  The one corpus-wide step counts
hashed n-grams, and map-side sums bring at most ``buckets`` rows per task to the
shuffle, however frequent a word is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import BLANKS
from spanvigil.session import materialise

#: Buckets of the two multinomials; the ratio table is one row of this many doubles.
BUCKETS = 1 << 16
#: Added to each bucket before its share is taken.
SMOOTHING = 1.0
#: Mean log ratio per n-gram below which a document is unlike the trusted target.
THRESHOLD = -0.25
LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANKS), "")


def gram_pairs(values: Column) -> Column:
    """One output row per word (or hash): itself and the next, null after the last.

    A text without words gives one row of nulls.
    """
    following = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    return F.inline_outer(F.arrays_zip(values.alias("first"), following.alias("second")))


def gram_buckets(first: Column, second: Column, buckets: int) -> Column:
    """Buckets of a word and of the pair it begins, from the words' hashes."""
    one, two = (F.pmod(h, F.lit(buckets)).cast("int") for h in (first, F.xxhash64(first, second)))
    return F.array(one, F.when(second.isNotNull(), two))


def _hashed_buckets(buckets: int) -> Column:
    first, second = (F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in ("first", "second"))
    return gram_buckets(first, second, buckets)


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``buckets`` rows: the log ratio per bucket, target share over raw share.

    ``trusted`` holds the ids of the target documents (repeats and nulls count
    for nothing).  Counts cover every document.  With no target document at all
    the table is zero: there is nothing to compare with.
    """
    marks = trusted.select(F.col(key).alias("_key")).where("_key is not null").distinct().withColumn("_target", F.lit(1))
    # Merged at every size: the texts are dealt by id once, so the plan (and what it
    # writes, about the input's size) does not change where the marks outgrow a broadcast.
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(marks.hint("merge"), "_key", "left")
    words = marked.select(F.coalesce("_target", F.lit(0)).alias("_target"), words_of(F.col("_text")).alias("_words"))
    pairs = words.select("_target", gram_pairs(F.col("_words")))
    grams = pairs.select("_target", F.explode(_hashed_buckets(buckets)).alias("bucket"))
    counts = grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_target").alias("target"))
    # The whole range joins in, so that every bucket has a row; its size is fixed.
    frame = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    # The counts are small (at most ``buckets`` rows) and read twice.
    rows = materialise(
        frame.join(counts, "bucket", "left").select(
            "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
        )
    )
    totals = rows.agg(F.sum("raw"), F.sum("target")).first()
    if not totals[1]:
        return rows.select("bucket", F.lit(0.0).alias("ratio"))
    raw_total, target_total = (float(t) + SMOOTHING * buckets for t in totals)
    share = F.log((F.col("target") + SMOOTHING) / target_total)
    return rows.select("bucket", (share - F.log((F.col("raw") + SMOOTHING) / raw_total)).alias("ratio"))


def _covered(starts: Column, width: int) -> Column:
    """Words under windows of ``width`` words that begin at the sorted starts."""
    reach = F.transform(
        starts,
        lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))),
    )
    return F.aggregate(reach, F.lit(0), lambda total, r: total + r)


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _hashes."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashes = F.col("_hashes")
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )
    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter(
        F.col("_ranked"),
        lambda x, i: F.coalesce(F.get(F.col("_ranked"), i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_ranked"), i + 1)["h"] == x["h"], F.lit(False)),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    symbols = F.regexp_count(whole, F.lit(f"[{SYMBOLS}]"))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", windows)
        # Only texts that do repeat a window are sorted.
        .withColumn("_ranked", F.when(repeats, ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
        .withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _covered(F.col("_starts"), 3).cast("long"))
    )


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    key: str = "doc_id",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Judge every document: base rules, then the ratio against ``threshold``.

    One row per input row with the ``keep`` columns and FEATURES.  ``score`` is
    the mean log ratio over the text's words and word pairs; 0 for a text
    without words (which fails the base rules anyway).  A score equal to the
    threshold is kept.  Null text counts as empty, repeated rows are judged one
    by one, null ids are never trusted, an empty table gives an empty result.
    Other columns of ``docs``, whatever their names, are left out unless named in
    ``keep``.
    """
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *kept, F.col(text).alias("_text"))
    featured = base_features(rows, "_text")
    carried = [f"_keep{i}" for i in range(len(keep))] + [c for c in FEATURES if c.startswith(("n_", "word_"))]
    pairs = featured.select("_row", *carried, gram_pairs(F.col("_hashes")))
    grams = pairs.select("_row", *carried, F.explode(gram_buckets(F.col("first"), F.col("second"), buckets)).alias("bucket"))
    # A fixed number of narrow rows: its size does not depend on the data.
    ratios = F.broadcast(ratio_table(docs, trusted, buckets, text, key))
    # A row's grams are neighbours in its task, so map-side sums leave one row per document.
    summed = grams.join(ratios, "bucket", "left").groupBy("_row").agg(
        *[F.first(c).alias(c) for c in carried], F.sum("ratio").alias("_total")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    judged = (
        summed.withColumn("base_failed", failed)
        .withColumn("score", F.coalesce(F.col("_total") / (2 * F.col("n_words") - 1), F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
    return judged.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *FEATURES)
