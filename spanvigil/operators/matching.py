"""Substring joins without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.session import drop_table, materialise

#: Characters of a gram; a shorter needle has none and is looked for in every text.
GRAM = 4

#: Needles of a list, on average: what one row of the index holds.
LIST_NEEDLES = 512

#: So many needles are sooner compared one by one than a text is cut into grams.
FEW_NEEDLES = 128

#: Shares of texts that have no key in common with the needles.
SHARES = 8


def _grams(text: Column) -> Column:
    """All overlapping grams, found by one pass of a zero-width match."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def _gram_lists(needles: DataFrame, on: list[str]) -> DataFrame:
    """The distinct grams of all needles in lists of bounded length, per ``on``."""
    grams = needles.select(*on, F.explode("_grams").alias("_gram")).distinct()
    sizes = grams.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / LIST_NEEDLES).alias("_lists"))
    part = F.pmod(F.xxhash64("_gram"), F.col("_lists")).alias("_list")
    return grams.join(sizes, on).groupBy(*on, part).agg(F.collect_list("_gram").alias("_asked")).drop("_list")


def gram_frequencies(texts: DataFrame, text: str, needles: DataFrame, on: list[str]) -> DataFrame:
    """``on``, ``_gram``, ``_texts``: in how many texts each gram of a needle occurs.

    A text keeps only the grams that some needle has before anything is exploded;
    counts are combined on the map side.
    """
    found = F.array_intersect(_grams(F.col(text)), F.col("_asked"))
    lists = materialise(_gram_lists(needles, on))
    rows = texts.select(*on, text).join(lists, on).select(*on, F.explode(found).alias("_gram"))
    return rows.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_texts"))


def rarest_grams(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str]) -> DataFrame:
    """Needles with ``_gram``, their gram that fewest texts have.

    ``needles`` are distinct and say by ``_many`` whether grams are worth while; the
    gram is NULL where they are not and for needles shorter than a gram, whose texts
    are not read.  A needle of which some gram is in no text is in no text either: it
    is left out.
    """
    named = needles.withColumn("_grams", F.when(F.col("_many"), F.array_distinct(_grams(F.col(needle)))))
    frequencies = gram_frequencies(texts, text, named.select(*on, "_grams"), on)
    counted = named.withColumn("_gram", F.explode_outer("_grams")).join(frequencies, [*on, "_gram"], "left")
    best = F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("_texts"), "_gram")).alias("_best")
    chosen = counted.groupBy(*needles.columns).agg(best)
    return chosen.where("_best._gram IS NULL OR _best._texts > 0").select(*needles.columns, F.col("_best._gram").alias("_gram"))


def contains_matches(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str]) -> DataFrame:
    """Pairs where ``text`` contains ``needle``, equal on the ``on`` columns.

    An index lists the needles of each ``on`` by their rarest gram, in lists of
    bounded length.  A text meets each list once: only needles whose gram is among
    the text's are compared with it, inside the row, so neither texts nor grams are
    moved.  The index is written, so Spark knows its size: it is broadcast only
    below the threshold, else both sides are shuffled by ``on`` and split by AQE.
    Empty needles and null texts match nothing.  Without ``on`` columns texts are
    dealt over a few shares, each with all needles, so that it stays an equi-join.
    """
    if not on:
        dealt = texts.withColumn("_share", F.pmod(F.xxhash64(text), F.lit(SHARES)).cast("int"))
        copied = needles.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        return contains_matches(dealt, text, copied, needle, ["_share"]).drop("_share")
    extra = [c for c in needles.columns if c not in on]
    distinct = needles.where(F.length(needle) > 0).distinct()
    sizes = distinct.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    shares = (F.col("_n") > FEW_NEEDLES).alias("_many"), F.ceil(F.col("_n") / LIST_NEEDLES).alias("_lists")
    asked = materialise(distinct.join(sizes, on).select(*needles.columns, *shares))
    chosen = rarest_grams(texts, text, asked, needle, on)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in extra]), F.col("_lists")).alias("_list")
    entries = F.collect_list(F.struct("_gram", *extra)).alias("_entries")
    index = materialise(chosen.groupBy(*on, part).agg(entries, F.collect_set("_gram").alias("_asked")).drop("_list"))
    drop_table(asked)
    # Lists of short needles alone need no grams of the text.
    present = F.when(F.size("_asked") > 0, F.array_intersect(_grams(F.col(text)), F.col("_asked")))
    probed = texts.where(F.col(text).isNotNull()).join(index, on).withColumn("_present", present)

    def holds(e: Column) -> Column:
        likely = e["_gram"].isNull() | F.coalesce(F.array_contains("_present", e["_gram"]), F.lit(False))
        return F.when(likely, F.contains(F.col(text), e[needle])).otherwise(F.lit(False))

    hits = probed.withColumn("_hit", F.explode(F.filter("_entries", holds)))
    return hits.select(*texts.columns, *[F.col(f"_hit.{c}").alias(c) for c in extra])
