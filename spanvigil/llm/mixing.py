"""Mixing sources to target weights by entropy balancing.

Rates stay as close as possible (in relative entropy, each word one unit) to
taking everything once, under the constraint that each source yields its target
of words.  The convex dual has one multiplier per source; a document's rate is the
exponential of its source's multiplier.  Newton steps run on Spark columns, a row
per source, and rates are then rounded into whole copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanvigil.session import materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document, and so the most a source can give.
MOST = 3
#: Documents rounded together; a larger source is dealt over more groups.
GROUP_ROWS = 2_000
TOLERANCE = 1e-9
MOST_STEPS = 200


def word_count(text: str) -> Column:
    """Number of words as a column; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to a table with a row per ``source``: ``source, source_size``.

    The sources share all words by weight; what exceeds MOST times a source's own
    size is shared again among the others.  That ends at one water level: with
    sources in ascending order of capacity per weight, the full ones come first,
    and the rest share what these leave.  Ties are full together.
    """
    # One row per source, after aggregation, is all these windows see.
    ordered = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(WEIGHTS))))
    whole = Window.partitionBy()
    before = Window.orderBy("_level", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("_most", F.lit(float(MOST)) * F.col("source_size"))
        .withColumn("_level", F.col("_most") / F.col("weight"))
        .withColumn("_words", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_weights", F.sum("weight").over(whole))
        .withColumn("_full", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_share", (F.col("_words") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
    )
    # The level is that of the first source its share does not fill.
    level = F.min(F.when(F.col("_share") <= F.col("_level"), F.struct("_level", "_share"))).over(whole)["_share"]
    return ranked.withColumn("target", F.least("_most", level * F.col("weight"))).select(
        "source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target")
    )


def balance(sources: DataFrame) -> DataFrame:
    """Adds ``rate``: the exponential of the dual solution, by Newton steps.

    The dual is ``sum(size * exp(x) - target * x)``; its Hessian is diagonal, so a
    step is a column expression.  Steps run until no source's gradient exceeds
    TOLERANCE of its target.  A source without target or words has rate 0.
    """
    active = (F.col("target") > 0) & (F.col("source_size") > 0)
    state = materialise(sources.withColumn("_x", F.lit(0.0)))
    for _ in range(MOST_STEPS):
        taken = F.col("source_size") * F.exp("_x")
        gap = state.where(active).agg(F.max(F.abs(taken - F.col("target")) / F.col("target"))).first()[0]
        if gap is None or gap <= TOLERANCE:
            break
        x = F.col("_x")
        for _ in range(4):  # a few steps at a time; each is only arithmetic
            x = x + F.greatest(F.col("target") / (F.col("source_size") * F.exp(x)) - 1, F.lit(-1.0)).cast("double")
        state = materialise(state.withColumn("_x", F.when(active, x).otherwise(F.lit(0.0))))
    return state.withColumn("rate", F.when(active, F.least(F.exp("_x"), F.lit(float(MOST)))).otherwise(F.lit(0.0))).drop("_x")


def round_copies(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one group of one source, largest documents first.

    Each document takes the copies that bring the running total nearest to the
    running target, so the error left is that of the smallest documents.  Equal
    sizes are taken in id order; null ids come last.
    """
    frame = frame.sort_values(["size", "_id", "_row"], ascending=[False, True, True], na_position="last")
    sizes, rate = frame["size"].to_numpy(np.int64), float(frame["rate"].iloc[0])
    copies, owed = np.zeros(len(sizes), np.int64), 0.0
    for n, size in enumerate(sizes):
        owed += rate * size
        if size:
            copies[n] = min(max(round(owed / size), 0), MOST)
            owed -= copies[n] * size
    return frame.assign(copies=copies)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, size, source_size, target, taken, copies`` and ``keep`` for every row.

    ``size`` counts the words; ``taken`` is ``copies * size``, at most three times
    the size.  A null source is one source, the last in order.  Null and empty texts
    have size 0 and take 0; a source without words has target 0.  Repeated rows are
    documents of their own.  An empty table gives an empty result; columns not
    named are not read.
    """
    kept = [F.col(c).alias(f"_keep{n}") for n, c in enumerate(keep)]
    rows = docs.select(
        F.col(key).cast("long").alias("_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), *kept
    )
    narrow = materialise(rows)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    rates = materialise(balance(source_targets(sizes.select("source", "source_size"))))
    groups = sizes.select("source", F.ceil(F.col("_docs") / GROUP_ROWS).alias("_groups")).join(
        rates.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))
    )
    joined = narrow.join(
        groups.select(F.col("source").alias("_source"), "source_size", "target", "rate", "_groups"),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    # A hot source is dealt over groups of bounded rows by id; equal ids differ by size only.
    dealt = joined.withColumn("_row", F.lit(0)).withColumn("_group", F.pmod(F.xxhash64("_id", "size"), F.col("_groups")))
    schema = StructType([*dealt.schema.fields, StructField("copies", LongType())])
    done = dealt.groupBy("source", "_group").applyInPandas(round_copies, schema)
    return done.select(
        F.col("_id").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        *[F.col(f"_keep{n}").alias(c) for n, c in enumerate(keep)],
    )
