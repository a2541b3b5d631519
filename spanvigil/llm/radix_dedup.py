"""Exact copies by distributed most-significant-digit radix partitioning.

Texts are split by successive bytes.  A digit is a run of bytes, twice as long at
each level as at the level above, so that the number of levels grows with the
logarithm of the longest text.  Rows that agree in all digits so far form a group;
a group is done once it has one row or its texts have ended.  Texts are equal only
because all their bytes were compared: no digest decides anything.

Most rows are alone after the first digit and leave.  The others write their
remaining bytes once, one row per digit, in a folder per level; each level reads
its own folder and moves only those digits.  Group sizes are sums combined on the
map side and the way back is a join whose large side Spark splits where it is
skewed, so a group that holds a third of all rows is never in one place.  Joins merge
at every size: the plan of a small table is that of a large one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import utf8
from spanvigil.session import drop_table, materialise

#: Bytes of the first digit; digits double until they are 2**DOUBLINGS times as long.
FIRST, DOUBLINGS = 64, 16


def _start(level: Column) -> Column:
    """Bytes before the digit of a level."""
    doubled = F.pow(F.lit(2), F.least(level, F.lit(DOUBLINGS))).cast("long") * FIRST - FIRST
    return doubled + F.greatest(level - DOUBLINGS, F.lit(0)).cast("long") * (FIRST << DOUBLINGS)


def _levels(length: Column) -> Column:
    """Levels that a text of so many bytes takes beyond the first digit, one at least."""
    doubled = F.ceil(F.log2(F.greatest(length, F.lit(FIRST)) / FIRST + 1)) - 1
    long = F.ceil((length - FIRST * ((1 << DOUBLINGS) - 1)) / (FIRST << DOUBLINGS)) + DOUBLINGS - 1
    return F.greatest(F.lit(1), F.when(length <= FIRST * ((1 << DOUBLINGS) - 1), doubled).otherwise(long)).cast("int")


def _digits(rest: Column) -> Column:
    """Level, bytes and whether the text ends there, for a text without its first digit.

    A text that ended with the first digit has one empty digit.
    """

    def one(level: Column) -> Column:
        at, following = (_start(level) - FIRST).cast("int"), (_start(level + 1) - FIRST).cast("int")
        ended = F.octet_length(rest) <= following
        return F.struct(level.alias("level"), rest.substr(at + 1, following - at).alias("digit"), ended.alias("ended"))

    return F.explode(F.transform(F.sequence(F.lit(1), _levels(F.octet_length(rest) + FIRST)), one))


def dedup(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its group of equal texts and the row of it that stays.

    ``doc_id, keep_id, group_size, kept, text_sha256``, then the columns of ``keep``.
    A null text is an empty one; empty texts are equal.  The row with the largest
    doc_id stays, a null doc_id being the smallest; of rows that are equal in text
    and id one stays, whichever was written last.  An empty table gives no rows.
    ``text_sha256`` is of the text and takes no part in the comparison.
    """
    raw = utf8("text")
    rows = docs.select(
        "doc_id",
        F.sha2(raw, 256).alias("text_sha256"),
        raw.substr(F.lit(1), F.lit(FIRST)).alias("digit"),
        raw.substr(F.lit(FIRST + 1), F.greatest(F.octet_length(raw) - FIRST, F.lit(0))).alias("rest"),
        (F.octet_length(raw) <= FIRST).alias("ended"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(None).cast("int").alias("_")]).alias("carried"),
    )
    shared = materialise(
        rows.groupBy("digit", "ended").count().where("count > 1").select("digit", "ended", F.monotonically_increasing_id().alias("group"))
    )
    first = materialise(
        rows.join(shared.hint("merge"), ["digit", "ended"], "left").select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "text_sha256",
            "carried",
            "group",
            F.when(F.col("group").isNotNull(), F.col("rest")).alias("rest"),
        )
    )
    drop_table(shared)
    together = F.col("group").isNotNull()
    digits = materialise(first.where(together).select("row", _digits(F.col("rest")).alias("d")).select("row", "d.*"), "level")
    live, level, decided = first.where(together).select("row", "doc_id", "group"), 1, []
    while not live.isEmpty():
        here = live.hint("merge").join(digits.where(F.col("level") == level).select("row", "digit", "ended"), "row")
        newest = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row")).alias("newest")
        sizes = here.groupBy("group", "digit", "ended").agg(F.count("*").alias("size"), newest, F.min("row").alias("next"))
        done = F.col("ended") | (F.col("size") == 1)
        split = materialise(
            here.join(sizes.hint("merge"), ["group", "digit", "ended"]).select(
                "row", "doc_id", F.col("next").alias("group"), F.col("newest.doc_id").alias("keep_id"), F.col("newest.row").alias("keep_row"), "size", done.alias("done")
            )
        )
        decided.append(split.where("done").select("row", "keep_id", "keep_row", "size"))
        live, level = split.where("not done").select("row", "doc_id", "group"), level + 1
    drop_table(digits)
    alone = first.where(~together).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "carried")
    result = alone
    if decided:
        found = reduce(DataFrame.unionByName, decided)
        result = alone.unionByName(
            first.where(together).join(found.hint("merge"), "row").select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "carried")
        )
    return result.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *[F.col(f"carried.{c}") for c in keep])
