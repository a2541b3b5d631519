"""Connected components by Spark joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.session import drop_table, materialise


def _centres(edges: DataFrame) -> DataFrame:
    """Per node its smallest neighbour, itself included (map-side minima)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _both(first: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each of the pairs of columns, in one pass."""
    pairs = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends])
    return first.select(F.inline(pairs)).where("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges, ("u", "v"), ("v", "u"))
    joined = both.join(_centres(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _both(down.join(_centres(down), "u"), ("v", "m"), ("u", "m")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has at most one edge (u, v), v < u, and v then has none."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    odd = (F.sum("up") > 1) | ((F.sum("up") == 1) & (F.min("up") == 0))
    seen = ends.groupBy("node").agg(odd.alias("odd")).agg(F.max("odd")).first()[0]
    return not seen


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tasks: int | None = None) -> DataFrame:
    """``node, label`` for every node of an undirected edge table.

    ``label`` is the smallest node of the component.  Loops and repeated edges do
    no harm; edges with a null end are ignored.  A hub's edges meet only in a
    minimum and in a join, so no node's neighbours are gathered in one place.
    Each round is written to the shared folder, by ``tasks`` tasks at most where
    that is given; rounds grow with the logarithm of the longest path.
    """

    def written(frame: DataFrame) -> DataFrame:
        return materialise(frame if tasks is None else frame.coalesce(tasks))

    usable = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    start = usable.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = written(start.distinct())
    while not _is_forest_of_stars(current):
        following = written(_small_star(_large_star(current)))
        drop_table(current)
        current = following
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
