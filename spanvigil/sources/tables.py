"""Warehouse-style reads: newest predictions, actuals of known keys, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanvigil.functions.scalars import assert_table_identifier
from spanvigil.sources.messages import map_default


def named_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(assert_table_identifier(name))


def newest(rows: DataFrame, time: str, since: Column | None = None, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows since a point in time; with ``limit`` the newest of them (top-k without a full sort)."""
    if since is not None:
        rows = rows.where(F.col(time) >= since)
    if limit is None:
        return rows
    order = [F.desc(time)] + ([F.col(tie)] if tie else [])
    return rows.orderBy(*order).limit(limit)


def actuals_for(actuals: DataFrame, keys: DataFrame | None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Actuals of the given load ids; with ``limit`` the newest of them."""
    if keys is not None:
        actuals = actuals.join(keys.select("load_id").distinct(), "load_id", "left_semi")
    return newest(actuals, "delivered_at", since, limit, "load_id")


def replay(rows: DataFrame, time: str, as_of: Column, since_minutes: int | None = 60) -> DataFrame:
    """Table rows of the last minutes as spans of the built-in shape."""
    if since_minutes is not None:
        rows = rows.where(F.col(time) >= as_of - F.make_dt_interval(mins=F.lit(since_minutes)))
    names = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))]
    stamped = {
        name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else F.col(name).cast("string")
        for name, kind in rows.dtypes
        if name in names
    }
    pairs = [x for name in names for x in (F.lit(name), stamped[name])]
    as_map = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return map_default(rows.select(as_map.alias("msg")))
