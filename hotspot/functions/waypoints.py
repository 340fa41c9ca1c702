"""Waypoints stored as four parallel ';'-separated lists (names, lats, lons, symbols)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspot.schemas import DEFAULT_SYMBOL


def _parts(c: str) -> Column:
    return F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x))


def waypoint_array(names="wpt_names", lats="wpt_lats", lons="wpt_lons", syms="wpt_symbols") -> Column:
    """P16 as an array<struct<pos,name,lat,lon,symbol>>: entries without both coordinates,
    or with unreadable ones, are skipped; a blank symbol becomes the default."""
    n_, la, lo, sy = _parts(names), _parts(lats), _parts(lons), _parts(syms)
    n = F.greatest(F.size(n_), F.size(la), F.size(lo), F.size(sy))
    items = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.coalesce(F.get(n_, i), F.lit("")).alias("name"),
            F.get(la, i).try_cast("double").alias("lat"),
            F.get(lo, i).try_cast("double").alias("lon"),
            F.coalesce(F.nullif(F.get(sy, i), F.lit("")), F.lit(DEFAULT_SYMBOL)).alias("symbol"),
            (F.coalesce(F.get(la, i), F.lit("")) != "").alias("has_lat"),
            (F.coalesce(F.get(lo, i), F.lit("")) != "").alias("has_lon"),
        ),
    )
    ok = F.filter(items, lambda x: x["has_lat"] & x["has_lon"] & x["lat"].isNotNull() & x["lon"].isNotNull())
    return F.transform(ok, lambda x: F.struct(x["pos"].alias("pos"), x["name"].alias("name"), x["lat"].alias("lat"),
                                              x["lon"].alias("lon"), x["symbol"].alias("symbol")))


def parse_waypoints(projects: DataFrame) -> DataFrame:
    """One row per usable waypoint of each project."""
    return projects.select("project_id", F.explode(waypoint_array()).alias("w")).select("project_id", "w.*")


def pack_waypoints(waypoints: DataFrame) -> DataFrame:
    """Rows back to the four ';'-lists, in waypoint order."""
    g = waypoints.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "lat", "lon", "symbol"))).alias("w"))
    return g.select(
        "project_id",
        F.array_join(F.transform("w", lambda x: x["name"]), ";").alias("wpt_names"),
        F.array_join(F.transform("w", lambda x: x["lat"].cast("string")), ";").alias("wpt_lats"),
        F.array_join(F.transform("w", lambda x: x["lon"].cast("string")), ";").alias("wpt_lons"),
        F.array_join(F.transform("w", lambda x: x["symbol"]), ";").alias("wpt_symbols"),
    )
