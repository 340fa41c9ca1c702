"""Spatial operators: project boxes, box assignment by grid cells, map extent, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot.functions.geo import COS_FLOOR, M_PER_DEG_MAP, bbox_cols
from hotspot.functions.waypoints import parse_waypoints
from hotspot.operators.dims import dim_join

REQUEST_MAX_DAYS = 5  # fixed value: longest window one area request may cover
#: Side of a grid cell. Fixed: one large project does not make all cells large.
CELL_DEG = 0.5


def project_boxes(projects: DataFrame) -> DataFrame:
    """Per project the download box (5 dp) and its 'W,S,E,N' request text."""
    b = bbox_cols("vent_lat", "vent_lon", "ref_radius_m")
    out = projects.select("project_id", *[v.alias(k) for k, v in b.items()])
    txt = F.concat_ws(",", *[F.format_string("%.5f", c) for c in ("west", "south", "east", "north")])
    return out.withColumn("area", txt)


def _split_antimeridian(boxes: DataFrame) -> DataFrame:
    """Boxes crossing +-180 become two boxes inside [-180, 180]."""
    parts = F.array(
        F.struct(F.greatest("west", F.lit(-180.0)).alias("w"), F.least("east", F.lit(180.0)).alias("e")),
        F.struct(
            F.when(F.col("west") < -180.0, F.col("west") + 360.0).when(F.col("east") > 180.0, F.lit(-180.0)).alias("w"),
            F.when(F.col("west") < -180.0, F.lit(180.0)).when(F.col("east") > 180.0, F.col("east") - 360.0).alias("e"),
        ),
    )
    x = boxes.select("*", F.explode(parts).alias("p")).where(F.col("p.w").isNotNull())
    return x.select("project_id", "south", "north", F.col("p.w").alias("west"), F.col("p.e").alias("east"))


def assign_projects(det: DataFrame, projects: DataFrame) -> DataFrame:
    """Global detections (no project) -> every project whose box contains them.

    A 2-D range join that Catalyst would run as a nested loop is rewritten as an equi-join
    on cells of a fixed grid: each box is listed under the cells it covers, a detection falls
    in exactly one cell. The exact box test follows the hash join. The box table is broadcast when Spark sizes it small (it is bounded by
    the project count), otherwise both sides shuffle on the cell key (AQE splits a hot cell)."""
    boxes = _split_antimeridian(project_boxes(projects))
    cell = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(CELL_DEG)).cast("long")
    south, north = F.greatest("south", F.lit(-90.0)), F.least("north", F.lit(90.0))
    cells = boxes.select(
        "*",
        F.explode(F.sequence(cell(south), cell(north))).alias("cy"),
    ).select("*", F.explode(F.sequence(cell("west"), cell("east"))).alias("cx"))
    d = det.withColumn("cy", cell("latitude")).withColumn("cx", cell("longitude"))
    j = d.join(cells, ["cy", "cx"])
    inside = F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east"))
    return j.where(inside).drop("cy", "cx", "south", "north", "west", "east")


def in_bbox(det: DataFrame, projects: DataFrame) -> DataFrame:
    """whether each detection lies inside its own project's download box (a box may cross
    the 180th meridian: longitudes are compared a full turn either way as well)."""
    b = project_boxes(projects).drop("area")
    j = dim_join(det, b, "project_id")
    lon = lambda turn: (F.col("longitude") + F.lit(turn)).between(F.col("west"), F.col("east"))
    inside = F.col("latitude").between(F.col("south"), F.col("north")) & (lon(0.0) | lon(360.0) | lon(-360.0))
    return j.withColumn("inside", inside)


def extent(filtered: DataFrame, projects: DataFrame, pad: float = 0.005) -> DataFrame:
    """Map bounds per project over the filtered detections, the vent, the reference
    radius box (if enabled) and the waypoints (if enabled); a degenerate side is padded."""
    det = filtered.groupBy("project_id").agg(
        F.min("latitude").alias("d_s"), F.max("latitude").alias("d_n"), F.min("longitude").alias("d_w"), F.max("longitude").alias("d_e")
    )
    wp = parse_waypoints(projects.where(F.col("include_reference_waypoint"))).groupBy("project_id").agg(
        F.min("lat").alias("w_s"), F.max("lat").alias("w_n"), F.min("lon").alias("w_w"), F.max("lon").alias("w_e")
    )
    dlat = F.col("ref_radius_m") / F.lit(M_PER_DEG_MAP)
    dlon = F.col("ref_radius_m") / (F.lit(M_PER_DEG_MAP) * F.greatest(F.cos(F.radians("vent_lat")), F.lit(COS_FLOOR)))
    rad = F.coalesce(F.col("include_reference_radius"), F.lit(False))
    p = projects.select(
        "project_id", "vent_lat", "vent_lon",
        F.when(rad, F.col("vent_lat") - dlat).alias("r_s"), F.when(rad, F.col("vent_lat") + dlat).alias("r_n"),
        F.when(rad, F.col("vent_lon") - dlon).alias("r_w"), F.when(rad, F.col("vent_lon") + dlon).alias("r_e"),
    )
    j = p.join(det, "project_id", "left").join(wp, "project_id", "left")
    s = F.least("vent_lat", "d_s", "r_s", "w_s")
    n = F.greatest("vent_lat", "d_n", "r_n", "w_n")
    w = F.least("vent_lon", "d_w", "r_w", "w_w")
    e = F.greatest("vent_lon", "d_e", "r_e", "w_e")
    j = j.select("project_id", s.alias("s"), n.alias("n"), w.alias("w"), e.alias("e"))
    return j.select(
        "project_id",
        F.when(F.col("s") == F.col("n"), F.col("s") - pad).otherwise(F.col("s")).alias("south"),
        F.when(F.col("s") == F.col("n"), F.col("n") + pad).otherwise(F.col("n")).alias("north"),
        F.when(F.col("w") == F.col("e"), F.col("w") - pad).otherwise(F.col("w")).alias("west"),
        F.when(F.col("w") == F.col("e"), F.col("e") + pad).otherwise(F.col("e")).alias("east"),
    )


# Map zoom level by view size (km): below 2 -> 15, 5 -> 14, 10 -> 13,
# 20 -> 12, 50 -> 11, otherwise 10.
ZOOM_STEPS = [(2.0, 15), (5.0, 14), (10.0, 13), (20.0, 12), (50.0, 11)]
ZOOM_FAR = 10


def view_zoom(filtered: DataFrame, projects: DataFrame) -> DataFrame:
    """A13 (view): the map view size is the larger of the reference radius and the longest
    runout (the radius alone when nothing was detected); the zoom level follows from it."""
    far = filtered.groupBy("project_id").agg(F.max("distance_km").alias("dmax"))
    p = projects.select("project_id", (F.col("ref_radius_m") / 1000.0).alias("radius_km"))
    j = p.join(far, "project_id", "left")
    view = F.greatest(F.col("radius_km"), F.coalesce(F.col("dmax"), F.col("radius_km")))
    zoom = F.lit(ZOOM_FAR)
    for limit, z in reversed(ZOOM_STEPS):
        zoom = F.when(view < limit, F.lit(z)).otherwise(zoom)
    return j.select("project_id", view.alias("view_km"), zoom.alias("zoom"))


def request_manifest(projects: DataFrame, sensor_keys: list[str]) -> DataFrame:
    """The area requests a download needs — per project, sensor and window of at most
    5 days covering the period's dates — with the box text and day count."""
    p = project_boxes(projects).join(projects.select("project_id", "start_ts", "end_ts"), "project_id")
    sd, ed = F.to_date("start_ts"), F.to_date("end_ts")
    w = p.select(
        "project_id", "area", sd.alias("sd"), ed.alias("ed"),
        F.explode(
            F.when(ed >= sd, F.sequence(sd, ed, F.expr(f"INTERVAL {REQUEST_MAX_DAYS} DAYS"))).otherwise(F.array().cast("array<date>"))
        ).alias("chunk_start"),
    )
    w = w.withColumn("chunk_end", F.least(F.date_add("chunk_start", REQUEST_MAX_DAYS - 1), F.col("ed")))
    w = w.withColumn("day_range", (F.datediff("chunk_end", "chunk_start") + 1).cast("int"))
    w = w.withColumn("sensor", F.explode(F.array(*[F.lit(k) for k in sensor_keys])))
    return w.select("project_id", "sensor", "chunk_start", "chunk_end", "day_range", "area")
