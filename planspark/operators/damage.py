"""Detections as regions on room surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.functions.scalars import measurement
from planspark.operators.geometry import point_segment


def projected(points: DataFrame, rooms: DataFrame, key: str, least: int = 30, far: float = 0.5, digits: int = 3) -> DataFrame:
    """Regions of detections: points (x, y above the floor, z) on the floor, the ceiling or the nearest wall of their room.

    ``rooms`` holds (room, ceiling, walls: array of wall, ax, az, bx, bz) for each key. The median height decides: below
    15 cm the floor, within 15 cm of the ceiling the ceiling, or else the wall nearest to the median place, if it is
    within ``far``; others are dropped, as are detections of fewer than ``least`` points. A region spans the 5th to 95th
    percentile along the surface. Walls shorter than 20 cm do not count.
    """
    middle = points.groupBy(key).agg(F.median("y").alias("h"), F.median("x").alias("mx"), F.median("z").alias("mz"), F.count("*").alias("n")).where(F.col("n") >= least).join(rooms, key)
    named = F.transform("walls", lambda w: F.struct(F.round(point_segment(F.col("mx"), F.col("mz"), w["ax"], w["az"], w["bx"], w["bz"]), 9).alias("far"), w["wall"].alias("wall"), w["ax"].alias("ax"), w["az"].alias("az"), w["bx"].alias("bx"), w["bz"].alias("bz")))
    long = F.filter(named, lambda w: F.hypot(w["bx"] - w["ax"], w["bz"] - w["az"]) >= 0.2)
    middle = middle.withColumn("w", F.array_min(long))
    flat = F.when(F.col("h") < 0.15, "floor").when(F.abs(F.col("h") - F.col("ceiling")) < 0.15, "ceiling")
    middle = middle.withColumn("kind", F.coalesce(flat, F.when(F.col("w.far") <= far, "wall"))).where("kind is not null")
    wall = F.col("kind") == "wall"
    middle = middle.withColumn("surface_id", F.when(wall, F.col("w.wall")).otherwise(F.concat_ws(".", "room", "kind")))
    length = F.hypot(F.col("w.bx") - F.col("w.ax"), F.col("w.bz") - F.col("w.az"))
    along = ((F.col("x") - F.col("w.ax")) * (F.col("w.bx") - F.col("w.ax")) + (F.col("z") - F.col("w.az")) * (F.col("w.bz") - F.col("w.az"))) / length
    rows = points.join(middle, key).select(key, "kind", "surface_id", "n", "h", F.when(wall, along).otherwise(F.col("x")).alias("a"), F.when(wall, F.col("y")).otherwise(F.col("z")).alias("b"))
    at = lambda c, p: F.percentile(c, F.lit(p))
    out = rows.groupBy(key, "kind", "surface_id", "n").agg(at("a", 0.05).alias("a0"), at("a", 0.95).alias("a1"), at("b", 0.05).alias("b0"), at("b", 0.95).alias("b1"), F.first("h").alias("h"))
    bottom = F.when(F.col("kind") == "wall", F.col("b0")).when(F.col("kind") == "floor", 0.0).otherwise(F.col("h"))
    corner = lambda a, b: F.array(F.round(a, digits), F.round(b, digits))
    polygon = F.array(corner("a0", "b0"), corner("a1", "b0"), corner("a1", "b1"), corner("a0", "b1"))
    width, height = F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")
    return out.select(key, "kind", "surface_id", "n", polygon.alias("polygon_on_surface"), F.round(width, digits).alias("width"), F.round(height, digits).alias("height"), F.round(width * height, digits + 1).alias("area"), (F.round(bottom, digits) + 0.0).alias("bottom"))


def measured(regions: DataFrame, absolute: float, relative: float, focal: Column, depth: Column) -> DataFrame:
    """Regions with their extents and area as intervals: a pixel's footprint and the tier's error at the edges."""
    edge = F.lit(absolute) + depth / focal
    sw, sh = F.hypot(edge, relative * F.col("width")), F.hypot(edge, relative * F.col("height"))
    area = F.hypot(F.col("width") * sh, F.col("height") * sw)
    return regions.withColumns({"extent_w": measurement(F.col("width"), sw, "m"), "extent_h": measurement(F.col("height"), sh, "m"), "area_m2": measurement(F.col("area"), area, "m2")})


def same_shape(width: Column, height: Column, depth_width: Column, depth_height: Column, slack: float = 0.04) -> Column:
    """Whether a depth raster has its image's shape, within a few percent."""
    return F.abs(depth_width / depth_height - width / height) <= slack * width / height
