"""Column expressions for poses, angles, measurements and texts; all stay inside generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z90 = 1.645


def rotation(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Nine row-major entries of the rotation of a quaternion, normalised first."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def transform(r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    """R·p + t."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def camera_point(u: Column, v: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """Camera coordinates of a depth pixel's centre."""
    return [(u + 0.5 - cx) * z / fx, (v + 0.5 - cy) * z / fy, z]


def plan_rotate(u: Column, v: Column, angle: Column | float) -> list[Column]:
    a = F.lit(angle)
    return [F.cos(a) * u - F.sin(a) * v, F.sin(a) * u + F.cos(a) * v]


def cell(value: Column, size: float, origin: float = 0.0) -> Column:
    """Grid index: floor, so negatives go down, as a long."""
    return F.floor((value - origin) / size).cast("long")


def cell_centre(index: Column, size: float, origin: float = 0.0) -> Column:
    return (index + 0.5) * size + origin


def moved(polygon: str, cos: Column, sin: Column, du: Column, dv: Column) -> Column:
    """A nested polygon (i, u, v) turned and shifted, point by point in place."""
    return F.transform(polygon, lambda p: F.struct(p["i"].alias("i"), (cos * p["u"] - sin * p["v"] + du).alias("u"), (sin * p["u"] + cos * p["v"] + dv).alias("v")))


def upright(up: Column, fx: Column, fy: Column, cx: Column, cy: Column, width: int, height: int, least: float = 0.7) -> tuple[Column, ...]:
    """Quarter turns (1 counter-clockwise, -1 clockwise, 0) that bring a frame upright, and its intrinsics after them."""
    level = F.abs(up) < least
    turn = lambda a, b, c: F.when(level, a).when(up > 0, b).otherwise(c)
    return turn(F.lit(0), F.lit(1), F.lit(-1)), turn(fx, fy, fy), turn(fy, fx, fx), turn(cx, cy, height - 1 - cy), turn(cy, width - 1 - cx, cx)


def rolled(r: Sequence[Column], turns: Column) -> list[Column]:
    """A camera's rotation after its image was turned by quarters: the camera rolls about its optical axis."""
    pick = lambda still, left, right: F.when(turns == 1, left).when(turns == -1, right).otherwise(still)
    return [e for i in range(3) for e in (pick(r[3 * i], r[3 * i + 1], -r[3 * i + 1]), pick(r[3 * i + 1], -r[3 * i], r[3 * i]), r[3 * i + 2])]


def letterboxed(views: DataFrame, keys: Sequence[str], focal: Column) -> DataFrame:
    """Views (w, h) scaled and centred to the commonest shape of their set, the larger of equals, with their intrinsics."""
    shapes = views.groupBy(*keys, "w", "h").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(F.struct("n", "h", "w")).alias("t"))
    rows = views.join(shapes.select(*keys, F.col("t.w").alias("tw"), F.col("t.h").alias("th")), list(keys))
    rows = rows.withColumn("scale", F.least(F.col("th") / F.col("h").cast("double"), F.col("tw") / F.col("w").cast("double")))
    rows = rows.withColumn("nw", F.bround(F.col("w") * F.col("scale")).cast("long")).withColumn("nh", F.bround(F.col("h") * F.col("scale")).cast("long"))
    rows = rows.withColumn("x0", F.floor((F.col("tw") - F.col("nw")) / 2)).withColumn("y0", F.floor((F.col("th") - F.col("nh")) / 2))
    return rows.withColumn("fx", focal * F.col("scale")).withColumn("cx", F.col("w") / 2.0 * F.col("scale") + F.col("x0")).withColumn("cy", F.col("h") / 2.0 * F.col("scale") + F.col("y0"))


def original_pixel(u: Column, v: Column, width: int, height: int, crop_w: int, crop_h: int, side: int) -> tuple[Column, Column]:
    """Pixel of the original photo under a pixel of its centre crop, after scaling to a long side; undoes both."""
    scale = float(side) / float(max(width, height))
    return tuple((c + (F.bround(F.lit(float(n)) * scale) - crop) / 2) / scale for c, n, crop in ((u, width, crop_w), (v, height, crop_h)))


def plus_minus(m: Column, unit: str = "m") -> Column:
    """``1.23 ±0.04 m`` of a measurement."""
    return F.when(m.isNull(), "n/a").otherwise(F.format_string(f"%.2f ±%.2f {unit}", m["value"], (m["hi"] - m["lo"]) / 2))


def measurement(value: Column, sigma: Column, unit: str, digits: int = 4) -> Column:
    """Value with its 90 % interval."""
    half = F.lit(Z90) * sigma
    return F.struct(F.round(value, digits).alias("value"), F.round(value - half, digits).alias("lo"), F.round(value + half, digits).alias("hi"), F.lit(unit).alias("unit"), F.lit(0.9).alias("coverage"))


def wall_sigma(before: Column, after: Column, length: Column, absolute: float, relative: float) -> Column:
    return F.sqrt(before * before + after * after + 2 * absolute * absolute + (relative * length) * (relative * length))


def median_sigma(spread: Column, n: Column) -> Column:
    """Standard error of a median."""
    return 1.2533 * spread / F.sqrt(n)


def snap_yaw(angle: Column) -> Column:
    """Nearest quarter turn; halves go to the even one."""
    quarter = math.pi / 2
    return F.bround(angle / quarter) * quarter


def wrap_angle(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def focal_px(f35: Column, width: Column, height: Column, default: float = 13.0) -> Column:
    """Focal length in pixels from its 35 mm equivalent."""
    return F.coalesce(f35, F.lit(default)) * F.hypot(width, height) / math.hypot(36, 24)


def field_of_view(width: Column, focal: Column) -> Column:
    return F.degrees(2 * F.atan(width / (2 * focal)))


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_escapes(text: Column) -> Column:
    """Terminal colour codes removed."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def band_error(value: Column, low: Column, high: Column) -> Column:
    """Distance to a band, zero inside."""
    return F.when(value < low, value - low).when(value > high, value - high).otherwise(F.lit(0.0))


def mean_reading(readings: Column) -> Column:
    """Mean of non-null readings, null if there are none."""
    kept = F.filter(readings, lambda r: r.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, r: a + r) / F.size(kept))
