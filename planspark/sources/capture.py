"""Capture folders: odometry, intrinsics, rasters, photos, structure files, plans; and their checks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("odometry.csv", "camera_matrix.csv", "depth")
PHOTO_TYPES = ("jpg", "jpeg", "heic", "heif", "png")
VIDEO_TYPES = ("mov", "mp4")
ODOMETRY = "timestamp double, frame int, x double, y double, z double, qx double, qy double, qz double, qw double"
SFM = "pieces array<int>, points array<array<double>>, c2w map<string,array<array<double>>>, K array<array<double>>"
PLAN = (
    "schema_version string, capture struct<tier:string,source:string>,"
    "rooms array<struct<id:string,label:string,polygon:array<array<double>>,walls:array<struct<id:string,length:struct<value:double,lo:double,hi:double,unit:string,coverage:double>>>,"
    "floor_area:struct<value:double,lo:double,hi:double,unit:string,coverage:double>,ceiling_height:struct<value:double,lo:double,hi:double,unit:string,coverage:double>>>,"
    "adjacency array<struct<a:string,b:string,via:string>>, warnings array<string>"
)


def odometry(spark: SparkSession, path: str) -> DataFrame:
    """Frames of an odometry file; a malformed line fails the read."""
    return spark.read.csv(path, header=True, schema=ODOMETRY, mode="FAILFAST", ignoreLeadingWhiteSpace=True)


def intrinsics(spark: SparkSession, path: str, scale: float = 256 / 1920) -> DataFrame:
    """One row (fx, fy, cx, cy) of a 3x3 camera matrix without header, rescaled to the depth raster."""
    lines = F.filter(F.split("value", r"\s*\n\s*"), lambda x: x != "")
    at = lambda i, j: F.get(F.split(F.get(lines, F.lit(i)), r"\s*,\s*"), F.lit(j)).cast("double") * scale
    return spark.read.text(path, wholetext=True).select(at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, folder, extension) of every file below a folder; hidden files and archive residue left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    out = files.select("path", "length", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"))
    return out.where(~F.col("path").rlike(r"/__MACOSX/") & ~F.col("name").rlike(r"^[._]")).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))


def missing_members(files: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Required names that are neither a file nor a folder of the listing."""
    wanted = files.sparkSession.createDataFrame([(n,) for n in required], "member string")
    there = files.select(F.explode(F.array("name", "folder")).alias("member")).distinct()
    return wanted.join(there, "member", "left_anti")


def tier(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Capture tier of a listing: lidar before video before photos, else null."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    found = F.when(has(F.col("name") == "odometry.csv"), "lidar").when(has(F.col("extension").isin(*VIDEO_TYPES)), "video").when(has(F.col("extension").isin(*PHOTO_TYPES)), "photos")
    return files.groupBy(*keys).agg(found.alias("tier"))


def photo_rooms(files: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Photos by room (their folder), rooms with too few left out, at most ``most`` evenly spaced ones of each."""
    from planspark.operators.runs import even_picks

    photos = files.where(F.col("extension").isin(*PHOTO_TYPES)).withColumnRenamed("folder", "room")
    enough = photos.withColumn("_n", F.count("*").over(Window.partitionBy("room"))).where(F.col("_n") >= least).drop("_n")
    return even_picks(enough, most, ["room"], ["name"])


def decode_png(data: bytes) -> tuple[int, int, list[int]]:
    """Width, height and samples of a greyscale PNG of 8 or 16 bits, without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[3] != 0 or head[2] not in (8, 16) or head[6]:
        raise ValueError("only greyscale rasters are read")
    width, height, depth = head[:3]
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    if len(raw) < height * (width * step + 1):
        raise ValueError("the raster ends early")
    rows = raw[: height * (width * step + 1)].reshape(height, -1)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, own = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = own
        elif kind == 1:
            now = own.reshape(width, step).cumsum(0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = own + above
        elif kind in (3, 4):
            now = _sequential(kind, own.tolist(), above.tolist(), step)
        else:
            raise ValueError("an unknown row filter")
        out[y] = above = now
    return width, height, out.reshape(-1).view(">u2" if step == 2 else np.uint8).tolist()


def _sequential(kind: int, own: list[int], above: list[int], step: int) -> np.ndarray:
    """Rows whose bytes build on those to their left: the average, or the nearest to the plane."""
    now = [0] * step + own
    up = [0] * step + above
    for i in range(step, len(now)):
        a, b = now[i - step], up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[i - step]
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        now[i] = (now[i] + guess) & 0xFF
    return np.array(now[step:], np.uint8)


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, w, h, samples) of a folder of numbered PNG rasters; unreadable files give null samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    w, h, values = decode_png(bytes(data))
                except (ValueError, zlib.error, struct.error, IndexError):
                    w = h = values = None
                rows.append((int(name.rsplit("/", 1)[-1].split(".")[0]), w, h, values))
            yield pd.DataFrame(rows, columns=["frame_id", "w", "h", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInPandas(run, "frame_id int, w int, h int, samples array<int>")


def pixels(frames: DataFrame, scale: float = 0.001) -> DataFrame:
    """One row (frame_id, u, v, z) for each sample of a raster."""
    out = frames.select("frame_id", "w", F.posexplode("samples").alias("i", "s"))
    return out.select("frame_id", (F.col("i") % F.col("w")).alias("u"), F.floor(F.col("i") / F.col("w")).cast("int").alias("v"), (F.col("s") * scale).alias("z"))


def probe(texts: DataFrame, text: str = "text") -> DataFrame:
    """Duration, size, rate, phone model and high dynamic range out of a decoder's text; sides swap where the film is
    turned a quarter."""
    c = F.col(text)
    num = lambda pattern, i=1: F.regexp_extract(c, pattern, i).try_cast("double")
    clock = r"Duration: (\d+):(\d+):([\d.]+)"
    turn = F.abs(F.abs(F.coalesce(num(r"rotation of (-?[\d.]+)"), F.lit(0.0))) - 90) < 1
    w, h = num(r"(\d{2,5})x(\d{2,5})", 1), num(r"(\d{2,5})x(\d{2,5})", 2)
    return texts.withColumn("duration", num(clock, 1) * 3600 + num(clock, 2) * 60 + num(clock, 3)).withColumn("w", F.when(turn, h).otherwise(w).cast("int")).withColumn("h", F.when(turn, w).otherwise(h).cast("int")).withColumn("fps", num(r"([\d.]+) fps")).withColumn("model", F.nullif(F.trim(F.regexp_extract(c, r"com\.apple\.quicktime\.model\s*:\s*([^\n]+)", 1)), F.lit(""))).withColumn("hdr", c.rlike("arib-std-b67|smpte2084"))


def structure(spark: SparkSession, path: str) -> DataFrame:
    """(frame, c2w) rows of structure-from-motion files."""
    return spark.read.json(path, schema=SFM, multiLine=True).select(F.explode("c2w").alias("frame", "c2w"))


def plans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=PLAN, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(release, asset, sha256, bytes, files) of a release manifest."""
    rows = spark.read.json(path, schema="release string, assets map<string,struct<sha256:string,bytes:bigint,files:bigint,unpacks_to:string>>", multiLine=True)
    return rows.select("release", F.explode("assets").alias("asset", "a")).select("release", "asset", "a.*")


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows kept at a path: written beside it and renamed, so that readers see a table whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(part)
    (new, files), (place, _) = _folder(spark, part), _folder(spark, path)
    files.delete(place, True)
    files.mkdirs(place.getParent())
    if not files.rename(new, place):
        raise OSError(f"cannot put a table at {path}")
    return spark.read.parquet(path)


def checkpointed(compute: Callable[[], DataFrame] | None, spark: SparkSession, path: str) -> DataFrame:
    """Rows kept at a path; a missing or broken table is computed and kept anew, or an error without ``compute``.

    The test reads no column: it counts by the files' footers.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        found = spark.read.parquet(path)
        found.count()
        return found
    except (PySparkException, Py4JJavaError):
        if compute is None:
            raise FileNotFoundError(f"no recorded table at {path}") from None
        return replace_table(compute(), spark, path)


def write_plans(plans_: DataFrame, path: str) -> None:
    plans_.write.mode("overwrite").json(path)
