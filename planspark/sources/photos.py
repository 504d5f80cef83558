"""Photos: what their headers say, rooms of photos, findings. Pixels are decoded elsewhere (``decode`` of ``room_photos``)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planspark.operators.runs import even_picks
from planspark.sources.capture import PHOTO_TYPES, listing
from planspark.sources.files import write_atomic

# Tags of the photo metadata format.
ORIENTATION, MODEL, EXIF, GPS, FOCAL_MM, FOCAL_35 = 0x0112, 0x0110, 0x8769, 0x8825, 0x920A, 0xA405
#: Long side that photos are scaled down to, and the focal length taken where a photo names none.
LONG_SIDE, ASSUMED_F35 = 1920, 13.0
HEADER = "w int, h int, orientation int, model string, f_mm double, f35 double, gps boolean, error string"


def _entries(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """Values of a directory of tags: numbers, fractions as floats, and texts."""
    out: dict[int, object] = {}
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 0) * count
        place = at + 10 + 12 * k
        if size > 4:
            place = struct.unpack_from(order + "I", tiff, place)[0]
        if kind == 2:
            out[tag] = tiff[place : place + count].split(b"\0")[0].decode("ascii", "replace")
        elif kind in (3, 4, 9) and count:
            out[tag] = struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind], tiff, place)[0]
        elif kind in (5, 10) and count:
            a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, place)
            out[tag] = a / b if b else None
    return out


def _tags(tiff: bytes) -> dict[int, object]:
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    out = _entries(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    if isinstance(out.get(EXIF), int):
        out |= {k: v for k, v in _entries(tiff, out[EXIF], order).items() if k in (FOCAL_MM, FOCAL_35)}
    return out


def header(data: bytes) -> dict[str, object]:
    """Size and metadata of a JPEG or PNG file; ``error`` says why a file cannot be read."""
    w = h = None
    tags: dict[int, object] = {}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack_from(">II", data, 16)
            at = 8
            while at + 8 <= len(data):
                size, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"eXIf":
                    tags = _tags(data[at + 8 : at + 8 + size])
                at += 12 + size
        elif data[:2] == b"\xff\xd8":
            at = 2
            while w is None:
                mark, size = struct.unpack_from(">HH", data, at)
                body = data[at + 4 : at + 2 + size]
                if len(body) < size - 2:
                    raise ValueError("the file ends early")
                if mark == 0xFFE1 and body[:6] == b"Exif\0\0":
                    tags = _tags(body[6:])
                elif 0xFFC0 <= mark <= 0xFFCF and mark not in (0xFFC4, 0xFFC8, 0xFFCC):
                    h, w = struct.unpack_from(">HH", body, 1)
                at += 2 + size
        else:
            raise ValueError("neither JPEG nor PNG")
    except (struct.error, KeyError, ValueError, IndexError) as e:
        return dict.fromkeys(("w", "h", "orientation", "model", "f_mm", "f35"), None) | {"gps": False, "error": str(e)[:60] or type(e).__name__}
    number = lambda t: float(tags[t]) if tags.get(t) else None
    return {"w": w, "h": h, "orientation": int(tags.get(ORIENTATION) or 1), "model": tags.get(MODEL), "f_mm": number(FOCAL_MM), "f35": number(FOCAL_35), "gps": GPS in tags, "error": None}


def tagged(jpeg: bytes, f35: int, orientation: int = 1, model: str = "") -> bytes:
    """A JPEG file with metadata of its lens put in front, in place of what it had."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    name = model.encode("ascii", "replace") + b"\0"
    place = 8 + 2 + 3 * 12 + 4
    exif = place + len(name) + len(name) % 2
    entries = struct.pack("<HHII", MODEL, 2, len(name), place) + struct.pack("<HHIHH", ORIENTATION, 3, 1, orientation, 0) + struct.pack("<HHII", EXIF, 4, 1, exif)
    if len(name) <= 4:
        entries = struct.pack("<HHI4s", MODEL, 2, len(name), name) + entries[12:]
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + entries + bytes(4) + name + bytes(len(name) % 2) + struct.pack("<HHHIHHI", 1, FOCAL_35, 3, 1, f35, 0, 0)
    body, at = b"Exif\0\0" + tiff, 2
    while jpeg[at : at + 2] == b"\xff\xe1":
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + jpeg[at:]


def write_proxies(folder: Path, stills: dict[str, bytes], f35: int, truth: dict[str, object]) -> None:
    """Stills of a room as photos with their lens, and beside them what is true of them."""
    folder.mkdir(parents=True, exist_ok=True)
    for name, jpeg in stills.items():
        write_atomic(folder / name, tagged(jpeg, f35))
    write_atomic(folder / "truth.json", json.dumps(truth, indent=1, sort_keys=True))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, room, name, header columns) of every photo below a folder."""
    files = listing(spark, path).where(F.col("extension").isin(*PHOTO_TYPES))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.select("path", F.col("folder").alias("room"), "name").join(content, "path")
    names = [f.split()[0] for f in HEADER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()), strict=True))
        for batch in batches:
            found = [header(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "room", "name")], *[pa.array([f[n] for f in found], kinds[n]) for n in names]], names=["path", "room", "name", *names])

    return rows.mapInArrow(run, "path string, room string, name string, " + HEADER)


def upright(photos: DataFrame) -> DataFrame:
    """Readable photos with their upright size, scaled to at most ``LONG_SIDE``, and intrinsics at that size."""
    turned = F.col("orientation") >= 5
    w, h = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    scale = F.least(F.lit(1.0), LONG_SIDE / F.greatest("w", "h"))
    out = photos.where("error is null").withColumn("uw", F.bround(w * scale).cast("int")).withColumn("uh", F.bround(h * scale).cast("int"))
    out = out.withColumn("focal_px", F.coalesce("f35", F.lit(ASSUMED_F35)) * F.hypot("uw", "uh") / F.hypot(F.lit(36.0), F.lit(24.0)))
    return out.withColumns({"cx": F.col("uw") / 2, "cy": F.col("uh") / 2, "assumed": F.col("f35").isNull()})


def rooms(photos: DataFrame, root: str, most: int = 8, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Photos of the rooms that are used, and warnings (room, text).

    A sub-folder is a room. Photos beside room folders are ignored; without such folders they are one room. Unreadable
    photos are skipped, of more than ``most`` evenly spaced ones are taken, rooms with fewer than ``least`` are dropped.
    """
    loose = F.col("room") == root
    has_rooms = photos.agg(F.coalesce(F.bool_or(~loose), F.lit(False))).scalar()
    good = upright(photos.where(~(loose & has_rooms)))
    counted = good.withColumn("_n", F.count("*").over(Window.partitionBy("room")))
    picked = even_picks(counted.where(F.col("_n") >= least).drop("_n"), most, ["room"], ["name"]).drop("index")
    say = lambda rows, text: rows.select("room", F.concat(*[t if not isinstance(t, str) else F.lit(t) for t in text]).alias("text"))
    usable = photos.where(~(loose & has_rooms)).groupBy("room").agg(F.count_if(F.col("error").isNull()).alias("n"), F.count_if(F.col("error").isNull() & F.col("f35").isNull()).alias("assumed"))
    warnings = say(photos.where("error is not null"), [F.col("name"), " unreadable (", F.col("error"), "); skipped"])
    warnings = warnings.unionByName(say(photos.where(loose & has_rooms).groupBy("room").count(), [F.col("count").cast("string"), " photos beside room folders; ignored"]))
    warnings = warnings.unionByName(say(usable.where(F.col("n") < least), [F.col("n").cast("string"), " usable photo(s); a room needs two; skipped"]))
    warnings = warnings.unionByName(say(usable.where(F.col("n") > most), [F.col("n").cast("string"), f" photos; kept {most} evenly spaced"]))
    return picked, warnings.unionByName(say(usable.where("assumed > 0"), ["no focal length; the widest lens is assumed"]))
