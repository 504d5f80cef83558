"""Readers of intermediate and control files: structure, links, detections, rules, truth, ranges, bundles, matches."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = "c2w:map<string,array<array<double>>>,points:array<array<double>>,obs:map<string,struct<uv:array<array<double>>,idx:array<int>>>"
STRUCTURE = f"K array<array<double>>, pieces array<int>, all array<struct<{PIECE}>>"
LINKS = "a string, pa int, b string, pb int, xa array<array<double>>, xb array<array<double>>, n int"
DETECTIONS = "model string, detections array<struct<image:int,class:string,x0:int,y0:int,x1:int,y1:int,confidence:double,note:string>>"
RULES = "rule_ord int, kind string, rule_id string, class string, surface string, below double, above double, least double, flag string, item_ord int, code string, description string, qty string, margin double"


def structure(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of structure files: ``poses`` (piece, frame, m00..m23), ``points`` (piece, idx, x, y, z) and ``seen``
    (piece, frame, idx, u, v)."""
    rows = spark.read.json(path, schema=STRUCTURE, multiLine=True).select(F.posexplode("all").alias("piece", "p"))
    poses = rows.select("piece", F.explode("p.c2w").alias("frame", "m")).select("piece", "frame", *[F.get(F.get("m", F.lit(i)), F.lit(j)).alias(f"m{i}{j}") for i in range(3) for j in range(4)])
    points = rows.select("piece", F.posexplode("p.points").alias("idx", "q")).select("piece", "idx", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    seen = rows.select("piece", F.explode("p.obs").alias("frame", "o")).select("piece", "frame", F.explode(F.arrays_zip("o.idx", "o.uv")).alias("z"))
    return {"poses": poses, "points": points, "seen": seen.select("piece", "frame", "z.idx", F.get("z.uv", F.lit(0)).alias("u"), F.get("z.uv", F.lit(1)).alias("v"))}


def links(spark: SparkSession, path: str) -> DataFrame:
    """Links between photos with their matched pixels, strongest first."""
    return spark.read.json(path, schema=LINKS, multiLine=True).orderBy(F.desc("n"), "a", "pa", "b", "pb")


def detections(spark: SparkSession, path: str) -> DataFrame:
    """(key, model, image, class, box, confidence, note) of cached answers, whose file names are their keys."""
    rows = spark.read.json(path, schema=DETECTIONS, multiLine=True).withColumn("key", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return rows.select("key", "model", F.explode("detections").alias("d")).select("key", "model", "d.*")


def replayed(path: Path, policy: str, live: Callable[[], bytes]) -> bytes:
    """A cached answer, or a new one that is then kept: ``replay`` fails on a miss, ``live`` always asks."""
    from planspark.sources.files import write_atomic

    if policy != "live" and path.exists():
        return path.read_bytes()
    if policy == "replay":
        raise FileNotFoundError(f"no recorded answer at {path}")
    data = live()
    path.parent.mkdir(parents=True, exist_ok=True)
    write_atomic(path, data)
    return data


def _one_line(text: str | None) -> str | None:
    return " ".join(text.split()) if text else None


def rules(spark: SparkSession, text: str) -> DataFrame:
    """Rule tables out of YAML: a row a concealed rule, and a row an item of a scope rule."""
    read, rows = yaml.safe_load(text), []
    for kind, name in (("concealed", "concealed_rules"), ("scope", "scope_rules")):
        for i, r in enumerate(read.get(name) or []):
            w = r.get("when") or {}
            head = (i, kind, r["id"], w.get("class"), w.get("surface"), w.get("bottom_below_m"), w.get("bottom_above_m"), w.get("min_length_m"), _one_line(r.get("flag")))
            for j, item in enumerate(r.get("items") or [{}]):
                rows.append((*head, j, item.get("code"), item.get("description"), item.get("qty"), float(item.get("margin") or 0)))
    return spark.createDataFrame(rows, RULES)


def truth(spark: SparkSession, text: str) -> DataFrame:
    """(space, room, item, kind, metres) of tape readings in YAML: means of the readings there are, null without any."""
    read, rows = yaml.safe_load(text), []
    mean = lambda v: float(np.mean(k)) / 100 if (k := [x for x in (v or []) if x is not None]) else None
    for room in read.get("rooms") or []:
        rows.append((read.get("space_id"), room["id"], None, "ceiling", mean(room.get("ceiling_height_cm"))))
        rows += [(read.get("space_id"), room["id"], w["id"], "wall", mean(w.get("length_cm"))) for w in room.get("walls") or []]
        rows += [(read.get("space_id"), room["id"], o["id"], "opening", mean(o.get("width_cm"))) for o in room.get("openings") or []]
    return spark.createDataFrame(rows, "space string, room string, item string, kind string, metres double")


def ranges(spark: SparkSession, text: str) -> DataFrame:
    """(capture, room, start, stop) of frame ranges in YAML, ends included."""
    read = yaml.safe_load(text)
    return spark.createDataFrame([(read["capture"], room, a, b) for room, spans in read["rooms"].items() for a, b in spans], "capture string, room string, start long, stop long")


def sizes(truth_rows: DataFrame) -> DataFrame:
    """(room, short, long, area) of rooms whose first four walls were read, opposite ones averaged."""
    four = truth_rows.where("kind = 'wall'").groupBy("room").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "metres"))), lambda w: w["metres"]).alias("w")).where("size(w) >= 4")
    at = lambda i: F.get("w", F.lit(i))
    a, b = (at(0) + at(2)) / 2, (at(1) + at(3)) / 2
    return four.select("room", F.least(a, b).alias("short"), F.greatest(a, b).alias("long"), (a * b).alias("area")).where("area is not null")


def arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(path, name, shape, data) of arrays in NPZ files; broken files give one row without a name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        rows += [(p, n, list(z[n].shape), z[n].astype(float).reshape(-1)) for n in names if n in z.files]
                except (ValueError, OSError, EOFError, KeyError, __import__("zipfile").BadZipFile):
                    rows.append((p, None, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], names=["path", "name", "shape", "data"])

    return files.mapInArrow(run, "path string, name string, shape array<long>, data array<double>")


def write_bundle(folder: Path, capture: str, sets: dict[str, dict[str, np.ndarray]]) -> None:
    """An evaluation bundle: an index, and a file of truth arrays a set; the index comes last, so a bundle is whole."""
    import json

    from planspark.sources.files import write_atomic

    for name, truth_arrays in sets.items():
        (folder / name).mkdir(parents=True, exist_ok=True)
        packed = io.BytesIO()
        np.savez_compressed(packed, **truth_arrays)
        write_atomic(folder / name / "gt.npz", packed.getvalue())
    write_atomic(folder / "index.json", json.dumps({"source_capture": capture, "sets": sorted(sets)}))


def bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(set, name, shape, data) of the truth arrays of a bundle's sets."""
    index = spark.read.json(f"{folder}/index.json", schema="source_capture string, sets array<string>", multiLine=True).select(F.explode("sets").alias("set"))
    rows = arrays(spark, folder, ["depth", "conf", "K", "T_world_cam", "source_frame"]).withColumn("set", F.element_at(F.split("path", "/"), -2))
    return rows.join(index, "set", "left_semi").where("name is not null").select("set", "name", "shape", "data")


def write_matches(path: Path, images: dict[int, np.ndarray], pairs: dict[tuple[int, int], np.ndarray]) -> None:
    """Keypoints and matches in the tables of the tracking library's database, in place of what it held."""
    with sqlite3.connect(path) as db:
        db.execute("create table if not exists keypoints (image_id integer primary key, rows integer, cols integer, data blob)")
        db.execute("create table if not exists matches (pair_id integer primary key, rows integer, cols integer, data blob)")
        db.execute("delete from keypoints")
        db.execute("delete from matches")
        db.executemany("insert into keypoints values (?, ?, ?, ?)", [(i, len(k), 2, np.asarray(k, "<f4").tobytes()) for i, k in images.items()])
        # fixed value: the library numbers a pair by its smaller image
        db.executemany("insert into matches values (?, ?, ?, ?)", [(min(a, b) * 2147483647 + max(a, b), len(m), 2, np.asarray(m if a < b else np.asarray(m)[:, ::-1], "<u4").tobytes()) for (a, b), m in pairs.items()])


def read_matches(spark: SparkSession, path: Path) -> DataFrame:
    """(a, b, ka, kb) of the matches in a tracking database."""
    with sqlite3.connect(path) as db:
        rows: list[tuple[Any, ...]] = []
        for pair, n, data in db.execute("select pair_id, rows, data from matches order by pair_id"):
            a, b = divmod(pair, 2147483647)
            rows += [(a, b, int(x), int(y)) for x, y in np.frombuffer(data, "<u4").reshape(n, 2)]
    return spark.createDataFrame(rows, "a long, b long, ka long, kb long")
