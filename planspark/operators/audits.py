"""Checks, findings and states: capture audits, plan hints, settings, releases and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Photos of a room, and the shortest film.
FEWEST, WANTED, SHORTEST_S = 2, 8, 20.0


def lens(f35: Column) -> Column:
    """Name of a lens by its 35 mm equivalent."""
    return F.when(f35.isNull(), "unknown").when(f35 < 18, "0.5x ultra-wide").when(f35 < 35, "1x wide").otherwise(F.concat(F.bround(f35 / 26).cast("int").cast("string"), F.lit("x tele")))


def photo_findings(photos: DataFrame) -> DataFrame:
    """(room, name, level, text) of photos (w, h, orientation, f35, f_mm): errors stop a run, warnings do not."""
    sideways = F.col("orientation").isin(5, 6, 7, 8)
    portrait = (F.col("w") > F.col("h")) == sideways
    kind = lens(F.col("f35"))
    found = F.array(
        F.when(F.col("f35").isNull() & F.col("f_mm").isNull(), F.struct(F.lit("error").alias("level"), F.lit("no focal length").alias("text"))),
        F.when(kind != "0.5x ultra-wide", F.struct(F.lit("warning").alias("level"), F.concat(F.lit("lens "), kind).alias("text"))),
        F.when(portrait, F.struct(F.lit("warning").alias("level"), F.lit("portrait").alias("text"))),
    )
    return photos.select("room", "name", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("room", "name", "f.*")


def room_findings(photos: DataFrame) -> DataFrame:
    """(room, name, level, text): rooms with too few or too many photos are errors, other numbers than eight warnings."""
    n = F.col("n")
    rooms = photos.groupBy("room").agg(F.count("*").alias("n"))
    level = F.when(~n.between(FEWEST, WANTED), "error").when(n != WANTED, "warning")
    return rooms.select("room", F.lit(None).cast("string").alias("name"), level.alias("level"), F.concat(n.cast("string"), F.lit(" photos")).alias("text")).where("level is not null")


def exit_codes(findings: DataFrame, key: str) -> DataFrame:
    """(key, errors, warnings, code): a capture with an error ends with one."""
    level = lambda what: F.count_if(F.col("level") == what)
    return findings.groupBy(key).agg(level("error").alias("errors"), level("warning").alias("warnings")).withColumn("code", F.when(F.col("errors") > 0, 1).otherwise(0))


def empty_hint(tier: Column, rooms: Column) -> Column:
    """Why a plan without rooms is empty; null for others."""
    hint = F.when(tier == "photos", "take eight overlapping 0.5x photos in a ring in each room").when(tier == "video", "walk each room slowly, half a minute or more").when(tier == "lidar", "scan the full perimeter of each room").otherwise("")
    return F.when(rooms == 0, F.concat(F.lit("no room could be measured; "), hint))


def opening_kinds(runs: DataFrame) -> DataFrame:
    """Openings (sill, width, support, seen) with their kind and confidence; a gap that nothing was seen through is weak."""
    kind = F.when(F.col("seen") & (F.col("sill") > 0.5), "window").when(F.col("width") <= 1.2, "door").otherwise("open_passage")
    sure = F.when(F.col("seen"), F.round(F.least(F.lit(1.0), F.col("support") / 200), 2)).otherwise(F.lit(0.3))
    return runs.withColumn("kind", kind).withColumn("confidence", sure).withColumn("sill", F.when(F.col("seen"), F.greatest("sill", F.lit(0.0))).otherwise(F.lit(0.0)))


def wrong_settings(settings: DataFrame, choices: dict[str, tuple[str, ...]], multiples: dict[str, int]) -> DataFrame:
    """(key, value) of settings that are no choice of theirs, or no multiple."""
    bad = F.lit(False)
    for key, words in choices.items():
        bad = F.when(F.col("key") == key, ~F.col("value").isin(*words)).otherwise(bad)
    for key, n in multiples.items():
        bad = F.when(F.col("key") == key, F.coalesce(F.col("value").try_cast("int") % n != 0, F.lit(True))).otherwise(bad)
    return settings.where(bad)


def refused(files: DataFrame, flag: Column) -> DataFrame:
    """Assets with a flagged file, each with how many; a release leaves them out."""
    return files.where(flag).groupBy("asset").agg(F.count("*").alias("flagged"))


def released(files: DataFrame, flag: Column) -> DataFrame:
    """(asset, files, bytes, sha256) of assets without a flagged file; the digest is that of their files' in name order."""
    parts = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    clean = files.join(refused(files, flag), "asset", "left_anti")
    return clean.groupBy("asset").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(parts, lambda p: p["sha256"]), ""), 256).alias("sha256"))


def interrupted(events: DataFrame) -> DataFrame:
    """State of each job after a restart: its last one, but what was queued or running is interrupted."""
    last = events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("steps"))
    return last.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def bad_steps(events: DataFrame) -> DataFrame:
    """Steps of jobs that a job cannot take: out of an end, back to the queue, or to an end without running."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    rows = events.withColumn("before", before)
    allowed = F.coalesce(((F.col("before") == "queued") & F.col("status").isin("running", "failed")) | ((F.col("before") == "running") & F.col("status").isin("done", "failed")), F.col("status") == "queued")
    return rows.where(~allowed)


def last_errors(lines: DataFrame, key: str) -> DataFrame:
    """The last line (no, line) of each key that names an error, or else its last line; at most 300 characters."""
    error = F.col("line").rlike(r"Error|Exception|not implemented")
    return lines.groupBy(key).agg(F.substring(F.coalesce(F.max_by(F.when(error, F.col("line")), F.when(error, F.col("no"))), F.max_by("line", "no")), 1, 300).alias("error"))


def tape_marks(rows: DataFrame) -> DataFrame:
    """Measurements (value, lo, hi) against tape (truth): error, its share, whether the interval holds, and a mark."""
    error = F.col("value") - F.col("truth")
    share = F.abs(error) / F.col("truth")
    return rows.withColumns({"error": error, "share": share, "holds": F.col("truth").between(F.col("lo"), F.col("hi")), "mark": F.when(share <= 0.03, "good").when(share <= 0.08, "fair").otherwise("poor")})
