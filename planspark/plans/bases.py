"""Capture tables derived from the driver's tables by the same expressions on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name: (table, condition, columns). Expressions are read alike by Spark SQL and DuckDB.
BASES: dict[str, tuple[str, str, dict[str, str]]] = {
    "points": ("lineitem", "true", {
        "capture_id": "l_orderkey % 8", "frame_id": "l_orderkey", "pos": "cast(l_linenumber as bigint)", "x": "(l_partkey * 37 + l_linenumber * 11) % 1000 / 100e0 - 5e0", "y": "(l_suppkey * 53 + l_linenumber * 7) % 280 / 100e0",
        "z": "(l_orderkey * 29 + l_partkey * 13) % 1000 / 100e0 - 5e0", "conf": "cast((l_partkey + l_linenumber) % 3 as int)", "depth": "5e-2 + (l_partkey * 7) % 600 / 100e0", "u": "cast((l_partkey * 3) % 256 as int)", "v": "cast((l_suppkey * 5) % 192 as int)"}),
    "frames": ("orders", "true", {
        "capture_id": "o_custkey % 16", "frame_id": "o_orderkey", "x": "(o_custkey * 17 + o_orderkey * 3) % 800 / 100e0", "z": "(o_custkey * 7 + o_orderkey * 11) % 600 / 100e0", "qx": "(o_orderkey % 7) / 10e0", "qy": "(o_orderkey % 11) / 10e0",
        "qz": "(o_orderkey % 5) / 10e0", "qw": "1e0 + (o_orderkey % 3) / 10e0", "status": "o_orderstatus", "price": "o_totalprice"}),
    "regions": ("part", "true", {
        "room_id": "p_partkey % 20", "d_ord": "p_partkey", "class": "case when p_size % 4 = 0 then 'water_stain' when p_size % 4 = 1 then 'mold' when p_size % 4 = 2 then 'crack' else 'hole' end",
        "surface": "case when p_partkey % 3 = 0 then 'ceiling' else 'wall' end", "surface_id": "concat('w', cast(p_partkey % 7 as string))", "bottom": "case when p_partkey % 11 = 0 then null else (p_partkey * 7 % 200) / 100e0 end",
        "length": "(p_partkey * 13 % 150) / 100e0 + 3e-4", "area": "(p_partkey * 19 % 90) / 100e0 + 3e-4", "wall_length": "case when p_partkey % 3 = 0 then null else 2e0 + (p_partkey % 7) / 2e0 + 3e-4 end", "ceiling": "case when p_partkey % 5 = 0 then null else 24e-1 + (p_partkey % 20) / 50e0 end", "floor_area": "8e0 + p_partkey % 20 + 3e-4"}),
    "corners": ("customer", "true", {"ring": "cast(floor(c_custkey / 40) as bigint)", "i": "c_custkey % 40", "u": "(c_custkey * 37 % 500) / 100e0", "v": "(c_custkey * 61 % 400) / 100e0"}),
    "pixels": ("customer", "true", {"frame_id": "cast(floor(c_custkey / 400) as bigint)", "u": "c_custkey % 20", "v": "cast(floor(c_custkey / 20) as bigint) % 20", "z": "1e0 + c_custkey * 37 % 100 / 100e0"}),
    "slots": ("events", "true", {"wall": "user_id", "slot": "event_id * 7 % 90", "value": "value"}),
    "jobs": ("events", "true", {"job_id": "user_id", "event_id": "event_id", "ts": "ts", "status": "event_type", "value": "value"}),
    "measures": ("lineitem", "true", {
        "quantity": "case when l_linenumber % 3 = 0 then 'wall' when l_linenumber % 3 = 1 then 'area' else 'ceiling' end", "tier": "case when l_suppkey % 3 = 0 then 'photos' when l_suppkey % 3 = 1 then 'video' else 'lidar' end",
        "space": "l_partkey % 50", "run": "l_orderkey % 5", "truth": "2e0 + l_partkey % 300 / 100e0", "predicted": "2e0 + l_partkey % 300 / 100e0 + (l_suppkey * 7 % 41 - 20) / 200e0", "lo": "19e-1 + l_partkey % 300 / 100e0", "hi": "205e-2 + l_partkey % 300 / 100e0"}),
    "boxes": ("lineitem", "true", {
        "image": "cast(floor(l_orderkey / 30) as bigint)", "box_id": "l_partkey * 10 + l_linenumber", "class": "l_returnflag", "x0": "l_partkey * 3 % 700 / 1e0", "y0": "l_suppkey * 7 % 700 / 1e0", "x1": "l_partkey * 3 % 700 + 100e0 + l_linenumber * 20", "y1": "l_suppkey * 7 % 700 + 100e0 + l_quantity", "score": "l_discount + l_tax + 0e0"}),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, condition, columns = BASES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition)
    return rows.selectExpr(*[f"{e} as `{c}`" for c, e in columns.items()])


def cte(*names: str) -> str:
    """``WITH`` clause of bases for the oracle."""
    parts = []
    for name in names:
        table, condition, columns = BASES[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{e.replace('as string)', 'as varchar)')} AS {c}" for c, e in columns.items()) + f" FROM {table} WHERE {condition})")
    return "WITH " + ", ".join(parts)
