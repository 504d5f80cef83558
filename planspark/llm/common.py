"""Helpers shared by the training-data operators: shared storage, Arrow batches, word splitting.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir`` so that every executor and a
restarted task can read them; a private folder is used only where that setting is absent (tests, notebooks).
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; texts may be long, so batches stay small.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; where a session of one machine names none, one is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else ""
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="planspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``batch_rows`` may be larger where Python takes narrow rows. The table is removed by ``release``, or else when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planspark-{uuid.uuid4().hex}"
    small_batches(spark, batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        small_batches(spark)
    hadoop_path, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(table: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    hadoop_path, files = _hadoop(table.sparkSession, table._path)
    files.delete(hadoop_path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for every later plan of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only; ``fn`` takes and returns columns as Python lists or arrays."""
    spark = df.sparkSession
    small_batches(spark)
    arrow_schema = spark.createDataFrame([], schema).schema
    fields = [f.name for f in arrow_schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(arrow_schema)
        for batch in batches:
            if batch.num_rows:
                out = fn({c: batch.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f], type=target.field(f).type) for f in fields], schema=target)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def filter_rows(df: DataFrame, columns: list[str], keep: Callable[[dict[str, list]], list[bool]]) -> DataFrame:
    """The rows, with all their columns, for which ``keep`` says true; one pass without a shuffle."""
    small_batches(df.sparkSession)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep({c: batch.column(i).to_pylist() for c, i in zip(columns, at, strict=True)}), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fold(doc_id: int, folds: int) -> int:
    """crc32 of the decimal id, modulo ``folds``; equals ``pmod(crc32(cast(id as string)), folds)``."""
    return zlib.crc32(str(doc_id).encode()) % folds


def fold_column(name: str, folds: int):
    """The fold of an id column; a null id is in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled ids in hash order; repeated labels of one id count as their largest."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    picked = marks.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.where(F.col(text).isNotNull()).select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(picked), id_col)
