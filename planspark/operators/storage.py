"""Tables of iterations in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a session of one machine that names none gets its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="planspark-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table: cuts its lineage, survives lost executors, and has the size of its files.

    (A checkpoint keeps the size estimated for its plan, which a loop of joins squares in every round.) The table goes
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
