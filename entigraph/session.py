"""Session defaults."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "entigraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and runtime skew handling; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``), which the driver and all executors share.  Only a
    local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="entigraph-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage of steps that iterate, survives lost
    executors, and tells Spark the true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has settled; results that were not yet written out can no longer be read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/settled-{spark.sparkContext.applicationId}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
