"""Session helpers: a session for scripts and tests, table reads, shared storage."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for bench runs and tests; a cluster brings its own."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout; clusters ship it with --py-files.

    Also bounds, for the rest of the session, what goes to them at once by bytes: ten thousand rows of long texts would be more than a worker should hold.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH")) if p)
    held = spark.conf.get(BATCH_CONF, str(BATCH_BYTES + 1))  # a size with or without a unit
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a local session gets a temporary folder, kept for the session; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_runlens_dir", None) or tempfile.mkdtemp(prefix="runlens-")
        spark._runlens_dir = base
    return f"{base.rstrip('/')}/runlens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared folder: it outlives the executors that wrote it."""
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._runlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialise` wrote and that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._runlens_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
