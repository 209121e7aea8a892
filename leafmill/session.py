"""Session factory and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.functions import count, lit

#: Settings that the operators rely on for their results.
SEMANTICS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def session(app: str = "leafmill", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings of tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    conf = SEMANTICS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.local.dir": os.environ.get("SPARK_LOCAL_DIRS", "/tmp/leafmill-local"),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir; one of our own only in a local session."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, from a Parquet table in the shared folder that goes away with the session.

    The table outlives any executor, is read with column pruning and gives the optimizer real sizes.
    """
    return written_and_counted(df, what)[0]


def written_and_counted(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """A written table and its number of rows, which is counted while it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafmill-{what}-{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, count(lit(1)).alias("n")).write.parquet(path)
    gone_with_session(spark, path)
    return spark.read.schema(df.schema).parquet(path), rows.get["n"]


def gone_with_session(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
