"""Session settings, table access and materialisation in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[weakref.ref, str]] = []


def local_session(cpus: int = 8, memory: str = "12g", name: str = "loamspark") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns and filters are pruned into its scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    A session without that setting (tests, a laptop) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        folder = tempfile.mkdtemp(prefix="loamspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for tables that go when the driver ends or release() is called."""
    path = f"{shared_dir(spark)}/loamspark-{label}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    It cuts the lineage: what follows reads replicated files, so a lost executor costs only its own tasks.
    The files go when the driver ends or release() is called. options are the writer's.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that materialize() wrote in this process."""
    while _written:
        _, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            return


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        release(spark)


atexit.register(_at_exit)
