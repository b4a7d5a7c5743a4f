"""Session settings, the shared work folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "tableflow", cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """This application's folder inside the shared one for cuts and scratch tables.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a
    local session may fall back to a folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="tableflow-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that no other caller uses."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession) -> None:
    """Delete what this application left in the shared folder, once its results are used."""
    drop_path(spark, work_root(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none when it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_counted(df: DataFrame, path: str, **counts) -> dict[str, int]:
    """Write Parquet and return the row count (and more counts) of the same pass."""
    watch = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(cond).alias(name) for name, cond in counts.items()]
    df.observe(watch, *metrics).write.mode("overwrite").parquet(path)
    return watch.get


# Rows of one key that a single task takes in stride.
HOT_ROWS = 5_000_000
