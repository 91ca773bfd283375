"""Session helpers: defaults for local runs, the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local does the machine's temporary folder serve; a cluster without
    the setting is an error, since a folder of one machine would lose data with it.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if conf.get("spark.master", "local").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir for local-cluster runs")
    at = os.path.join(tempfile.gettempdir(), "hearthdex-shared")
    os.makedirs(at, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    return f"file://{at}"


_homes: set[str] = set()


def _remove(folder, configuration) -> None:
    """Best effort: the driver's JVM may have gone first."""
    try:
        folder.getFileSystem(configuration).delete(folder, True)
    except Exception:  # noqa: BLE001
        pass


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Used to cut lineage or to read an expensive result twice. The files are in
    the shared folder, so a lost executor costs nothing but its running tasks. They lie in
    a folder of the application, which is removed when the driver ends.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/hearthdex-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_remove, spark._jvm.org.apache.hadoop.fs.Path(home), spark._jsc.hadoopConfiguration())
    at = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, to fix it for stages that compute more than they read."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer than half of them a task; else as it is.

    For Python stages that compute long over few bytes. Large inputs have a task for each
    part of a file and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 2 * df.rdd.getNumPartitions() <= cores else df
