"""Session helpers: a local session for tests and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "corvath", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and bench.py use."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CORVATH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; set one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


#: Spark's own switch: an action's shuffle files go as soon as it is over. A lost one would be made again.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors don't cost the work before it.

    drop_shuffles: the shuffle files behind it, which nothing reads any more, are removed at once. Else they stay until the
    driver happens to collect its garbage, which under a small load is never: a long chain of steps then holds them all.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    before = conf.get(_DROP_SHUFFLES, None)
    conf.set(_DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, as a plan takes the setting when it is made
    finally:
        conf.unset(_DROP_SHUFFLES) if before is None else conf.set(_DROP_SHUFFLES, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
