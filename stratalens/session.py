"""Session helpers: local sessions for tests, and the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratalens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = named or "file://" + tempfile.mkdtemp(prefix="stratalens-")
    sc.setCheckpointDir(where)
    return sc.getCheckpointDir() or where


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written once to the shared folder, so that a lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
