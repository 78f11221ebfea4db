"""Session factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under; on a cluster, pass your own session instead."""
    made = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return share_path(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_tables() -> tuple[str, ...]:
    return (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split()


def share_path(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this machine's files import the package from where it is; elsewhere it must be installed or sent."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    paths = [p for p in (known.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
