"""Written tables in the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark is local (as in tests), a new temporary one is set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The copy has known size and no lineage. It goes when the process ends; a frame that is derived from it may be used until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quernstone-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def stage_by(df: DataFrame, key: str, name: str = "t") -> DataFrame:
    """The same in buckets by ``key``, as many as shuffles have partitions: joins on it and groups by it leave the copy where it is."""
    spark = df.sparkSession
    n, as_table = partitions(spark), f"quernstone_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{as_table}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(as_table)
    _written.append((spark, path))
    made = spark.table(as_table)
    made.staged_at, made.as_table = path, as_table
    return made


def unstage(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stage`` returned, as the rounds of a loop do with those before them; nothing derived from them may run afterwards."""
    for df in frames:
        if hasattr(df, "as_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.as_table}")
        at = (df.sparkSession, df.staged_at)
        if at in _written:
            _written.remove(at)
            _delete(*at)


#: Bytes of files up to which a frame counts as small; in memory it may be several times that.
SMALL_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether a staged frame has at most ``max_rows`` rows in at most SMALL_BYTES of files; the check behind each broadcast."""
    return _known_bytes(df) <= SMALL_BYTES and df.limit(max_rows + 1).count() <= max_rows


def if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is staged and small enough, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def _known_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame, size: int = 16 << 20) -> int:
    """Into how many groups to deal rows that meet in whole groups: the shuffle partitions, or more if that is over ``size`` bytes of files a group."""
    known = _known_bytes(df)
    return max(partitions(df.sparkSession), known // size if known < 1 << 60 else 0)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _delete(spark, path)
