"""Readers and writers: delimited text, JSON, SQL dumps, Parquet artefacts, JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import stage

ARTICLE = "id string, title string, text string"
LINK = "from_id string, from_title string, to_ids array<string>, to_titles array<string>"
PLAYS = "qtr int, down int, ydstogo double, yardline_100 int, score_differential int, win int"
DUMP_TUPLE = r"\((\d+),\d+,'((?:[^'\\]|\\.)*)',\d+\)"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text, one file or many, gzip by suffix. Without a schema all columns are strings: nothing is inferred, so the files are read once."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.schema(schema).option("mode", "DROPMALFORMED") if schema else reader
    return reader.csv(path if isinstance(path, str) else list(path))


def with_file_stem(rows: DataFrame, out_col: str = "stem") -> DataFrame:
    """Adds the name of the file that a row is from, without its suffixes."""
    return rows.withColumn(out_col, F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.(csv|tsv|txt|json|jsonl)?(\.gz)?$", ""))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = ARTICLE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """One JSON document or array; None if there is no such file."""
    if not exists(spark, path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_positional(spark: SparkSession, path: str, names: Sequence[str], sep: str = ",") -> DataFrame:
    """Lines cut at a separator, columns by place; shorter lines are dropped."""
    cut = F.split("value", f"[{sep}]" if len(sep) == 1 and sep not in "\\^]" else sep)
    rows = spark.read.text(path).select(cut.alias("c")).where(F.size("c") >= len(names))
    return rows.select(*(F.col("c")[i].alias(n) for i, n in enumerate(names)))


def parse_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """from_id, title of the tuples of INSERT lines of an SQL dump, many a line; an escaped quote does not end a title."""
    rows = lines.where(F.startswith(column, F.lit("INSERT INTO")))
    ids, titles = (F.regexp_extract_all(F.col(column), F.lit(DUMP_TUPLE), F.lit(g)) for g in (1, 2))
    rows = rows.select(F.explode(F.arrays_zip(ids.alias("i"), titles.alias("t"))).alias("x"))
    return rows.select(F.col("x.i").cast("long").alias("from_id"), F.regexp_replace(F.col("x.t"), r"\\(.)", "$1").alias("title"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_dump(spark.read.text(path))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_of(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first Parquet artefact that is there."""
    return next((spark.read.parquet(p) for p in paths if exists(spark, p)), None)


def artefact(spark: SparkSession, path: str, make) -> DataFrame:
    """A Parquet artefact, made if it is not there."""
    if not exists(spark, path):
        make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def missing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the required artefacts that are not there."""
    return [p for p in paths if not exists(spark, p)]


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, sep: str = ",", header: bool = True, gzip: bool = False) -> None:
    out = rows.select(*columns) if columns else rows
    writer = out.write.mode("overwrite").option("header", header).option("sep", sep)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def to_json_array(rows: DataFrame) -> DataFrame:
    """One row, one JSON array, of a small result."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("json"))


def update_timings(spark: SparkSession, path: str, new: dict) -> dict:
    """Read a timing document (one that is missing or broken counts as empty), merge ``new`` into it, and write it again in whole."""
    import json

    old: dict = {}
    if exists(spark, path):
        try:
            read = json.loads(spark.read.text(path, wholetext=True).first()[0])
            old = read if isinstance(read, dict) else {}
        except (ValueError, TypeError):
            old = {}
    merged = merge_timings(old, new)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(merged, indent=2).encode()))
    out.close()
    return merged


def piped(rows: DataFrame, command: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """Rows as lines of text through an external program, one for each partition, and its lines back as string columns; lines of another
    number of fields are dropped. The one place for a script of one's own; what built-in expressions say should be said with them."""
    lines = rows.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("value"))
    back = rows.sparkSession.createDataFrame(lines.rdd.map(lambda x: x.value).pipe(command).map(lambda x: (x,)), "value string")
    parts = F.split("value", sep.replace("|", "\\|"), -1)
    return back.where(F.size(parts) == len(columns)).select(*(parts[i].alias(c) for i, c in enumerate(columns)))


def merge_timings(old: dict, new: dict) -> dict:
    """An updated timing document."""
    return {**old, **new}


def external_table(spark: SparkSession, name: str, path: str, ddl: str = PLAYS) -> DataFrame:
    """A view over delimited files with a header."""
    read_csv(spark, path, ddl).createOrReplaceTempView(name)
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(rows: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    rows.write.format("jdbc").mode("overwrite").options(url=url, dbtable=table, batchsize=str(batch), truncate="true", **options).save()


def numbered(rows: DataFrame, order: str, out_col: str = "row_id") -> DataFrame:
    """Dense numbers from 0 in an order: ranges are sorted apart and their sizes added up, so no task sees all rows."""
    dealt = stage(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_p").count().withColumn("_before", F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    place = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1 + F.coalesce("_before", F.lit(0))
    return dealt.join(F.broadcast(sizes.drop("count")), "_p").withColumn(out_col, place.cast("long")).drop("_p", "_before")
