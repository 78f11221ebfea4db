"""A corpus pipeline over documents: language, repeated lines, near-duplicates, benchmark leaks, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, language, lines, mixing, near
from quernstone.staging import stage

#: SQL can't express language identification and the edit join; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language one can tell; learned from the rows that have a language. Those without a letter go, and null texts.

    Repeated rows have one verdict. An empty table gives an empty one, as does a table in which no row with a text has a language.
    """
    return language.keep_identified(docs, language.fit_languages(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines within two edits of an earlier one; n_chars is the new length. Documents with nothing left go.

    Null texts stay. Rows of null ids come after all others; rows that are repeated whole are judged as one, and keep the same lines.
    Columns other than text and n_chars stay as they are, whatever their names. An empty table gives an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("others"))
    out = lines.dedup_lines(packed).where("n_removed = 0 or trim(replace(text, '\n', ' ')) <> ''")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("others.n_chars")).alias("n_chars")
    return out.select(*(length if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at 0.8 of five-word shingles: the smallest id.

    Null and empty texts and rows of null ids stay. Rows that are repeated whole, or share the id that stays, all stay; rows that share
    an id of which one text goes all go. An empty table gives an empty one.
    """
    return near.drop_near_duplicates(docs, percent=80, words=5)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no window as long as a benchmark item with 0.8 of its five-word shingles.

    Null and empty texts stay; each row is judged by its own text, so repeated rows go or stay together. An empty table, or an empty
    benchmark, changes nothing.
    """
    return decontaminate.drop_containing(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, share=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often: sources weigh 1, 2, 3 in turn, at most 3 copies of each.

    Each row has its own size, source_size, target, copies and taken, also those with a null id or an id that others have; input columns
    of these names are replaced. Rows of one id draw the same number, so of one source they are taken in order of size, then of a hash of
    the row; rows that are repeated whole are taken one by one. Texts without words, null ones too, take no words, and stay if their
    turn comes. Null sources are one source. An empty table gives an empty one.
    """
    return mixing.pareto_mix(docs, keep=tuple(docs.columns)).where("copies > 0")


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; each says what it does with odd rows.

    An empty table gives an empty result. Extra columns of any name go along.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
