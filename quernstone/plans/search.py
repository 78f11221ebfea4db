"""One entry point for the ranking methods, and what is shown of their results."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import graph, text, vector
from ..staging import stage

METHODS = ("fulltext_daat", "fulltext_taat", "tfidf", "bm25", "lsa", "dense", "ppr")


@dataclass
class Corpus:
    """Documents (doc_id, title, text) and what was made of them; parts that are missing limit the methods."""

    articles: DataFrame
    index: text.Index
    ranks: DataFrame | None = None
    latent: text.Latent | None = None
    vectors: DataFrame | None = None
    encoder: object = None
    doc_entities: DataFrame | None = None
    edges: DataFrame | None = None
    stats: dict = field(default_factory=dict)


def search(corpus: Corpus, method: str, query: str, k: int = 10) -> DataFrame:
    """doc_id, score of a method; ``corpus.stats`` gets the time, the rows shown and the corpus size. An unknown method raises ValueError."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    began = time.perf_counter()
    if method == "fulltext_daat":
        found = text.daat(corpus.index, query, k)
    elif method == "fulltext_taat":
        found = text.taat(corpus.index, query, k)
    elif method in ("tfidf", "bm25"):
        found = getattr(text, method)(corpus.index, query, k)
    elif method == "lsa":
        found = corpus.latent.search(query, k)
    elif method == "dense":
        import pandas as pd

        encoded = (corpus.encoder or vector.hashing_encoder)(pd.Series([query]))[0]
        found = vector.exact_knn(corpus.vectors, encoded, k, id_col="doc_id")
    else:
        terms = text.query_terms(query)
        found = graph.ppr_search(corpus.doc_entities, corpus.articles.select(F.col("doc_id").alias("id")), corpus.edges, terms, [t for t in terms if len(t) > 3], k)
    rows = found.collect()
    corpus.stats = {"elapsed_s": round(time.perf_counter() - began, 3), "shown": len(rows), "corpus": corpus.articles.count()}
    return found.sparkSession.createDataFrame(rows, found.schema)


def enrich(results: DataFrame, articles: DataFrame, ranks: DataFrame | None = None, width: int = 300) -> DataFrame:
    """Results with title, address form of the title, rank (6 digits, 0 if unknown), rounded score and a snippet; unknown documents are dropped."""
    results = stage(results.select("doc_id", "score"), "results")  # what a search shows, some hundred rows at most
    joined = articles.join(F.broadcast(results), "doc_id")
    known = ranks.select(F.col("id").alias("doc_id"), "r").join(F.broadcast(results.select("doc_id")), "doc_id", "left_semi") if ranks is not None else None
    joined = joined.join(F.broadcast(known), "doc_id", "left") if ranks is not None else joined.withColumn("r", F.lit(0.0))
    return joined.select(
        "doc_id",
        "title",
        F.replace("title", F.lit(" "), F.lit("_")).alias("title_url"),
        F.round("score", 4).alias("score"),
        F.round(F.coalesce("r", F.lit(0.0)), 6).alias("pagerank"),
        X.snippet(F.col("text"), width).alias("snippet"),
    )
