import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import expr as X
from quernstone.operators import text
from quernstone.plans import search as S

DOCS = [(1, "a a b"), (2, "a c"), (3, "c d")]


@pytest.fixture(scope="module")
def index(spark):
    return text.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"), staged=True)


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def test_frequencies(index):
    tf = {(r.doc_id, r.term): round(r.tf, 6) for r in index.postings.collect()}
    assert tf[1, "a"] == 0.666667 and tf[2, "a"] == 0.5


def test_conjunctive_and_disjunctive(index):
    assert scores(text.daat(index, "a c")) == {2: 1.0}
    assert scores(text.taat(index, "a c")) == {1: 0.666667, 2: 1.0, 3: 0.5}
    assert scores(text.daat(index, "a zzz")) == {} == scores(text.daat(index, ""))
    assert scores(text.daat(index, "a a c")) == {2: 1.0}


def test_tfidf(index):
    assert scores(text.tfidf(index, "a c")) == {1: 0.590852, 2: 1.0, 3: 0.428046}
    idf = {r.term: round(r.idf, 6) for r in text.tfidf_weights(index).collect()}
    assert idf == {"a": 1.287682, "b": 1.693147, "c": 1.287682, "d": 1.693147}


def test_bm25(index):
    assert scores(text.bm25(index, "b")) == {1: 0.45263}
    assert scores(text.bm25(index, "d d")) == {3: 1.091841}
    assert scores(text.bm25(index, "a")) == {}


def test_contributions(index):
    got = {(r.term, r.doc_id): r.contribution for r in text.bm25_contributions(index, "b d d", text.taat(index, "b d")).collect()}
    assert got == {("b", 1): 0.45263, ("d", 1): 0.0, ("b", 3): 0.0, ("d", 3): 0.54592}
    matrix = {(r.term, r.doc_id): r.tf for r in text.term_matrix(index, "a c", text.taat(index, "a c")).collect()}
    assert matrix["a", 1] == 0.6667 and matrix["c", 1] == 0.0 and len(matrix) == 6


def test_postings_are_counted_without_a_shuffle(spark):
    """Each row's words are counted in the row; texts without words have no postings but count as documents."""
    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, "..."), (4, "a")], "doc_id long, text string")
    plain = text.build_index(df)
    assert "Exchange" not in plain.postings._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.doc_id, r.cnt, r.len) for r in plain.postings.collect()) == [("a", 1, 1, 3), ("a", 4, 1, 1), ("b", 1, 2, 3)]
    terms, n, mean_len = plain.totals
    assert {r.term: r.df for r in terms.collect()} == {"a": 2, "b": 1} and (n, mean_len) == (4, 1.0)
    assert text.build_index(df.limit(0)).totals[1:] == (0, None) and text.bm25(text.build_index(df.limit(0)), "a").count() == 0


def test_plain_index_scores_as_the_written_one(spark, index):
    plain = text.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))
    for query in ("a c", "d d", "b zzz", ""):
        for method in (text.tfidf, text.bm25, text.daat, text.taat):
            assert scores(method(plain, query)) == scores(method(index, query))
    for method in (text.tfidf_contributions, text.bm25_contributions):
        made = [sorted(map(tuple, method(i, "b d d", text.taat(i, "b d")).collect())) for i in (plain, index)]
        assert made[0] == made[1] and len(made[0]) == 4


def test_ranks_of_other_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"T {i}", t) for i, t in DOCS], "doc_id long, title string, text string")
    ranks = spark.createDataFrame([(i, i / 4) for i in range(3)], "id long, r double")
    shown = S.enrich(spark.createDataFrame([(2, 0.5), (3, 0.25)], "doc_id long, score double"), docs, ranks)
    assert "Exchange hashpartitioning" not in shown._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.pagerank for r in shown.collect()} == {2: 0.5, 3: 0.0}


def test_tokens(spark):
    row = spark.range(1).select(X.tokens(F.lit("Ёлка-2 ÉtÉ x1y ПРИВЕТ")).alias("t")).first()
    assert row.t == ["ёлка", "t", "x", "y", "привет"]


def test_latent_scores_match_a_dense_decomposition(spark):
    docs = [(i, t) for i, t in enumerate(["red blue red", "blue green", "green red green", "tree leaf", "leaf tree root", "root leaf blue"])]
    latent = text.Latent(spark.createDataFrame(docs, "doc_id long, text string"), k=3)
    words = latent.counter.vocabulary
    raw = np.array([[t.split().count(w) for w in words] for _, t in docs], float)
    idf = np.log((1 + len(docs)) / (1 + (raw > 0).sum(0))) + 1
    m = raw * idf
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = np.linalg.svd(m)[2][:3].T
    p = m @ v
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q = np.array([float(w in ("tree", "root")) for w in words]) * idf @ v
    q /= np.linalg.norm(q)
    want = {i: round(float(s), 5) for i, s in enumerate(p @ q) if s > 1e-9}
    got = {r.doc_id: round(r.score, 5) for r in latent.search("tree root").collect() if r.score > 1e-9}
    assert got == pytest.approx(want, abs=2e-5)


def test_latent_vectors_are_made_once(spark):
    """Searches and scatters read what was written; documents without terms have a vector of no length; the vocabulary is cut by count, then term."""
    docs = [(0, "red red blue"), (1, None), (2, "blue green"), (3, "..."), (4, "green red"), (5, "ash")]
    latent = text.Latent(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary=4, k=2)
    assert latent.counter.vocabulary == ["red", "blue", "green", "ash"]
    assert latent.idf == pytest.approx([math.log(7 / (1 + df)) + 1 for df in (2, 2, 2, 1)])
    sizes = {r.doc_id: round(math.hypot(*r.v), 6) for r in latent.vectors.collect()}
    assert sizes == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: sizes[5]}
    placed = latent.scatter(latent.search("red"))
    for made in (placed, latent.search("red")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "MapInArrow" not in plan
    hits = {r.doc_id for r in latent.search("red").collect()}
    assert {r.doc_id for r in placed.collect() if r.is_result} == hits >= {0, 4} and placed.count() == 6


def test_decomposition_holds_its_rows(spark, monkeypatch):
    """Its passes read rows from memory, and they go when it ends."""
    seen, svd, kept = [], text.RowMatrix.computeSVD, lambda: spark.sparkContext._jsc.getPersistentRDDs().size()

    def watched(self, *given, **named):
        level = self._java_matrix_wrapper._java_model.rows().getStorageLevel()
        seen.append((level.useMemory(), level.useDisk()))
        return svd(self, *given, **named)

    monkeypatch.setattr(text.RowMatrix, "computeSVD", watched)
    before = kept()
    text.Latent(spark.createDataFrame(DOCS, "doc_id long, text string"), k=2)
    assert seen == [(True, False)] and kept() == before


def test_facade(spark, index):
    articles = spark.createDataFrame([(i, f"T {i}", t) for i, t in DOCS], "doc_id long, title string, text string")
    corpus = S.Corpus(articles, index)
    assert scores(S.search(corpus, "fulltext_taat", "a c"))[2] == 1.0
    assert corpus.stats["shown"] == 3 and corpus.stats["corpus"] == 3
    with pytest.raises(ValueError):
        S.search(corpus, "telepathy", "a")
    ranks = spark.createDataFrame([(2, 0.25)], "id long, r double")
    shown = {r.doc_id: (r.title_url, r.pagerank, r.snippet) for r in S.enrich(text.taat(index, "a c"), articles, ranks).collect()}
    assert shown[2] == ("T_2", 0.25, "a c") and shown[1][1] == 0.0
    assert math.isclose(sum(x[1] for x in shown.values()), 0.25)
