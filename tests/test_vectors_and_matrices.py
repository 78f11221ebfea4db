import numpy as np
import pytest

from quernstone.operators import linalg, relational, vector
from quernstone.session import table


def test_exact_order(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = vector.exact_knn(df, [0.8, 0.6]).collect()
    assert [(r.vec_id, round(r.score, 2)) for r in got] == [(2, 0.96), (1, 0.8), (3, 0.6), (4, -0.8)]


def test_batch_breaks_ties_by_id_and_leaves_self_out(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 1.0])], "vec_id long, embedding array<double>").repartition(5)
    got = vector.batch_knn(df, df.where("vec_id in (3, 99)"), 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(3, 0), (3, 1), (3, 2), (3, 4), (99, 0), (99, 1), (99, 2), (99, 3)]
    assert vector.batch_knn(df, df.limit(0)).count() == 0


def test_batch_leaves_null_vectors_out_and_tiles_are_one_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = np.round(rng.standard_normal((90, 4)), 1)
    df = spark.createDataFrame([*((i, [float(x) for x in v]) for i, v in enumerate(m)), (900, None)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vector, "TILE", (5, 7))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = [(q, i) for q in range(90) for i in sorted(set(range(90)) - {q}, key=lambda i: (-scores[q, i], i))[:4]]
    got = vector.batch_knn(df, df, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == want


def test_no_pair_of_a_cell_is_a_row(spark, sf_dir):
    """A probe joins no rows: pairs are scored in tasks."""
    rows = table(spark, sf_dir, "embeddings")
    found = vector.IvfIndex(rows, cells=4).search(rows.where("vec_id % 20 = 0"), 10)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_candidate_of_a_bucket_is_a_row(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = vector.lsh_knn(rows, rows.where("vec_id % 20 = 0"), 10)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    far = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.8, 0.6]), (4, None)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vector.lsh_knn(far, far.where("vec_id = 1"), 5, width=5.0).collect()] == [(3, 0.8)]


def test_a_queries_reach_is_one_row_to_the_driver(spark, sf_dir, monkeypatch):
    """Counts of distances stay where they are made; only the reach of each query is brought back."""
    rows = table(spark, sf_dir, "embeddings")
    asked, brought, plain = rows.where("vec_id % 20 = 0"), [], type(rows).collect
    index = vector.SketchIndex(rows)
    monkeypatch.setattr(type(rows), "collect", lambda df: (brought.append(got := plain(df)), got)[1])
    found = index.search(asked, 10)
    assert max(map(len, brought)) == asked.count() and found.count() == 10 * asked.count()


def test_index_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    truth = vector.batch_knn(rows, asked)
    assert relational.recall(truth, vector.IvfIndex(rows, cells=16).search(asked, 10, probes=12)).first().recall >= 0.9
    assert relational.recall(truth, vector.IvfIndex(rows, cells=4).search(asked, 10, probes=4)).first().recall == 1.0
    assert relational.recall(truth, vector.lsh_knn(rows, asked, 10)).first().recall >= 0.9


def test_sketches_prune_and_find(spark, sf_dir):
    """Recall over 0.9 while under a quarter of the rows are ranked by their vectors; all of them if asked, exactly; ties and odd rows."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    index, truth = vector.SketchIndex(rows), vector.batch_knn(rows, asked)
    assert relational.recall(truth, index.search(asked, 10, share=0.2)).first().recall >= 0.9
    whole = index.search(asked, 10, share=1.0)
    assert sorted(map(tuple, whole.select(truth.columns).collect())) == sorted(map(tuple, truth.collect()))
    odd = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)] + [(20, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = vector.SketchIndex(odd).search(odd.where("vec_id = 3"), 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4]
    assert vector.SketchIndex(odd.limit(0)).search(odd, 4).count() == 0 == vector.SketchIndex(odd).search(odd.limit(0), 4).count()


def test_search_reaches_the_index_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    found = vector.search(rows, asked, 10, ("ivf",))["ivf"][0]
    assert relational.recall(vector.batch_knn(rows, asked), found).first().recall >= 0.9


def test_batches_are_one_search(spark, sf_dir, monkeypatch):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    whole = sorted(map(tuple, vector.batch_knn(rows, asked).collect()))
    monkeypatch.setattr(vector, "BATCH", 7)
    assert sorted(map(tuple, vector.batch_knn(rows, asked).collect())) == whole


def test_latencies(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    got = vector.latencies(rows, rows, n=5)
    assert 0 < got["p50"] <= got["p95"] <= got["p99"] and vector.latencies(rows, rows.limit(0)) == {}


def test_components_of_embeddings_are_those_of_numpy(spark, sf_dir):
    from quernstone import catalog

    rows = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()}
    ids = sorted(rows)
    m = np.array([rows[i] for i in ids], float)
    m -= m.mean(axis=0)
    want = m @ np.linalg.svd(m, full_matrices=False)[2][:2].T
    got = {r.vec_id: (r.x, r.y) for r in catalog.QUERIES["pca_scatter"](spark, sf_dir).collect()}
    placed = np.array([got[i] for i in ids])
    for k in range(2):  # signs are free; so is a constant, as the projection may be of rows that are not centred
        a, b = placed[:, k] - placed[:, k].mean(), want[:, k] - want[:, k].mean()
        assert np.allclose(a, b, atol=1e-3) or np.allclose(a, -b, atol=1e-3)


def test_dense_checks_are_guarded():
    assert linalg.dense_fits(15_000) and not linalg.dense_fits(15_001) and not linalg.dense_fits(0)


def test_strategies(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    got = vector.search(rows, rows.where("vec_id = 40"), 5, ("exact", "ivf"))
    assert {k: v[0].count() for k, v in got.items()} == {"exact": 5, "ivf": 5}
    with pytest.raises(ValueError):
        vector.search(rows, rows, 5, ("guess",))


def test_encoder(spark):
    df = vector.encode(spark.createDataFrame([("a b",), ("",), (None,)], "t string"), "t")
    assert sorted(round(sum(x * x for x in r.embedding), 4) for r in df.collect()) == [0.0, 0.0, 1.0]


def test_products(spark):
    rng = np.random.default_rng(42)
    a, b = rng.standard_normal((7, 5)), rng.standard_normal((5, 9))
    x, y = linalg.from_numpy(spark, a), linalg.from_numpy(spark, b)
    for made in (linalg.matmul(x, y), linalg.matmul_blocks(x, y, 3)):
        assert np.allclose(linalg.to_numpy(made, (7, 9)), a @ b, atol=1e-8)
    assert np.array_equal(linalg.to_numpy(linalg.transpose(x), (5, 7)), a.T)
    with pytest.raises(ValueError):
        linalg.run("invert", x)


def test_a_pair_of_blocks_at_a_time(spark, monkeypatch):
    """Python gets a group for each pair of blocks, never a batch of many."""
    a = np.arange(1.0, 31.0).reshape(3, 10)
    x, y = linalg.from_numpy(spark, a), linalg.from_numpy(spark, a.T)
    made = linalg.matmul_blocks(x, y, 2)
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(linalg.to_numpy(made, (3, 3)), a @ a.T)


def test_least_squares(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1.0), (1, [1.0, 1.0], 3.0), (2, [1.0, 2.0], 5.0)], "i long, a array<double>, y double")
    ata, aty = linalg.gram(rows)
    assert linalg.to_numpy(ata, (2, 2)).tolist() == [[3, 3], [3, 5]]
    assert {r.i: r.v for r in aty.collect()} == {0: 9.0, 1: 13.0}
    assert [round(r.x, 9) for r in linalg.least_squares(rows, 2).orderBy("j").collect()] == [1.0, 2.0]


def test_generated_rows_do_not_depend_on_partitions(spark):
    truth = np.random.default_rng(7).standard_normal(4)
    row = lambda i: linalg.seeded_row(i, 4, truth)
    got = [r.x for r in linalg.least_squares(linalg.generated_rows(spark, 300, row), 4).orderBy("j").collect()]
    made = [row(i) for i in range(300)]
    want = np.linalg.lstsq(np.array([a for a, _ in made]), np.array([y for _, y in made]), rcond=None)[0]
    assert np.allclose(got, want, atol=1e-6)


def test_close_is_numpys(spark):
    a = np.array([[1.0, 2.0]])
    b = a + np.array([[1e-9, 1e-3]])
    got = relational.close(linalg.from_numpy(spark, a), linalg.from_numpy(spark, b), ["i", "j"]).first()
    assert got.all_close is bool(np.allclose(a, b)) and abs(got.max_abs_diff - 1e-3) < 1e-9
