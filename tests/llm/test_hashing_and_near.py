import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quernstone import staging
from quernstone.llm import components, near
from quernstone.llm.components import connected_components
from quernstone.llm.hashing import Words, pieces, shingle_sets

TEXTS = ["a b c d e f", "", "A  b\tc d E f ", "x y", None, "é ü b c d e f g", "x", "yz w", "\u00a0 q"]


@pytest.mark.parametrize("most", [1, 12, 1 << 20])
def test_words_are_split_as_bytes_are(most):
    found = []
    for a, b, data, bounds in pieces(pa.array(TEXTS), most):
        w = Words(data, bounds, lower=False)
        for k in range(b - a):
            own = slice(w.first[k], w.first[k + 1])
            found.append([bytes(data[x:y]) for x, y in zip(w.start[own], w.end[own], strict=True)])
    assert found == [(t or "").encode().split() for t in TEXTS]


def test_shingles_do_not_depend_on_place_or_case():
    sets = [s for _, _, d, b in pieces(pa.array(TEXTS)) for s in shingle_sets(Words(d, b, lower=True), 5)]
    assert [len(s) for s in sets] == [2, 0, 2, 1, 0, 4, 1, 1, 1]
    assert np.array_equal(sets[0], sets[2])
    assert len({int(s[0]) for s in (sets[3], sets[6], sets[7])}) == 3


@pytest.mark.parametrize("n", [4, 20, 150, 1500])
def test_signatures_estimate_similarity_with_less_spread_than_minhash(n):
    rng, errors = np.random.default_rng(n), []
    for _ in range(80):
        base = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a, b = base[: int(1.5 * n)], base[n // 2 :]
        s = near.superminhash([a, b, np.zeros(0, np.uint64)])
        assert np.isfinite(s[:2]).all() and np.isinf(s[2]).all()
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 1.1 * (0.25 / near.SIGNATURE) ** 0.5


def test_signature_is_a_minimum_over_elements():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(2))
    whole = near.superminhash([np.unique(np.concatenate([a, b]))])[0]
    assert np.array_equal(whole, np.minimum(*near.superminhash([a, b])))


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = w.encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def copies(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    bases, docs = [[word() for _ in range(rng.choice([3, 30, 80, 160]))] for _ in range(6)], []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = word()
        docs.append((i * 3 + 1, " ".join(own).upper() if rng.random() < 0.2 else "\n".join(own)))
    return docs + [(5000, ""), (5001, None), (5002, " \t"), (5003, ""), (5004, "solo"), (5005, "SOLO")]


@pytest.mark.parametrize("block", [2000, 7])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = copies(block, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df, percent=85).collect()}
    want = brute(docs, 85)
    assert got == want
    assert len({v[1] for v in want.values()}) < 120


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_miss_far_less_than_bands_do(percent):
    p, m = percent / 100, near.SIGNATURE
    miss = sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1) if k / m < p - near.SLACK)
    assert miss < 1e-3 * (1 - p**near.ROWS) ** near.BANDS
    # 80 or 85 words of 100: a pair at the threshold, whose signatures agree in 80 of 125 places
    texts = pa.chunked_array([pa.array([" ".join(f"w{i}" for i in range(percent)), " ".join(f"w{i}" for i in range(100))])])
    signed = [bytes(m), bytes(80) + b"\x01" * (m - 80)]
    assert near.forest(np.array([1, 2]), texts, signed, percent, 1) == ([1], [2])


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert sorted((r.doc_id or 0) for r in near.drop_near_duplicates(df).collect()) == [0, 0, 1]


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2 ** 64 agree for any base."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_of_one_polynomial_hash_differ(spark):
    a, b = thue_morse(1024)
    (w,) = [Words(d, bounds, lower=False) for _, _, d, bounds in pieces(pa.array([a, b, a[:70], b[:70], "a" * 100, "a" * 101]))]
    assert len(set(w.hash.tolist())) == 6 == len(set(w.again().tolist())) and not set(w.hash.tolist()) & set(w.again().tolist())
    tail = " " + " ".join(map(str, range(12)))
    df = spark.createDataFrame([(1, a + tail), (2, b + tail), (3, b), (4, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_duplicates(df, percent=100).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_texts_that_share_an_id_keep_their_links(spark):
    """Different texts of one id are judged each by its text; both have links, which are not lost."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end"), (4, c), (0, b + " x y")]
    got = near.near_duplicates(spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, node int, mark string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 0, False), (3, 1, False), (4, 4, True)]


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_only_pairs_of_different_parts_are_dealt(spark, monkeypatch):
    """A cluster of one part goes nowhere; the blocks of a part that holds most of one meet the rest's alone; each pair of parts meets."""
    monkeypatch.setattr(near, "BLOCK", 5)
    rows = [(1, 100, n) for n in range(40)] + [(2, 200, n) for n in range(100, 140)] + [(2, 300 + n % 2, n) for n in range(140, 147)] + [(3, n, n) for n in range(200, 212)]
    df = spark.createDataFrame([(c, p, n, n, 0, b"", 1) for c, p, n in rows], "component long, part long, node long, id long, mark long, signature binary, n long")
    met, sent = set(), {1: 0, 2: 0, 3: 0}
    groups = {}
    for r in near._grid(df).collect():
        groups.setdefault((r.component, r.i, r.j), []).append(r)
        sent[r.component] += 1
    for (_, i, j), own in groups.items():
        met |= {(a.node, b.node) for a in own for b in own if a.node < b.node and a.part != b.part and (i == j or a.own != b.own)}
    assert met == {(a, b) for c, p, a in rows for d, q, b in rows if c == d and p != q and a < b}
    assert sent[1] == 0 and sent[2] == 40 * 2 + 7 * 10 and sent[3] == 12 * 3


def plain_components(edges):
    label = {x: x for e in edges for x in e}
    for u, v in edges:
        old, new = max(label[u], label[v]), min(label[u], label[v])
        label = {k: new if x == old else x for k, x in label.items()}
    return label


@pytest.mark.parametrize("small", [64 << 20, -1])
def test_components_of_hubs_chains_and_repeated_edges(spark, monkeypatch, small):
    """With lookups sent to all tasks, and joined: hubs of any place in the order, a chain of no order, edges that come again."""
    monkeypatch.setattr(staging, "SMALL_BYTES", small)
    rng = random.Random(5)
    chain = rng.sample(range(1000, 1040), 40)
    edges = [(500, i) for i in range(40)] + [(41, i) for i in range(42, 70)] + list(zip(chain[:-1], chain[1:], strict=True)) + [(-3, 2**60), (2**60, -3)]
    edges += [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)] + edges[:30]
    got = [(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()]
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and dict(got) == want


def test_near_duplicates_beyond_the_broadcast_bounds(spark, monkeypatch):
    """Rows that come again and no table small enough for all tasks: the same classes."""
    monkeypatch.setattr(staging, "SMALL_BYTES", -1)
    docs = copies(3, 40)
    got = near.near_duplicates(spark.createDataFrame(docs + docs, "doc_id long, text string").repartition(3), percent=85).collect()
    want = brute(docs, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted([(i, *v) for i, v in want.items()] * 2)


def test_steps_shuffle_no_more_than_they_need(spark, monkeypatch):
    """What has small tables to look up does so in the tasks; with many shuffle partitions, shuffles cost their number."""
    shuffles = []

    def counted(df, *name):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return staging.stage(df, *name)

    monkeypatch.setattr(near, "stage", counted)
    monkeypatch.setattr(components, "stage", counted)
    docs = copies(4, 60)
    counted(near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85))
    assert sum(shuffles) <= 30
    shuffles.clear()
    counted(connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")))
    assert sum(shuffles) <= 3
