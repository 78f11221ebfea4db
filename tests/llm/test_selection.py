import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat, decontaminate, mixing, topk


# --- mixing ---


def fill(sizes, weights, ceiling):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > ceiling * sizes[s] * (1 + 1e-12)]
        if not over:
            return target | fixed
        fixed |= {s: float(ceiling * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_sizes(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(0, 40)), rng.choice(["b", "a", None, "é", "Z", "hot", "hot", "hot", "hot"])) for i in range(400)] + [(900, None, "a"), (901, "", "none")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.pareto_mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes, (1, 2, 3), 3)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1e-9 for s in sizes)
    again = mixing.pareto_mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_inclusion_follows_appeal(spark):
    rows = [(i, "a b c d", "s", 1.0 + i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, appeal double")
    got = mixing.pareto_mix(df.union(df.limit(0)), appeal_col="appeal").groupBy(F.col("doc_id") % 2).agg(F.avg("copies")).collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] / share[0] == pytest.approx(2, rel=0.1) and share[0] + share[1] == pytest.approx(2, abs=0.01)


def test_what_a_bound_takes_is_reshared(spark):
    """Appeals so unequal that some documents reach the bound: expected copies add up to the target, by appeal among the others."""
    rng = np.random.default_rng(8)
    size, appeal = rng.integers(1, 30, 3000), rng.choice([0.2, 1.0, 3.0, 40.0], 3000, p=[0.3, 0.4, 0.2, 0.1])
    rows = [(i, "w " * int(size[i]), "ab"[i % 2], float(appeal[i]), None) for i in range(3000)] + [(5000, None, None, None, 1), (5001, "w", "z", -1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, appeal double, pull int")
    got = {r.doc_id: r for r in mixing.pareto_mix(df, appeal_col="appeal", max_copies=3).collect()}
    for source in "ab":
        own = [r for r in got.values() if r.source == source]
        ids = np.array([r.doc_id for r in own])
        target, s, a = own[0].target, size[ids].astype(float), appeal[ids]
        low, high = 0.0, 1e6  # the rate whose bounded shares make the target
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if (s * np.minimum(3, c * a)).sum() < target else (low, c)
        want = np.minimum(3, low * a)
        assert (want == 3).any() and abs((s * want).sum() - target) < 1e-3
        copies = np.array([r.copies for r in own])
        assert abs((s * copies).sum() - target) <= s.max()
        for x in np.unique(a):
            assert copies[a == x].mean() == pytest.approx(want[a == x][0], abs=0.1)
        assert ((copies >= np.floor(want - 1e-9)) & (copies <= np.ceil(want + 1e-9))).all()
    assert got[5001].copies == 0 == got[5000].copies


def test_pareto_order_includes_as_asked():
    """With unequal odds the order's fixed-size samples hit the asked probabilities closely."""
    rng = np.random.default_rng(2)
    p = np.array([0.1, 0.3, 0.5, 0.7, 0.4] * 20)
    n, hits = round(p.sum()), np.zeros(len(p))
    for _ in range(3000):
        u = rng.random(len(p))
        hits[np.argsort((u / (1 - u)) / (p / (1 - p)))[:n]] += 1
    assert np.abs(hits / 3000 - p).max() < 0.05


def test_materialised_mix(spark):
    df = spark.createDataFrame([(i, "x y", "s") for i in range(30)], "doc_id long, text string, source string")
    mix = mixing.pareto_mix(df)
    assert mixing.repeat_documents(df, mix).count() == mix.agg(F.sum("copies")).first()[0]


# --- top-k ---


def plain_topk(rows, asked, k, scale=256):
    whole = {i: [math.floor(scale * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(set(asked) & set(whole)):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_topk_is_that_of_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.1, 1, 100])]) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(400, None), (402, [1.0] * 7 + [None]), (404, [float("nan")] * 8), (406, [1.0, 2.0]), (408, [2.0, 1.0]), (410, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain_topk(rows, [i for i, _ in rows if i % 10 == 0], 5)


def test_topk_with_large_numbers_and_few_rows(spark):
    rows = [(0, [3e6, -1.0]), (1, [2e6, 5.0]), (2, [-3e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df, k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain_topk(rows, [0, 1, 2], 5)
    assert topk.top_k(df, df.limit(0)).count() == 0 == topk.top_k(df.limit(0), df).count()


# --- decontamination ---


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_hits(text, items, window):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        x = plain_words(t)
        n = min(window, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[a : a + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("seed", "small"), [(1, 400_000), (2, 0)])
def test_hits_are_those_of_all_windows(spark, monkeypatch, seed, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "É", "é", "x1", "Ab", "cd", "ef", "gh", "ij", "Klm"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 8, 9, 20])))) for i in range(12)] + [(50, None), (51, "--"), (3, "the of")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 3)):
            x = rng.choice(items)[1] or ""
            at = rng.randrange(0, len(own) + 1)
            own[at:at] = x.upper().split() if rng.random() < 0.5 else x.split()
        docs.append((i, rng.choice([" ", "-", "\n"]).join(own)))
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame([*items, (None, "the of")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(df, bench).collect()}
    want = {i: plain_hits(t, items, 8) for i, t in docs}
    assert got == want and any(v[2] for v in want.values())
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, bench, min_items=2).collect()}
    assert kept == {i for i, v in want.items() if len(v[2]) < 2}


def plain_contained(text, items, shingle, share):
    w, found = plain_words(text), set()
    for i, t in items:
        x = plain_words(t)
        k = min(shingle, len(x))
        own = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if x else set()
        for a in range(max(1, len(w) - len(x) + 1)):
            part = w[a : a + len(x)]
            have = {tuple(part[b : b + k]) for b in range(len(part) - k + 1)} & own
            if own and len(have) >= share * len(own) - 1e-9:
                found.add(str(i))
    return found


@pytest.mark.parametrize(("seed", "small", "share"), [(1, 400_000, 0.8), (2, 0, 0.8), (3, 400_000, 0.5), (4, 400_000, 1.0)])
def test_contained_items_are_those_of_all_windows(spark, monkeypatch, seed, small, share):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    rng = random.Random(seed)
    word = lambda: rng.choice("the of a é É x1 ab cd".split()) if rng.random() < 0.5 else rng.choice("klm nop qrs tuv wxy zab cde fgh".split()) + str(rng.randrange(9))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 5, 9, 20, 40])))) for i in range(14)] + [(50, None), (51, "--"), (52, "klm " * 12)]
    docs = []
    for i in range(80):
        own = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            x = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if x:
                    x[rng.randrange(len(x))] = rng.choice([word(), "", word() + " " + word()])
            at = rng.randrange(0, len(own) + 1)
            own[at:at] = x[rng.choice([0, 0, 2]) :]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(own)))
    docs += [(100, None), (101, ""), (None, items[5][1])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n int").repartition(3)
    bench = spark.createDataFrame([*items, (None, "the of")], "item_id long, text string")
    got = {}
    for r in decontaminate.contained_items(df, bench, share=share).collect():
        got.setdefault(r.id, set()).add(r.item)
    want = {i: f for i, t in docs if (f := plain_contained(t, items, 5, share))}
    assert got == want and len(want) > 5
    clash = df.withColumnRenamed("n", "_id").withColumn("_Hash", F.lit("x"))
    left = decontaminate.drop_containing(clash, bench, share=share)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == clash.columns
    assert kept == {i for i, _ in docs} - set(want)


# --- chat ---


def test_branches(spark):
    # 1 - 2 - 4 and 1 - 3 - 5 - 6, 7 a root of its own under a parent that isn't there, 8 and 9 in a ring with 10 below
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 2.0), ("t", 4, 2, 5.0), ("t", 5, 3, 1.0), ("t", 6, 5, None), ("u", 7, 99, 1.0), ("v", 8, 9, 1.0), ("v", 9, 8, 1.0), ("v", 10, 9, 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.reply_paths(df, best=5).orderBy("tree", "branch", "depth").collect():
        paths.setdefault((r.tree, r.branch), []).append(r.node)
    assert paths == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5, 6], ("u", 1): [7]}
    assert {r.leaf for r in chat.reply_paths(df).collect()} == {4, 7}


def plain_branches(rows, best):
    """Each tree's best root-to-leaf paths, by walking up from each leaf."""
    parent = {(t, n): p for t, n, p, _ in rows}
    score = {(t, n): x or 0.0 for t, n, _, x in rows}
    inner = {(t, p) for t, n, p, _ in rows if (t, p) in parent}
    found = {}
    for t, n, _, _ in rows:
        if (t, n) in inner:
            continue
        path, at = [], n
        while (t, at) in parent and at not in path:
            path.append(at)
            at = parent[t, at]
        if (t, at) not in parent or at is None:
            found.setdefault(t, []).append((-sum(score[t, x] for x in path), n, path[::-1]))
    return {(t, k + 1): p for t, own in found.items() for k, (_, _, p) in enumerate(sorted(own)[:best])}


@pytest.mark.parametrize("best", [1, 3])
def test_branches_are_those_of_all_walks(spark, best):
    rng, rows = random.Random(best), []
    for t in range(40):
        n = rng.choice([1, 2, 5, 17, 60])
        for i in range(n):
            up = rng.choice([None, 1000 + i]) if rng.random() < 0.05 or i == 0 else max(0, i - rng.choice([1, 1, 1, 2, 5])) if rng.random() < 0.8 else rng.randrange(i)
            rows.append((f"t{t}", i, up, rng.choice([None, 0.0, 1.0, 2.0, -1.0])))
    df = spark.createDataFrame([(*r, "x") for r in rows], "tree string, node long, parent long, score double, branch string").repartition(5)
    got = {}
    for r in sorted(chat.reply_paths(df, best=best).collect(), key=lambda r: (r.tree, r.branch, r.depth)):
        assert r.depth == len(got.setdefault((r.tree, r.branch), []))
        got[r.tree, r.branch].append(r.node)
    assert got == plain_branches(rows, best) and sum(len(p) for p in got.values()) > 150


def test_no_paths_are_written_before_ranking(spark, monkeypatch):
    """A chain of 300 messages with a leaf each has 45,150 rows of paths; those written are a few for each message and the one that stays."""
    rows = [("t", i, i - 1 if i else None, 1.0) for i in range(300)] + [("t", 1000 + i, i, 1.0) for i in range(300)]
    written, stage = [], chat.stage

    def counted(df, name):
        out = stage(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(chat, "stage", counted)
    got = chat.reply_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double")).orderBy("depth").collect()
    assert [r.node for r in got] == [*range(300), 1299] and max(written) <= 600


def test_long_thread(spark):
    rows = [("t", i, i - 1 if i else None, 1.0) for i in range(70)]
    got = chat.reply_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double")).orderBy("depth").collect()
    assert [r.node for r in got] == list(range(70)) == [r.depth for r in got]


def test_round_trip(spark):
    rng = random.Random(4)
    bits = ["<|turn|>", "<|text|>", "<|end|>", "\\", "<\\|", "<", "|", "\n", "a", "é", "</s>", "[INST]", "\U0001f600", " "]
    rows = [("c%d" % (i // 6), i % 6, rng.choice(["user", "assistant", "assistant", None, "<|end|>\n\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "conv string, turn int, role string, text string")
    messages = chat.linear_messages(df, "conv", "turn", "role", "text")
    out = chat.format_paths(chat.reply_paths(messages.select("tree", "node", "parent", "score")), messages)
    got = out.select(F.substring("tree", 2, 9).alias("c"), "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert len(got) == 20
    for r in got:
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r.c))
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in own]
        assert r.said == "".join(text for _, role, text in own if role == "assistant")
        # the mask covers just the assistant's texts: what is left of the string has the other turns alone
        cut = "".join(ch for k, ch in enumerate(r.formatted) if not any(s.start <= k < s.start + s.size for s in r.loss))
        assert cut.count("<|turn|>assistant<|text|><|end|>") == sum(role == "assistant" for _, role, _ in own)
