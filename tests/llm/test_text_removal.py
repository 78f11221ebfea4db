import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import lines, substrings


def brute_repeats(docs, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_are_those_of_all_windows(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcde") + str(rng.randrange(40)) for _ in range(rng.choice([12, 13, 14, 19, 20, 40]))] for _ in range(12)]
    docs = []
    for i in range(120):
        own = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            own += [str(rng.random())[:5] for _ in range(rng.randrange(0, 9))] + p[rng.randrange(0, 3) : len(p) - rng.randrange(0, 3)]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(own)))
    docs += [(500, None), (501, ""), (502, "é\u00a0ü " * 20), (503, "é\u00a0ü " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df).collect()}
    want = brute_repeats(docs, 13)
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_any_two_windows_have_a_common_anchor():
    size = 13 - substrings.PERIOD + 1
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            steps = [d for d in range(13 - size + 1) if (i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER]
            assert steps


def test_words_of_one_polynomial_hash_are_not_removed(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    b, tail = a.translate({97: 98, 98: 97}), " " + " ".join(map(str, range(12)))
    df = spark.createDataFrame([(1, a + tail), (2, b + tail), (3, "x " + a + tail)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()) == [(1, 0), (2, 0), (3, 13)]


def test_null_ids_lose_nothing(spark):
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, text), (None, text), (None, None), (3, text), (3, text), (5, text + " end")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df).collect())
    assert got == [(0, 0, 0, ""), (0, 20, 0, text), (0, 20, 0, text), (3, 20, 0, text), (3, 20, 0, text), (5, 21, 20, "end")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(docs, per_edit, most):
    placed = [(i, n, x) for i, t in docs if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    first = {}
    for i, n, x in sorted(placed):
        first.setdefault(x, (i, n))
    texts = list(first)
    near = {x: [] for x in texts}
    for k, a in enumerate(texts):
        for b in texts[:k]:
            t = min(min(len(a), len(b)) // per_edit, most)
            if t and abs(len(a) - len(b)) <= t and distance(a, b) <= t:
                near[a].append(b)
                near[b].append(a)
    out = {}
    for i, t in docs:
        own, kept, removed, links = ([] if t is None else t.split("\n")), [], 0, 0
        for n, x in enumerate(own):
            links += len(near.get(x, ())) if x.strip(" ") else 0
            if x.strip(" ") and ((i, n) != first[x] or any(first[y] < first[x] for y in near[x])):
                removed += 1
            else:
                kept.append(x)
        out[i] = (len(own), removed, links, None if t is None else "\n".join(kept))
    return out


def edited(rng, s, k, letters):
    s = list(s)
    for _ in range(k):
        o, p = rng.random(), rng.randrange(len(s) + 1)
        if o < 0.33:
            s.insert(p, rng.choice(letters))
        elif s and o < 0.66:
            s.pop(min(p, len(s) - 1))
        elif s:
            s[min(p, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance_is_the_edit_distance(spark, most):
    rng, rows = random.Random(most), []
    for _ in range(1500):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 30)))
        rows.append((a, edited(rng, a, rng.randrange(0, 6), "abcé ")))
    df = spark.createDataFrame(rows + [("", ""), ("a" * 300, "a" * 299 + "b")], "x string, y string")
    got = lines.with_middles(df, "x", "y", most).select("x", "y", lines.distance(F.col("middle"), most).alias("d")).collect()
    for r in got:
        want = distance(r.x, r.y)
        assert r.d == want if want <= most else r.d > most, r
    assert len(got) == len(rows) + 2 and sum(r.d <= most for r in got) > 300


@pytest.mark.parametrize(("seed", "per_edit", "most", "crowd"), [(1, 20, 2, 200), (2, 8, 3, 200), (3, 20, 1, 200), (4, 20, 2, 2), (5, 8, 3, 2), (6, 20, 1, 2)])
def test_lines_are_those_of_all_pairs(spark, monkeypatch, seed, per_edit, most, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "SAMPLE", 1 if crowd == 2 else 1024)
    monkeypatch.setattr(lines, "SEEN", 3)
    rng, letters = random.Random(seed), "abcdeé ü"

    base = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 18, 19, 20, 21, 25, 38, 39, 40, 41, 42, 60, 90]))) for _ in range(40)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 2, 3, 4]), letters) for _ in range(rng.randrange(0, 8)))) for i in range(90)]
    docs += [(200, None), (201, ""), (202, "  \n\n" + base[3])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_lines string").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.text) for r in lines.dedup_lines(df, per_edit=per_edit, most=most).collect()}
    want = brute_lines(docs, per_edit, most)
    assert got == want
    assert sum(v[1] for v in want.values()) > 60


def test_one_segment_in_common_makes_no_pairs_of_all(spark, monkeypatch):
    """100,000 lines with a common start, as long as their segment and more: few pairs are compared, and planted copies are found."""
    made, count = [], lines._paired

    def counted(marked, per_edit, most):
        made.append(marked.groupBy("stamp").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("held")).agg(F.sum(F.col("n") * F.col("held"))).first()[0] or 0)
        return count(marked, per_edit, most)

    monkeypatch.setattr(lines, "_paired", counted)
    start = "the same start of every line there is: "
    own = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)
    df = spark.range(100_000).select(F.concat(F.lit(start), own).alias("line"))
    df = df.unionByName(spark.range(20).select(F.concat(F.lit(start[:-1]), F.substring(own, 1, 39), F.lit("x")).alias("line")))
    df = df.select(F.unhex(F.md5("line")).alias("key"), "line")
    got = lines.line_links(df).join(df.withColumnsRenamed({"key": "a", "line": "x"}), "a").join(df.withColumnsRenamed({"key": "b", "line": "y"}), "b").select("x", "y").collect()
    assert len(got) == 20 and {distance(r.x, r.y) for r in got} <= {1, 2}
    assert len(made) > 1 and sum(made) < 100 * 100_000


def test_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 3)
    common = "the same line stands in every document there is, at its top"
    docs = [(i, common + f"\nbut the line number {i} below it is of its own, {'abcdefghij'[i] * 9}") for i in range(10)] + [(20, common[:-1])]
    got = {r.doc_id: (r.n_removed, r.n_links) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (0, 1)} | {i: (1, 1) for i in range(1, 10)} | {20: (1, 1)}
