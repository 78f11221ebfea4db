"""Near-duplicate documents by SuperMinHash signatures, banding, verification and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import buckets, if_small, stage
from .components import POINTERS, connected_components, pointers, relabel, roots
from .hashing import Words, mix, pieces, shingle_sets

BANDS, ROWS = 25, 5
SIGNATURE = BANDS * ROWS
#: A pair of one cluster is verified if its signatures agree by the threshold less this. For a binomial estimate that misses a pair at
#: 0.85 with a chance of 4e-11 and one at 0.80 of 3e-10, far less than the banding does.
SLACK = 0.24
#: Members and bytes of a block of a large cluster.
BLOCK, BLOCK_BYTES = 2000, 8 << 20


def superminhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """Signatures (sets x m, float64; an empty set's are inf).

    Each element goes through the places in an order of its own, a permutation drawn step by step, and offers rank + uniform number
    at the place of each step, so the ranks it offers are correlated: one of each. A place keeps the least offer. Elements of a set
    stop as soon as their rank can't lower any place. Whole batches take a step at a time.
    """
    kept = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for a in _cuts(sets):
        _offer(kept, owner[a], element[a], m)
    return kept


def _cuts(sets: list[np.ndarray], most: int = 32_000) -> Iterator[slice]:
    """Slices of the elements at the ends of sets; a set that is larger than ``most`` is one."""
    ends = np.cumsum([len(s) for s in sets]) if sets else np.zeros(1, int)
    at = 0
    while at < ends[-1]:
        k = np.searchsorted(ends, at + most, "right")
        to = ends[k - 1] if k and ends[k - 1] > at else ends[k]
        yield slice(int(at), int(to))
        at = to


def _offer(kept: np.ndarray, owner: np.ndarray, element: np.ndarray, m: int) -> None:
    order, flat, scale = None, kept.reshape(-1), float(2**-53)
    for step in range(m):
        first = mix(element + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (first >> np.uint64(11)).astype(np.float64) * scale + step
        pick = step + ((mix(first) >> np.uint64(32)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            rows = np.arange(len(element))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
        np.minimum.at(flat, owner * m + place, value)
        live = np.zeros(len(kept), bool)
        ids = np.unique(owner)
        live[ids] = kept[ids].max(axis=1) > step + 1
        stay = live[owner]
        if not stay.any():
            return
        if order is None:
            order = np.empty((int(stay.sum()), m), np.uint8 if m <= 256 else np.uint16)
            order[:] = np.arange(m)
            rows = np.arange(len(order))
            order[rows, pick[stay]] = 0
        else:
            order = order[stay]
        owner, element = owner[stay], element[stay]


SKETCH = "id long, mark long, n long, f1 long, f2 long, bands array<long>, signature binary"


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for a, b, data, bounds in pieces(batch.column(2)):
                sets = shingle_sets(Words(data, bounds, lower=True), k)
                kept = superminhash(sets)
                bits = mix(kept.view(np.uint64))
                weights = np.array([mix(np.array([7919 * (r + 1)], np.uint64))[0] | np.uint64(1) for r in range(ROWS)])
                tags = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
                bands = mix((bits.reshape(-1, BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64) + tags).view(np.int64)
                size = np.array([len(s) for s in sets])
                f1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                low = (bits >> np.uint64(56)).astype(np.uint8)
                offsets = np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        marks.slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(f1),
                        pa.array(f2),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["id", "mark", "n", "f1", "f2", "bands", "signature"],
                )

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sets that aren't empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _spoked(percent: int, k: int):
    """Links between the first text of each group (the head, whose ``lead`` is set) and the others; no more than the head's set is held.

    Rows of one node, which are repeated rows of the input, follow each other; all but the first are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, last = np.zeros(0, np.uint64), None
        for batch in batches:
            heads, lead, nodes = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            found = []
            for a, _, data, bounds in pieces(batch.column(4)):
                for i, own in enumerate(shingle_sets(Words(data, bounds, lower=True), k), a):
                    if lead[i]:
                        head = own
                    elif nodes[i] != last and alike(head, own, percent):
                        found.append(i)
                    last = nodes[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[found], pa.int64()), pa.array(heads[found], pa.int64())], ["u", "v"])

    return run


def _linked(percent: int, k: int):
    """Links of the members of each group (sorted by group) that join different parts: a spanning forest of the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                parts = t.column("part").to_numpy()
                # a task of two blocks has the pairs across them; those within are the tasks' of one block
                sides = t.column("own").to_numpy() if key[1] != key[2] else None
                u, v = forest(t.column("node").to_numpy(), t.column("text"), t.column("signature").to_pylist(), percent, k, parts, sides)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (own := tuple(keys[:, a].tolist())) != key:
                    yield from flush()
                    held, key = [], own
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def forest(
    ids: np.ndarray, texts: pa.ChunkedArray, signatures: list[bytes], percent: int, k: int, parts: np.ndarray | None = None, sides: np.ndarray | None = None
) -> tuple[list[int], list[int]]:
    """Pairs of ids with 100 * intersection >= percent * union; of those that would close a ring, none.

    Texts of one of the ``parts`` are known to be linked; with ``sides``, only pairs of different ones are looked at.

    Sets are of 64-bit hashes that have nothing of the words' form in them (see ``hashing``): for a pair of sets of 20,000 shingles the
    chance that any two different shingles are taken for one is 2e-11.
    """
    sets: list[np.ndarray] = []
    for _, _, data, bounds in pieces(texts):
        sets += shingle_sets(Words(data, bounds, lower=True), k)
    size = np.array([len(s) for s in sets])
    signed = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(sets), -1)
    label = np.arange(len(sets)) if parts is None else np.unique(parts, return_inverse=True)[1]
    u, v = [], []
    least = percent / 100 - SLACK
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest if sides is None else rest[sides[rest] != sides[i]]
        rest = rest[(label[rest] != label[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        if not len(rest):
            continue
        agree = (signed[rest] == signed[i]).mean(axis=1)
        for j in rest[np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]].tolist():
            if label[j] != label[i] and alike(sets[i], sets[j], percent):
                label[label == label[j]] = label[i]
                u.append(int(ids[i]))
                v.append(int(ids[j]))
    return u, v


def _grid(members: DataFrame) -> DataFrame:
    """Members of clusters of several parts, once for each pair of blocks (i, j) that they are needed for.

    If a cluster is larger than a block and one part holds half of it or more, that part has blocks of its own, which don't meet each other.
    """
    sized = members.groupBy("component", "part").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    per = sized.groupBy("component").agg(F.max(F.struct("c", "part", "e")).alias("top"), F.sum("c").alias("c"), F.sum("e").alias("e"), F.count("*").alias("parts"))
    blocks = lambda c, e: F.greatest(F.ceil(c / BLOCK), F.ceil(e * 8 / BLOCK_BYTES)).cast("long")
    split = (blocks(F.col("c"), F.col("e")) > 1) & (F.col("top.c") * 2 >= F.col("c"))
    first = F.when(split, blocks(F.col("top.c"), F.col("top.e"))).otherwise(F.lit(0).cast("long"))
    rest = F.when(split, blocks(F.col("c") - F.col("top.c"), F.col("e") - F.col("top.e"))).otherwise(blocks(F.col("c"), F.col("e")))
    per = per.where("parts > 1").select("component", F.col("top.part").alias("main"), first.alias("first"), (first + rest).alias("all"))
    dealt = members.join(if_small(stage(per, "per"), 500_000), "component")
    in_main = (F.col("first") > 0) & (F.col("part") == F.col("main"))
    deal = F.xxhash64("node", F.lit(5))
    dealt = dealt.withColumn("own", F.when(in_main, F.pmod(deal, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(deal, F.col("all") - F.col("first"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(in_main, F.col("first")).otherwise(F.lit(0).cast("long")), F.col("all") - 1)))
    return dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "part", "id", "mark", "node", "signature")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """Near-duplicate classes of documents whose shingle sets have 100 * intersection >= percent * union.

    1. One pass makes each document's SuperMinHash signature, the hashes of its bands and a 128-bit fingerprint of its set.
    2. Documents of one set are a class, with a number of its own; one of its texts stands for it from here on.
    3. Classes with a band in common are tied to the band's smallest.
    4. Each class is verified on full sets with the one of those smallest that it has most bands in common with; a text goes out once.
       Each of these links points from a class to a smaller one, one at most from each; the classes under one root are a part. A large group
       of copies costs its length.
    5. Ties between different parts make clusters of them; what is left is pairs of different parts of a cluster.
       A cluster's texts meet in one task, or if it is large, in a task per pair of its blocks:
       blocks of the largest part, which meet those of the rest alone, and blocks of the rest. Pairs with similar sizes and signatures are
       verified on full sets. Only links that join parts leave the task.
    6. The components of parts by these links are the result, named by the smallest id of their classes.

    Tables of pointers up to a number go to all tasks, so that few steps shuffle anything; beyond it they are joined.

    At 0.85, 25 bands of 5 miss a pair with a chance of 4.3e-7, if nothing else links it, and the signatures of step 5 with 4e-11: 4.3e-7
    in sum; at 0.80, 4.9e-5 and 3e-10: 4.9e-5 in sum.

    Returns a row per input row: id_col, n_shingles, component_id (the smallest id reachable), kept (id = component_id). Words are runs
    without ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle. Null and empty texts have no
    shingles and are linked with nothing. A row with a null id is linked with nothing: component_id is null, kept true. Rows that share
    an id are judged each by its text, and no text's links are lost to the other. An empty table gives an empty result. Columns other
    than the two are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    sketch = stage(source.mapInArrow(_sketches(words), SKETCH), "sketch")
    real = sketch.where("n > 0 and id is not null")
    # bands and signatures are of the set, so any row's will do; numbers are written once, so that a task that runs again can't deal others
    classes = real.groupBy("f1", "f2", "n").agg(
        F.min(F.struct("id", "mark")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    classes = stage(classes.select("*", "least.*").drop("least").withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("band", "head")
    shared = keyed.join(heads, "band").where("node <> head").groupBy(F.col("node").alias("u"), F.col("head").alias("v")).agg(F.count("*").alias("bands"))
    ties = stage(shared, "ties")

    spokes = stage(ties.groupBy("u").agg(F.max_by("v", F.struct("bands", -F.col("v"))).alias("head")), "spokes")
    load = if_small(stage(spokes.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("salts")), "load"), 500_000)
    rims = spokes.join(load, "head").select("head", F.pmod(F.xxhash64("u", F.lit(7)), "salts").alias("salt"), F.lit(False).alias("lead"), F.col("u").alias("node"))
    hubs = load.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("lead"), F.col("head").alias("node"))
    wheel = if_small(stage(rims.unionByName(hubs), "wheel"), 500_000)
    wheel = if_small(stage(classes.select("node", "id", "mark").join(wheel, "node"), "wheel"), 500_000)
    texts = source.join(wheel, ["id", "mark"]).select("head", "salt", "lead", "node", "text")
    dealt = texts.repartition(buckets(source), "head", "salt").sortWithinPartitions("head", "salt", F.desc("lead"), "node")
    parts = roots(stage(dealt.mapInArrow(_spoked(percent, words), "u long, v long"), "linked"))
    part = if_small(parts, POINTERS)

    clusters = stage(connected_components(relabel(ties.select("u", "v"), part, "u", "v")).select(F.col("node").alias("part"), "component"), "clusters")
    members = relabel(classes.select(F.col("node").alias("part"), "node", "id", "mark", "signature", "n"), part, "part").join(if_small(clusters, POINTERS), "part")
    grid = if_small(stage(_grid(stage(members, "members")), "grid"), 500_000)
    texts = source.join(grid, ["id", "mark"]).select("component", "i", "j", "own", "part", "node", "signature", "text")
    dealt = texts.repartition(buckets(source), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = stage(dealt.mapInArrow(_linked(percent, words), "u long, v long"), "links")

    tops = pointers(relabel(links, part, "u", "v"))
    linked = stage(relabel(parts.select("u", "v"), if_small(tops, POINTERS), "v").unionByName(tops.select("u", "v")), "linked")
    ids = classes.select(F.col("node").alias("u"), "id").join(if_small(linked, POINTERS), "u")
    least = stage(ids.groupBy("v").agg(F.min("id").alias("least")), "least")
    least = classes.select(F.col("node").alias("v"), "id").join(if_small(least, POINTERS), "v").select("v", F.least("id", "least").alias("first"))
    least = stage(least, "least")
    named = linked.join(if_small(least, POINTERS), "v").select(F.col("u").alias("node"), "first").unionByName(least.select(F.col("v").alias("node"), "first"))
    named = classes.select("node", "f1", "f2", "n", "id", "copies").join(if_small(stage(named, "named"), POINTERS), "node", "left")
    # a text that is alone in its class and linked with none is its own component
    named = named.where("copies > 1 or first is not null").select("f1", "f2", "n", F.coalesce("first", "id").alias("component_id"))
    out = sketch.select("id", "n", "f1", "f2").join(if_small(stage(named, "named"), POINTERS), ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that ``near_duplicates`` does not keep; a row with a null id stays."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
