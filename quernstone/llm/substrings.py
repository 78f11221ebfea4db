"""Removal of repeated passages found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import buckets as count_buckets
from ..staging import stage
from .hashing import Words, pieces

#: Differences of places in COVER give all residues of PERIOD, so any two runs of PERIOD places have a pair of them in step.
PERIOD, COVER = 7, (0, 1, 3)
#: Entries that a task holds before it hands them on.
FLUSH = 1 << 20
PACK = "bucket int, found boolean, body binary"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays by planes of bytes, compressed: the high bytes of sorted or small numbers cost next to nothing."""
    parts, codec = [], pa.Codec("zstd", compression_level=1)
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
        packed = codec.compress(raw, asbytes=True) if raw else b""
        parts += [np.array([len(x), x.dtype.itemsize, len(packed)], np.int64).tobytes(), packed]
    return b"".join(parts)


def _spread(body: bytes) -> list[np.ndarray]:
    found, at, codec = [], 0, pa.Codec("zstd")
    while at < len(body):
        n, width, size = np.frombuffer(body, np.int64, 3, at).tolist()
        at += 24
        raw = np.frombuffer(codec.decompress(body[at : at + size], n * width, asbytes=True) if size else b"", np.uint8)
        found.append(np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(f"u{width}"))
        at += size
    return found


class _Shelf:
    """Entries (hash, place) of documents on their way to the buckets of their hashes.

    Entries of width 4 are anchors: 32 bits of their hashes within a bucket, since what they find is looked at again. Those of width 8
    decide, so they have 128 bits: a second hash goes with each.

    What a task can settle itself does not travel: where several documents of a load have a hash, those that are not the first of them
    are found by that alone, and only the first one's entries go on. So a bucket gets one document a load of any hash, however common.
    """

    def __init__(self, buckets: int, width: int, later_only: bool):
        self.buckets, self.width, self.later_only = buckets, width, later_only
        self.clear()

    def clear(self) -> None:
        self.docs: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.seconds: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.n = 0

    def add(self, doc: tuple, hashes: np.ndarray, places: np.ndarray, second: np.ndarray | None = None) -> None:
        self.docs.append(np.array([*doc, len(hashes)], np.int64))
        self.hashes.append(hashes)
        self.seconds.append(np.zeros(0, np.uint64) if second is None else second)
        self.places.append(places.astype(np.uint32))
        self.n += len(hashes)

    def flush(self) -> Iterator[tuple[int, bool, bytes]]:
        """Packs: of each bucket of hashes, keys (sorted), each entry's document and place, and the documents; and what is found, by document."""
        if not self.n:
            return
        docs, hashes, second, places = np.stack(self.docs), np.concatenate(self.hashes), np.concatenate(self.seconds), np.concatenate(self.places)
        self.clear()
        owner = np.repeat(np.arange(len(docs), dtype=np.uint32), docs[:, 2])
        bucket = ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        key = hashes if self.width == 8 else hashes & np.uint64(0xFFFFFFFF)
        order = np.lexsort((second, key, bucket) if len(second) else (key, bucket))
        bucket, key, owner, places = bucket[order], key[order], owner[order], places[order]
        second = second[order] if len(second) else second
        ids = docs[owner, 0]
        first, found = _settle(_changes(key, second) | (bucket[1:] != bucket[:-1]), ids, self.later_only)
        yield from ((to, True, body) for to, body in _by_document(docs[:, 0], docs[:, 1], owner[found], places[found], self.buckets))
        bucket, key, owner, places = bucket[first], key[first], owner[first], places[first]
        second = second[first] if len(second) else second
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            used, own = np.unique(owner[a:b], return_inverse=True)
            steps = np.diff(key[a:b], prepend=np.uint64(0)).astype(f"u{self.width}")
            yield int(bucket[a]), False, _squeeze(steps, own.astype(np.uint32), places[a:b], docs[used, 0], docs[used, 1], second[a:b])


def _changes(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where sorted entries differ from the one before; without seconds, by their keys alone."""
    change = key[1:] != key[:-1]
    return change | (second[1:] != second[:-1]) if len(second) else change


def _settle(change: np.ndarray, ids: np.ndarray, later_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries, split at ``change``: which are of their group's smallest id, and which are found: in a group of two ids or more, and
    if ``later_only`` not of the smallest."""
    at = np.flatnonzero(np.concatenate([[True], change]))
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))
    least, most = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    first = ids == least[group]
    return first, ~first if later_only else (least < most)[group]


def _by_document(ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packs of places, dealt by document."""
    if not len(doc):
        return
    to = deal(ids, buckets)[doc]
    order = np.lexsort((place, doc, to))
    doc, place, to = doc[order], place[order], to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        used, own = np.unique(doc[a:b], return_inverse=True)
        yield int(to[a]), _squeeze(own.astype(np.uint32), place[a:b], ids[used], marks[used])


def _table(found: list[tuple[int, bool, bytes]]) -> pa.Table:
    return pa.table([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.binary())], ["bucket", "found", "body"])


def _rows(found: Iterator[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for x in found:
        yield from _table([x]).to_batches()


def _is_cover(place: np.ndarray) -> np.ndarray:
    return np.isin(place % PERIOD, COVER)


def _anchors(window: int, buckets: int):
    size = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = _Shelf(buckets, 4, later_only=False)
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, to, data, bounds in pieces(batch.column(2)):
                words = Words(data, bounds, lower=False)
                hashes = words.runs(size)
                for row, a, b in zip(range(first, to), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    if b - a >= window:
                        places = np.flatnonzero(_is_cover(np.arange(b - a - size + 1)))
                        shelf.add((ids[row], marks[row]), hashes[a + places], places)
                if shelf.n >= FLUSH:
                    yield from _rows(shelf.flush())
        yield from _rows(shelf.flush())

    return run


def _shared(later_only: bool, buckets: int):
    """Of one bucket's packs: what tasks found, and the entries whose hash is in two documents (in one of a smaller id, if later_only)."""

    def run(table: pa.Table) -> pa.Table:
        keys, seconds, docs, places, ids, marks, base, out = [], [], [], [], [], [], 0, []
        for bucket, done, body in zip(*(table.column(c).to_pylist() for c in ("bucket", "found", "body")), strict=True):
            if done:
                out.append((bucket, True, body))
                continue
            steps, own, place, doc, mark, second = _spread(body)
            keys.append(np.cumsum(steps, dtype=np.uint64))
            seconds.append(second)
            docs.append(own.astype(np.int64) + base)
            places.append(place)
            ids.append(doc.view(np.int64))
            marks.append(mark.view(np.int64))
            base += len(doc)
        if keys:
            key, second, doc, place, ids, marks = map(np.concatenate, (keys, seconds, docs, places, ids, marks))
            order = np.lexsort((second, key)) if len(second) else np.argsort(key, kind="stable")
            key, doc, place = key[order], doc[order], place[order]
            found = _settle(_changes(key, second[order] if len(second) else second), ids[doc], later_only)[1]
            out += [(to, True, body) for to, body in _by_document(ids, marks, doc[found], place[found], buckets)]
        return _table(out)

    return run


def deal(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each document."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = deal(batch.column(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

    return run


def _places(packs: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """The places of each (id, text hash)."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for body in packs.column("body").to_pylist():
        own, place, ids, marks = _spread(body)
        at = np.searchsorted(own, np.arange(len(ids) + 1)).tolist()
        for k, doc in enumerate(zip(ids.view(np.int64).tolist(), marks.view(np.int64).tolist(), strict=True)):
            found.setdefault(doc, []).append(place[at[k] : at[k + 1]])
    return {k: np.unique(np.concatenate(v)).astype(np.int64) for k, v in found.items()}


def _reach(places: np.ndarray, back: int, ahead: int, n: int) -> np.ndarray:
    """Which of n places are from ``back`` before to ``ahead`` after one of ``places``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(places - back, 0, n), 1)
    np.add.at(step, np.clip(places + ahead + 1, 0, n), -1)
    return np.cumsum(step[:n]) > 0


def _windows(window: int, buckets: int):
    """The whole windows that hold an anchor of two documents, on their way to the buckets of their hashes."""

    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        found, shelf, out = _places(packs), _Shelf(buckets, 8, later_only=True), []
        docs = docs.combine_chunks()
        ids, marks = docs.column("id").to_numpy(), docs.column("mark").to_numpy()
        for first, to, data, bounds in pieces(docs.column("text")):
            near = [found.get(x) for x in zip(ids[first:to].tolist(), marks[first:to].tolist(), strict=True)]
            if all(x is None for x in near):
                continue
            words = Words(data, bounds, lower=False)
            again = words.again()
            for k, places in enumerate(near):
                a, n = words.first[k], words.first[k + 1] - words.first[k]
                if places is not None and n >= window:
                    at = np.flatnonzero(_reach(places, PERIOD - 1, 0, n - window + 1))
                    shelf.add((ids[first + k], marks[first + k]), words.runs(window, a + at), at, words.runs(window, a + at, again))
            if shelf.n >= FLUSH:
                out += shelf.flush()
        out += shelf.flush()
        return _table(out)

    return run


KEPT = "id long, n_words long, n_removed long, text string"


def _kept(docs: pa.Table, found: dict[tuple[int, int], np.ndarray], window: int) -> pa.Table:
    docs = docs.combine_chunks()
    ids, marks = docs.column("id").to_pylist(), docs.column("mark").to_pylist()
    n_words, n_removed, texts = [], [], []
    for first, to, data, bounds in pieces(docs.column("text")):
        raw = data.tobytes()
        for k in range(to - first):
            words = raw[bounds[k] : bounds[k + 1]].split()
            n = len(words)
            places = found.get((ids[first + k], marks[first + k]))
            if places is not None and n >= window:
                gone = _reach(places, 0, window - 1, n)
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            n_words.append(n)
            n_removed.append(n - len(words))
            texts.append(b" ".join(words).decode("utf-8", "replace"))
    return pa.table([docs.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "text"])


def _removed(window: int):
    return lambda docs, packs: _kept(docs, _places(packs), window)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _kept(pa.Table.from_batches([batch]), {}, 1).to_batches()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Documents without the words inside a window of ``window`` words that also starts in a document of a smaller id.

    1. Of the windows of window - 6 words, only those at places 0, 1 and 3 modulo 7 are hashed. Whatever two places a repeated window
       starts at, some anchor of this kind lies inside both copies at the same distance, so both documents have it.
    2. Anchors of two documents or more are extended: the whole windows around them are hashed to 128 bits, and the smallest id of each
       is found. Two different windows among 1e13 are taken for one with a chance of 1.5e-13.
    3. Words under a window of a smaller id go.

    Hashes travel as sorted, compressed packs, dealt by hash, after each task has settled what its own documents have in common; what is
    found travels back dealt by document. Words are runs without ASCII
    white space, unchanged. Returns a row per input row: id_col, n_words, n_removed, text (kept words, joined by one space). Null, empty
    and short texts lose nothing, nor does a row with a null id, which is no earlier copy of others either; such rows are not dealt at all. Rows that share an id
    are judged each by its text and are no earlier copies of each other. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    buckets = count_buckets(source)
    whole = source.where("id is not null").mapInArrow(_deal(buckets), "bucket int, id long, mark long, text string")
    anchors = source.where("id is not null").mapInArrow(_anchors(window, buckets), PACK)
    shared = stage(anchors.groupBy("bucket").applyInArrow(_shared(False, buckets), PACK), "shared")
    windows = whole.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_windows(window, buckets), PACK)
    later = stage(windows.groupBy("bucket").applyInArrow(_shared(True, buckets), PACK), "later")
    out = whole.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(_removed(window), KEPT)
    out = out.unionByName(source.where("id is null").mapInArrow(_whole, KEPT))
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def kept_hash(text: Column) -> Column:
    return F.sha2(text, 256)
