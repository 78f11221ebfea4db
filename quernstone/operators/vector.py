"""Exact and approximate nearest neighbours by cosine, recall, encoders."""

from __future__ import annotations

import math
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..staging import stage

#: Queries that one pass over the vectors answers; their matrix is all that tasks are sent.
BATCH = 4096


def exact_knn(vectors: DataFrame, query: list[float], k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one vector: id, score (cosine, 6 digits). ``where`` filters rows before the search."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col), F.round(X.cosine(F.col(vector_col), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` nearest of every query, other ids only.

    Queries go in batches of 4096 to all partitions, where matrix products score tiles of them against tiles of the partition's rows and keep k;
    the partitions' bests then meet by query. No pair leaves its task unless it may be among the k. Null ids and vectors take no part.
    """
    rows = _plain(vectors, id_col, vector_col)

    def scorer(ids: np.ndarray, unit: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, k, digits)
            for batch in batches:
                best.offer(batch["id"].to_numpy(), _units(_matrix(batch["v"])), unit)
            yield from best.found()

        return run

    return _in_batches(_plain(queries, id_col, vector_col), k, lambda ids, unit: rows.mapInArrow(scorer(ids, unit), FOUND))


def rank_within(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double"


def _plain(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), X.doubles(F.col(vector_col)).alias("v")).where("id is not null and v is not null")


def _in_batches(asked: DataFrame, k: int, search: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """The k best of all queries (id, v): ``search`` gets ids and unit vectors of BATCH queries at a time, by id; of many batches each is its own small table."""
    parts, last = [], None
    while True:
        own = (asked if last is None else asked.where(F.col("id") > last)).orderBy("id").limit(BATCH).collect()
        if not own:
            break
        last = own[-1]["id"]
        part = search(np.array([r["id"] for r in own]), _units(np.array([r["v"] for r in own])))
        parts.append(stage(part, "batch") if parts or len(own) == BATCH else part)
    if not parts:
        return asked.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return rank_within(found, k)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, without a Python object for each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 1)


def _units(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size > 0, size, 1.0)


#: Queries and rows whose scores are held at once: 4 MB.
TILE = (1024, 512)


class _Best:
    """The ``k`` best rows seen of each query, as arrays: higher scores (rounded), then smaller ids. A query's own id is none of them."""

    def __init__(self, ids: np.ndarray, k: int, digits: int):
        self.ids, self.k, self.digits = ids, k, digits
        self.score, self.item = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def offer(self, own: np.ndarray, vectors: np.ndarray, unit: np.ndarray, asked: np.ndarray | None = None, allowed: Callable | None = None, over: float | None = None) -> None:
        """Rows ``own`` with unit ``vectors``, to the queries ``asked`` (positions; else all) with their ``unit`` vectors, tile by tile.

        ``allowed`` (positions of queries, a slice of rows) says which pairs count, ``over`` which scores; a tile without any isn't multiplied.
        """
        asked = np.arange(len(self.ids)) if asked is None else asked
        for b in range(0, len(own), TILE[1]):
            rows = slice(b, b + TILE[1])
            for a in range(0, len(asked), TILE[0]):
                at = asked[a : a + TILE[0]]
                fits = None if allowed is None else allowed(at, rows)
                if fits is not None and not fits.any():
                    continue
                scores = unit[at] @ vectors[rows].T
                scores[self.ids[at][:, None] == own[None, rows]] = -np.inf
                if fits is not None:
                    scores[~fits] = -np.inf
                if over is not None:
                    scores[scores <= over] = -np.inf
                floor = self.score[at, -1]
                if not np.isfinite(floor).all() and scores.shape[1] > self.k:  # nothing to compare with yet: the tile's own kth
                    floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
                # rounding may lift a score by half a unit of its last digit
                q, c = np.nonzero((scores >= (floor - 10.0**-self.digits)[:, None]) & np.isfinite(scores))
                if len(q):
                    self._take(at, q, own[rows][c], np.round(scores[q, c], self.digits))

    def _take(self, at: np.ndarray, q: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        there = np.unique(q)
        q = np.concatenate([q, np.repeat(there, self.k)])
        items, scores = np.concatenate([items, self.item[at[there]].ravel()]), np.concatenate([scores, self.score[at[there]].ravel()])
        order = np.lexsort((items, -scores, q))
        q, items, scores = q[order], items[order], scores[order]
        first = np.searchsorted(q, there)
        chosen = first[:, None] + np.arange(self.k)
        self.score[at[there]], self.item[at[there]] = scores[chosen], items[chosen]

    def found(self) -> Iterator[pa.RecordBatch]:
        q, place = np.nonzero(np.isfinite(self.score))
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.item[q, place]), pa.array(self.score[q, place])], ["query_id", "vec_id", "score"])


#: Share of its cells that an index looks into if not told otherwise: what vectors without clusters need for a recall of 0.9.
PROBED = 0.75


def latencies(vectors: DataFrame, queries: DataFrame, k: int = 10, n: int = 100, *, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[str, float]:
    """P50, P95 and P99 in milliseconds of ``n`` single searches, one after another: jobs of their own, so scheduling is part of each."""
    took = []
    for row in queries.orderBy(id_col).limit(n).select(vector_col).collect():
        began = time.perf_counter()
        exact_knn(vectors, list(row[0]), k, id_col=id_col, vector_col=vector_col).collect()
        took.append((time.perf_counter() - began) * 1000)
    return {f"p{p}": round(float(np.percentile(took, p)), 2) for p in (50, 95, 99)} if took else {}


class IvfIndex:
    """Vectors dealt to k-means cells; a search looks at the ``probes`` cells nearest to the query and ranks them exactly."""

    # cells are fitted on about ``fit_rows`` vectors at most, chosen by a hash of the id; all are dealt to them
    def __init__(self, vectors: DataFrame, cells: int = 16, *, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = 50_000, seed: int = 1):
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), X.unit(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
        units = stage(rows, "units")  # fitting passes over them again and again
        n, rows = units.count(), units.withColumn("features", array_to_vector("v"))
        fit = rows if n <= fit_rows else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
        self.model = KMeans(k=cells, seed=seed, maxIter=15).fit(fit)
        self.centers = np.array(self.model.clusterCenters())
        self.rows = stage(self.model.transform(rows).select("vec_id", "v", F.col("prediction").alias("cell")), "cells")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """query_id, vec_id, score, rank. A task multiplies each cell's rows with the vectors of the queries that probe it, and keeps k of each."""
        probes, centers = probes or math.ceil(len(self.centers) * PROBED), self.centers

        def scorer(ids: np.ndarray, unit: np.ndarray) -> Callable:
            near = np.argsort(-(unit @ centers.T), axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(ids), len(centers)), bool)
            probed[np.arange(len(ids))[:, None], near] = True

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = _Best(ids, k, 6)
                for batch in batches:
                    own, cell, vectors = batch["vec_id"].to_numpy(), batch["cell"].to_numpy(), _matrix(batch["v"])
                    for c in np.unique(cell):
                        here = cell == c
                        best.offer(own[here], vectors[here], unit, np.flatnonzero(probed[:, c]))
                yield from best.found()

            return run

        return _in_batches(_plain(queries, id_col, vector_col), k, lambda ids, unit: self.rows.mapInArrow(scorer(ids, unit), FOUND))


class SketchIndex:
    """Vectors with sketches of ``bits`` signs of random projections, an eighth of the vectors' bytes; a search compares sketches with all rows and
    ranks exactly only the nearest ``share`` of them.

    Unlike cells, this prunes vectors without clusters too. How near a sketch must be is found for each query from the counts of all distances,
    so the share is of the whole table. Null vectors take no part; all must be of one length. No vectors give no results.
    """

    def __init__(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 256, seed: int = 5):
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), X.doubles(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
        first = rows.select(F.size("v")).first()
        size, rng = (first[0] if first else 1), np.random.default_rng(seed)
        # blocks of projections at right angles tell more than independent ones
        self.planes = np.hstack([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-bits // size))])[:, :bits]
        planes = self.planes

        def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    unit = _units(np.stack(batch["v"].to_numpy()))
                    yield pd.DataFrame({"vec_id": batch["vec_id"], "v": list(unit), "code": [x.tobytes() for x in np.packbits(unit @ planes > 0, axis=1)]})

        self.rows = stage(rows.mapInPandas(sketch, "vec_id long, v array<double>, code binary"), "sketches")
        self.n = self.rows.count()

    def search(self, queries: DataFrame, k: int = 10, share: float = 0.15, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
        """query_id, vec_id, score, rank: the ``k`` nearest other ids among the ``share`` of rows with the nearest sketches (ties included)."""

        def near(ids: np.ndarray, unit: np.ndarray) -> DataFrame:
            codes = _words(np.packbits(unit @ self.planes > 0, axis=1))
            counted = self.rows.select("code").mapInArrow(_distances(codes), "query int, apart int, n long").groupBy("query", "apart").agg(F.sum("n").alias("n"))
            so_far = F.sum("n").over(W.partitionBy("query").orderBy("apart"))
            reached = counted.withColumn("n", so_far).where(F.col("n") >= max(k + 1, share * self.n)).groupBy("query").agg(F.min("apart").alias("apart"))
            reach = np.zeros(len(ids), np.int64) if self.n > k else np.full(len(ids), self.planes.shape[1])
            for query, apart in reached.collect():
                reach[query] = apart
            return self.rows.mapInArrow(_near(ids, unit, codes, reach, k, digits), FOUND)

        asked = _plain(queries, id_col, vector_col)
        return _in_batches(asked if self.n else asked.limit(0), k, near)


def _words(codes: np.ndarray) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return _words(np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(batch), -1))


def _apart(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many signs differ: queries x rows."""
    out = np.zeros((len(codes), len(own)), np.int32)
    for j in range(own.shape[1]):
        out += np.bitwise_count(codes[:, j, None] ^ own[None, :, j])
    return out


def _distances(codes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = codes.shape[1] * 64 + 1
        seen = np.zeros((len(codes), width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            own = _codes(batch)
            for a in range(0, len(codes), TILE[0]):
                here = codes[a : a + TILE[0]]
                base = width * np.arange(len(here))[:, None]
                for b in range(0, len(own), TILE[1]):
                    seen[a : a + TILE[0]] += np.bincount((_apart(here, own[b : b + TILE[1]]) + base).ravel(), minlength=len(here) * width).reshape(len(here), width)
        query, apart = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(apart.astype(np.int32)), pa.array(seen[query, apart])], ["query", "apart", "n"])

    return run


def _near(ids: np.ndarray, unit: np.ndarray, codes: np.ndarray, reach: np.ndarray, k: int, digits: int) -> Callable:
    """Each query's k best of a task's rows whose sketches are within its reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, k, digits)
        for batch in batches:
            if len(batch):
                own = _codes(batch)
                best.offer(batch["vec_id"].to_numpy(), _matrix(batch["v"]), unit, allowed=lambda at, rows, own=own: _apart(codes[at], own[rows]) <= reach[at][:, None])
        yield from best.found()

    return run


def lsh_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, width: float = 0.5, reach: float = 1.4) -> DataFrame:
    """Approximate neighbours by random projections of unit vectors, ranked exactly. ``reach`` bounds the distance, so recall may be below 1.

    A pair is a candidate if some table has both in one bucket. Tasks hold the queries' buckets and look for candidates among their rows, so no
    pair is written; at the default width nearly all pairs are candidates, which takes time as an exact search does, but no disk.
    """
    rows = _plain(vectors, id_col, vector_col)
    first = rows.select(F.size("v")).first()
    planes = np.random.default_rng(3).standard_normal((first[0] if first else 1, tables))
    planes /= np.sqrt((planes * planes).sum(axis=0))

    def scorer(ids: np.ndarray, unit: np.ndarray) -> Callable:
        asked = np.floor(unit @ planes / width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, k, 6)
            for batch in batches:
                vectors = _units(_matrix(batch["v"]))
                own = np.floor(vectors @ planes / width)

                def meet(at: np.ndarray, rows: slice, own: np.ndarray = own) -> np.ndarray:
                    found = np.zeros((len(at), len(own[rows])), bool)
                    for t in range(tables):
                        found |= asked[at, t, None] == own[None, rows, t]
                    return found

                best.offer(batch["id"].to_numpy(), vectors, unit, allowed=meet, over=1.0 - reach * reach / 2.0)
            yield from best.found()

        return run

    return _in_batches(_plain(queries, id_col, vector_col), k, lambda ids, unit: rows.mapInArrow(scorer(ids, unit), FOUND))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, strategies: tuple[str, ...] = ("exact",), index: IvfIndex | None = None) -> dict[str, tuple[DataFrame, float]]:
    """Results and seconds by strategy: exact, ivf, lsh, sketch. An unknown one raises ValueError."""
    k, out = X.clamp(k), {}
    for name in strategies:
        if name not in ("exact", "ivf", "lsh", "sketch"):
            raise ValueError(f"unknown strategy: {name}")
        began = time.perf_counter()
        if name == "exact":
            found = batch_knn(vectors, queries, k)
        elif name == "ivf":
            index = index or IvfIndex(vectors)
            found = index.search(queries, k)
        elif name == "sketch":
            found = SketchIndex(vectors).search(queries, k)
        else:
            found = lsh_knn(vectors, queries, k)
        out[name] = (stage(found, name), time.perf_counter() - began)
    return out


def hashing_encoder(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a sentence encoder: 384 signed sums of hashed words, unit length."""
    size = 384

    def one(text: str | None) -> list[float]:
        v = np.zeros(size, np.float32)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h >> 31 else -1.0
        return (v / (float(np.sqrt((v * v).sum())) or 1.0)).tolist()

    return texts.map(one)


def encode(rows: DataFrame, text_col: str, encoder: Callable[[pd.Series], pd.Series] = hashing_encoder, out_col: str = "embedding") -> DataFrame:
    """Adds the vector of a text; ``encoder`` gets a batch of texts."""
    return rows.withColumn(out_col, F.pandas_udf(encoder, "array<float>")(F.col(text_col)))
