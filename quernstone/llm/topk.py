"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage

#: Queries of one block; the block is collected and sent to the tasks, and is all that the driver ever holds of the vectors.
BLOCK = 2048
#: Parts into which each pass splits the range that holds a query's kth score.
BINS = 256
#: Score cells that a task holds at once.
CELLS = 1 << 22


class _Block:
    """Queries of one block, by dimension, with the range [low, low + BINS * width) in which each kth score lies."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int):
        self.ids, self.k = ids, k
        dims = np.array([len(v) for v in vectors])
        self.by_dim = {int(d): (np.flatnonzero(dims == d), np.stack([vectors[i] for i in np.flatnonzero(dims == d)])) for d in np.unique(dims)}
        self.low = np.zeros(len(ids), np.int64)
        self.width = np.ones(len(ids), np.int64)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries' numbers, candidates' ids, scores: queries x candidates) for the rows of a batch (id, vector of long)."""
        ids = batch.column(0).to_numpy()
        vectors = batch.column(1)
        offsets = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False)
        dims = np.diff(offsets)
        for d, (numbers, queries) in self.by_dim.items():
            rows = np.flatnonzero(dims == d)
            step = max(1, CELLS // max(1, len(numbers)))
            for a in range(0, len(rows), step):
                own = rows[a : a + step]
                found = values[offsets[own][:, None] + np.arange(d)]
                top = max(np.abs(queries).max(initial=0), 1) * float(max(np.abs(found).max(initial=0), 1)) * max(d, 1)
                exact = np.float64 if top < 2**53 else np.int64  # the products of whole numbers add up exactly in either
                yield numbers, ids[own], (queries.astype(exact) @ found.astype(exact).T).astype(np.int64)


def _histogram(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(block.ids) * (BINS + 1), np.int64)
        for batch in batches:
            for numbers, ids, scores in block.scores(batch):
                bins = np.minimum((scores - block.low[numbers][:, None]) // block.width[numbers][:, None], BINS)
                seen = (bins >= 0) & (ids[None, :] != block.ids[numbers][:, None])
                at = (numbers[:, None] * (BINS + 1) + bins)[seen]
                count += np.bincount(at, minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at // (BINS + 1)), pa.array(at % (BINS + 1)), pa.array(count[at])], ["query", "bin", "n"])

    return run


def _reached(block: _Block):
    """Per task: each query's scores above its kth, and of those equal to it no more than could still be among the k, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for numbers, ids, scores in block.scores(batch):
                good = (scores >= block.low[numbers][:, None]) & (ids[None, :] != block.ids[numbers][:, None])
                q, c = np.nonzero(good)
                found = pd.DataFrame({"query": numbers[q], "id": ids[c], "score": scores[q, c]})
                kept = found if kept is None else pd.concat([kept, found])
                kept = kept.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(block.k)
        if kept is not None and len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[kept["query"].to_numpy()]), pa.array(kept["id"].to_numpy()), pa.array(kept["score"].to_numpy())], ["query_id", "vec_id", "score"])

    return run


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if any is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def top_k(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256
) -> DataFrame:
    """Each query's k highest inner products with the vectors of other ids, exactly.

    Vectors are whole numbers, floor(scale * x). Queries are taken in blocks of 2048, by id; of each block

    1. every vector is scored, and each task counts its scores by 256 bins of the range that they can be in, from the largest norms;
    2. the bins' global sums tell which bin holds each query's kth score, and it is split again until it holds one value;
    3. every vector is scored once more and only scores that reach the kth value leave their task, of those equal to it the k smallest ids.

    The last step orders at most k rows a task for each query, ties to the smaller id. Scores are kept nowhere and no pairs are joined.

    Returns query_id, rank (from 1), vec_id, score; fewer than k if there are fewer vectors. Vectors that are null or hold a null or
    not finite component take no part, nor rows of a null id; only vectors of one length meet. A query id that repeats counts once, as
    its smallest vector; vectors of a repeated id count each. No queries or vectors give no rows. The sums must fit 63 bits.
    """
    spark = vectors.sparkSession
    real = vectors.select(F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    real = stage(real, "vectors")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    asked = stage(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    longest = real.agg(F.max(norm)).first()[0]
    parts, last = [], None
    while longest is not None:
        rest = asked if last is None else asked.where(F.col("id") > last)
        rows = rest.orderBy("id").limit(BLOCK).collect()
        if not rows:
            break
        last = rows[-1]["id"]
        block = _Block(np.array([r["id"] for r in rows], np.int64), [np.array(r["v"], np.int64) for r in rows], k)
        _locate(real, block, longest)
        parts.append(stage(real.mapInArrow(_reached(block), "query_id long, vec_id long, score long"), "block"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _locate(real: DataFrame, block: _Block, longest: float) -> None:
    """Narrow each query's range until it is its kth score alone; where fewer than k score, until it is below all."""
    for numbers, queries in block.by_dim.values():
        reach = np.ceil(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * longest * (1 + 1e-9)).astype(np.int64) + 1
        block.low[numbers] = -reach
        block.width[numbers] = -(-(2 * reach + 1) // BINS)
    above = np.zeros(len(block.ids), np.int64)
    while True:
        counted = real.mapInArrow(_histogram(block), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).collect()
        count = np.zeros((len(block.ids), BINS + 1), np.int64)
        for query, at, n in counted:
            count[query, at] = n
        past = count[:, BINS]  # scores beyond the range
        upto = past[:, None] + np.cumsum(count[:, BINS - 1 :: -1], axis=1)
        enough = upto >= block.k
        at = np.where(enough.any(axis=1), BINS - 1 - enough.argmax(axis=1), 0)
        done = block.width == 1
        block.low = block.low + at * block.width
        above = past
        if done.all():
            return
        block.width = np.where(done, 1, -(-block.width // BINS))
