"""Matrices as (i, j, v) rows: products, transposes, Gram matrices and least squares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "i long, j long, v double"


def from_numpy(spark: SparkSession, m: np.ndarray) -> DataFrame:
    i, j = np.indices(m.shape)
    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": m.ravel().astype(float)}), CELLS)


def to_numpy(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A small matrix on the driver."""
    out = np.zeros(shape)
    for i, j, v in cells.collect():
        out[i, j] = v
    return out


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product, as a join on the inner index and a sum; absent cells are 0."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matmul_blocks(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """The same for dense matrices: blocks are multiplied as arrays, so the join has block³ times fewer rows."""

    def blocked(m: DataFrame, row: str, col: str, width: str) -> DataFrame:
        cell = F.struct((F.col("i") % block).cast("int").alias("r"), (F.col("j") % block).cast("int").alias("c"), "v")
        return m.groupBy(F.floor(F.col("i") / block).alias(row), F.floor(F.col("j") / block).alias(col)).agg(F.collect_list(cell).alias(width))

    def dense(cells: pa.Array) -> np.ndarray:
        m, x = np.zeros((block, block)), cells.flatten()
        m[x.field("r").to_numpy(), x.field("c").to_numpy()] = x.field("v").to_numpy(zero_copy_only=False)
        return m

    def multiply(pair: pa.Table) -> pa.Table:
        bi, bj, m = pair["bi"][0].as_py(), pair["bj"][0].as_py(), np.zeros((block, block))
        for batch in pair.to_batches():
            for at in range(len(batch)):
                m += dense(batch["x"].slice(at, 1)) @ dense(batch["y"].slice(at, 1))
        i, j = np.nonzero(m)
        return pa.table({"i": i + bi * block, "j": j + bj * block, "v": m[i, j]})

    # a task's Python holds one pair of blocks at a time, not a batch of them
    pairs = blocked(a, "bi", "bk", "x").join(blocked(b, "bk", "bj", "y"), "bk")
    return pairs.groupBy("bi", "bj", "bk").applyInArrow(multiply, CELLS).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def generated_rows(spark: SparkSession, m: int, row: Callable[[int], tuple[list[float], float]]) -> DataFrame:
    """i, a array<double>, y: rows made on the executors from their number, so any partitioning gives the same."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [row(int(i)) for i in batch["id"]]
            yield pd.DataFrame({"i": batch["id"], "a": [list(map(float, x)) for x, _ in made], "y": [float(y) for _, y in made]})

    return spark.range(m).mapInPandas(make, "i long, a array<double>, y double")


def seeded_row(i: int, k: int, truth: np.ndarray, seed: int = 7, noise: float = 0.01) -> tuple[list[float], float]:
    rng = np.random.default_rng([seed, i])
    a = rng.standard_normal(k)
    return a.tolist(), float(a @ truth + noise * rng.standard_normal())


def gram(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AᵀA (i, j, v) and Aᵀy (i, v) of rows (a, y): each partition adds up its own, and only K² sums of each meet."""
    first = rows.select(F.posexplode("a").alias("i", "x"), "a")
    ata = first.select("i", "x", F.posexplode("a").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    aty = rows.select(F.posexplode("a").alias("i", "x"), "y").groupBy("i").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return ata.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"), aty.select(F.col("i").cast("long").alias("i"), "v")


def gram_dense(rows: DataFrame, k: int) -> DataFrame:
    """Both at once by matrix products in the partitions: i, j, v, where column K is Aᵀy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if len(batch):
                a = np.stack(batch["a"].to_numpy())
                total[:, :k] += a.T @ a
                total[:, k] += a.T @ batch["y"].to_numpy()
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return rows.select("a", "y").mapInPandas(run, CELLS).groupBy("i", "j").agg(F.sum("v").alias("v"))


def solve(ata: np.ndarray, aty: np.ndarray) -> np.ndarray:
    """The K×K system; K is small, so it is solved on the driver."""
    return np.linalg.solve(ata, aty)


def least_squares(rows: DataFrame, k: int) -> DataFrame:
    """j, x: normal-equation least squares, without intercept or regularisation."""
    both = to_numpy(gram_dense(rows, k), (k, k + 1))
    x = solve(both[:, :k], both[:, k])
    return rows.sparkSession.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "j long, x double")


OPERATIONS: dict[str, Callable] = {"matmul": matmul, "transpose": transpose, "solve": solve, "gram": gram}


def run(operation: str, *args):
    """An operation by name; an unknown one raises ValueError."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    return OPERATIONS[operation](*args)


def dense_fits(n: int, most: int = 15_000) -> bool:
    """Whether an n x n check in one machine's memory is made at all: three matrices of 8-byte numbers, 5.4 GB at 15,000."""
    return 0 < n <= most
