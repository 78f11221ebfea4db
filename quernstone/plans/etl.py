"""Linear pipelines of the batch jobs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import relational as R
from ..sources import files


def run_steps(steps: list[tuple[str, Callable[[], object]]], retries: int = 1) -> dict[str, int]:
    """Run steps in order, each again up to ``retries`` times if it fails; milliseconds of each."""
    took: dict[str, int] = {}
    for name, step in steps:
        for attempt in range(retries + 1):
            began = time.perf_counter()
            try:
                step()
                took[name] = int((time.perf_counter() - began) * 1000)
                break
            except Exception:
                if attempt == retries:
                    raise
    return took


def rates_job(spark: SparkSession, raw: str, clean: str, out: str) -> dict[str, int]:
    """Raw play files to clean ones to grouped rates, as one JSON line a group."""

    def prepare() -> None:
        rows = R.clean_plays(files.read_csv(spark, raw)).where("valid")
        files.write_csv(rows, clean, ["qtr", "down", "ydstogo", "yardline_100", "score_differential", "win"])

    def rate() -> None:
        files.write_jsonl(R.situation(files.read_csv(spark, clean, files.PLAYS)), out)

    return run_steps([("prepare", prepare), ("rates", rate)])


def listings_job(listings: DataFrame, encoder: Callable | None = None) -> DataFrame:
    """Clean listings with their vectors."""
    from ..operators import vector

    clean = R.clean_listings(listings).where("valid").drop("valid")
    return vector.encode(clean, "text", encoder) if encoder else vector.encode(clean, "text")
