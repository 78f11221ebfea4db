"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import if_small, stage
from .names import without

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of one level of the search for a source's threshold; two levels leave about one row in 16 million to order.
BINS = 4096
#: Columns that the mix adds.
MADE = ("size", "source_size", "target", "copies", "taken")


def uniform(id_col: str, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the md5 of the seed and the id."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_copies: int, share: float = 1.0) -> DataFrame:
    """Targets of sources (key, source, source_size): ``share`` of all sizes split by weight, none above ``max_copies`` times its size.

    Weights repeat over the sources in code point order, null last. Resharing the excess until no target is above its ceiling is
    filling to one water level: sources are ordered by ceiling over weight, and the level is what is left for the first source that
    it does not fill, a weight. One row a source goes through one task here, never a document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("ceiling", F.col("source_size").cast("double") * float(max_copies))
    by_fill = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everywhere = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (
        F.sum(F.col("source_size").cast("double")).over(everywhere) * share - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_fill))
    open_place = F.when(F.col("ceiling") >= F.col("weight") * F.col("level"), F.struct("place", "level"))
    ranked = ranked.withColumn("water", F.min(open_place).over(everywhere)["level"])
    filled = F.least(F.col("ceiling"), F.coalesce(F.col("weight") * F.col("water"), F.col("ceiling")))
    return ranked.select("key", "source", "source_size", filled.alias("target"))


def pareto_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_copies: int = 3,
    appeal_col: str | None = None,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many copies of each document a mix takes.

    A document's expected copies are its source's target over the source's size, times its ``appeal_col`` over the source's
    size-weighted mean if one is given, at most ``max_copies``: what that bound takes from some is shared by the others of the source,
    by appeal, until none is above it (``_rates``). It gets the whole part for certain. What is left of the target in
    words goes to further single copies in Pareto order: a uniform number's odds over the odds of the fractional part, ascending, up
    to the row whose middle word passes what is left. That row is found from sums over two levels of bins, so no source is ever
    ordered as a whole: only the rows of one bin in 16 million are.

    Returns a row per input row: ``id_col``, ``source_col``, size, source_size, target, copies, taken. A size counts runs of
    characters other than white space of ASCII; null and empty texts have size 0 and take 0 words. Null sources are one source, after the others.
    Rows of the same id and size draw the same number, are next to each other in the order and can't be told apart in the result.
    A null or negative appeal counts as 0, and a source whose appeals are all 0 takes nothing. An empty table gives an empty result. Other
    columns are not read, but with ``keep``, these columns of each row stand in place of id and source (but those that are named as what is
    made is, which this replaces), and tied rows are ordered by a hash of them.
    """
    keep = tuple(without(keep, MADE))
    appeal = F.greatest(F.coalesce(F.col(appeal_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if appeal_col else F.lit(1.0)
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        appeal.alias("appeal"),
        uniform(id_col, seed).alias("u"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    sized = stage(sized, "sized")
    totals = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("appeal")).alias("pull"))
    totals = stage(totals, "totals")
    targets = source_targets(totals.drop("pull"), weights, max_copies).join(totals.select("key", "pull"), "key")
    targets = if_small(stage(targets, "targets"), 100_000)

    if appeal_col:
        targets = _rates(sized, targets, max_copies)
        rate = F.col("rate") * F.col("appeal")
    else:
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = sized.join(targets.drop("source"), "key").withColumn("expected", F.least(rate, F.lit(float(max_copies))))
    drawn = drawn.withColumn("whole", F.floor("expected").cast("long")).withColumn("part", F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("part") / (1.0 - F.col("part")))
    free = (F.col("whole") < max_copies) & (F.col("part") > 0)
    drawn = drawn.withColumn("rank", F.when(free, odds / (1.0 + odds)))
    drawn = drawn.withColumn("bin", F.floor(F.col("rank") * BINS).cast("long"))
    drawn = drawn.withColumn("fine", F.floor((F.col("rank") * BINS - F.col("bin")) * BINS).cast("long"))
    carried = ["row"] if keep else []
    drawn = stage(drawn.select("id", "source", "key", "size", "source_size", "target", "whole", "rank", "bin", "fine", *carried), "drawn")

    need = drawn.groupBy("key").agg((F.max("target") - F.sum(F.col("whole") * F.col("size")).cast("double")).alias("need"))
    bins = drawn.where("bin is not null").groupBy("key", "bin").agg(F.sum("size").alias("words"))
    at_bin = _first_past(bins, need, "bin")
    edge = if_small(stage(at_bin, "edge"), 100_000)
    fines = drawn.join(edge, ["key", "bin"]).groupBy("key", "fine").agg(F.sum("size").alias("words"))
    at_fine = _first_past(fines, edge.select("key", "need"), "fine").select("key", "fine", F.col("need").alias("need_fine"))
    at_fine = if_small(stage(at_fine, "fine"), 100_000)

    edges = edge.select("key", F.col("bin").alias("edge_bin")).join(at_fine.withColumnRenamed("fine", "edge_fine"), "key", "left")
    edges = edges.join(need.select("key", F.col("need").alias("need_all")), "key", "right")
    edges = if_small(stage(edges, "edges"), 100_000)
    placed = drawn.join(edges, "key")
    before = F.col("bin") < F.col("edge_bin")
    at = F.col("bin") == F.col("edge_bin")
    sure = F.col("edge_bin").isNull() & (F.col("need_all") > 0) | before | at & F.coalesce(F.col("fine") < F.col("edge_fine"), F.lit(True))
    sure = F.col("bin").isNotNull() & F.coalesce(sure, F.lit(False))
    tied = F.coalesce(at & (F.col("fine") == F.col("edge_fine")), F.lit(False))
    ordered = W.partitionBy("key").orderBy("rank", "id", "size", *map(F.xxhash64, carried)).rowsBetween(W.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("size").over(ordered), F.lit(0)) + F.col("size") / 2.0
    close = placed.where(tied).withColumn("more", F.when(middle <= F.col("need_fine"), 1).otherwise(0))
    rest = placed.where(~tied).withColumn("more", F.when(sure, 1).otherwise(0))
    both = rest.unionByName(close).withColumn("copies", F.col("whole") + F.col("more"))
    return both.select(
        *([F.col("row.*")] if keep else [F.col("id").alias(id_col), F.col("source").alias(source_col)]),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def _rates(sized: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``targets`` with each source's rate: the copies for an appeal of 1, such that the expected words, none over ``max_copies``, make the target.

    Documents that the bound holds are set aside and the rest is shared by the others, which may bring more to the bound; each round
    adds up one row a source, and the rates only rise, until no more documents are set aside.
    """
    rates = targets.withColumn("rate", F.when(F.col("pull") > 0, F.col("target") / F.col("pull")).otherwise(0.0))
    held = None
    while True:
        rates = if_small(stage(rates, "rates"), 100_000)
        full = F.col("rate") * F.col("appeal") >= max_copies
        sums = sized.join(rates.select("key", "rate"), "key").groupBy("key").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("bound"), F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("appeal"))).alias("free"), F.count(F.when(full, 1)).alias("n")
        )
        sums = if_small(stage(sums, "sums"), 100_000)
        if (now := sums.agg(F.sum("n")).first()[0] or 0) == held or not now:
            return rates
        held = now
        left = F.col("target") - F.col("bound") * float(max_copies)
        rates = rates.join(sums, "key").withColumn("rate", F.when((F.col("free") > 0) & (left > 0), F.greatest("rate", left / F.col("free"))).otherwise(F.col("rate")))
        rates = rates.drop("bound", "free", "n")


def _first_past(bins: DataFrame, need: DataFrame, bin_col: str) -> DataFrame:
    """The first bin of each key at whose end the words pass ``need``, and the need that is left at its start. At most BINS rows a key."""
    upto = F.sum("words").over(W.partitionBy("key").orderBy(bin_col))
    found = bins.withColumn("upto", upto).join(need, "key").where(F.col("upto") > F.col("need"))
    first = found.groupBy("key").agg(F.min(F.struct(bin_col, "upto", "words", "need")).alias("x"))
    return first.select("key", F.col(f"x.{bin_col}"), (F.col("x.need") - (F.col("x.upto") - F.col("x.words"))).alias("need"))


def repeat_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as ``mix`` says, with its copy's number. Ids must be unique."""
    times = mix.where("copies > 0").select(id_col, "copies")
    return docs.join(times, id_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
