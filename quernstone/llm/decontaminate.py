"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import is_small, stage
from .names import free_name

#: Between words, after A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows up to which the items' tables are broadcast: some 100 bytes a row.
SMALL = 400_000


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BREAK), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words array<string>, size int, items array<string>. A shorter item is one window; one without words, none."""
    listed = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    listed = listed.where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = listed.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("size", F.size("win"))


def word_counts(source: DataFrame, vocab: DataFrame, few: bool) -> DataFrame:
    """word, count over all documents (w array<string>) of the words of ``vocab``, which is broadcast if it is of ``few`` rows."""
    met = source.select(F.explode("w").alias("word"))
    return stage(met.join(F.broadcast(vocab), "word").groupBy("word").count() if few else met.groupBy("word").count().join(vocab, "word", "left_semi"), "rarity")


def item_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
) -> DataFrame:
    """Where item windows stand in documents.

    The window of ``window`` item words is the set that a document window of the same length must contain whole. Containment being
    all of it, one necessary prefix token is enough: the window's rarest word, by its count over all documents. A window with a word
    that no document has is dropped there. The exploded document words are joined with the prefix tokens; the token's place gives the
    only start that is possible, the length bounds keep that window inside the document, and the words are compared one by one.

    Returns a row per occurrence: id, text_hash (of the document's text; together they name a row), start (from 0), size, items array<string>.
    Null and empty texts have no words. Items with a null id take no part; repeated items and documents change nothing.
    """
    spark = docs.sparkSession
    wins = stage(item_windows(items, item_id_col, item_text_col, window).withColumn("win_id", F.monotonically_increasing_id()), "windows")
    vocab = stage(wins.select(F.explode("win").alias("word")).distinct(), "vocab")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("w"))
    few = is_small(vocab, SMALL) and is_small(wins, SMALL)
    rarity = word_counts(source, vocab, few)
    placed = wins.select("win_id", F.posexplode("win").alias("offset", "word"))
    placed = placed.join(rarity, "word", "left").groupBy("win_id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("rarest")
    )
    prefix = placed.where("rarest.n > 0").select("win_id", F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"))
    prefix = stage(prefix.join(wins, "win_id").drop("win_id"), "prefix")
    if few:
        near = source.select("id", "text_hash", "w", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
        near = near.join(F.broadcast(prefix), "word")
    else:  # only keys and places travel, and the texts of those that met are joined again
        met = source.select("id", "text_hash", F.posexplode("w").alias("at", "word")).join(prefix, "word").withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
        once = source.dropDuplicates(["id", "text_hash"]).withColumn("n", F.size("w"))
        near = once.join(met, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("win")
    return near.where(inside).where(same).select("id", "text_hash", start.alias("start"), "size", "items")


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, **options) -> DataFrame:
    """One row per document row: id_col, n_words, n_hit (words inside any occurrence), items (sorted as strings), contaminated.

    ``contaminated`` says that at least ``min_items`` items have a window in the document. See ``item_hits`` for nulls and repeated rows:
    each row has a result, by its own text. Without items, or with none that has words, nothing is hit; no documents give no rows. Other
    columns are not read.
    """
    hits = item_hits(docs, items, id_col=id_col, text_col=text_col, **options)
    spans = F.array_sort(F.collect_set(F.struct("start", "size")))
    found = hits.groupBy("id", "text_hash").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def covered(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        new = F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    found = found.select("id", "text_hash", F.aggregate("spans", zero, covered)["n"].alias("n_hit"), "items")
    all_docs = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.coalesce(F.size(F.array_remove(F.split(F.col(text_col), RAW_BREAK), "")), F.lit(0)).cast("long").alias("n_words"),
    )
    right = found.withColumnsRenamed({"id": "hit_id", "text_hash": "hit_hash"})
    joined = all_docs.join(right, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        listed.alias("items"),
        (F.size(listed) >= min_items).alias("contaminated"),
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    share: float = 0.8,
) -> DataFrame:
    """Items of whose distinct shingles some window of the document, as long as the item, has ``share`` or more.

    An item's shingles are ordered by rarity, the count over all documents of their rarest word. A window may lack m - need of the m, so
    one of the m - need + 1 rarest is in it whole: they are the necessary prefix. Document words are joined with the prefix shingles'
    rarest words, whose place gives the only place that the shingle can have; the shingle is verified there word by word, and only windows
    that reach over it are counted, by 64-bit hashes of their shingles, with the document's ends as bounds.

    Returns id, text_hash (together they name a row), item, contained (the largest share), a row for each item and place it was found at.
    An item shorter than a shingle is one shingle; items without words or with a null id take no part, nor do documents without words.
    Repeated items and documents change nothing; an item id with two texts is found if either is. Without items or documents there are no
    rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("w"))
    listed = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w"))
    listed = listed.where(F.size("w") > 0).distinct().withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(shingle)))
    each = listed.select("item", "w", "n", "k", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("at"))
    each = each.select("item", "w", "n", "k", "at", F.slice("w", F.col("at") + 1, F.col("k")).alias("s"))
    each = each.groupBy("item", "w", "n", "k", "s").agg(F.min("at").alias("at"))
    sets = each.groupBy("item", "w", "n", "k").agg(F.collect_set(F.xxhash64("s")).alias("hashes"), F.count("*").alias("m"))
    need = F.ceil(F.col("m") * share - 1e-9).cast("int")
    sets = stage(sets.select(F.xxhash64("item", "w").alias("set"), "item", "n", "k", "m", "hashes", need.alias("need")), "sets")
    each = stage(each.select(F.xxhash64("item", "w").alias("set"), "s", "at"), "shingles")
    vocab = stage(each.select(F.explode("s").alias("word")).distinct(), "vocab")
    few = is_small(vocab, SMALL) and is_small(each, SMALL)
    rarity = word_counts(source, vocab, few)
    placed = each.select("set", "s", "at", F.posexplode("s").alias("offset", "word")).join(rarity, "word", "left")
    least = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("seen"), "word", "offset")).alias("x")
    placed = placed.groupBy("set", "s", "at").agg(least).join(sets.select("set", "n", "k", "m", "need"), "set")
    order = W.partitionBy("set").orderBy("x.seen", "at")
    prefix = placed.withColumn("place", F.row_number().over(order)).where((F.col("place") <= F.col("m") - F.col("need") + 1) & (F.col("x.seen") > 0))
    prefix = stage(prefix.select("set", "s", "at", "n", "k", F.col("x.word").alias("word"), F.col("x.offset").alias("offset")), "prefix")
    if few:
        near = source.select("id", "text_hash", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefix), "word")
    else:  # only keys and places travel, and the texts of those that met are joined again
        met = source.select("id", "text_hash", F.posexplode("w").alias("pos", "word")).join(prefix, "word").withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
        near = source.dropDuplicates(["id", "text_hash"]).join(met, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    start = F.col("pos") - F.col("offset")
    near = near.where((start >= 0) & (start + F.col("k") <= F.size("w"))).where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("k")) == F.col("s"))
    lined = start - F.col("at")
    near = near.select("id", "text_hash", "set", lined.alias("lined"), F.slice("w", F.greatest(lined - F.col("n"), F.lit(0)) + 1, 3 * F.col("n")).alias("region"))
    near = near.groupBy("id", "text_hash", "set", "lined").agg(F.first("region").alias("region"))
    near = near.join(F.broadcast(sets) if few else sets, "set")
    which = F.transform(F.sequence(F.lit(1), F.size("region") - F.col("k") + 1), lambda i: F.array_position("hashes", F.xxhash64(F.slice("region", i, F.col("k")))))
    near = near.withColumn("which", F.explode(F.array(which)))  # a generated column is made once, not for each window again
    found = lambda x: F.size(F.array_distinct(F.filter(x, lambda y: y > 0)))
    near = near.where(found(F.col("which")) >= F.col("need"))
    starts = F.filter(F.sequence(F.lit(1), F.size("which")), lambda i: F.col("which")[i - 1] > 0)
    best = F.array_max(F.transform(starts, lambda i: found(F.slice("which", i, F.col("n") - F.col("k") + 1))))
    return near.withColumn("best", best).where(F.col("best") >= F.col("need")).select("id", "text_hash", "item", (F.col("best") / F.col("m")).alias("contained"))


def drop_containing(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item, as ``contained_items`` has it; their columns stay as they are, whatever their names.

    Each row is judged by its own text: rows of null ids, of one id with different texts, and repeated rows (all of which go or stay).
    Null and empty texts stay. Without items all rows stay; an empty table gives an empty result.
    """
    own = free_name(docs.columns, "_id")
    bad = contained_items(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = bad.select(F.col("id").alias(own), F.col("text_hash").alias(own + "_hash")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad[own]) & (F.xxhash64(docs[text_col]) == bad[own + "_hash"]), "left_anti")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those ids that ``contamination`` marks a row of; a row with a null id stays. Columns stay as they are."""
    bad = contamination(docs, items, id_col=id_col, **options).where("contaminated").select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti")
