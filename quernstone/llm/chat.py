"""Reply trees and chat formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """No control string is left: backslashes are doubled, then ``<|`` becomes ``<\\|``, which doubling can't have made."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def reply_paths(messages: DataFrame, *, best: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees.

    ``messages`` has tree string, node long, parent long (null or unknown: a root), score double; (tree, node) must be unique. Branches
    are ranked by the sum of their messages' scores (null counts 0), ties to the smaller leaf, and the first ``best`` of each tree stay.

    1. Self-joins whose reach doubles: each message's total of the messages up to its ancestor 1, 2, 4, ... steps up is joined with that
       ancestor's own, a row a message each time, until all have reached their roots. So a chain of n messages takes log2(n) joins.
    2. Leaves are ranked by their totals. No path is written before that, so no more paths are than stay.
    3. From the leaves that stay, the same ancestors, the furthest first, give all rows of their paths.

    Returns tree, branch (from 1), leaf, node, depth (0 at the root). Messages on a reply cycle, or below one, are on no
    root-to-leaf path and are left out. No messages give no rows; other columns are not read.
    """
    up = messages.select("tree", F.col("node").alias("parent"), F.lit(1).alias("known"))
    linked = messages.join(up, ["tree", "parent"], "left")
    linked = linked.select("tree", "node", F.when(F.col("known") == 1, F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    linked = stage(linked, "linked")
    # over: the message that is not yet in the total, null once the root is in it; length: of messages in the total
    now = stage(linked.select("tree", "node", F.col("parent").alias("over"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")), "reach")
    reaches, most = [now], linked.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 2 ** (len(reaches) - 1) < most and not now.where("over is not null").isEmpty():
        further = now.select("tree", F.col("node").alias("over"), F.col("over").alias("beyond"), F.col("total").alias("more"), F.col("length").alias("steps"))
        open_ = now.where("over is not null").join(further, ["tree", "over"])
        open_ = open_.select("tree", "node", F.col("beyond").alias("over"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("steps")).alias("length"))
        now = stage(open_.unionByName(now.where("over is null")), "reach")
        reaches.append(now)
    inner = linked.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = now.where("over is null").join(inner, ["tree", "node"], "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)
    path = stage(chosen.select("tree", "branch", F.col("node").alias("leaf"), "node", (F.col("length") - 1).alias("depth")), "path")
    # in round k the messages that are 2 ** k or more apart get the one 2 ** k steps up: no row twice
    for k in range(len(reaches) - 1, -1, -1):
        jumps = reaches[k].where("over is not null").select("tree", "node", "over")
        more = path.join(jumps, ["tree", "node"]).select("tree", "branch", "leaf", F.col("over").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        path = stage(path.unionByName(more), "path")
    return path


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation per path: tree, branch, formatted, loss array<struct<start, size>> (code points of ``formatted``, from 0).

    ``messages`` has tree, node, role, text. A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``, role and text escaped, null as
    empty. The loss mask covers the text of each assistant turn, without its markers. A path of messages that are not there has no row;
    no paths give no rows. Other columns are not read.
    """
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = paths.join(said, ["tree", "node"])
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = turns.withColumn("turn", F.concat(head, "body", F.lit(END)))
    before = W.partitionBy("tree", "branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length(head)
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("size")))
    turns = turns.withColumn("span", span)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "turn"))), lambda x: x["turn"]), "")
    return turns.groupBy("tree", "branch").agg(joined.alias("formatted"), F.array_sort(F.collect_list("span")).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>, read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|turn\|>")

    def turn(x: Column) -> Column:
        role, body = F.substring_index(x, TEXT, 1), F.substring_index(F.substring_index(x, END, 1), TEXT, -1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    cut = lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), x["size"].cast("int")))
    return F.array_join(F.transform(loss, cut), "")


def linear_messages(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows of conversations as reply trees: each row, by turn (ties by role, then text), answers the one before it.

    A null conv_id is a conversation of its own and comes first in none; a null turn comes first. Columns: tree, conv, node, parent, role, text, score.
    """
    tree = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n"))
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(tree.alias("tree"), F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    named = named.withColumn("node", F.row_number().over(order).cast("long"))
    score = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double")
    return named.select("tree", "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", score.alias("score"))
