"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import if_small, stage
from .names import without

#: Frequent lines that are broadcast at most: those of more than a share of 1 in this of all lines.
HOT = 100_000
#: Lines of one stamp that are paired; a stamp of more is cut into finer ones, up to so many times.
CROWD, DEPTH = 200, 4
#: One in SAMPLE lines tells which stamps are so common that no task should look through their lines: those that SEEN of it have.
SAMPLE, SEEN = 1024, 100


def tolerance(size: Column, per_edit: int, most: int) -> Column:
    """Edits that a line of ``size`` characters may differ by: one for each ``per_edit``, ``most`` at most."""
    return F.least(F.floor(size / per_edit), F.lit(most)).cast("int")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (of the text; with the id it names a row), n (from 0), line, key (of the line's text; null if the line is blank)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    return rows.withColumn("key", F.when(F.trim("line") != "", F.unhex(F.md5("line"))))


def shifts(edits: int) -> list[tuple[int, int, int]]:
    """(d, i, s): that a line d longer than an indexed one may have that one's segment i (from 0) s places from where it stands there.

    s goes from max(-i, d - (edits - i)) to min(i, d + (edits - i)): further off, what stands before or after it would take too many
    edits. With d = s = 0 it is the line's own segment, which is what the index holds of it.
    """
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            out += [(d, i, s) for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]
    return out


def with_stamps(lines: DataFrame, per_edit: int, most: int) -> DataFrame:
    """The lines' columns but the text, with size, stamp, own (whether the index holds it), t and longer, a row for each stamp.

    A line of n characters is cut at floor(n i / (t + 1)). A stamp is a hash of the tolerance t, the segment's number, the length of
    the shorter line and the segment; ``longer`` says by how much this line is longer than that. It is made in steps, since generated
    code that is too long is never compiled to machine code, and from four bytes a character, so that no place has to be counted off.
    """
    size, wide = F.col("size"), F.col("_wide")
    sized = lines.withColumn("size", F.length("line")).where(F.col("size") >= per_edit).withColumn("_wide", F.encode("line", "UTF-32"))
    cuts = {f"_cut_{t}_{d}_{i}": F.expr(f"cast(((size - {d}) * {i}) div {t + 1} as int)") for t in range(1, most + 1) for d in range(t + 1) for i in range(1, t + 1)}
    cut = lambda t, d, i: F.lit(0) if i == 0 else size - d if i == t + 1 else F.col(f"_cut_{t}_{d}_{i}")
    lists = {}
    for t in range(most, 0, -1):
        made = []
        for d, i, s in shifts(t):
            start, end = cut(t, d, i), cut(t, d, i + 1)
            made.append(F.xxhash64(F.lit(16 * t + i), size - d, F.substring(wide, (start + s) * 4 + 1, (end - start) * 4)))
        # a line meets shorter ones of tolerance t; it may have a higher one itself, but then it is no segment of its own here
        met = size >= per_edit * t if t == most else size.between(per_edit * t, per_edit * (t + 1) - 1 + t)
        lists[f"_list_{t}"] = F.when(met, F.array(*made)).otherwise(F.array().cast("array<bigint>"))
    kept = [c for c in lines.columns if c != "line"]
    listed = sized.withColumns(cuts).select(*kept, "size", *(x.alias(c) for c, x in lists.items()))
    # places in the joined list: those of higher tolerances come first, where a line has them
    offset, mine, level, longer = F.lit(0), F.lit(False), F.lit(0), F.lit(0)
    for t in range(most, 0, -1):
        found, has = shifts(t), size >= per_edit * t if t == most else size.between(per_edit * t, per_edit * (t + 1) - 1 + t)
        here = has & (F.col("at") >= offset) & (F.col("at") < offset + len(found))
        mine = mine | here & (tolerance(size, per_edit, most) == t) & (F.col("at") - offset).isin([k for k, (d, _, s) in enumerate(found) if d == s == 0])
        level = level + F.when(here, t).otherwise(0)
        for d in range(1, t + 1):
            longer = longer + F.when(here & (F.col("at") - offset).isin([k for k, x in enumerate(found) if x[0] == d]), d).otherwise(0)
        offset = offset + F.when(has, len(found)).otherwise(0)
    spread = listed.select(*kept, "size", F.posexplode(F.concat(*lists)).alias("at", "stamp"))
    return spread.withColumns({"own": mine, "t": level.cast("int"), "longer": longer.cast("int")}).drop("at")


def grams(line: Column) -> Column:
    """The parities of a line's pairs of neighbouring characters, dealt to 64 by hash: an edit changes four of them at most."""
    chars = F.split(line, "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def _common(a: Column, b: Column) -> Column:
    """How many characters at their starts two strings share: found by halving, so by a few comparisons of whole pieces."""
    most = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    same = lambda n, s: (n + s <= most) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(same(n, s), n + s).otherwise(n))


def with_middles(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Adds middle: long (characters of the longer of strings ``a`` and ``b``), rows (those of the other, among nulls), m (how many).

    What the two share at their starts and ends is cut off first, which changes no edit distance. The row after ``most`` nulls is the
    first. A generated column is made once, not at each use.
    """
    at = pairs.withColumn("_start", _common(F.col(a), F.col(b)))
    at = at.withColumns({"_a": F.reverse(F.expr(f"substring(`{a}`, _start + 1)")), "_b": F.reverse(F.expr(f"substring(`{b}`, _start + 1)"))})
    at = at.withColumn("_end", _common(F.col("_a"), F.col("_b")))
    at = at.withColumns({c: F.reverse(F.expr(f"substring({c}, _end + 1)")) for c in ("_a", "_b")})
    swap = F.length("_a") > F.length("_b")
    at = at.withColumns({"_short": F.when(swap, F.col("_b")).otherwise(F.col("_a")), "_long": F.when(swap, F.col("_a")).otherwise(F.col("_b"))})
    chars = lambda c: F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    none = F.lit(None).cast("string")
    rows = F.concat(F.array_repeat(none, most), chars("_short"), F.array_repeat(none, 2 * most + 1))
    made = F.struct(chars("_long").alias("long"), rows.alias("rows"), F.length("_short").alias("m"))
    return at.select(*pairs.columns, F.explode(F.array(made)).alias("middle"))


def distance(middle: Column, most: int) -> Column:
    """The edit distance of two strings (see ``with_middles``) if it is at most ``most``, else some larger number.

    It is banded and bit-parallel: of each column of the table of distances only the 2 most + 1 cells about the diagonal count, and they
    are bits of one number, ``up`` where the distance rises by one downwards and ``down`` where it falls. A step takes the bits of the cells
    that match the column's character; an addition's carries, ands, ors and shifts make all cells of the next column at once. The
    distance is followed along the band's lowest diagonal, then up the last column to the end of the shorter string.
    """
    width = 2 * most + 1
    mask = F.lit((1 << width) - 1).cast("long")
    shift = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    bit = lambda x, at: shift(x, at).bitwiseAND(F.lit(1).cast("long")).cast("int")
    long, rows, m = middle["long"], middle["rows"], middle["m"]
    n = F.size(long)

    def match(c: Column, j: Column) -> Column:  # in column j, cell k is row j - most + k
        cells = [F.when(rows[j + k] == c, 1 << k).otherwise(0) for k in range(width)]
        return sum(cells[1:], cells[0]).cast("long")

    def diagonal(acc: Column, x: Column) -> Column:
        """Adds zero: the cells that are as far as the one before them on the diagonal."""
        up, down = acc["up"], acc["down"]
        zero = (x.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(x).bitwiseOR(down).bitwiseAND(mask)
        return F.struct(up.alias("up"), down.alias("down"), zero.alias("zero"), acc["far"].alias("far"))

    def down_a_row(acc: Column) -> Column:
        """The cells as the next column needs them: its band is a row lower."""
        up, down, zero = acc["up"], acc["down"], acc["zero"]
        right, moved = down.bitwiseOR(F.bitwise_not(zero.bitwiseOR(up))).bitwiseAND(mask), shift(zero, F.lit(1))
        return F.struct(
            zero.bitwiseAND(up).bitwiseOR(F.bitwise_not(moved.bitwiseOR(right))).bitwiseAND(mask).alias("up"),
            moved.bitwiseAND(right).alias("down"),
            F.lit(0).cast("long").alias("zero"),
            (acc["far"] + 1 - bit(zero, F.lit(width - 1))).alias("far"),
        )

    def climb(acc: Column) -> Column:
        at = lambda k: F.greatest(F.lit(width - 2) - k, F.lit(0))
        step = lambda far, k: F.when(k < n + most - m, far - bit(acc["up"], at(k)) + bit(acc["down"], at(k))).otherwise(far)
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * most)), acc["far"], step)

    # a fold over one element, so that zero is worked out once for its uses
    column = lambda acc, x: F.aggregate(F.array(F.lit(0)), diagonal(acc, x), lambda made, _: down_a_row(made))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit((1 << width) - (1 << most)).cast("long").alias("up"), zero.alias("down"), zero.alias("zero"), F.lit(most).alias("far"))
    return F.when(n - m > most, F.lit(most + 1)).otherwise(F.aggregate(F.transform(long, match), start, column, climb))


def line_links(lines: DataFrame, *, per_edit: int = 20, most: int = 2) -> DataFrame:
    """Pairs of different lines within the edit tolerance of the shorter one: a, b (keys), each pair once.

    ``lines`` has key and line; a line may have several rows. A line of tolerance t is split into t + 1 segments; a line within t
    edits that is no shorter has one of them unchanged, near the same place.

    1. Stamps of all lines meet, and lines of which another has a stamp that an index holds are marked. No pairs are made. A stamp so
       common that it shows in a sample of the lines is not looked through: its lines are marked as they are.
    2. Only marked lines meet again, as pairs by stamp, of which those stay whose parities of character pairs differ by no more than
       the tolerance allows. Lines of a stamp that more than CROWD have are not paired, but meet by finer stamps (see ``_finer``), up to
       DEPTH times.
    3. Those are verified by a banded bit-parallel edit distance, after what the two share at their ends is cut off.
    """
    short = lines.select(F.xxhash64("line").alias("h"), "line")
    seen = with_stamps(short.where(F.pmod("h", F.lit(SAMPLE)) == 0).distinct(), per_edit, most).groupBy("stamp").count().where(F.col("count") >= SEEN)
    seen = stage(seen.select("stamp", F.lit(True).alias("common")), "common")
    met, by = with_stamps(short, per_edit, most).select("stamp", "h", "own"), ["stamp"]
    if not seen.isEmpty():
        met = met.join(if_small(seen, 500_000), "stamp", "left").withColumn("spread", F.when(F.col("common"), F.col("h")).otherwise(0))
        by = ["stamp", "spread"]
    group = W.partitionBy(*by)
    met = met.withColumns({"low": F.min("h").over(group), "high": F.max("h").over(group), "held": F.max("own").over(group)})
    marks = (F.col("held") & (F.col("low") != F.col("high"))) | (F.coalesce("common", F.lit(False)) if "common" in met.columns else F.lit(False))
    ends = stage(met.where(marks).select("h").distinct(), "ends")
    texts = lines.withColumn("h", F.xxhash64("line")).join(if_small(ends, 500_000), "h").select("key", "line").dropDuplicates(["key"])
    texts = stage(texts.withColumn("grams", grams(F.col("line"))), "texts")
    marked, pairs = stage(with_stamps(texts, per_edit, most), "marked"), []
    for level in range(DEPTH + 1):
        crowds = marked.groupBy("stamp").agg(F.count("*").alias("n"), F.max("own").alias("held")).where((F.col("n") > CROWD) & F.col("held"))
        crowds = stage(crowds.select("stamp"), "crowds")
        if level == DEPTH or crowds.isEmpty():
            pairs.append(_paired(marked, per_edit, most))
            break
        crowds = if_small(crowds, 500_000)
        pairs.append(_paired(marked.join(crowds, "stamp", "left_anti"), per_edit, most))
        crowded = marked.join(crowds, "stamp")
        if not level:
            crowded = crowded.join(texts.select("key", "line"), "key").withColumns({"from": F.lit(0), "to": F.lit(0)})
        marked = stage(_finer(crowded), "marked")
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    found = stage(found.distinct(), "pairs")
    text = texts.select("key", "line")
    both = found.join(text.withColumnsRenamed({"key": "a", "line": "line_a"}), "a").join(text.withColumnsRenamed({"key": "b", "line": "line_b"}), "b")
    allowed = tolerance(F.least(F.length("line_a"), F.length("line_b")), per_edit, most)
    both = with_middles(both.withColumn("allowed", allowed), "line_a", "line_b", most)
    return both.where(distance(F.col("middle"), most) <= F.col("allowed")).select("a", "b")


def _paired(marked: DataFrame, per_edit: int, most: int) -> DataFrame:
    asked = marked.select("stamp", F.col("key").alias("a"), F.col("size").alias("size_a"), F.col("grams").alias("grams_a"))
    held = marked.where("own").select("stamp", F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("grams_b"))
    allowed = tolerance(F.least("size_a", "size_b"), per_edit, most)
    apart = F.bit_count(F.col("grams_a").bitwiseXOR(F.col("grams_b")))
    pairs = asked.join(held, (asked["stamp"] == held["stamp"]) & (F.col("a") != F.col("b")) & (apart <= allowed * 4))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _finer(crowded: DataFrame) -> DataFrame:
    """Rows of crowded stamps by finer ones: of what they have met by, and of one piece more.

    A stamp's indexed lines are of one length and tolerance t. What all of them start and end with (known from the least and the largest
    of them, and of their reversals) tells nothing; of the rest, the longer part beside the piece that they met by last (from, to) is
    cut into t + 1 pieces. A line within t edits has one of these unchanged too, at most t places off.
    """
    own = crowded.where("own").withColumn("back", F.reverse("line"))
    edges = own.groupBy("stamp").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("line", "back") for f in (F.min, F.max)), F.max("size").alias("whole"))
    start, end = _common(F.col("min_line"), F.col("max_line")), _common(F.col("min_back"), F.col("max_back"))
    shared = stage(edges.select("stamp", "whole", start.alias("start"), end.alias("end")), "shared")
    rows = crowded.join(if_small(shared, 100_000), "stamp")
    rows = rows.withColumn("stop", F.greatest(F.col("whole") - F.col("end"), F.col("start")))
    rows = rows.withColumn("after", F.least(F.greatest("to", "start"), "stop"))
    rows = rows.withColumns({"left": F.greatest(F.least("from", "stop") - F.col("start"), F.lit(0)), "right": F.col("stop") - F.col("after")})
    rows = rows.withColumns({"begin": F.when(F.col("left") > F.col("right"), F.col("start")).otherwise(F.col("after")), "wide": F.greatest("left", "right")})
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("t"))))
    cut = lambda k: (F.col("begin") + F.floor(F.col("wide") * k / (F.col("t") + 1))).cast("int")
    rows = rows.withColumns({"from": cut(F.col("piece")), "to": cut(F.col("piece") + 1)})
    rows = rows.withColumn("shift", F.explode(F.sequence(-F.col("t"), F.col("t"))))
    fits = (F.abs(F.col("longer") - F.col("shift")) <= F.col("t")) & (F.col("from") + F.col("shift") >= 0) & (F.col("to") + F.col("shift") <= F.col("size"))
    stamp = F.xxhash64("stamp", "piece", F.substring("line", F.col("from") + F.col("shift") + 1, F.col("to") - F.col("from")))
    made = rows.where(fits).withColumns({"stamp": stamp, "own": F.col("own") & (F.col("shift") == 0)})
    return made.select("stamp", "key", "size", "own", "t", "longer", "grams", "line", "from", "to")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_edit: int = 20, most: int = 2) -> DataFrame:
    """Documents without lines that repeat an earlier one, exactly or within a few edits.

    A line goes if the same text stands earlier (in a document of a smaller id, or above in its own), or if a different text within
    the tolerance first stands earlier: one edit for each 20 characters of the shorter, two at most, none under 20. Whether the
    earlier line goes itself does not matter. Blank lines stay and repeat nothing.

    Returns the input's rows with the text that is left, n_lines, n_removed and n_links (of its lines with different texts, each
    line's added); input columns of these names are replaced, others stay whatever their names. A null text has no lines and stays null;
    an empty text is one blank line. Rows of a null id come after all others. Rows that are repeated whole are judged as one. An empty
    table gives an empty result.
    """
    lines = split_lines(docs, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "n")
    firsts = lines.where("key is not null").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    firsts = stage(firsts, "firsts")
    # of a frequent line only the first goes on; there are HOT frequent lines at most, so that they can be broadcast at any size
    total = firsts.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(stage(firsts.where(F.col("times") > max(1, total // HOT)).select("key", "first"), "hot"))
    once = lines.where("key is not null").join(hot, "key", "left").where(F.col("first").isNull() | (F.col("first") == place)).select("key", "line")
    links = stage(line_links(once, per_edit=per_edit, most=most), "links")
    return _apply(docs, lines, firsts, links, id_col, text_col)


def _apply(docs: DataFrame, lines: DataFrame, firsts: DataFrame, links: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = firsts.select("key", "first")
    ends = ends.join(place.withColumnsRenamed({"key": "a", "first": "own"}), "a").join(place.withColumnsRenamed({"key": "b", "first": "other"}), "b")
    near = ends.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("links"), F.max(F.col("other") < F.col("own")).alias("late"))
    flagged = firsts.join(near, "key", "left").where("times > 1 or links > 0")
    flagged = stage(flagged.select("key", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("late", F.lit(False)).alias("late")), "flagged")
    marks = lines.select("id", "mark", "n", "key").join(if_small(flagged, 500_000), "key")
    here = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "n")
    found = marks.select("id", "mark", "n", "links", (F.col("late") | (here != F.col("first"))).alias("gone"))
    found = found.distinct().groupBy("id", "mark").agg(
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("n")))).alias("gone"), F.sum("links").alias("n_links")
    )
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    right = found.withColumnsRenamed({"id": "_id", "mark": "_mark"})
    joined = named.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    all_lines = F.split("text", "\n")
    # the lines between one that goes and the next; the places are sorted, so each line is looked at once
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    stops = F.concat(gone, F.array(F.size(all_lines)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(all_lines, a + 1, b - a)))
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    made = {
        text_col: F.when(F.col("text").isNotNull(), text),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long"),
        "n_removed": F.size(gone).cast("long"),
        "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
    }
    others = [F.col("row")[c].alias(c) for c in without(docs.columns, made)]
    return joined.select(*others, *(x.alias(c) for c, x in made.items()))
