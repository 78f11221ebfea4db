"""URL filters: explicit rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .names import without

#: host/path, longest first where they compete.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MADE = ("host", "path", "rule", "verdict")
#: Parts of a url of which the labels' rate and share are counted: the host's last label and last two, its first, and the path's first.
STATISTICS = ("end", "tail", "first", "lead")
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "dashes", *(f"{x}_{y}" for x in STATISTICS for y in ("rate", "share")))


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is no ``://`` or no url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. A rule fits its host and all subdomains where the path starts with its own."""
    found: Column | None = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule string, verdict string>") if found is None else found


def lexical(url: Column) -> Column:
    """The lexical features of a url, and its parts of STATISTICS. One struct, so that no column is in its way."""
    url = F.coalesce(url, F.lit(""))
    host, path = url_host(url), url_path(url)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    made = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
        "entropy": entropy,
        "params": F.regexp_count(query, F.lit("[^&]+")),
        "dashes": F.regexp_count(host, F.lit("[-_]")),
    }
    parts = {"end": F.substring_index(host, ".", -1), "tail": F.substring_index(host, ".", -2), "first": F.substring_index(host, ".", 1), "lead": F.regexp_extract(path, "^/([^/]*)", 1)}
    return F.struct(*(x.cast("double").alias(n) for n, x in made.items()), *(x.alias(n) for n, x in parts.items()))


class UrlModel:
    """Trees that tell blocked urls from allowed ones; see ``fit_urls``."""

    def __init__(self, trees: GBTClassificationModel | None, rates: dict[str, DataFrame], base: float):
        self.trees, self.rates, self.base = trees, rates, base

    def _vectors(self, rows: DataFrame) -> DataFrame:
        """``rows`` (lex: struct of ``lexical``, and others) with features, by the rates of all labelled urls."""
        joined = rows
        for name, rates in self.rates.items():
            joined = joined.withColumn(name, F.col(f"lex.{name}")).join(F.broadcast(rates), name, "left").drop(name)
        return _assembled(joined, rows.columns, self.base)

    def predict(self, urls: DataFrame, url_col: str, out_col: str = "blocked") -> DataFrame:
        """Adds ``out_col``, whether the trees would block the url; without trees, whether the labels were all of blocked urls.

        Other columns stay as they are, whatever their names; one of the name ``out_col`` is replaced.
        """
        kept = without(urls.columns, [out_col])
        if self.trees is None:
            return urls.select(*kept, F.lit(self.base > 0.5).alias(out_col))
        rows = urls.select(F.struct(*kept).alias("row"), lexical(F.col(url_col)).alias("lex"))
        judged = self.trees.transform(self._vectors(rows).select("row", "features"))
        return judged.select("row.*", (F.col("prediction") > 0.5).alias(out_col))


def _assembled(joined: DataFrame, kept: Sequence[str], base: float) -> DataFrame:
    """The rows' ``kept`` columns and features: lexical ones, and their parts' rates and shares (of unknown ones, the overall rate and 0)."""
    filled = joined.fillna({f"{x}_rate": base for x in STATISTICS} | {f"{x}_share": 0.0 for x in STATISTICS})
    named = filled.select(*kept, *(F.col(f if f.endswith(("_rate", "_share")) else f"lex.{f}").alias(f) for f in FEATURES))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(named).select(*kept, "features")


def fit_urls(labelled: DataFrame, url_col: str, label_col: str, *, sample: int = 20_000, folds: int = 5, trees: int = 15, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit gradient-boosted trees on labelled urls (label true: block).

    ``sample`` bounds the labelled rows that are used, the first by a hash of the url; rows of null urls or labels are not. The rates
    and shares of STATISTICS are counted on that sample, smoothed by the overall rate, so these tables are no larger than it. Trees are fitted on rates out of fold: a row has those counted without its own fold of urls (1 of
    ``folds``, by hash), so no label is told by its own rate. With one label only, or none, there are no trees.
    """
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"), F.xxhash64(url_col, F.lit(seed)).alias("h"))
    rows = rows.orderBy("h", "url", "label").limit(sample).withColumn("lex", lexical(F.col("url")))
    rows = stage(rows.select("label", "lex", F.pmod("h", F.lit(folds)).alias("fold")), "labelled")
    seen, base = rows.agg(F.count("*"), F.avg("label")).first()
    base = float(base or 0.0)
    rate = lambda bad, n: (bad + 2.0 * base) / (n + 2.0)

    def counts(name: str) -> DataFrame:
        return rows.groupBy(F.col(f"lex.{name}").alias(name)).agg(F.sum("label").alias("bad"), F.count("*").alias("n"))

    def rates(name: str) -> DataFrame:
        return stage(counts(name).select(name, rate(F.col("bad"), F.col("n")).alias(f"{name}_rate"), (F.col("n") / float(max(seen, 1))).alias(f"{name}_share")), name)

    model = UrlModel(None, {name: rates(name) for name in STATISTICS}, base)
    if 0.0 < base < 1.0:
        made = rows
        for name in STATISTICS:
            own = rows.groupBy(F.col(f"lex.{name}").alias(name), "fold").agg(F.sum("label").alias("own_bad"), F.count("*").alias("own_n"))
            held = own.join(counts(name), name).select(
                name, "fold", rate(F.col("bad") - F.col("own_bad"), F.col("n") - F.col("own_n")).alias(f"{name}_rate"), (F.col("n") / float(max(seen, 1))).alias(f"{name}_share")
            )
            made = made.withColumn(name, F.col(f"lex.{name}")).join(F.broadcast(held), [name, "fold"]).drop(name)
        made = _assembled(made, ["label"], base)
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
        model.trees = gbt.fit(stage(made, "made").coalesce(4))
    return model


def judge_urls(pages: DataFrame, *, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, **options) -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to ``pages``; columns of these names are replaced, others stay whatever their names.

    The longest rule that fits decides; the trees decide the rest. Without ``model`` they are trained on the urls that rules decide, as
    labels. Null urls and urls without ``://`` have an empty host and path, fit no rule and are left to the trees. Repeated rows are
    judged alike; an empty table gives an empty result.
    """
    kept = without(pages.columns, MADE)
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), F.col(url_col).alias("url"), rule_match(host, path, rules).alias("match"))
    if model is None:
        model = fit_urls(rows.where("match is not null").select("url", (F.col("match.verdict") == "block").alias("bad")), "url", "bad", **options)
    judged = model.predict(rows, "url", "block")
    verdict = F.coalesce(F.col("match.verdict"), F.when(F.col("block"), "block").otherwise("allow"))
    made = {"host": url_host(F.col("url")), "path": url_path(F.col("url")), "rule": F.col("match.rule"), "verdict": verdict}
    return judged.select(*(F.col("row")[c].alias(c) for c in kept), *(x.alias(c) for c, x in made.items()))
