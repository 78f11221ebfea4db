"""Grouped rates, validation, pivots, percentiles, joins with defaults and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def situation(plays: DataFrame, *, flavour: str = "spark", least: int = 10, bayes: bool = True) -> DataFrame:
    """Win rates by quarter, down, score bucket and field bucket, of regular plays, for groups of ``least`` rows and more.

    flavour says what happens to nulls: ``spark`` drops rows without ``win``; ``hive`` counts them in the total only; ``mapreduce``
    drops rows with any null. A null score or yard line is in the last bucket where it is not dropped.
    """
    rows = plays.where(F.col("qtr").between(1, 4) & F.col("down").between(1, 4))
    if flavour == "mapreduce":
        rows = rows.dropna(subset=["win", "score_differential", "yardline_100"])
    elif flavour == "spark":
        rows = rows.where(F.col("win").isNotNull())
    elif flavour != "hive":
        raise ValueError(f"unknown flavour: {flavour}")
    keys = ["qtr", "down", X.score_bucket(F.col("score_differential")).alias("score_diff_bucket"), X.field_bucket(F.col("yardline_100")).alias("field_bucket")]
    out = rows.groupBy(*keys).agg(F.sum("win").cast("long").alias("wins"), F.count("*").alias("total")).where(F.col("total") >= least)
    out = out.withColumn("win_probability", X.ratio(F.col("wins"), F.col("total")))
    if bayes:
        out = out.withColumn("win_prob_bayes", X.beta_mean(F.col("wins"), F.col("total")))
    return out.orderBy("qtr", "down", "score_diff_bucket", "field_bucket")


def heatmap(cells: DataFrame, *, down: int = 3, field: str = "26-50") -> DataFrame:
    """Rates of one down and field bucket: a row per quarter, a column per score bucket, null where there is no group."""
    return cells.where((F.col("down") == down) & (F.col("field_bucket") == field)).groupBy("qtr").pivot("score_diff_bucket", X.SCORE_BUCKETS).agg(F.first("win_probability"))


def prior_effect(cells: DataFrame, k: int = 10) -> DataFrame:
    """The groups whose rate the prior moves most."""
    moved = cells.withColumn("difference", F.round(F.abs(F.col("win_probability") - F.col("win_prob_bayes")), 4))
    return moved.orderBy(F.desc("difference"), "qtr", "down", "score_diff_bucket", "field_bucket").limit(k)


REQUIRED = ("qtr", "down", "ydstogo", "yardline_100", "score_differential", "result")


def clean_plays(raw: DataFrame) -> DataFrame:
    """Typed plays from strings, with ``valid``: all seven fields filled, none of six NA, numbers that parse, and a win or a loss."""
    fine = X.usable(F.col("posteam_type"), na=False)
    for name in REQUIRED:
        fine = fine & X.usable(F.col(name))
    result = X.to_int(F.trim("result"))
    home, away = F.trim("posteam_type") == "home", F.trim("posteam_type") == "away"
    win = F.when((home & (result > 0)) | (away & (result < 0)), 1).when((home & (result < 0)) | (away & (result > 0)), 0)
    typed = {name: X.to_int(F.trim(name)) for name in ("qtr", "down", "yardline_100", "score_differential")}
    typed["ydstogo"] = F.trim("ydstogo").try_cast("double")
    out = raw.withColumns({"win": win, "_fine": fine}).withColumns(typed)
    whole = F.col("_fine") & F.col("win").isNotNull()
    for name in typed:
        whole = whole & F.col(name).isNotNull()
    return out.withColumn("valid", F.coalesce(whole, F.lit(False))).drop("_fine", "posteam_type", "result")


def tally(rows: DataFrame, by: str, flag: str = "valid") -> DataFrame:
    """Rows written and skipped by file."""
    return rows.groupBy(by).agg(F.count_if(F.col(flag)).alias("written"), F.count_if(~F.col(flag)).alias("skipped"))


def clean_listings(raw: DataFrame, remap: Mapping[str, str] | None = None, least: int = 20) -> DataFrame:
    """Listings from strings: typed, with the composed text; ``valid`` if id, place and enough text are there."""
    city = F.col("city")
    for old, new in (remap or {}).items():
        city = F.when(F.col("city") == old, new).otherwise(city)
    out = raw.withColumns(
        {
            "name": X.clean_text(F.col("name")),
            "description": X.clean_text(F.col("description"), 1000),
            "city": city,
            "price": X.clean_price(F.col("price")),
            "bedrooms": X.to_int(F.col("bedrooms")),
            "bathrooms": F.col("bathrooms").try_cast("double"),
            "latitude": F.col("latitude").try_cast("double"),
            "longitude": F.col("longitude").try_cast("double"),
        }
    )
    out = out.withColumn("text", X.listing_text(*(F.col(c) for c in ("name", "description", "city", "bedrooms", "bathrooms", "price"))))
    fine = X.usable(F.col("id"), na=False) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.length("text") >= least)
    return out.withColumn("valid", F.coalesce(fine, F.lit(False)))


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = (), points: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Exact percentiles, interpolated between neighbours."""
    return rows.groupBy(*by).agg(*(F.percentile(F.col(value), p / 100).alias(f"p{p}") for p in points))


def recall(truth: DataFrame, found: DataFrame, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """Mean over the truth's queries of the share of their true items that were found, to 4 digits."""
    true = truth.groupBy(query).agg(F.collect_set(item).alias("truth"))
    got = found.groupBy(query).agg(F.collect_set(item).alias("found"))
    empty = F.array().cast(true.schema["truth"].dataType)
    share = F.size(F.array_intersect("truth", F.coalesce("found", empty))) / F.greatest(F.size("truth"), F.lit(1))
    return true.join(got, query, "left").agg(F.round(F.avg(share), 4).alias("recall"), F.count("*").alias("queries"))


def join_last(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join with the right row of each key that is last by ``order``."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*[c for c in right.columns if c != key]), order).alias("_r"))
    return left.join(last, key).select(*left.columns, *(F.col("_r")[c].alias(c) for c in right.columns if c != key and c not in left.columns))


def overlay(left: DataFrame, right: DataFrame, key: str, keep: Sequence[str] = (), defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join whose right columns take the place of the left's, but for ``keep``; then defaults for what is null."""
    other = right.select(F.col(key).alias("_k"), *(F.col(c).alias("_r_" + c) for c in right.columns if c != key))
    joined = left.join(other, F.col(key) == F.col("_k"), "left")
    names = [*left.columns, *(c for c in right.columns if c not in left.columns)]

    def value(c: str) -> Column:
        if c == key or c not in right.columns or c in keep and c in left.columns:
            out = F.col(c)
        else:
            out = F.coalesce("_r_" + c, c) if c in left.columns else F.col("_r_" + c)
        return F.coalesce(out, F.lit((defaults or {})[c])) if c in (defaults or {}) else out

    return joined.select(*(value(c).alias(c) for c in names))


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left join of one column with a default for rows that have none."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, fallback))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones each time: the first by a hash of the seed and the key."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.orderBy(order, key).limit(n)


def keyword_filter(rows: DataFrame, column: str, stems: Sequence[str]) -> DataFrame:
    """Rows whose lower-cased column holds any of the stems."""
    low = F.lower(F.col(column))
    fits = F.lit(False)
    for stem in stems:
        fits = fits | F.contains(low, F.lit(stem))
    return rows.where(fits)


def corpus(articles: DataFrame, stems: Sequence[str], *, size: int = 5000, most: int | None = None, id_col: str = "id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """id, title, text of articles whose title holds a stem; texts are cut to ``size`` characters. ``most`` keeps the first by id, as a limit that is asked for."""
    fits = keyword_filter(articles, title_col, stems)
    out = fits.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, size).alias("text"))
    return out.orderBy("id").limit(most) if most is not None else out


def load_rows(listings: DataFrame, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """What a vector store is loaded with: listings that have a vector (the last of an id), names cut to 200 and descriptions to 500 characters,
    empty numbers as 0. ``vectors`` has id, vector and n, which orders those of one id."""
    joined = join_last(listings, vectors, id_col, "n")
    return joined.select(
        F.col(id_col).alias("listing_id"),
        F.substring("name", 1, 200).alias("name"),
        F.substring("description", 1, 500).alias("description"),
        "city",
        X.or_zero(F.col("price")).alias("price"),
        X.or_zero(F.col("bedrooms"), "int").alias("bedrooms"),
        X.or_zero(F.col("bathrooms")).alias("bathrooms"),
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
        vector_col,
    )


def map_sample(listings: DataFrame, key: str = "id", n: int = 2000, seed: int = 42) -> DataFrame:
    """lat, lon, name (60 characters), city, price of a seeded sample of the listings whose coordinates are numbers."""
    placed = listings.withColumns({"lat": F.col("latitude").try_cast("double"), "lon": F.col("longitude").try_cast("double")})
    chosen = sample(placed.where("lat is not null and lon is not null"), key, n, seed)
    return chosen.select(key, "lat", "lon", F.substring("name", 1, 60).alias("name"), "city", "price")


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Each pair of ends once, the smaller first, without loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def two_sided(links: DataFrame, corpus: DataFrame) -> DataFrame:
    """Links (from_id, to_title) between documents (id, title) of the corpus, as ids, each once."""
    source = corpus.select(F.col("id").alias("from_id"))
    target = corpus.select(F.col("title").alias("to_title"), F.col("id").alias("to_id"))
    return links.join(source, "from_id", "left_semi").join(target, "to_title").select("from_id", "to_id").distinct()


def all_terms(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents that hold every one of the terms: an intersection of posting lists by counting."""
    wanted = list(dict.fromkeys(terms))
    return postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def close(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "v", atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Largest difference of two sparse matrices, and whether all are within atol + rtol * |b|. A missing cell is 0."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), list(keys), "full")
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.agg(F.max(gap).alias("max_abs_diff"), F.bool_and(gap <= atol + rtol * F.abs(F.coalesce("y", F.lit(0.0)))).alias("all_close"))
