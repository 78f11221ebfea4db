"""The registered queries of the library's own operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as X
from .operators import graph, linalg, relational, text, vector
from .plans import search as plan_search
from .session import table
from .sources import files
from .staging import shared_dir, stage
from .streaming import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- grouped rates; lineitem stands for plays ---


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("qtr"),
        F.quarter("l_shipdate").alias("down"),
        (F.col("l_quantity").cast("int") - 25).alias("score_differential"),
        (F.col("l_partkey") % 100 + 1).cast("int").alias("yardline_100"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("win"),
    )


PLAYS = """plays AS (SELECT l_linenumber AS qtr, quarter(l_shipdate) AS down, CAST(l_quantity AS INT) - 25 AS s, l_partkey % 100 + 1 AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS win FROM lineitem)"""
SCORE = "CASE WHEN s <= -14 THEN 'le-14' WHEN s <= -7 THEN '-13to-7' WHEN s <= -1 THEN '-6to-1' WHEN s = 0 THEN '0' WHEN s <= 6 THEN '1to6' WHEN s <= 13 THEN '7to13' ELSE 'ge14' END"
FIELD = "CASE WHEN y <= 25 THEN '0-25' WHEN y <= 50 THEN '26-50' WHEN y <= 75 THEN '51-75' ELSE '76-100' END"
CELLS = f"""{PLAYS},
g AS (SELECT qtr::INT AS qtr, down::INT AS down, {SCORE} AS score_diff_bucket, {FIELD} AS field_bucket, sum(win)::BIGINT AS w, count(*)::BIGINT AS t
      FROM plays WHERE qtr BETWEEN 1 AND 4 AND down BETWEEN 1 AND 4 AND win IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cells AS (SELECT qtr, down, score_diff_bucket, field_bucket, w AS wins, t AS total, ((w * 20000 + t) // (2 * t)) / 10000.0::DOUBLE AS win_probability,
      (((w + 2) * 20000 + t + 4) // (2 * (t + 4))) / 10000.0::DOUBLE AS win_prob_bayes FROM g)"""


@query(f"WITH {CELLS} SELECT * FROM cells")
def situation(spark, sf_dir):
    return relational.situation(plays(spark, sf_dir))


@query(f"WITH {CELLS} SELECT * EXCLUDE (win_prob_bayes) FROM cells")
def situation_hive(spark, sf_dir):
    return relational.situation(plays(spark, sf_dir), flavour="hive", bayes=False)


@query(f"WITH {CELLS} SELECT * EXCLUDE (win_prob_bayes) FROM cells")
def situation_mapreduce(spark, sf_dir):
    return relational.situation(plays(spark, sf_dir), flavour="mapreduce", bayes=False)


@query(
    "WITH "
    + CELLS
    + " SELECT qtr, "
    + ", ".join(f"max(win_probability) FILTER (score_diff_bucket = '{b}') AS \"{b}\"" for b in X.SCORE_BUCKETS)
    + " FROM cells WHERE down = 3 AND field_bucket = '26-50' GROUP BY qtr"
)
def heatmap(spark, sf_dir):
    return relational.heatmap(relational.situation(plays(spark, sf_dir)))


@query(
    f"WITH {CELLS}, d AS (SELECT *, round(abs(win_probability - win_prob_bayes), 4) AS difference FROM cells) "
    "SELECT * FROM d ORDER BY difference DESC, qtr, down, score_diff_bucket, field_bucket LIMIT 10"
)
def prior_effect(spark, sf_dir):
    return relational.prior_effect(relational.situation(plays(spark, sf_dir)))


@query(f"WITH {CELLS} SELECT min(CASE WHEN total > 0 THEN total END) AS low, max(total) AS high, count(*) AS cells FROM cells")
def total_range(spark, sf_dir):
    cells = relational.situation(plays(spark, sf_dir))
    return cells.agg(F.min(F.when(F.col("total") > 0, F.col("total"))).alias("low"), F.max("total").alias("high"), F.count("*").alias("cells"))


@query(f"WITH {CELLS} SELECT * FROM cells WHERE qtr = 2 AND down = 3 AND field_bucket = '26-50'")
def filtered_cells(spark, sf_dir):
    return relational.situation(plays(spark, sf_dir)).where("qtr = 2 and down = 3 and field_bucket = '26-50'")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


# --- validation ---


def raw_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with the faults that play files have: empty, NA, 3.0, ties, unknown teams."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "case when l_orderkey % 17 = 0 then 'NA' else cast(l_linenumber as string) end as qtr",
        "case when l_orderkey % 19 = 0 then '' else concat(cast(quarter(l_shipdate) as string), '.0') end as down",
        "cast(l_partkey % 20 as string) as ydstogo",
        "concat(' ', cast(l_partkey % 100 as string)) as yardline_100",
        "case when l_suppkey % 23 = 0 then 'x' else cast(cast(l_quantity as int) - 25 as string) end as score_differential",
        "case l_orderkey % 5 when 0 then 'home' when 1 then 'away' when 2 then 'home' when 3 then 'away' else 'none' end as posteam_type",
        "cast(cast(l_quantity as int) % 7 - 3 as string) as result",
        "l_linestatus as file",
    )


RAW = """raw AS (SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_linenumber END AS qtr, CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE quarter(l_shipdate) END AS down,
  (l_partkey % 20)::DOUBLE AS ydstogo, l_partkey % 100 AS yardline_100, CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE CAST(l_quantity AS INT) - 25 END AS score_differential,
  l_orderkey % 5 AS team, CAST(l_quantity AS INT) % 7 - 3 AS result, l_linestatus AS file FROM lineitem),
typed AS (SELECT *, CASE WHEN team IN (0, 2) AND result > 0 OR team IN (1, 3) AND result < 0 THEN 1 WHEN team IN (0, 2) AND result < 0 OR team IN (1, 3) AND result > 0 THEN 0 END AS win FROM raw),
flagged AS (SELECT *, qtr IS NOT NULL AND down IS NOT NULL AND score_differential IS NOT NULL AND win IS NOT NULL AS valid FROM typed)"""


@query(f"WITH {RAW} SELECT file, count(*) FILTER (valid) AS written, count(*) FILTER (NOT valid) AS skipped FROM flagged GROUP BY file")
def validation_tally(spark, sf_dir):
    return relational.tally(relational.clean_plays(raw_plays(spark, sf_dir)), "file")


@query(
    f"WITH {RAW} SELECT qtr::INT AS qtr, down::INT AS down, win::INT AS win, count(*) AS n, sum(score_differential)::BIGINT AS s, sum(yardline_100)::BIGINT AS y, sum(ydstogo) AS g FROM flagged WHERE valid GROUP BY ALL"
)
def clean_plays(spark, sf_dir):
    rows = relational.clean_plays(raw_plays(spark, sf_dir)).where("valid")
    return rows.groupBy("qtr", "down", "win").agg(F.count("*").alias("n"), F.sum("score_differential").alias("s"), F.sum("yardline_100").alias("y"), F.sum("ydstogo").alias("g"))


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "case when p_partkey % 31 = 0 then '' else cast(p_partkey as string) end as id",
        "concat('  ', p_name, '\t', p_brand) as name",
        "concat(p_type, '\r\n', p_brand) as description",
        "case p_size % 3 when 0 then '2025-01' when 1 then 'Rome' else '' end as city",
        "case when p_partkey % 7 = 0 then 'free' else concat('$', format_number(p_retailprice, 2)) end as price",
        "case when p_size % 5 = 0 then '' else concat(cast(p_size % 6 as string), '.0') end as bedrooms",
        "cast(p_size % 4 + 0.5 as string) as bathrooms",
        "case when p_partkey % 13 = 0 then 'n/a' else cast(p_size as string) end as latitude",
        "cast(p_size / 2.0 as string) as longitude",
    )


@query(
    """WITH l AS (SELECT p_partkey, p_name || ' ' || p_brand AS name, p_type || ' ' || p_brand AS description, CASE p_size % 3 WHEN 0 THEN 'Milan' WHEN 1 THEN 'Rome' ELSE '' END AS city,
  CASE WHEN p_partkey % 7 <> 0 THEN round(p_retailprice, 2) END AS price, CASE WHEN p_size % 5 <> 0 THEN p_size % 6 END AS bedrooms, p_size % 4 + 0.5::DOUBLE AS bathrooms, p_size FROM part
  WHERE p_partkey % 31 <> 0 AND p_partkey % 13 <> 0)
SELECT p_partkey::VARCHAR AS id, city, price, concat_ws(' ', regexp_replace(trim(name), '\\s+', ' ', 'g'), description, CASE WHEN city <> '' THEN 'Located in ' || city || '.' END,
  CASE WHEN bedrooms IS NOT NULL THEN bedrooms::VARCHAR || ' bedrooms.' END, bathrooms::VARCHAR || ' bathrooms.', CASE WHEN price IS NOT NULL THEN '$' || round_even(price, 0)::BIGINT::VARCHAR || ' per night.' END) AS text
FROM l"""
)
def listing_text(spark, sf_dir):
    return relational.clean_listings(raw_listings(spark, sf_dir), {"2025-01": "Milan"}).where("valid").select("id", "city", "price", "text")


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g'))) AS h FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("h"))


# --- aggregates, joins, sets ---


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return relational.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT user_id, (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def enrich_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query(
    "SELECT o_custkey AS c_custkey, last.o_orderkey AS o_orderkey, c_name FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) last ON c_custkey = o_custkey"
)
def join_last(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.join_last(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_orderkey")


@query(
    "SELECT c_custkey, COALESCE(s_name, c_name) AS name, c_acctbal AS score, COALESCE(s_nationkey, -1) AS nation FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"
)
def overlay_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("nation"))
    return relational.overlay(left, right, "c_custkey", keep=["score"], defaults={"nation": -1})


@query("SELECT c_custkey, COALESCE(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def default_join(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return relational.with_default(table(spark, sf_dir, "customer").select("c_custkey"), counts, "c_custkey", "n", 0)


@query("SELECT o_orderkey, md5('42:' || o_orderkey::VARCHAR) AS h FROM orders ORDER BY h, o_orderkey LIMIT 200")
def seeded_sample(spark, sf_dir):
    return relational.sample(table(spark, sf_dir, "orders"), "o_orderkey", 200).select("o_orderkey", F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))).alias("h"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'schein') OR contains(lower(text), 'copyright')")
def keyword_filter(spark, sf_dir):
    return relational.keyword_filter(table(spark, sf_dir, "documents"), "text", ["license", "schein", "copyright"]).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL")
def undirected_edges(spark, sf_dir):
    return relational.undirected(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("SELECT DISTINCT l_orderkey AS from_id, n_nationkey AS to_id FROM lineitem JOIN nation ON n_name = (SELECT n_name FROM nation x WHERE x.n_nationkey = l_suppkey % 30) WHERE l_orderkey IN (SELECT n_nationkey FROM nation)")
def hyperlinks(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), (F.col("l_suppkey") % 30).alias("n"))
    links = links.join(F.broadcast(names.select(F.col("id").alias("n"), F.col("title").alias("to_title"))), "n").select("from_id", "to_title")
    return relational.two_sided(links, names).select("from_id", F.col("to_id").cast("int").alias("to_id"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT conv_id, count(*) AS n, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY conv_id")
def distinct_lists(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.collect_list("role"))).alias("roles"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, (sum(l_quantity) / count(*)) / (SELECT sum(l_quantity) / count(*) FROM lineitem) AS speed FROM lineitem GROUP BY ALL")
def speed_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    whole = rows.agg((F.sum("l_quantity") / F.count("*")).alias("base"))
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).crossJoin(F.broadcast(whole))
    return out.select("l_returnflag", "l_linestatus", "n", (F.col("q") / F.col("n") / F.col("base")).alias("speed"))


# --- sources and sinks, by writing and reading back ---


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/quernstone-files-{uuid.uuid4().hex}/{name}"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer").repartition(3), path, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], gzip=True)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def csv_union(spark, sf_dir):
    a, b = scratch(spark, "a"), scratch(spark, "b")
    files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), a)
    files.write_csv(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), b)
    rows = files.read_csv(spark, [a, b])
    return rows.select(X.strict_int(F.col("n_nationkey")).alias("n_nationkey"), "n_name")


@query("SELECT p_partkey, p_brand, p_size FROM part")
def tsv_scan(spark, sf_dir):
    path = scratch(spark, "tsv")
    files.write_csv(table(spark, sf_dir, "part"), path, ["p_partkey", "p_brand", "p_size"], sep="\t", header=False)
    rows = files.read_positional(spark, path, ["p_partkey", "p_brand", "p_size"], sep="\t")
    return rows.select(F.col("p_partkey").try_cast("long").alias("p_partkey"), "p_brand", X.strict_int(F.col("p_size")).alias("p_size"))


@query("SELECT doc_id::VARCHAR AS id, source AS title, text FROM documents")
def jsonl_scan(spark, sf_dir):
    path = scratch(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text"), path)
    return files.read_jsonl(spark, path)


@query("SELECT o_orderkey AS from_id, o_orderpriority || '''s' AS title FROM orders")
def dump_scan(spark, sf_dir):
    path = scratch(spark, "dump")
    orders = table(spark, sf_dir, "orders")
    one = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(",0,'"), F.col("o_orderpriority"), F.lit("\\'s',0)"))
    lines = orders.groupBy((F.col("o_orderkey") % 50).alias("k")).agg(F.concat(F.lit("INSERT INTO `pagelinks` VALUES "), F.array_join(F.collect_list(one), ","), F.lit(";")).alias("value"))
    lines.select("value").union(spark.range(1).select(F.lit("-- (1,0,'no',0)").alias("value"))).write.option("compression", "gzip").text(path)
    return files.read_dump(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def json_document(spark, sf_dir):
    path = scratch(spark, "json")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.to_json_array(rows).write.text(path)
    return files.read_json_document(spark, path, "n_nationkey int, n_name string")


@query("SELECT l_orderkey AS o, l_linenumber AS n, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber, l_orderkey) - 1 AS row_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def dense_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).distinct()
    return files.numbered(rows.withColumn("k", F.col("o") * 10 + F.col("n")), "k").select("o", "n", "row_id")


# --- retrieval; documents stand for articles ---

ASKED = "the thing der"
RARE = "erthst ontion the"


def _index(spark: SparkSession, sf_dir: str) -> text.Index:
    return text.build_index(table(spark, sf_dir, "documents"))


INDEX = """d AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[а-яёa-z]+') AS w FROM documents), dl AS (SELECT doc_id, len(w)::BIGINT AS len FROM d),
post AS MATERIALIZED (SELECT term, doc_id, count(*)::BIGINT AS cnt FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
p AS MATERIALIZED (SELECT post.*, len, cnt / len AS tf FROM post JOIN dl USING (doc_id)), df AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term), n AS (SELECT count(*)::BIGINT AS n, avg(len) AS m FROM dl)"""


def _terms(q: str) -> str:
    return ", ".join(f"('{t}', {c}::BIGINT)" for t, c in __import__("collections").Counter(text.query_terms(q)).items())


@query(f"WITH {INDEX} SELECT term, count(*) AS df, sum(cnt)::BIGINT AS cnt, round(sum(tf), 6) AS tf FROM p GROUP BY term")
def postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("cnt").alias("cnt"), F.round(F.sum("tf"), 6).alias("tf"))


@query(f"WITH {INDEX}, q(term, c) AS (VALUES {_terms(ASKED)}) SELECT doc_id, round(sum(tf), 6) AS score FROM p JOIN q USING (term) GROUP BY doc_id HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 10")
def daat(spark, sf_dir):
    return text.daat(_index(spark, sf_dir), ASKED)


@query(f"WITH {INDEX}, q(term, c) AS (VALUES {_terms(ASKED)}) SELECT doc_id, round(sum(tf), 6) AS score FROM p JOIN q USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def taat(spark, sf_dir):
    return text.taat(_index(spark, sf_dir), ASKED)


@query(
    f"WITH {INDEX}, q(term, c) AS (VALUES {_terms(ASKED)}), pq AS MATERIALIZED (SELECT term, doc_id, tf FROM p JOIN q USING (term)), "
    "r AS MATERIALIZED (SELECT doc_id, round(sum(tf), 6) AS score FROM pq GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10), "
    "grid AS MATERIALIZED (SELECT q.term, r.doc_id FROM q CROSS JOIN r) SELECT grid.term, grid.doc_id, round(COALESCE(tf, 0), 4) AS tf FROM grid LEFT JOIN pq USING (term, doc_id)"
)
def term_matrix(spark, sf_dir):
    index = _index(spark, sf_dir)
    return text.term_matrix(index, ASKED, text.taat(index, ASKED))


WEIGHTS = """i AS (SELECT term, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM df, n), x AS (SELECT term, doc_id, idf, tf * idf AS w FROM p JOIN i USING (term)),
l AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1), tw AS (SELECT term, doc_id, idf, w / CASE WHEN l > 0 THEN l ELSE 1 END AS w FROM x JOIN l USING (doc_id))"""
QW = f"q(term, c) AS (VALUES {_terms(RARE)}), qr AS (SELECT term, c / (SELECT sum(c) FROM q) * idf AS w FROM q JOIN i USING (term)), qw AS (SELECT term, w / sqrt(sum(w * w) OVER ()) AS qw FROM qr)"
TFIDF = f"WITH {INDEX}, {WEIGHTS}, {QW}, tq AS MATERIALIZED (SELECT term, doc_id, tw.idf AS idf, w, qw FROM tw JOIN qw USING (term)), r AS MATERIALIZED (SELECT doc_id, round(sum(w * qw), 6) AS score FROM tq GROUP BY 1 HAVING sum(w * qw) > 0 ORDER BY score DESC, doc_id LIMIT 10)"


@query(f"{TFIDF} SELECT * FROM r")
def tfidf(spark, sf_dir):
    return text.tfidf(_index(spark, sf_dir), RARE)


@query(f"{TFIDF}, grid AS MATERIALIZED (SELECT q.term, r.doc_id FROM q CROSS JOIN r) SELECT grid.term, grid.doc_id, COALESCE(round(idf * w, 5), 0) AS contribution FROM grid LEFT JOIN tq USING (term, doc_id)")
def tfidf_contributions(spark, sf_dir):
    index = _index(spark, sf_dir)
    return text.tfidf_contributions(index, RARE, text.tfidf(index, RARE))


BM25 = f"""WITH {INDEX}, q(term, c) AS (VALUES {_terms(RARE)}), raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw, m FROM df, n), mean AS (SELECT avg(raw) AS a FROM raw),
k AS (SELECT term, c, CASE WHEN raw < 0 THEN 0.25::DOUBLE * a ELSE raw END AS idf, m FROM raw JOIN q USING (term), mean),
part AS (SELECT term, doc_id, idf * (cnt * 2.5::DOUBLE) / (cnt + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / m)) AS one, c FROM p JOIN k USING (term)),
r AS (SELECT doc_id, round(sum(one * c), 6) AS score FROM part GROUP BY 1 HAVING sum(one * c) > 0 ORDER BY score DESC, doc_id LIMIT 10)"""


@query(f"{BM25} SELECT * FROM r")
def bm25(spark, sf_dir):
    return text.bm25(_index(spark, sf_dir), RARE)


@query(f"{BM25} SELECT q.term, r.doc_id, COALESCE(round(one, 5), 0) AS contribution FROM q CROSS JOIN r LEFT JOIN part ON part.term = q.term AND part.doc_id = r.doc_id")
def bm25_contributions(spark, sf_dir):
    index = _index(spark, sf_dir)
    return text.bm25_contributions(index, RARE, text.bm25(index, RARE))


@query(f"WITH {INDEX}, q(term, c) AS (VALUES {_terms(ASKED)}) SELECT doc_id FROM p JOIN q USING (term) GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def posting_intersection(spark, sf_dir):
    return relational.all_terms(_index(spark, sf_dir).postings, text.query_terms(ASKED))


@query()
def lsa(spark, sf_dir):
    """Singular vectors have no fixed sign, so SQL can't give these scores; tests hold them against a dense decomposition."""
    return text.Latent(table(spark, sf_dir, "documents")).search(RARE)


@query()
def lsa_scatter(spark, sf_dir):
    latent = text.Latent(table(spark, sf_dir, "documents"), k=2)
    return latent.scatter(latent.search(RARE))


@query()
def pca_scatter(spark, sf_dir):
    """Two principal components of the embeddings, about their mean; signs are free."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(X.doubles(F.col("embedding"))).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    placed = PCA(k=2, inputCol="c", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return placed.select("vec_id", F.round(F.col("p")[0], 5).alias("x"), F.round(F.col("p")[1], 5).alias("y"))


@query(
    f"""{BM25}, t AS (SELECT doc_id, source || ' no' AS title, trim(regexp_replace(text, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g')) AS t FROM documents)
SELECT r.doc_id, title, replace(title, ' ', '_') AS title_url, round(score, 4) AS score, CASE WHEN r.doc_id % 2 = 0 THEN round(r.doc_id / 7.0::DOUBLE, 6) ELSE 0 END AS pagerank,
  CASE WHEN length(t) <= 300 THEN t ELSE regexp_extract(substring(t, 1, 300), '^(.{{0,299}})\\s', 1) || '…' END AS snippet FROM r JOIN t USING (doc_id)"""
)
def enriched_results(spark, sf_dir):
    """Ranks are known of even ids only, so that the others get the default."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.concat("source", F.lit(" no")))
    ranks = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") / 7.0).alias("r"))
    return plan_search.enrich(text.bm25(_index(spark, sf_dir), RARE), docs, ranks)


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_extract(substring(t, 1, 300), '^(.{0,299})\\s', 1) || '…' END AS s FROM t"""
)
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("s"))


# --- what articles and listings become ---


@query("SELECT doc_id, source || '. ' || substring(COALESCE(text, ''), 1, 512) AS vector_form, md5(source || '. ' || substring(COALESCE(text, ''), 1, 2000)) AS entity_form FROM documents")
def article_forms(spark, sf_dir):
    form = lambda n: X.article_form(F.col("source"), F.col("text"), n)
    return table(spark, sf_dir, "documents").select("doc_id", form(512).alias("vector_form"), F.md5(form(2000)).alias("entity_form"))


@query(
    "SELECT doc_id AS id, substring(text, 1, 60) AS title, substring(text, 1, 5000) AS text FROM documents "
    "WHERE contains(lower(substring(text, 1, 60)), 'the') OR contains(lower(substring(text, 1, 60)), 'sch') ORDER BY id LIMIT 100"
)
def corpus_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.substring("text", 1, 60))
    return relational.corpus(docs, ["the", "sch"], most=100, id_col="doc_id")


@query(
    """WITH v AS (SELECT (vec_id % 300 + 1)::VARCHAR AS id, vec_id, embedding FROM embeddings), last AS (SELECT id, arg_max(embedding, vec_id) AS e FROM v GROUP BY id)
SELECT p_partkey::VARCHAR AS listing_id, substring('  ' || repeat(p_name || ' ', 20), 1, 200) AS name, substring(repeat(p_type || ' ', 60), 1, 500) AS description, p_brand AS city,
  CASE WHEN p_size % 4 = 0 THEN 0 ELSE round(p_retailprice, 2) END AS price, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END::INT AS bedrooms, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size / 2.0::DOUBLE END AS bathrooms,
  p_size::DOUBLE AS latitude, -p_size::DOUBLE AS longitude, e[1]::DOUBLE AS first FROM part JOIN last ON id = p_partkey::VARCHAR"""
)
def load_projection(spark, sf_dir):
    listings = table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as id", "concat('  ', repeat(concat(p_name, ' '), 20)) as name", "repeat(concat(p_type, ' '), 60) as description", "p_brand as city",
        "case when p_size % 4 = 0 then '' else cast(round(p_retailprice, 2) as string) end as price", "case when p_size % 5 = 0 then null else cast(p_size as string) end as bedrooms",
        "case when p_size % 3 = 0 then ' ' else cast(p_size / 2.0 as string) end as bathrooms", "cast(p_size as string) as latitude", "cast(-p_size as string) as longitude",
    )
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 300 + 1).cast("string").alias("id"), "embedding", F.col("vec_id").alias("n"))
    return relational.load_rows(listings, vectors).withColumn("first", F.col("embedding")[0].cast("double")).drop("embedding")


@query(
    """SELECT p_partkey AS id, p_size::DOUBLE AS lat, p_size / 2.0::DOUBLE AS lon, substring(repeat(p_name || ' ', 9), 1, 60) AS name, p_brand AS city, p_size % 7 AS price
FROM part WHERE p_partkey % 13 <> 0 ORDER BY md5('42:' || p_partkey::VARCHAR), p_partkey LIMIT 150"""
)
def map_sample(spark, sf_dir):
    listings = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "case when p_partkey % 13 = 0 then 'n/a' else cast(p_size as string) end as latitude", "cast(p_size / 2.0 as string) as longitude",
        "repeat(concat(p_name, ' '), 9) as name", "p_brand as city", "p_size % 7 as price",
    )
    return relational.map_sample(listings, n=150)


KINDS = "CASE WHEN length(x) >= 8 THEN 'N' WHEN regexp_matches(x, '^[A-Z]') THEN 'N' WHEN x LIKE '%e' THEN 'A' ELSE '-' END"


@query(
    f"""WITH s AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(substring(text, 1, 2000), '[A-Za-z]+'), lambda x: chr(1) || {KINDS} || chr(2) || x), '') AS s FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(s, '\x01N\x02[^\x01]*(?:\x01[NA]\x02[^\x01]*)+')) AS r FROM s),
p AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(r, '\x01[NA]\x02', ' ', 'g'))) AS phrase FROM r)
SELECT doc_id, phrase FROM p WHERE length(phrase) > 4 AND length(phrase) < 60"""
)
def noun_phrases(spark, sf_dir):
    """Phrases of words whose kinds are told by a plain rule, in place of a tagger's."""
    kind = lambda x: F.when(F.length(x) >= 8, "NOUN").when(x.rlike("^[A-Z]"), "PROPN").when(F.endswith(x, F.lit("e")), "ADJ").otherwise("X")
    words = F.regexp_extract_all(F.substring("text", 1, 2000), F.lit("[A-Za-z]+"), F.lit(0))
    tagged = F.transform(words, lambda x: F.struct(x.alias("lemma"), kind(x).alias("pos")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(graph.noun_phrases(tagged)).alias("phrase"))


# --- graphs; suppliers of common orders, and documents of common entities ---


def supplier_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("entity"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), stage(graph.cooccurrence(pairs), "edges")


def co_sql(pairs: str) -> str:
    return f"""de AS (SELECT DISTINCT doc_id, entity FROM ({pairs})), band AS (SELECT entity FROM de GROUP BY 1 HAVING count(*) BETWEEN 2 AND 500),
ok AS (SELECT de.* FROM de JOIN band USING (entity)), ww AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS w FROM ok a JOIN ok b ON a.entity = b.entity AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM ww) WHERE k <= 20)"""


SUPPLIERS = co_sql("SELECT l_suppkey AS doc_id, l_orderkey AS entity FROM lineitem")
ENTITIES = "SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}'))) AS entity FROM documents"


@query(f"WITH {SUPPLIERS} SELECT src, dst, w FROM e")
def cooccurrence(spark, sf_dir):
    return supplier_graph(spark, sf_dir)[1]


@query(f"SELECT DISTINCT doc_id, entity FROM ({ENTITIES})")
def entities(spark, sf_dir):
    return graph.regex_entities(table(spark, sf_dir, "documents"), pattern="[A-Z][a-z]{6,}")


@query(f"WITH {co_sql(ENTITIES)} SELECT src, dst, w FROM e")
def entity_graph(spark, sf_dir):
    return graph.cooccurrence(graph.regex_entities(table(spark, sf_dir, "documents"), pattern="[A-Z][a-z]{6,}"))


def rank_sql(start: str, share: str, rounds: int, tol: str) -> str:
    """Unrolled rounds; the first whose change is below ``tol``, or the last."""
    parts = [f"nd AS MATERIALIZED ({start})", f"sh AS MATERIALIZED ({share})", "r0 AS MATERIALIZED (SELECT id, p, r FROM nd)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"""r{k} AS MATERIALIZED (SELECT o.id, o.p, 0.15::DOUBLE * o.p + 0.85::DOUBLE * (COALESCE(g.g, 0) + o.p * (SELECT COALESCE(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM sh))) AS r
FROM r{k - 1} o LEFT JOIN (SELECT dst, sum(r * share) AS g FROM sh JOIN r{k - 1} ON id = src GROUP BY dst) g ON g.dst = o.id)"""
        )
    moved = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.r - b.r)) AS m FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(1, rounds + 1))
    return ", ".join(parts) + f", moved AS ({moved}), stop AS (SELECT COALESCE(min(k) FILTER (m < {tol}), {rounds}) AS k FROM moved) SELECT id, round(r, 9) AS r FROM ({every}) JOIN stop USING (k)"


EVEN = "SELECT s_suppkey AS id, 1.0::DOUBLE / count(*) OVER () AS p, 1.0::DOUBLE / count(*) OVER () AS r FROM supplier"
BY_DEGREE = "SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e"
BY_WEIGHT = "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e"
SEEDED = "SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN 1.0::DOUBLE ELSE 0 END / greatest(count(*) FILTER (s_nationkey = 3) OVER (), 1) AS p, p AS r FROM supplier"


@query(f"WITH {SUPPLIERS}, {rank_sql(EVEN, BY_DEGREE, 20, '1e-6')}")
def pagerank(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    return graph.pagerank(nodes, edges).select("id", F.round("r", 9).alias("r"))


@query(f"WITH {SUPPLIERS}, {rank_sql(EVEN, BY_DEGREE, 20, '1e-6')} ORDER BY r DESC, id LIMIT 10")
def top_ranks(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    return graph.top_ranks(graph.pagerank(nodes, edges).select("id", F.round("r", 9).alias("r")))


@query(f"WITH {SUPPLIERS}, {rank_sql(EVEN, BY_DEGREE, 20, '1e-6 * (SELECT count(*) FROM supplier)')}")
def pagerank_supersteps(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    return graph.pagerank_supersteps(nodes, edges).select("id", F.round("r", 9).alias("r"))


@query(f"WITH {SUPPLIERS}, {rank_sql(SEEDED, BY_WEIGHT, 50, '1e-6')}")
def personalized_pagerank(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("id"), F.lit(1.0).alias("weight"))
    return graph.personalized_pagerank(nodes, edges, seeds).select("id", F.round("r", 9).alias("r"))


@query(f"WITH {SUPPLIERS} SELECT src, sum(w)::BIGINT AS out_w, count(*) AS degree FROM e GROUP BY src")
def out_weights(spark, sf_dir):
    return graph.out_weights(supplier_graph(spark, sf_dir)[1], F.col("w"))


FOUND = "top2 AS (SELECT entity FROM de GROUP BY entity HAVING count(*) BETWEEN 2 AND 50 ORDER BY count(*) DESC, entity LIMIT 2), sd AS (SELECT doc_id AS id, 2.0::DOUBLE * count(*) AS weight FROM de JOIN top2 USING (entity) GROUP BY 1)"
FROM_FOUND = "SELECT id, p, p AS r FROM (SELECT doc_id AS id, COALESCE(weight, 0) / (SELECT sum(weight) FROM sd) AS p FROM documents LEFT JOIN sd ON id = doc_id)"


@query(f"WITH {co_sql(ENTITIES)}, {FOUND}, " + rank_sql(FROM_FOUND, BY_WEIGHT, 50, "1e-6").replace("SELECT id, round(r, 9) AS r FROM (", "SELECT id AS doc_id, round(r, 9) AS score FROM (") + " ORDER BY score DESC, doc_id LIMIT 10")
def ppr_search(spark, sf_dir):
    """Documents by personalised PageRank from those of the two commonest entities that 2 to 50 have."""
    docs = table(spark, sf_dir, "documents")
    found = stage(graph.regex_entities(docs, pattern="[A-Z][a-z]{6,}"), "entities")
    edges = stage(graph.cooccurrence(found), "edges")
    first = [r[0] for r in found.groupBy("entity").count().where("count between 2 and 50").orderBy(F.desc("count"), "entity").limit(2).select("entity").collect()]
    return graph.ppr_search(found, docs.select(F.col("doc_id").alias("id")), edges, first, first)


@query(
    f"""WITH {SUPPLIERS}, res AS (SELECT s_suppkey AS id, s_acctbal AS score FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10),
rk AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM res),
nb AS (SELECT src, dst, rank, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM e JOIN rk ON rk.id = src),
ad AS (SELECT dst AS id, min(rank * 100 + k) AS seat FROM nb WHERE k <= 5 AND dst NOT IN (SELECT id FROM res) GROUP BY dst),
ids AS (SELECT id, 0 AS tier FROM res UNION ALL SELECT id, 1 FROM (SELECT id, row_number() OVER (ORDER BY seat, id) AS p FROM ad) WHERE p <= 40 - (SELECT count(*) FROM res))
SELECT id, round(COALESCE(score, 0), 6) AS score, round(COALESCE(score, 0) / (SELECT max(score) FROM res), 3) AS norm_score,
  CASE WHEN s_nationkey = 3 AND tier = 0 THEN 'seed_result' WHEN s_nationkey = 3 THEN 'seed' WHEN tier = 0 THEN 'result' ELSE 'neighbor' END AS role
FROM ids LEFT JOIN res USING (id) JOIN supplier ON s_suppkey = id"""
)
def subgraph_nodes(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier")
    results = suppliers.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return graph.subgraph(stage(results, "results"), suppliers.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id")), edges)[0]


@query(
    f"""WITH {SUPPLIERS}, res AS (SELECT s_suppkey AS id, s_acctbal AS score FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10),
rk AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM res),
nb AS (SELECT src, dst, rank, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM e JOIN rk ON rk.id = src),
ad AS (SELECT dst AS id, min(rank * 100 + k) AS seat FROM nb WHERE k <= 5 AND dst NOT IN (SELECT id FROM res) GROUP BY dst),
ids AS (SELECT id, 0 AS tier FROM res UNION ALL SELECT id, 1 FROM (SELECT id, row_number() OVER (ORDER BY seat, id) AS p FROM ad) WHERE p <= 40 - (SELECT count(*) FROM res))
SELECT src, dst, w FROM e WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)"""
)
def subgraph_edges(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier")
    results = suppliers.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return graph.subgraph(stage(results, "results"), suppliers.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id")), edges)[1]


@query(
    """WITH w AS (SELECT doc_id AS d, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(COALESCE(text, '')), '[а-яёa-z]+')) AS t FROM documents) WHERE length(t) > 1 GROUP BY ALL),
tt AS (SELECT t, count(*) AS df, sum(c) AS a FROM w GROUP BY t ORDER BY a DESC, t LIMIT 30000),
r AS (SELECT d, t, (1 + ln(c)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w FROM w JOIN tt USING (t)),
u AS (SELECT d, t, w / sqrt(sum(w * w) OVER (PARTITION BY d)) AS w FROM r),
s AS (SELECT a.d AS src, b.d AS dst, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.t = b.t AND a.d <> b.d GROUP BY ALL)
SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM s) WHERE k <= 5"""
)
def knn_graph(spark, sf_dir):
    return graph.knn_graph(table(spark, sf_dir, "documents"))


# --- vectors ---

COSINE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


@query(f"SELECT b.vec_id, round({COSINE}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, b.vec_id LIMIT 10")
def exact_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector.exact_knn(rows, list(rows.where("vec_id = 0").first()["embedding"]))


@query(f"SELECT b.vec_id, round({COSINE}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label = 3 ORDER BY score DESC, b.vec_id LIMIT 10")
def filtered_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector.exact_knn(rows, list(rows.where("vec_id = 0").first()["embedding"]), where=F.col("label") == 3)


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({COSINE}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def batch_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector.batch_knn(rows, rows.where("vec_id % 20 = 0"))


@query()
def ivf_recall(spark, sf_dir):
    """Recall of the cell index against the exact search; an index has no SQL."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    return relational.recall(vector.batch_knn(rows, asked), vector.search(rows, asked, 10, ("ivf",))["ivf"][0])


@query()
def sketch_recall(spark, sf_dir):
    """Recall of the sketch index, which ranks 15 in 100 rows exactly."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    return relational.recall(vector.batch_knn(rows, asked), vector.SketchIndex(rows).search(asked, 10))


@query()
def lsh_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    return relational.recall(vector.batch_knn(rows, asked), vector.lsh_knn(rows, asked, 10))


@query("SELECT l_suppkey AS vec_id, embedding[1]::DOUBLE AS x, count(*) AS n FROM lineitem JOIN embeddings ON vec_id = l_suppkey GROUP BY ALL")
def load_join(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("vec_id")).agg(F.count("*").alias("n"))
    return counts.join(table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), "n")


@query()
def encoded_listings(spark, sf_dir):
    """Listings with vectors of the stand-in encoder, which SQL does not have."""
    rows = relational.clean_listings(raw_listings(spark, sf_dir)).where("valid")
    return vector.encode(rows, "text").select("id", F.round(X.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("size"))


# --- matrices; embeddings as rows ---


def matrix(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return rows.select(F.col("vec_id").alias("i"), F.col("p").cast("long").alias("j"), F.col("v").cast("double").alias("v")) if column == "i" else rows.select(F.col("p").cast("long").alias("i"), F.col("vec_id").alias("j"), F.col("v").cast("double").alias("v"))


COO = "m AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"WITH {COO} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def matmul(spark, sf_dir):
    return linalg.matmul(matrix(spark, sf_dir, "j"), matrix(spark, sf_dir, "i")).withColumn("v", F.round("v", 6))


@query(f"WITH {COO} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def matmul_blocks(spark, sf_dir):
    return linalg.matmul_blocks(matrix(spark, sf_dir, "j"), matrix(spark, sf_dir, "i"), 64).withColumn("v", F.round("v", 6))


@query(f"WITH {COO} SELECT j AS i, i AS j, v FROM m")
def transpose(spark, sf_dir):
    return linalg.transpose(matrix(spark, sf_dir, "i"))


@query(f"WITH {COO} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def gram(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(X.doubles(F.col("embedding")).alias("a"), F.col("label").cast("double").alias("y"))
    return linalg.gram(rows)[0].withColumn("v", F.round("v", 6))


@query(
    """WITH t AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS x, sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice) AS y, sum(l_quantity * l_extendedprice) AS xy FROM lineitem)
SELECT 0::BIGINT AS j, round((xx * y - x * xy) / (n * xx - x * x), 4) AS x FROM t UNION ALL SELECT 1, round((n * xy - x * y) / (n * xx - x * x), 4) FROM t"""
)
def least_squares(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array(F.lit(1.0), "l_quantity").alias("a"), F.col("l_extendedprice").alias("y"))
    return linalg.least_squares(rows, 2).withColumn("x", F.round("x", 4))


@query()
def generated_least_squares(spark, sf_dir):
    """Rows are made by a seeded generator of numpy, which SQL does not have; tests hold them against its solver."""
    truth = np.random.default_rng(7).standard_normal(8)
    return linalg.least_squares(linalg.generated_rows(spark, 2000, lambda i: linalg.seeded_row(i, 8, truth)), 8)


@query(
    f"""WITH {COO}, g AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL),
c AS (SELECT 'blocks' AS pair, x.v, y.v AS w FROM g x JOIN g y ON x.i = y.j AND x.j = y.i UNION ALL SELECT 'rounded', v, round(v, 2) FROM g)
SELECT pair, round(max(abs(v - w)), 6) AS max_abs_diff, bool_and(abs(v - w) <= 1e-8 + 1e-5 * abs(w)) AS all_close FROM c GROUP BY pair"""
)
def all_close(spark, sf_dir):
    """The product of a matrix with itself, computed in blocks and as a Gram matrix; and the latter against its cells rounded to 2 digits."""
    rows = table(spark, sf_dir, "embeddings").select(X.doubles(F.col("embedding")).alias("a"), F.col("label").cast("double").alias("y"))
    gram = stage(linalg.gram(rows)[0], "gram")
    blocks = linalg.matmul_blocks(matrix(spark, sf_dir, "j"), matrix(spark, sf_dir, "i"), 64)
    pairs = {"blocks": (blocks, gram), "rounded": (gram, gram.withColumn("v", F.round("v", 2)))}
    first, second = (relational.close(a, b, ["i", "j"]).select(F.lit(name).alias("pair"), F.round("max_abs_diff", 6).alias("max_abs_diff"), "all_close") for name, (a, b) in pairs.items())
    return first.unionByName(second)


# --- stream ---


@query()
def streamed_rates(spark, sf_dir):
    """The windowed rates as a stream over the events there are; the batch form has SQL."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    stream = rates.windowed_rates(rates.read_events(spark, f"{sf_dir}/event[s].parquet", schema))
    return rates.run_available(stream, "rates_" + uuid.uuid4().hex)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS total, count(*) FILTER (value > 50) AS wins, ((count(*) FILTER (value > 50) * 20000 + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS rate FROM events GROUP BY ALL")
def windowed_rates(spark, sf_dir):
    return rates.windowed_rates(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
