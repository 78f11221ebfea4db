"""The registered queries of the ten operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, lines, mixing, near, pages, substrings, topk, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of them."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit_languages(docs.where(~held_out & F.col("doc_id").isNotNull()))
    found = language.identify(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    out = pages.extract_main_text(_read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents, sources weighing 1, 2, 3 in turn, at most 3 copies of each."""
    mix = mixing.pareto_mix(_read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all others."""
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 8 words in whole documents."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted conversation -1, formatted and read back."""
    own = "</s>[INST] ok [/INST]"
    planted = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for n, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    messages = chat.stage(chat.linear_messages(rows, "conv_id", "turn", "role", "text"), "messages")
    paths = chat.reply_paths(messages.select("tree", "node", "parent", "score"))
    out = chat.format_paths(paths, messages).withColumn("turns", chat.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = chat.read_loss(F.col("formatted"), F.col("loss"))
    conv = F.when(F.col("tree") != "n", F.substring("tree", 2, 99).cast("long"))
    return out.withColumn("said", loss).select(
        conv.alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each page's url: the rules', else that of trees trained on the urls that rules decide."""
    return urls.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at 0.85 of five-word shingles."""
    return near.near_duplicates(_read(spark, sf_dir, "documents"), percent=85, words=5)


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 13 words and more that an earlier one has."""
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", substrings.kept_hash(F.col("text")).alias("kept_sha256"))


def op10_edit_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines within two edits of an earlier one."""
    out = lines.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_site_templates, op3_pareto_mix, op4_histogram_topk, op5_decontaminate, op6_reply_trees, op7_url_filter, op8_superminhash, op9_difference_cover, op10_edit_join_lines)}

SQL = {
    "op3_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, COALESCE('s' || source, 'n') AS key,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('17:' || COALESCE(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3.0::DOUBLE AS ceiling FROM s),
f AS (SELECT *, row_number() OVER o AS place,
        (sum(source_size::DOUBLE) OVER () - COALESCE(sum(ceiling) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - COALESCE(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY ceiling / weight, source ASC NULLS LAST)),
water AS (SELECT arg_min(level, place) AS water FROM f WHERE ceiling >= weight * level),
t AS (SELECT key, source_size, LEAST(ceiling, COALESCE(weight * water, ceiling)) AS target FROM f, water),
e AS (SELECT doc_id, key, size, source_size, target, u,
        LEAST(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END, 3.0::DOUBLE) AS expected FROM d JOIN t USING (key)),
p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS part FROM e),
q AS (SELECT *, CASE WHEN whole < 3 AND part > 0 THEN (u / (1.0::DOUBLE - u)) / (part / (1.0::DOUBLE - part)) END AS odds FROM p),
r AS (SELECT *, odds / (1.0::DOUBLE + odds) AS rank, max(target) OVER (PARTITION BY key) - (sum(whole * size) OVER (PARTITION BY key))::DOUBLE AS need FROM q),
c AS (SELECT *, COALESCE(sum(size) OVER (PARTITION BY key ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle FROM r),
m AS (SELECT *, whole + CASE WHEN rank IS NOT NULL AND need > 0 AND middle <= need THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM m
""",
    "op4_histogram_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
""",
    "op5_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, w[i:i + 7] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM v),
o AS (SELECT r, i, n, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT r, i, n, item FROM o JOIN v ON o.win = v.win AND o.n = len(v.win)),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, COALESCE(len(w), 0)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
""",
    "op6_reply_trees": r"""
WITH m AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM m),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(r) + length(t) + 23) AS chars
      FROM f GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM g
""",
    "op8_superminhash": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b) SELECT a, min(b) AS component_id FROM t GROUP BY a)
SELECT d.doc_id, COALESCE(n, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id
""",
    "op9_difference_cover": r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
o AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS f FROM o GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM o JOIN f USING (h) WHERE f < doc_id),
k AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
r AS (SELECT k.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY k.p) FILTER (g.p IS NULL) AS kept
      FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    # of two edits at most, one of three parts of a line is free; levenshtein counts bytes here, which is never less than characters and at most
    # four times as many, so pairs between are worked out by rows of the table of distances
    "op10_edit_join_lines": r"""
WITH RECURSIVE d AS (SELECT doc_id, text, COALESCE(string_split(text, chr(10)), []) AS lines FROM documents),
l AS (SELECT doc_id, COALESCE(doc_id, 9000000000000000)::HUGEINT * 1000000000 + n AS place, line, trim(line, ' ') <> '' AS said
      FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d)),
f AS (SELECT line, length(line) AS size, min(place) AS first FROM l WHERE said GROUP BY line),
u AS (SELECT *, least(size // 20, 2) AS t FROM f WHERE size >= 20),
c AS (SELECT a.line AS a, b.line AS b, a.t, a.first AS first_a, b.first AS first_b
      FROM u a JOIN (SELECT *, size - unnest([0, 1, 2]) AS near FROM u) b ON a.size = b.near AND (a.size < b.size OR a.line < b.line) AND b.size - a.size <= a.t
      WHERE abs(strlen(a.line) - strlen(b.line)) <= 4 * a.t
        AND (contains(b.line, a.line[1:a.size // 3]) OR contains(b.line, a.line[a.size // 3 + 1:2 * (a.size // 3)]) OR contains(b.line, a.line[2 * (a.size // 3) + 1:]))),
e AS MATERIALIZED (SELECT *, levenshtein(a, b) AS bytes FROM c),
y AS MATERIALIZED (SELECT row_number() OVER () AS id, string_split(a, '') AS x, string_split(b, '') AS y, * FROM e WHERE bytes > t AND bytes <= 4 * t),
r AS (SELECT id, 0 AS j, range(len(x) + 1) AS row FROM y
      UNION ALL
      SELECT id, j, list_transform(row, lambda v, i: (i - 1) + list_min(list_transform(row[1:i], lambda w, k: w - (k - 1)))) AS row
      FROM (SELECT id, j + 1 AS j, list_prepend(j + 1, list_transform(range(1, len(x) + 1), lambda i: least(row[i + 1] + 1, row[i] + (x[i] <> y[j + 1])::INT))) AS row
            FROM r JOIN y USING (id) WHERE j < len(y))),
k AS (SELECT a, b, first_a, first_b FROM e WHERE bytes <= t
      UNION ALL SELECT a, b, first_a, first_b FROM y JOIN r USING (id) WHERE j = len(y) AND row[len(x) + 1] <= t),
n AS (SELECT line, count(*) AS links, bool_or(other < own) AS late
      FROM (SELECT a AS line, first_a AS own, first_b AS other FROM k UNION ALL SELECT b, first_b, first_a FROM k) GROUP BY line),
g AS (SELECT doc_id, place, line, CASE WHEN said THEN COALESCE(links, 0) ELSE 0 END AS links, said AND (place <> first OR COALESCE(late, false)) AS gone
      FROM l LEFT JOIN f USING (line) LEFT JOIN n USING (line)),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sum(links) AS n_links, string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_links, 0)::BIGINT AS n_links, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id IS NOT DISTINCT FROM d.doc_id
""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
