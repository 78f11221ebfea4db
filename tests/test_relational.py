from pyspark.sql import functions as F

from quernstone.functions import expr as X
from quernstone.operators import relational as R

PLAYS = "qtr int, down int, score_differential int, yardline_100 int, win int"


def test_bucket_edges(spark):
    scores = [-15, -14, -13, -7, -6, -1, 0, 1, 6, 7, 13, 14, None]
    want = ["le-14", "le-14", "-13to-7", "-13to-7", "-6to-1", "-6to-1", "0", "1to6", "1to6", "7to13", "7to13", "ge14", "ge14"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s int").select("i", X.score_bucket(F.col("s")).alias("b"))
    assert [r.b for r in df.orderBy("i").collect()] == want
    yards = [25, 26, 50, 51, 75, 76, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(yards)], "i int, s int").select("i", X.field_bucket(F.col("s")).alias("b"))
    assert [r.b for r in df.orderBy("i").collect()] == ["0-25", "26-50", "26-50", "51-75", "51-75", "76-100", "76-100"]


def test_groups_of_nine_are_dropped_and_of_ten_kept(spark):
    rows = [(1, 1, 0, 10, 1)] * 9 + [(2, 1, 0, 10, 1)] * 9 + [(2, 1, 0, 10, 0)] + [(5, 1, 0, 10, 1)] * 20
    got = R.situation(spark.createDataFrame(rows, PLAYS)).collect()
    assert [(r.qtr, r.wins, r.total, r.win_probability, r.win_prob_bayes) for r in got] == [(2, 9, 10, 0.9, 0.7857)]


def test_nulls_by_flavour(spark):
    rows = [(1, 1, 0, 10, 1)] * 10 + [(1, 1, 0, 10, None)] * 5 + [(1, 1, None, 10, 1)] * 10
    df = spark.createDataFrame(rows, PLAYS)
    totals = lambda f: {r.score_diff_bucket: r.total for r in R.situation(df, flavour=f, bayes=False).collect()}
    assert totals("spark") == {"0": 10, "ge14": 10}
    assert totals("hive") == {"0": 15, "ge14": 10}
    assert totals("mapreduce") == {"0": 10}


def test_rounding_ties_go_up(spark):
    row = spark.range(1).select(X.ratio(F.lit(1), F.lit(32)).alias("a"), X.ratio(F.lit(57), F.lit(800)).alias("b"), X.ratio(F.lit(5040), F.lit(9406)).alias("c")).first()
    assert tuple(row) == (0.0313, 0.0713, 0.5358)


def test_clean_plays(spark):
    names = ["qtr", "down", "ydstogo", "yardline_100", "score_differential", "posteam_type", "result", "file"]
    rows = [
        ("3.0", "2", "5.5", " 40 ", "-7", "home", "3", "a"),
        ("3", "2", "5", "40", "-7", "away", "-3", "a"),
        ("3", "2", "5", "40", "-7", "home", "-3", "a"),
        ("3", "2", "5", "40", "-7", "home", "0", "a"),
        ("3", "2", "5", "40", "-7", "bench", "3", "b"),
        ("NA", "2", "5", "40", "-7", "home", "3", "b"),
        ("3", "", "5", "40", "-7", "home", "3", "b"),
        ("3", "x", "5", "40", "-7", "home", "3", "b"),
        (None, "2", "5", "40", "-7", "home", "3", "b"),
    ]
    out = R.clean_plays(spark.createDataFrame(rows, names))
    assert [(r.qtr, r.ydstogo, r.win) for r in out.where("valid").collect()] == [(3, 5.5, 1), (3, 5.0, 1), (3, 5.0, 0)]
    assert {r.file: (r.written, r.skipped) for r in R.tally(out, "file").collect()} == {"a": (3, 1), "b": (0, 5)}


def test_strict_and_loose_numbers(spark):
    row = spark.range(1).select(X.strict_int(F.lit("1.0")).alias("a"), X.strict_int(F.lit(" 3 ")).alias("b"), X.to_int(F.lit("-2.9")).alias("c"), X.to_int(F.lit("x")).alias("d")).first()
    assert tuple(row) == (None, 3, -2, None)


def test_listings(spark):
    cols = ["id", "name", "description", "city", "price", "bedrooms", "bathrooms", "latitude", "longitude"]
    rows = [
        ("1", "A  b\r\n", "x\ty", "2025-01", "$1,234.50", "2.0", "1.5", "1", "2"),
        ("2", "A long enough name", "", "Rome", "free", "", "", "1", "2"),
        ("3", "A long enough name", "", "Rome", "$5", "1", "1", "", "2"),
        ("", "A long enough name", "", "Rome", "$5", "1", "1", "1", "2"),
        ("5", "A", "", "", "", "", "", "1", "2"),
    ]
    out = R.clean_listings(spark.createDataFrame(rows, cols), {"2025-01": "Milan"}).where("valid").orderBy("id").collect()
    assert [r.text for r in out] == ["A b x y Located in Milan. 2 bedrooms. 1.5 bathrooms. $1234 per night.", "A long enough name Located in Rome."]
    assert (out[0].price, out[0].bedrooms, out[1].price) == (1234.5, 2, None)


def test_percentiles(spark):
    row = R.percentiles(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), "v").first()
    assert [round(x, 2) for x in row] == [2.5, 8.95, 9.79]


def test_recall(spark):
    truth = spark.createDataFrame([(1, 2), (1, 1)], "query_id long, vec_id long")
    found = spark.createDataFrame([(1, 2), (1, 3)], "query_id long, vec_id long")
    assert R.recall(truth, found).first().recall == 0.5
    assert R.recall(truth, truth).first().recall == 1.0
    assert R.recall(truth, found.limit(0)).first().recall == 0.0


def test_overlay_keeps_and_defaults(spark):
    left = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.4)], "id int, name string, score double")
    right = spark.createDataFrame([(1, "A", 9.0, None)], "id int, name string, score double, url string")
    got = sorted(R.overlay(left, right, "id", keep=["score"], defaults={"url": "-"}).collect())
    assert [tuple(r) for r in got] == [(1, "A", 0.5, "-"), (2, "b", 0.4, "-")]


def test_join_last_takes_the_last_duplicate(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "id int, n int, v string")
    assert [tuple(r) for r in R.join_last(left, right, "id", "n").select("id", "v").collect()] == [(1, "y")]


def test_sets(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 2)], "src int, dst int")
    assert [tuple(r) for r in R.undirected(edges).collect()] == [(1, 2)]
    links = spark.createDataFrame([(1, "b"), (1, "b"), (1, "zz"), (9, "b")], "from_id int, to_title string")
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    assert [tuple(r) for r in R.two_sided(links, corpus).collect()] == [(1, 2)]


def test_sample_is_the_same_each_time(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    first = sorted(r.k for r in R.sample(df, "k", 50).collect())
    assert len(first) == 50 and first == sorted(r.k for r in R.sample(df.repartition(7), "k", 50).collect())


def test_snippet(spark):
    df = spark.createDataFrame([(0, "aaa  bbb\nccc ddd", 9), (1, "short one", 300)], "i int, t string, w int")
    assert df.where("i = 0").select(X.snippet(F.col("t"), 9).alias("s")).first().s == "aaa bbb…"
    assert df.where("i = 1").select(X.snippet(F.col("t")).alias("s")).first().s == "short one"


def test_close(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, v double")
    assert tuple(R.close(a, a, ["i", "j"]).first()) == (0.0, True)
    assert tuple(R.close(a, b, ["i", "j"]).first()) == (2.0, False)


def test_parameters(spark):
    assert spark.range(1).select(X.listing_url(F.lit(7), "http://x/")).first()[0] == "http://x/7"
    assert [X.clamp(k) for k in (0, 20, 999)] == [1, 20, 200]
    assert [X.search_depth(k) for k in (10, 100, 900)] == [64, 200, 1000]
