import pytest

from quernstone.plans import etl
from quernstone.sources import files
from quernstone.streaming import rates


def test_dump_titles_with_quotes(spark):
    lines = [("INSERT INTO `p` VALUES (1,0,'A_b',0),(2,0,'O\\'Hara',0);",), ("CREATE TABLE (3,0,'x',0)",)]
    got = files.parse_dump(spark.createDataFrame(lines, "value string")).collect()
    assert sorted((r.from_id, r.title) for r in got) == [(1, "A_b"), (2, "O'Hara")]


def test_csv_with_file_names(spark, tmp_path):
    for name, rows in {"milan.csv": "1,a\n2,b\n", "2025-01.csv": "3,c\n"}.items():
        (tmp_path / name).write_text("id,v\n" + rows)
    got = files.with_file_stem(files.read_csv(spark, str(tmp_path))).collect()
    assert sorted((r.id, r.stem) for r in got) == [("1", "milan"), ("2", "milan"), ("3", "2025-01")]


def test_malformed_lines_are_dropped(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1,2\n3\n4,5,6\n")
    assert sorted(tuple(r) for r in files.read_positional(spark, str(tmp_path / "p.txt"), ["a", "b"]).collect()) == [("1", "2"), ("4", "5")]


def test_artefacts(spark, tmp_path):
    path, calls = str(tmp_path / "a"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert files.artefact(spark, path, make).count() == 3 == files.artefact(spark, path, make).count()
    assert len(calls) == 1
    assert files.missing(spark, [path, path + "x"]) == [path + "x"]
    assert files.first_of(spark, path + "x", path).count() == 3 and files.first_of(spark, path + "x") is None
    assert files.read_json_document(spark, path + "y.json") is None
    assert files.merge_timings({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}


def test_jobs_run_in_order_and_again(spark, tmp_path):
    tried = []

    def flaky():
        tried.append(1)
        if len(tried) < 2:
            raise OSError("first")

    assert list(etl.run_steps([("a", flaky), ("b", lambda: None)])) == ["a", "b"]
    with pytest.raises(ZeroDivisionError):
        etl.run_steps([("c", lambda: 1 / 0)])


def test_rates_job(spark, tmp_path):
    head = "qtr,down,ydstogo,yardline_100,score_differential,posteam_type,result,extra\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.csv").write_text(head + "1,2,10,30,0,home,3,x\n" * 9 + "1,2,10,30,0,home,-3,x\n" + "NA,2,10,30,0,home,3,x\n")
    took = etl.rates_job(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), str(tmp_path / "out"))
    assert set(took) == {"prepare", "rates"}
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.wins, r.total, r.win_probability, r.field_bucket) for r in got] == [(9, 10, 0.9, "26-50")]
    assert files.external_table(spark, "plays_view", str(tmp_path / "clean")).count() == 10


def test_stream_is_the_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = rates.windowed_rates(events)
    stream = rates.windowed_rates(rates.read_events(spark, f"{sf_dir}/event[s].parquet", events.schema))
    got = rates.run_available(stream, "stream_test")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_dense_numbers(spark):
    df = spark.createDataFrame([(x * 7 % 100,) for x in range(100)], "k int").repartition(6)
    got = files.numbered(df, "k").orderBy("k").collect()
    assert [r.row_id for r in got] == list(range(100))


def test_timing_document_is_read_and_written(spark, tmp_path):
    path = tmp_path / "timing.json"
    assert files.update_timings(spark, str(path), {"spark_ms": 5}) == {"spark_ms": 5}
    assert files.update_timings(spark, str(path), {"hive_ms": 7, "spark_ms": 6}) == {"hive_ms": 7, "spark_ms": 6}
    path.write_text("{broken")
    (tmp_path / ".timing.json.crc").unlink(missing_ok=True)
    assert files.update_timings(spark, str(path), {"a": 1}) == {"a": 1}


def test_piped_script(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "a\tb")], "n int, t string").repartition(2)
    got = files.piped(df, "tr a-z A-Z", ["n", "t"]).collect()
    assert sorted(map(tuple, got)) == [("1", "X"), ("2", "")]


def test_staged_tables_go_and_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from quernstone import staging

    kept, gone = staging.stage(spark.range(3), "kept"), staging.stage(spark.range(4), "gone")
    assert files.exists(spark, gone.staged_at)
    staging.unstage(gone)
    assert not files.exists(spark, gone.staged_at) and kept.count() == 3
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(far)


def test_broadcasts_are_checked_by_bytes(spark, monkeypatch):
    from quernstone import staging

    df = staging.stage(spark.range(1000), "wide")
    assert staging.is_small(df, 1000) and not staging.is_small(df, 999)
    monkeypatch.setattr(staging, "SMALL_BYTES", 100)
    assert not staging.is_small(df, 1000)
