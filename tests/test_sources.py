import json

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import charts as chart_ops
from loomgrid.sources import audio, readers, writers


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "charts"
    for name, doc, file in [
        ("a song", "﻿&title=A song\n&artist=X ＆ Y\n&version=13.2\n&chart_version=13.2\n&lv_5=12+\n&des_5=n1\n&inote_5=(120){4}1,\n2,3,4,E\n&first=1.5\n", "maidata.txt"),
        ("b", "&title=B [DX]\n&artist=Z\n&chart_version=9. v\n&lv_5=13\n&lv_6=14\n&inote_5=(120){4}1,2,E\n&inote_6=(120){4}9,E\n&first_6=2", "majdata.txt"),
        ("none", "nothing", "readme.txt"),
    ]:
        (root / name).mkdir(parents=True)
        (root / name / file).write_text(doc, encoding="utf-8")
    (root / "a song" / "majdata.txt").write_text("&title=second choice")
    return root


def test_folders_to_relations(spark, library, tmp_path):
    docs, skipped = readers.chart_documents(spark, str(library))
    assert [r.folder.rpartition("/")[2] for r in skipped.collect()] == ["none"]
    rows = readers.records(docs)
    songs, charts = readers.songs_and_charts(rows)
    got = {r.chart_id: r for r in charts.collect()}
    assert sorted(got) == ["1:DX:5", "1:DX:6", "2:ST:5"]
    assert got["2:ST:5"].level_value == pytest.approx(12.6) and got["2:ST:5"].first_seconds == 1.5 and got["2:ST:5"].content == "(120){4}1,\n2,3,4,E"
    assert got["1:DX:6"].first_seconds == 2.0 and got["2:ST:5"].charter == "n1"
    assert [(r.song_id, r.title_key) for r in songs.orderBy("song_id").collect()] == [(1, "B"), (2, "A song")]
    writers.table(songs, f"{tmp_path}/out/songs", keys=["song_id"])
    writers.table(charts, f"{tmp_path}/out/charts", keys=["chart_id"], references=(songs, "song_id"))
    with pytest.raises(ValueError):
        writers.table(charts, f"{tmp_path}/out/charts", references=(songs.where("song_id = 1"), "song_id"))
    with pytest.raises(ValueError):
        writers.table(charts.union(charts), f"{tmp_path}/out/charts", keys=["chart_id"])

    good, bad = chart_ops.split_errors(chart_ops.measures(charts))
    assert [r.chart_id for r in bad.collect()] == ["1:DX:6"]
    assert good.where("chart_id = '2:ST:5'").first().start_seconds == 1.5
    writers.chart_json(good, charts.select("chart_id", "title"), f"{tmp_path}/json")
    line = spark.read.json(f"{tmp_path}/json").where("chart_id = '2:ST:5'").first()
    assert line.measure_count == 1 and line.measures[0].end_seconds == 3.5
    writers.measure_csv(good, f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").where("chart_id = '2:ST:5'").first().end_seconds == "3.500000"
    assert writers.errors(bad, f"{tmp_path}/bad") == 1
    assert writers.dry_run(charts, "chart_id").first().first_key == "1:DX:5"


def test_a_chart_twice_is_an_error(spark, library):
    rows = readers.records(readers.chart_documents(spark, str(library))[0])
    with pytest.raises(Exception, match="two charts"):
        readers.songs_and_charts(rows.union(rows))[1].collect()


def test_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"song": {"song_id": 7, "title": "t"}, "chart": {"chart_kind": "dx", "difficulty_index": 5, "level": "13"}, "measures": [{"index": 1, "start_seconds": 0, "end_seconds": 2, "duration_seconds": 2, "beats": 4, "bpm": 120, "simai": "{4}1,2,3,4,"}]}))
    rows, bad = readers.exported_measures(spark, f"{tmp_path}/c.json")
    assert bad.count() == 0
    row = rows.first()
    assert (row.chart_id, row.idx, row.text) == ("7:DX:5", 1, "{4}1,2,3,4,")
    (tmp_path / "i.json").write_text(json.dumps({"charts": [{"file": "f", "song_id": i, "title": f"Title {i}", "chart_kind": "DX", "difficulty_index": 5, "level": "13"} for i in range(30)], "errors": [{"song_id": 1, "error": "x"}]}))
    index, errors = readers.chart_index(spark, f"{tmp_path}/i.json")
    assert errors.count() == 1
    assert readers.one_chart(index, song_id="3").title == "Title 3"
    assert readers.one_chart(index, title="tLE 17").song_id == 17
    with pytest.raises(ValueError, match="more than 20"):
        readers.one_chart(index, chart_kind=" dx ")
    base = {b: 1.0 for b in ("density_note_mean_p95", "density_peak_q90_p95", "density_cv_p05", "density_cv_p95", "burst_density_p98", "slide_density_p98", "slide_ratio_p98", "charge_density_p98", "charge_ratio_p98", "handtrip_density_p98", "tricky_intensity_p98")}
    (tmp_path / "b.json").write_text(json.dumps({"baselines": base}))
    (tmp_path / "b2.json").write_text(json.dumps(base))
    assert readers.baselines(spark, f"{tmp_path}/b.json").first().burst_density_p98 == 1.0
    assert readers.baselines(spark, f"{tmp_path}/b2.json").first().burst_density_p98 == 1.0
    (tmp_path / "b3.json").write_text(json.dumps({"density_note_mean_p95": 1.0}))
    with pytest.raises(ValueError):
        readers.baselines(spark, f"{tmp_path}/b3.json")
    (tmp_path / "s.json").write_text(json.dumps({"recommended_standards": [{"level": "13", "steady_density_p33": 3.0, "steady_density_p67": 5.0}]}))
    assert readers.standards(spark, f"{tmp_path}/s.json").first().p67 == 5.0


def test_splits(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("﻿chart_id,song_id,difficulty,level_value,more\n1:DX:5,1,5,12.6,x\n2:DX:6,2,6,13,y\n", encoding="utf-8")
    rows = readers.split_rows(spark, str(good))
    assert [tuple(r) for r in rows.orderBy("chart_id").collect()] == [("1:DX:5", 1, 5, 12.6), ("2:DX:6", 2, 6, 13.0)]
    for name, text in {"empty": "chart_id,song_id,difficulty,level_value\n", "column": "chart_id,song_id\na,1\n", "twice": "chart_id,song_id,difficulty,level_value\na,1,5,1\na,1,5,1\n", "other": "chart_id,song_id,difficulty,level_value\na,1,4,1\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError):
            readers.split_rows(spark, f"{tmp_path}/{name}.csv")
    writers.split_csv(rows.withColumn("split", F.when(F.col("song_id") == 1, "train").otherwise("test")), f"{tmp_path}/out", ["song_id"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out/train").count() == 1


def test_audio_candidates(spark):
    m = spark.createDataFrame([("c1", "C:\\x\\song a\\maidata.txt"), ("c2", "/data/song b/maidata.txt"), ("c3", "/data/none/maidata.txt")], "chart_id string, created_from_file string")
    files = spark.createDataFrame([("/music/song a/track.ogg",), ("/data/song b/track.mp3",), ("/music/song b/track.mp3",)], "path string")
    found = readers.audio_sources(m, files, "/music/")
    assert {r.chart_id: r.audio_file for r in found.collect()} == {"c1": "/music/song a/track.ogg", "c2": "/data/song b/track.mp3", "c3": None}
    good, other = readers.of_formats(found, [".OGG, wav"])
    assert [r.chart_id for r in good.collect()] == ["c1"] and other.count() == 2
    assert audio.metadata(spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")).first().sha1 == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_settings_and_ranges():
    assert readers.parse_range("3") == (3, 3) and readers.parse_range("2..5") == (2, 5) and readers.parse_range("2:5") == (2, 5) and readers.parse_range("2-5") == (2, 5)
    for bad in ("0", "5-2", "x"):
        with pytest.raises(ValueError):
            readers.parse_range(bad)
    assert readers.config({"lr": 1, "n": 4}, {"lr": 0.1, "n": 2, "name": "a"}) == {"lr": 1.0, "n": 4, "name": "a"}
    for wrong in ({"x": 1}, {"n": "4"}):
        with pytest.raises(ValueError):
            readers.config(wrong, {"n": 2})


def test_audio_is_cut_by_a_program(spark, tmp_path):
    """A stand-in for the program writes its arguments, and fails for one file."""
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nfor last; do :; done\ncase "$*" in *broken*) echo "no such stream" >&2; exit 1;; esac\nprintf "%s" "$5 $7 $9" > "$last"\n')
    tool.chmod(0o755)
    rows = [("a", "x.mp3", "c/c_001_1-4.mp3", 1.5, 9.5), ("b", "broken.mp3", "c/c_002_2-5.mp3", 0.0, 8.0), ("c", "y.mp3", "c/c_003_3-6.mp3", -0.25, 2.0)]
    windows = spark.createDataFrame(rows, "key string, audio_file string, audio_name string, start_seconds double, end_seconds double")
    out = {r.key: r for r in audio.cut(windows, str(tmp_path / "out"), given=str(tool)).collect()}
    assert (tmp_path / "out" / "c" / "c_001_1-4.mp3").read_text() == "1.500000 8.000000 x.mp3"
    assert (tmp_path / "out" / "c" / "c_003_3-6.mp3").read_text() == "0.000000 2.250000 y.mp3"
    assert out["b"].error == "no such stream\n" and out["b"].sha1 is None and out["a"].size == 23
    (tmp_path / "out" / "c" / "c_001_1-4.mp3").write_text("kept")
    assert {r.key: r.size for r in audio.cut(windows, str(tmp_path / "out"), given=str(tool)).collect()}["a"] == 4
    with pytest.raises(FileNotFoundError):
        audio.cut(windows, str(tmp_path / "out"), given="no-such-program")
    names = audio.window_names(spark.createDataFrame([("a b", 3, 1, 4)], "chart_name string, chunk_index int, start_measure int, end_measure int"))
    assert names.first().audio_name == "a_b/a_b_003_1-4.mp3"


def test_reports_by_stem(spark):
    index = spark.createDataFrame([("x/b.segments.json", "t", "13"), ("x/a.segments.json", "u", "13"), ("x/c.segments.json", "v", "12")], "file string, title string, level string")
    measures = spark.createDataFrame([("m/a.json", 7)], "file string, measure_count int")
    good, bad = readers.by_stem(readers.select_reports(index, level="13"), measures)
    assert [(r.stem, r.measure_count) for r in good.collect()] == [("a", 7)]
    assert [tuple(r) for r in bad.collect()] == [("b", "no measures for b")]
    assert [r.stem for r in readers.select_reports(index, 1, level="13").collect()] == ["a"]
