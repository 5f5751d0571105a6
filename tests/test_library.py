import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import notation
from loomgrid.operators import integrity, library, segments
from loomgrid.sources import writers

#: Published examples of valid charts.
VALID = """(174){16}1,2,3,4,E
5h[2:1],E
4h[#5.678],E
4h[150#2:1],E
5bxh[2:1],E
1-4[8:3],E
1-4[160#8:3],E
1-4[160#2],E
1-4[3##1.5],E
1-4[3##8:3],E
1-4[3##160#8:3],E
1V35[8:3],E
1-4[4:3]*-6[8:5],E
1-4q7-2[1:2],E
1-4[2:1]q7[2:1]-2[1:1],E
B1/D4/Ch[4:3],E
C1/C2/C,E
1/8h[2:1],E
12,E
1`2`3/4,E
1$,1$$,E
1@-5[8:1],E
3h,Ch,E
1?-5[2:1],1!-5[2:1],E
B7f/Chf[1:2],E""".split("\n")


@pytest.mark.parametrize("chart", VALID)
def test_published_examples(chart):
    assert sum(notation.count_notes(chart)[0][k] for k in notation.COUNTERS[:5]) > 0


@pytest.fixture(scope="module")
def charts(spark):
    rng = random.Random(1)
    make = lambda: "(150){8}" + ",".join(rng.choice(["1", "2h[4:1]", "3-7[8:1]", "", "4/5", "C", "8", "1V35[4:1]"]) for _ in range(8 * 26)) + ",E"
    rows = [(f"{i}:DX:5", i, f"song {i}", "DX", 5, ["12+", "13", "10", "15"][i % 4], make()) for i in range(4)] + [("9:DX:5", 9, "bad", "DX", 5, "13", "(120){4}9,E")]
    return spark.createDataFrame(rows, "chart_id string, song_id int, title string, chart_kind string, difficulty int, level string, content string")


def test_score_table(spark, charts, tmp_path):
    table, base, bad = library.score_table(charts)
    assert [r.chart_id for r in bad.collect()] == ["9:DX:5"]
    out = library.score_file(table)
    assert tuple(out.columns) == library.SCORE_COLUMNS and out.count() == 4
    out.write.option("header", "true").csv(f"{tmp_path}/scores")
    library.intermediates(table).write.json(f"{tmp_path}/intermediates")
    assert spark.read.json(f"{tmp_path}/intermediates").select("scores.note").count() == 4
    assert base.count() == 1


def test_reports_tables_and_checks(spark, charts, tmp_path):
    none = "CAST(NULL AS STRING)"
    standards = spark.sql(f"SELECT * FROM VALUES (0, '12', 0.5D, 50.0D, {none}, {none}), (1, '13', 0.1D, 0.2D, {none}, {none}) AS t(pos, level, p33, p67, low, high)")
    cut = lambda df, label: (df.write.mode("overwrite").parquet(f"{tmp_path}/{label}"), spark.read.parquet(f"{tmp_path}/{label}"))[1]
    sections, bad = library.reports(charts, standards=standards, config=segments.Config(edge=2), cut=cut)
    sections = cut(sections, "reports")
    assert sections.groupBy("chart_id").count().where("count <> 5").isEmpty() and bad.count() == 1
    tiers = {r.level: r.t for r in sections.join(charts, "chart_id").where("steady_tier is not null").groupBy("level").agg(F.collect_set("steady_tier").alias("t")).collect()}
    assert all(tiers.get(level, [want]) == [want] for level, want in (("12+", "MID"), ("13", "HIGH"), ("10", "LOW"), ("15", "HIGH")))
    t = library.tables(charts, sections, cut=cut, features=3)
    writers.tables(t, f"{tmp_path}/out")
    t = {k: spark.read.parquet(f"{tmp_path}/out/{k}") for k in t}
    pattern = t["pattern"]
    assert integrity.table_check(pattern, t["index"], t["segments"], 4413).first().ok
    assert pattern.where("error is not null").isEmpty() and "00000_DX_5_song_0:1-4" in {r.key for r in pattern.select("key").collect()}
    assert integrity.missing(pattern.select(F.col("segment_key").alias("key")), t["segments"], "key").isEmpty()
    inside = integrity.containment(pattern.select("chart_id", "segment_id", F.col("body_start_measure").alias("start"), F.col("body_end_measure").alias("end")), sections.select("chart_id", "segment_id", F.col("start_measure").alias("start"), F.col("end_measure").alias("end")), ["chart_id", "segment_id"])
    assert inside.where("not ok").isEmpty()
    measures = spark.read.parquet(f"{tmp_path}/measures")  # written by the cut
    audio = charts.select("chart_id", F.when(F.col("song_id") > 0, "a.mp3").alias("audio_file"), F.lit("mp3").alias("audio_format"))
    rows = library.audio_table(pattern, measures, audio)
    found = integrity.compare_keys(pattern.where("song_id > 0"), rows, "key").first()
    assert (found.only_left, found.only_right) == (0, 0) and rows.where("end_seconds <= start_seconds").isEmpty()
    old = pattern.select("key", "vector")
    new = library.migrate(old, pattern)
    assert new.columns == ["key", "vector", "segment_id", "segment_key"] and integrity.mapping_differences(new, pattern, "key", "segment_id", "segment_key").isEmpty()
    writers.table(t["index"], f"{tmp_path}/again", keys=["chart_id"], partition=["chart_kind"])
    split = charts.where("song_id < 5").select("chart_id", "song_id", "difficulty", F.lit(12.6).alias("level_value"))
    records = integrity.records(pattern, split, rows.select("key", "audio_file"), t["segments"]).collect()
    assert records and all(len(r.numeric_conditions) == 7 and abs(sum(x * x for x in r.teacher_vector) - 1) < 1e-5 for r in records)


def test_field_counts(spark):
    df = spark.createDataFrame([(1, "&title=a\n&inote_5=(120){4}1,\n2h,E\n&inote_6=9,E")], "id int, doc string")
    got = {r.field: r for r in library.field_counts(df, "id", "doc").collect()}
    assert got["inote_5"].tap == 1 and got["inote_5"].hold == 1 and got["inote_6"].error
