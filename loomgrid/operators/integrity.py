"""Joins of charts' tables, and checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, vectors
from .numbering import numbered


def catalog(charts: DataFrame, songs: DataFrame) -> DataFrame:
    """Charts with content and their songs, by song_id; the order of both keys is the reader's to ask for."""
    return charts.join(songs, "song_id").where(F.trim(F.coalesce("content", F.lit(""))) != "")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def compare_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row: keys of both sides, only of the left, only of the right, with the least of those as examples."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full")
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    only_l, only_r = F.col("_r").isNull(), F.col("_l").isNull()
    return both.agg(F.count("*").alias("n_keys"), F.count_if(only_l).alias("only_left"), F.count_if(only_r).alias("only_right"), F.min(F.when(only_l, name)).alias("left_example"), F.min(F.when(only_r, name)).alias("right_example"))


def missing(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key the other side does not have."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def mapping_differences(left: DataFrame, right: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys for which the two sides do not say the same (null equals null)."""
    a = left.select(key, *(F.col(c).alias("_l_" + c) for c in columns), F.lit(True).alias("_l"))
    b = right.select(key, *(F.col(c).alias("_r_" + c) for c in columns), F.lit(True).alias("_r"))
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in columns:
        same &= F.col("_l_" + c).eqNullSafe(F.col("_r_" + c))
    return a.join(b, key, "full").where(~same).select(key)


def containment(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (start, end) with `ok`: their outer row (by keys) exists and holds their range."""
    o = outer.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    ok = F.col("_s").isNotNull() & (F.col("_s") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_e"))
    return inner.join(o, keys, "left").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_s", "_e")


def upsert(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The table with the updates' columns where the key is in both; new columns are added, no row is."""
    values = [c for c in updates.columns if c != key]
    u = updates.select(key, *(F.col(c).alias("_u_" + c) for c in values), F.lit(True).alias("_hit"))
    rows = table.join(u, key, "left")
    kinds = dict(updates.dtypes)
    keep = lambda c: F.col(c) if c in table.columns else F.lit(None).cast(kinds[c])
    merged = {c: F.when(F.col("_hit"), F.col("_u_" + c)).otherwise(keep(c)) for c in values}
    return rows.select(*(merged.get(c, F.col(c)).alias(c) for c in table.columns), *(merged[c].alias(c) for c in values if c not in table.columns))


def with_columns_of(table: DataFrame, other: DataFrame) -> DataFrame:
    """The table with the other's columns added as nulls."""
    return table.withColumns({c: F.lit(None).cast(k) for c, k in other.dtypes if c not in table.columns})


def leakage(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def records(patterns: DataFrame, split: DataFrame, audio: DataFrame, segments: DataFrame) -> DataFrame:
    """Training records: patterns of the split's charts with their audio and section, unit teacher vectors and numeric conditions. Rows whose song ids disagree, whose section is not 0 to 4 or whose vector has no length are left out; the checks above name them."""
    s = split.select("chart_id", F.col("song_id").alias("_song"), "difficulty", "level_value")
    names = [f"{n}_score" for n in stats.SCORES]
    patterns = patterns.select("key", "chart_id", "song_id", "segment_id", "segment_key", "vector")
    rows = patterns.join(s, "chart_id").join(audio.select("key", "audio_file"), "key").join(segments.select(F.col("key").alias("segment_key"), *names), "segment_key")
    rows = rows.where((F.col("song_id") == F.col("_song")) & F.col("segment_id").between(0, 4)).withColumn("teacher_vector", vectors.unit(F.col("vector")))
    rows = rows.where("teacher_vector is not null").withColumns({"numeric_conditions": stats.conditions("level_value", names), "difficulty_id": F.col("difficulty") - 5})
    return rows.select("key", "chart_id", "song_id", "segment_id", "segment_key", "difficulty", "difficulty_id", "level_value", "audio_file", "teacher_vector", "numeric_conditions")


def fixed_size(df: DataFrame, column: str, size: int) -> DataFrame:
    """The table, failing when a vector has another size."""
    return df.withColumn(column, F.when(F.assert_true(F.size(column) == size, f"{column} must have {size} elements").isNull(), F.col(column)))


def table_check(chunks: DataFrame, index: DataFrame, segments: DataFrame, size: int) -> DataFrame:
    """One row of what must hold: numbers of rows, unique keys, five sections a chart, scores within 0 and 200, vector size."""
    c = chunks.agg(F.count("*").alias("rows"), F.countDistinct("key").alias("keys"), F.count_if(F.size("vector") != size).alias("bad_vectors"))
    i = index.agg(F.sum("chunk_count").alias("indexed"))
    bad = F.lit(False)
    for n in stats.SCORES:
        bad |= ~F.col(f"{n}_score").between(0, 200)
    s = segments.groupBy("chart_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).agg(F.count_if(F.col("n") != 5).alias("bad_charts"), F.sum("bad").alias("bad_scores"))
    return c.crossJoin(i).crossJoin(s).withColumn("ok", (F.col("rows") == F.col("keys")) & (F.col("rows") == F.col("indexed")) & (F.col("bad_vectors") == 0) & (F.col("bad_charts") == 0) & (F.col("bad_scores") == 0))


#: Categories of charters, and the name of none.
SINGLE, SHARED, UNRECOGNISED, UNSIGNED = "个人谱师", "多人合作谱", "未识别", "未署名"


def song_ids(charts: DataFrame) -> DataFrame:
    """Songs (title_key, artist_key) numbered from 1 in the order of their earliest version, with the attributes of that chart.

    Songs are numbered over ranges of their order, so no task holds them all."""
    from ..functions import text

    rows = charts.withColumns({"title_key": text.song_title(F.col("title")), "artist_key": text.artist_key(F.col("artist")), "version_no": text.version_number(F.col("version"))})
    first = F.min_by(F.struct("title", "artist", "version"), F.struct("version_no", "version", "title", "artist"))
    songs = rows.groupBy("title_key", "artist_key").agg(F.min(F.struct("version_no", F.coalesce("version", F.lit("")).alias("version"))).alias("v"), first.alias("f"), F.count("*").alias("chart_count"))
    flat = songs.select("v.version_no", F.col("v.version").alias("version"), "title_key", "artist_key", F.col("f.title").alias("title"), F.col("f.artist").alias("artist"), "chart_count")
    order = [F.col("version_no").asc_nulls_first(), "version", F.col("title_key").asc_nulls_first(), F.col("artist_key").asc_nulls_first()]
    return numbered(flat, order).select((F.col("n") + 1).cast("int").alias("song_id"), "title_key", "artist_key", "title", "artist", "version", "chart_count")



def charter_category(charts: DataFrame, aliases: DataFrame, credits: DataFrame, unknown: DataFrame) -> DataFrame:
    """Charters by category: a known alias (alias, main), a shared credit (credit, names), an unknown shared credit (credit), or none of them; the main names of each. The three lists are small tables of names."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("main").alias("_main"))
    parts = credits.select("credit", F.posexplode("names").alias("_i", "_n")).withColumn("_n", F.trim(F.element_at(F.split("_n", "／"), 1)))
    named = parts.join(a, F.col("_n") == F.col("_a"), "left").groupBy("credit").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_main", "_n").alias("m")))).alias("l"))
    c = named.select(F.col("credit").alias("_c"), F.transform("l", lambda x: x["m"]).alias("_names"))
    u = unknown.select(F.col("credit").alias("_u")).distinct()
    name = F.trim("charter")
    rows = charts.join(a, name == F.col("_a"), "left").join(c, name == F.col("_c"), "left").join(u, name == F.col("_u"), "left")
    none = F.coalesce(F.col("charter"), F.lit("")) == ""
    category = F.when(none | F.col("_a").isNotNull(), SINGLE).when(F.col("_c").isNotNull() | F.col("_u").isNotNull(), SHARED).otherwise(UNRECOGNISED)
    names = F.when(none, F.array(F.lit(UNSIGNED))).when(F.col("_a").isNotNull(), F.array("_main")).when(F.col("_c").isNotNull() & (F.size("_names") > 0), F.col("_names")).otherwise(F.array(name))
    return rows.withColumns({"charter_category": category, "charter_names": names}).drop("_a", "_main", "_c", "_names", "_u")
