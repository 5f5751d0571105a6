"""Choosing charts: exclusions, samples, coverage, and splits that share no song.

Greedy choices need every earlier one, so they run on the driver, over what the rules can tell apart:
the counts and first keys of each combination of kind and categories (`select_covering`), the kinds of
the charts in the order of their keys (`assign_splits`, a few bytes a chart), and one row of counts a
song (`split_disjoint`). No number of charts is refused.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .numbering import numbered

#: First keys of a combination that are fetched at once; if a choice needs more, four times as many.
DEPTH = 16


def exclude_lowest(charts: DataFrame, count: int, below: float = 13.0, tie=None) -> DataFrame:
    """Charts below a level without the `count` of them that come first by (version, level, tie); the tie is a hash of the id unless given."""
    tie = F.xxhash64("chart_id") if tie is None else tie
    low = charts.where(F.col("level_value") < below)
    first = low.orderBy(F.asc("version_no"), "level_value", tie, "chart_id").limit(count).select("chart_id")
    return low.join(F.broadcast(first), "chart_id", "left_anti").select(*charts.columns)


def sample(rows: DataFrame, count: int, key: str, seed: int) -> DataFrame:
    """`count` rows by a digest of seed and key, without replacement."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(count)


def disjoint_batches(rows: DataFrame, size: int, key: str = "key", song: str = "song_id", order=None) -> DataFrame:
    """Batches without two rows of a song: the k-th row of every song is in round k, rounds are cut into whole batches, what is left over is dropped.

    Rows are numbered over ranges of (song, order), then of (round, order); a song or a round with a large share of the rows is spread over many tasks."""
    order = F.xxhash64(key) if order is None else order

    def within(df: DataFrame, by: str, name: str) -> DataFrame:
        """Places from 0 within each value of `by`, and the number of its rows."""
        placed = cut(numbered(df.withColumn("_o", order), [F.asc_nulls_first(by), "_o", key], "_n").drop("_o"), "places")
        firsts = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"), F.count("*").alias("_all"))
        return placed.join(firsts, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col("_n") - F.col("_first")).drop("_by", "_n", "_first")

    rounds = within(rows, song, "_k").withColumn("round", F.col("_k") + 1).drop("_k", "_all")
    placed = within(rounds, "round", "_k")
    return placed.where(F.col("_k") < F.floor(F.col("_all") / size) * size).withColumn("batch", F.floor(F.col("_k") / size)).drop("_k", "_all")


def kind_targets(counts: dict[str, int], size: int) -> dict[str, int]:
    """Proportional numbers of each kind, rounded half to even."""
    total = sum(counts.values())
    return {k: round(size * n / total) for k, n in sorted(counts.items())}


def _first_keys(charts: DataFrame, by: list[str], key: str, depth: int) -> list:
    """The `depth` smallest keys of each combination of `by`, in the order of the keys."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return charts.select(key, *by).withColumn("_n", first).where(F.col("_n") <= depth).drop("_n").orderBy(key, *by).collect()


#: How much the shares of kind and of the categories (in their order) count when the rest is filled.
KIND_WEIGHT, CATEGORY_WEIGHTS = 2.0, (1.0, 1.0, 0.75)


def select_covering(charts: DataFrame, size: int, categories: list[str], kind: str = "kind", key: str = "chart_id") -> DataFrame:
    """At least `size` charts that cover every value of the categories.

    First, until all values are covered, the chart that adds most new ones (then of the kind that lacks most); then the
    chart whose kind and values are least represented, by weighted shares of their targets or totals. Ties go to the smaller key."""
    by = [kind, *categories]
    counts = {tuple(r[c] for c in by): r["_count"] for r in charts.groupBy(*by).agg(F.count("*").alias("_count")).collect()}
    kinds = Counter()
    totals = [Counter() for _ in categories]
    for (k, *value), n in counts.items():
        kinds[k] += n
        for c, v in enumerate(value):
            totals[c][v] += n
    target = kind_targets(kinds, size)
    weights = [CATEGORY_WEIGHTS[c] if c < len(CATEGORY_WEIGHTS) else 1.0 for c in range(len(categories))]

    def choose(keys: dict[tuple, list]) -> list | None:
        """The chosen keys; None if a combination has more charts than known keys and needs them."""
        have, seen, used = Counter(), [Counter() for _ in categories], Counter()
        chosen = []
        alike = {x: own[0] for x, own in keys.items()}  # charts that no rule tells apart: their (place, key) in front

        def take(x: tuple) -> bool:
            chosen.append(alike.pop(x)[1])
            used[x] += 1
            if used[x] < len(keys[x]):
                alike[x] = keys[x][used[x]]
            have[x[0]] += 1
            for c, v in enumerate(x[1:]):
                seen[c][v] += 1
            return x in alike or used[x] == counts[x]

        new = lambda x: sum(not seen[c][v] for c, v in enumerate(x[1:]))
        while any(len(+seen[c]) < len(totals[c]) for c in range(len(categories))):
            if not take(max((x for x in alike if new(x)), key=lambda x: (new(x), target[x[0]] - have[x[0]], -alike[x][0]))):
                return None
        while alike and len(chosen) < size:
            def represented(x: tuple) -> float:
                return KIND_WEIGHT * have[x[0]] / max(target[x[0]], 1) + sum(w * seen[c][v] / max(totals[c][v], 1) for c, (w, v) in enumerate(zip(weights, x[1:], strict=True)))

            if not take(min(alike, key=lambda x: (represented(x), alike[x][0]))) and len(chosen) < size:
                return None
        return chosen

    depth, chosen = DEPTH, None
    while chosen is None:
        keys: dict[tuple, list] = {}
        for place, r in enumerate(_first_keys(charts, by, key, depth)):
            keys.setdefault(tuple(r[c] for c in by), []).append((place, r[key]))
        chosen, depth = choose(keys), 4 * depth
    return charts.sparkSession.createDataFrame([(x,) for x in sorted(chosen)], charts.select(key).schema)


def assign_splits(charts: DataFrame, sizes: dict[str, int], categories: list[str], kind: str = "kind", key: str = "chart_id") -> DataFrame:
    """key, split: every split gets each value of the categories while there are charts of it; then the (chart, split) whose kind the split lacks most, that brings it a new value, and whose split is the emptiest. Ties go to the smaller key, then the earlier split."""
    sizes_of = {r[0]: r[1] for r in charts.groupBy(kind).agg(F.count("*")).collect()}
    kinds, order = list(sizes_of), list(sizes)
    target = {s: kind_targets(Counter(sizes_of), n) for s, n in sizes.items()}
    count, of_kind = Counter(), {s: Counter() for s in sizes}
    early: dict[tuple, list[str]] = {}  # splits of the charts of a key and kind that bring a split a value

    # a chart is taken as the first one with a value, and each of its values is wanted once a split
    rows = _first_keys(charts, [kind, *categories], key, len(categories) * len(sizes))
    values = [tuple(str(r[c]) for c in categories) for r in rows]
    taken = set()
    for c in range(len(categories)):
        of_value: dict[str, list[int]] = {}
        for i, x in enumerate(values):
            of_value.setdefault(x[c], []).append(i)
        for v in sorted(of_value):
            for s in order:
                i = next((i for i in of_value[v] if i not in taken), None)
                if i is not None and count[s] < sizes[s]:
                    taken.add(i)
                    early.setdefault((rows[i][key], rows[i][kind]), []).append(s)
                    count[s] += 1
                    of_kind[s][rows[i][kind]] += 1

    # from here on every split that is not full has all values of the charts left, so only their kinds tell them apart
    number = F.coalesce(*(F.when(F.col(kind).eqNullSafe(F.lit(k)), F.lit(n)) for n, k in enumerate(kinds))) if kinds else F.lit(0)
    table = charts.select(key, number.cast("int").alias("_kind")).orderBy(key, "_kind").toArrow()
    of_row, keys = table.column("_kind").to_numpy(), table.column(key)
    split = np.full(len(of_row), -1, np.int8 if len(order) < 128 else np.int32)
    spots: dict[tuple, list[int]] = {}
    if early:
        wanted = pa.array([k for k, _ in early], keys.type)
        for i in np.flatnonzero(pc.is_in(keys, value_set=wanted).to_numpy()):
            spots.setdefault((keys[int(i)].as_py(), kinds[of_row[i]]), []).append(int(i))
    for x, names in early.items():
        for i, s in zip(spots[x], names, strict=False):
            split[i] = order.index(s)
    free = {k: np.flatnonzero((of_row == n) & (split < 0)) for n, k in enumerate(kinds)}
    used = Counter()
    open_ = {k: int(own[0]) for k, own in free.items() if len(own)}  # the first chart left of each kind
    while open_ and any(count[s] < sizes[s] for s in order):
        *_, k, s = max(((target[s].get(k, 0) - of_kind[s][k], sizes[s] - count[s], -first, -o, n, k, s) for n, (k, first) in enumerate(open_.items()) for o, s in enumerate(order) if count[s] < sizes[s]), key=lambda x: x[:5])
        split[open_[k]] = order.index(s)
        count[s] += 1
        of_kind[s][k] += 1
        used[k] += 1
        if used[k] < len(free[k]):
            open_[k] = int(free[k][used[k]])
        else:
            del open_[k]
    there = np.flatnonzero(split >= 0)
    names = pa.array(order, pa.string()).take(pa.array(split[there]))
    out = pa.table({key: keys.take(pa.array(there)), "split": names})
    return charts.sparkSession.createDataFrame(out, charts.select(key, F.lit("").alias("split")).schema)


#: Weights of the features that a split should share out evenly.
LEAST_TOTAL = 10  # differences are shares of a value's total, of so many at least
SPLIT_WEIGHTS = {"chunk_count": 4.0, "version": 8.0, "difficulty": 12.0, "level": 6.0, "version_difficulty": 3.0, "chart_kind": 2.0}


def exact_sum(items: list[int], weights: list[int], total: int) -> list[int]:
    """Items whose weights add up to a total, the earlier ones if they can; an error if none do."""
    reach = [1]  # bit t: the first items reach a sum of t
    for w in weights:
        reach.append((reach[-1] | reach[-1] << w) & ((1 << (total + 1)) - 1))
    if not reach[-1] >> total & 1:
        raise ValueError(f"no set of songs has exactly {total} charts")
    out = []
    for k in reversed(range(len(items))):
        if not reach[k] >> total & 1:
            out.append(items[k])
            total -= weights[k]
    return out


def split_disjoint(charts: DataFrame, sizes: dict[str, int], features: list[str], song: str = "song_id", key: str = "chart_id", rounds: int = 20) -> DataFrame:
    """key, split: exact sizes, no song in two splits, and categories spread as evenly as a local search finds.

    Songs in the order of a hash fill the smaller splits to their exact sizes (subset sums), the rest is the largest;
    swaps of songs of equal size then lower the differences. The result is checked, not claimed optimal."""
    counted = charts.select(F.col(song).alias("_song"), F.explode(F.array(F.struct(F.lit(-1).alias("f"), F.lit(None).cast("string").alias("v")), *(F.struct(F.lit(i).alias("f"), F.col(f).cast("string").alias("v")) for i, f in enumerate(features)))).alias("x"))
    each: dict = {}
    for r in counted.groupBy("_song", "x.f", "x.v").agg(F.count("*").alias("n")).collect():
        each.setdefault(r["_song"], {}).setdefault(r["f"], Counter())[r["v"]] = r["n"]
    songs = sorted(each, key=lambda x: (x is None, x))
    weight = [each[x][-1][None] for x in songs]
    contents = [{f: each[x][i] for i, f in enumerate(features)} for x in songs]
    totals = {f: sum((own[f] for own in contents), Counter()) for f in features}
    if sum(sizes.values()) != sum(weight):
        raise ValueError("the sizes must add up to the number of charts")
    of: dict[int, str] = {}
    names, n = list(sizes), sum(weight)
    order = sorted(range(len(songs)), key=lambda i: hashlib.blake2b(str(songs[i]).encode(), digest_size=8).digest())
    for split in sorted(names, key=lambda s: (sizes[s], s)):
        left = [i for i in order if i not in of]
        for i in left if split == max(names, key=lambda s: (sizes[s], s)) else exact_sum(left, [weight[i] for i in left], sizes[split]):
            of[i] = split
    held = {s: {f: Counter() for f in features} for s in names}
    for i, split in of.items():
        for f in features:
            held[split][f].update(contents[i][f])

    def gain(split: str, out: int, into: int) -> float:
        """How much nearer to its share a split comes if one song takes the place of another; only their values count."""
        share, total = sizes[split] / n, 0.0
        for f in features:
            for v in contents[out][f].keys() | contents[into][f].keys():
                now = held[split][f][v] - totals[f][v] * share
                total += SPLIT_WEIGHTS.get(f, 1.0) * (abs(now) - abs(now + contents[into][f][v] - contents[out][f][v])) / max(totals[f][v], LEAST_TOTAL)
        return total

    alike: dict[int, list[int]] = {}
    for i in order:
        alike.setdefault(weight[i], []).append(i)
    for _ in range(rounds):
        moved = False
        for own in alike.values():
            for x, i in enumerate(own):
                for j in own[x + 1 :]:
                    a, b = of[i], of[j]
                    if a != b and gain(a, i, j) + gain(b, j, i) > 1e-9:
                        of[i], of[j], moved = b, a, True
                        for f in features:
                            held[a][f].subtract(contents[i][f]), held[a][f].update(contents[j][f])
                            held[b][f].subtract(contents[j][f]), held[b][f].update(contents[i][f])
        if not moved:
            break
    schema = charts.select(F.col(song).alias("_song"), F.lit("").alias("split")).schema
    placed = charts.sparkSession.createDataFrame([(x, of[i]) for i, x in enumerate(songs)], schema)
    return charts.join(placed, F.col(song).eqNullSafe(F.col("_song"))).select(key, "split")


def split_summary(rows: DataFrame, split: str, song: str, counts: list[str]) -> DataFrame:
    """Charts, songs and counted values of each split."""
    return rows.groupBy(split).agg(F.count("*").alias("n_charts"), F.countDistinct(song).alias("n_songs"), *(F.countDistinct(c).alias(f"n_{c}") for c in counts))


def share_spread(rows: DataFrame, split: str, features: list[str]) -> DataFrame:
    """feature, value, spread: largest less smallest percentage of a value over the splits; a split without it has 0."""
    long = rows.select(split, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))).alias("x")).select(split, "x.feature", "x.value")
    sizes = rows.groupBy(split).agg(F.count("*").alias("size"))
    counts = long.groupBy(split, "feature", "value").agg(F.count("*").alias("n")).join(F.broadcast(sizes), split).withColumn("share", 100 * F.col("n") / F.col("size"))
    splits = sizes.agg(F.count("*").alias("splits"))
    out = counts.groupBy("feature", "value").agg(F.max("share").alias("hi"), F.min("share").alias("lo"), F.count("*").alias("k")).crossJoin(F.broadcast(splits))
    return out.select("feature", "value", (F.col("hi") - F.when(F.col("k") < F.col("splits"), 0.0).otherwise(F.col("lo"))).alias("spread"))


def check_split(rows: DataFrame, sizes: dict[str, int], song: str = "song_id") -> DataFrame:
    """split, size, wanted and songs it shares with others."""
    shared = rows.groupBy(song).agg(F.countDistinct("split").alias("k")).where("k > 1").select(song)
    bad = rows.join(shared, song, "left_semi").groupBy("split").agg(F.countDistinct(song).alias("shared_songs"))
    wanted = F.create_map(*(x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))))
    out = rows.groupBy("split").agg(F.count("*").alias("size")).join(bad, "split", "left")
    return out.withColumns({"wanted": F.try_element_at(wanted, F.col("split")), "shared_songs": F.coalesce("shared_songs", F.lit(0))})


def split_features(charts: DataFrame) -> DataFrame:
    """The categories by which splits are compared, from chart_version, difficulty_name, level and chart_kind."""
    return charts.withColumns({"version": F.col("chart_version"), "difficulty": F.col("difficulty_name"), "version_difficulty": F.concat_ws("|", "chart_version", "difficulty_name")})


def charter_bucket(category: str = "charter_category", names: str = "charter_names"):
    """The shared category, else the first name."""
    from .integrity import SHARED, UNSIGNED

    return F.when(F.col(category) == SHARED, SHARED).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit(UNSIGNED)))


def dataset_summary(records: DataFrame) -> DataFrame:
    """One row: records, charts, songs, counts by difficulty and by section, least and largest level."""
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    each = lambda c: records.groupBy(c).agg(F.count("*").alias("n")).agg(counts(c).alias(f"{c}_counts"))
    whole = records.agg(F.count("*").alias("record_count"), F.countDistinct("chart_id").alias("chart_count"), F.countDistinct("song_id").alias("song_count"), F.min("level_value").alias("minimum_level"), F.max("level_value").alias("maximum_level"))
    return whole.crossJoin(each("difficulty")).crossJoin(each("segment_id"))


def category_totals(charts: DataFrame, features: list[str]) -> DataFrame:
    """feature, value, n of several categories in one pass."""
    long = charts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))).alias("x")).select("x.feature", "x.value")
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def divider_summary(charts: DataFrame, threshold: float) -> DataFrame:
    """One row: songs and charts with a divider above a threshold, and the largest of all."""
    from ..functions import text

    d = charts.withColumn("_d", text.large_dividers(F.col("content"), threshold)).where(F.size("_d") > 0)
    return d.agg(F.countDistinct("song_id").alias("songs"), F.countDistinct("chart_id").alias("charts"), F.max(F.array_max("_d")).alias("largest"))
