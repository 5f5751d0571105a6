"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces. All pieces are packed as best-fit
decreasing does it (of equally full bins the one of the smaller size first), over a histogram: how
many pieces there are of each length is all the plan needs, and there are at most as many lengths as
the longest sequence has tokens, however many documents there are. Equal pieces are placed at once into all bins that are alike. A piece that fits no open bin
opens one of the permitted sizes: the one whose price, less the worth of what it can still take in
(the shorter pieces not placed yet), is least. At the end each bin shrinks to the smallest permitted
size that holds its contents.

Pieces then find their place by their number among the pieces of their length. The numbers are dealt
in two steps (within groups of a hash of the id, after the counts of the groups before), so a length
that a third of all pieces share is not numbered by one task.

Defined cases: null and empty texts, and null counts, have no tokens and one empty piece in bin -1
(nothing to pack); texts of any length are cut into pieces, none is dropped; equal lengths go in the
order of key and piece within groups by hash; repeated rows are packed each, and null ids are kept; an
empty table gives no rows; other columns are not used, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _light, settle, small

SIZES = (512, 1024, 2048, 4096, 8192)
#: Pieces of one length are numbered in groups of about so many, in at least GROUPS groups.
GROUP_ROWS, GROUPS, MOST_GROUPS = 1 << 20, 64, 1 << 16


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def token_price(size: int) -> float:
    """A sequence costs its tokens and a part for attention that grows with its length."""
    return size * (1 + size / 65536)


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, price: Callable[[int], float] = token_price) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Best-fit decreasing over {length: count}: (size, number of like bins, [(length, pieces in each)])."""
    sizes = tuple(sorted(sizes))
    if any(n > sizes[-1] or n < 1 for n in histogram):
        raise ValueError("a length does not fit any size")
    lengths = sorted(histogram, reverse=True)
    mass = [0]  # tokens of the shortest lengths, to see what is left to fill a bin
    rising = lengths[::-1]
    for n in rising:
        mass.append(mass[-1] + n * histogram[n])
    open_: dict[int, list[tuple[int, int, tuple]]] = {}  # free tokens -> like bins (number, size, contents)
    free: list[int] = []
    unit = min(price(s) / s for s in sizes)

    def put(room: int, group: tuple[int, int, tuple]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(free, room)
        open_[room].append(group)

    for n in lengths:
        left = histogram[n]
        while left:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                below = mass[bisect.bisect_left(rising, n)]

                def loss(size: int) -> tuple[float, int]:
                    same = min(left, size // n)
                    room = size - same * n
                    fits = min(room, mass[bisect.bisect_right(rising, room)], below)
                    return price(size) - unit * (same * n + fits), size

                size = min((s for s in sizes if s >= n), key=loss)
                full = sizes[-1] // n  # with fewer pieces left than this the next choice may differ
                put(size, (max(1, (left - full) // (size // n) + 1), size, ()))
                continue
            room = free[at]
            pick = min(range(len(open_[room])), key=lambda i: open_[room][i][1])
            number, size, inside = open_[room].pop(pick)
            if not open_[room]:
                del open_[room]
                free.pop(at)
            each = room // n
            whole = min(number, left // each)
            if whole:
                put(room - each * n, (whole, size, (*inside, (n, each))))
                left -= whole * each
            rest = number - whole
            if rest and left:  # fewer pieces than one more bin takes
                put(room - left * n, (1, size, (*inside, (n, left))))
                left, rest = 0, rest - 1
            if rest:
                put(room, (rest, size, inside))
    bins = [g for room in sorted(open_) for g in open_[room]]
    out = []
    for number, _, inside in bins:
        used = sum(n * k for n, k in inside)
        out.append((next(s for s in sizes if s >= used), number, list(inside)))
    return sorted(out, key=lambda b: (-b[0], [(-n, -k) for n, k in b[2]], -b[1]))


def places(bins: list[tuple[int, int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Ranges of piece numbers for each length: (length, low, high, pieces in each bin, first bin, size, offset in the bin)."""
    used: dict[int, int] = {}
    out, first = [], 0
    for size, number, inside in bins:
        offset = 0
        for n, k in inside:
            low = used.get(n, 0)
            out.append((n, low, low + number * k, k, first, size, offset))
            used[n] = low + number * k
            offset += n * k
        first += number
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES, tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """pack_counted of the texts' tokens: words unless `tokens` counts others."""
    return pack_counted(docs.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("n_tokens")), key, sizes)


def pack_counted(counts: DataFrame, key: str = "doc_id", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row per piece of (key, n_tokens): key, piece, first_token, n_tokens, bin_id, bin_size, bin_offset (all but key bigint)."""
    spark, most = counts.sparkSession, max(sizes)
    counted = counts.select(F.col(key).alias("key"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("total"))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / most))))
    cut = counted.select("key", "total", piece.alias("piece")).select("key", "piece", (F.col("piece") * most).alias("first_token"), F.least(F.lit(most), F.col("total") - F.col("piece") * most).alias("n_tokens"))
    cut = settle(cut, "pieces")
    lengths = cut.where("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most as many as the longest sequence has tokens
    histogram = {r["n_tokens"]: r["count"] for r in lengths}
    found = places(plan(histogram, sizes))
    ranges = spark.createDataFrame(found, "length bigint, low bigint, high bigint, k bigint, first bigint, bin_size bigint, base bigint")

    ranges = F.broadcast(ranges) if _light(ranges, len(found)) else ranges
    groups = min(MOST_GROUPS, max(GROUPS, max(histogram.values(), default=0) // GROUP_ROWS))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    before = Window.partitionBy("n_tokens").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.where("n_tokens > 0").groupBy("n_tokens", "g").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("n_tokens", "g").orderBy("key", "piece")
    numbered = cut.where("n_tokens > 0").withColumn("i", F.row_number().over(order) - 1).join(small(settle(starts, "starts")), ["n_tokens", "g"]).withColumn("i", F.col("i") + F.col("start"))
    placed = numbered.join(ranges, (F.col("n_tokens") == F.col("length")) & (F.col("i") >= F.col("low")) & (F.col("i") < F.col("high")))
    nth = F.col("i") - F.col("low")
    out = placed.select(
        F.col("key").alias(key), "piece", "first_token", "n_tokens",
        (F.col("first") + F.floor(nth / F.col("k"))).alias("bin_id"), "bin_size", (F.col("base") + F.pmod(nth, "k") * F.col("n_tokens")).alias("bin_offset"),
    )
    empty = cut.where("n_tokens = 0").select(F.col("key").alias(key), "piece", "first_token", "n_tokens", F.lit(-1).cast("bigint").alias("bin_id"), F.lit(0).cast("bigint").alias("bin_size"), F.lit(0).cast("bigint").alias("bin_offset"))
    return out.unionByName(empty)


def sequences(placed: DataFrame, ids: DataFrame, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """The packed sequences: bin_id, bin_size, ids (of its pieces, one after the other, without padding) and starts (their offsets).

    `ids` has one row a document: key and the list that was counted. A bin holds at most the longest
    sequence, so no group is unbounded."""
    own = placed.where("bin_id >= 0").join(ids.select(key, F.col(column).alias("_ids")), key)
    piece = F.struct("bin_offset", F.slice("_ids", F.col("first_token").cast("int") + 1, F.col("n_tokens").cast("int")).alias("part"))
    bins = own.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return bins.select("bin_id", "bin_size", F.flatten("pieces.part").alias("ids"), F.col("pieces.bin_offset").alias("starts"))
