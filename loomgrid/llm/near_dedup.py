"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Every document gets its set of word shingles (64-bit numbers made of keyed word hashes) and a
   signature of `coords` MinHash values. Documents with the same set form a class, a node.
2. Nodes are posted under each (coordinate, value). Two sets above the similarity collide in at least
   `match` lists but for a chance below 1e-7 (binomial tail), so ordered by list length they share
   one of their `coords - match + 1` shortest lists: the prefix. The longer lists are skipped when
   lists are merged; they are only probed for pairs that the prefix lists have proposed. Values that
   no other node has are dropped.
3. Only nodes that share a prefix list are read again for their full sets. Shingles that only one of
   them has bound every similarity of a node from above: pairs and nodes below the threshold go
   without a comparison.
4. In each list the node with the smallest share of such shingles is compared with the others, which
   joins most groups by a number of pairs linear in their size. Of lists that still hold several
   components, all nodes outside the largest are then compared with those of other components, in
   blocks of bounded size; pairs in one component need not be. A block counts collisions list by list,
   the prefix first. So no link between components is lost and no group is expanded into all its pairs.
5. A pair is retained if it collides in `match` coordinates, in blocks as elsewhere, and it is a link
   if its full sets reach the similarity.

Defined cases: texts without words (null, empty) have an empty set and are linked with nothing;
texts with fewer words than a shingle have the whole sequence as their one shingle; a text of any
length is read whole, in parts; similarities that equal the threshold are links, and of equal ids'
rows none is preferred; rows that repeat an id count as one document, linked through any of its
texts, each with its own set size; a null id is linked with nothing, has a null component and
stays; an empty table gives no rows; other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import pieces, release, rows_of, settle, skewed_join, small, text_bytes
from .components import components

COORDS = 40
#: Bounds of the blocks that are compared in memory.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1 << 20
MISS = 1e-7
NEVER = 1 << 62  # rows of a side that is never broadcast


def match_threshold(percent: int, coords: int, miss: float = MISS) -> int:
    """The most matches that a pair at the similarity reaches but for a chance of `miss`."""
    p, tail = percent / 100, 0.0
    for m in range(coords + 1):
        tail += math.comb(coords, m) * p**m * (1 - p) ** (coords - m)
        if tail > miss:
            return max(1, m)
    return coords


def multipliers(coords: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, (2, coords), dtype=np.uint64) * kernels.U64(2) + kernels.U64(1)


def signatures_of(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """The MinHash signatures of non-empty sets: the upper 32 bits of the least of each coordinate's hashes."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    add, times = multipliers(coords)
    out = np.empty((len(sets), coords), np.int32)
    for k in range(coords):
        out[:, k] = (np.minimum.reduceat((flat ^ add[k]) * times[k], heads) >> kernels.U64(32)).astype(np.uint32).view(np.int32)
    return out


def lists(rows: list[np.ndarray] | np.ndarray, dtype) -> pa.ListArray:
    offs = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(dtype, copy=False).view(dtype)))


def _shingled(docs: DataFrame, words: int, coords: int) -> DataFrame:
    """key, n, digest of the set and signature of (key, text). With columns node and want in docs instead: node, n, signature and the set, of the texts whose digest is want. No shuffle."""
    full = "want" in docs.columns

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                sets = kernels.shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                ids = batch.column(0).slice(i, j - i)
                if full:
                    own = [k for k, want in enumerate(batch.column(2).slice(i, j - i).to_pylist()) if want == digest[k]]
                    ids, sets, digest = ids.take(pa.array(own, pa.int64())), [sets[k] for k in own], ()
                there = [s for s in sets if len(s)]
                sig = iter(signatures_of(there, coords) if there else ())
                none = np.zeros(0, np.int32)
                cols = [ids, pa.array([len(s) for s in sets], pa.int64()), lists([next(sig) if len(s) else none for s in sets], np.int32)]
                cols.append(lists([s.view(np.int64) for s in sets], np.int64) if full else pa.array(digest, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["node" if full else "key", "n", "sig", "shingles" if full else "digest"]
    return docs.mapInArrow(run, f"{names[0]} bigint, n bigint, sig array<int>, " + ("shingles array<bigint>" if full else "digest binary"))


def collisions(left: np.ndarray, right: np.ndarray, match: int) -> np.ndarray:
    """Which pairs of two sides' signatures collide in `match` coordinates or more.

    The lists of a coordinate pair the rows that have its value on either side. Coordinates are merged
    from the one with the fewest collisions on; pairs that the first `coords - match + 1` lists do not
    hold are skipped in the rest, as whole rows and columns of the counts."""
    coords = left.shape[1]
    equal = [np.equal.outer(left[:, k], right[:, k]) for k in range(coords)]
    order = np.argsort([e.sum() for e in equal], kind="stable")
    prefix = coords - match + 1
    count = np.add.reduce([equal[k] for k in order[:prefix]], dtype=np.int16)
    out = np.zeros(count.shape, bool)
    i, j = np.flatnonzero(count.any(1)), np.flatnonzero(count.any(0))
    if len(i):
        at = np.ix_(i, j)
        first = count[at]
        rest = np.add.reduce([equal[k][at] for k in order[prefix:]], dtype=np.int16) if prefix < coords else 0
        out[at] = (first > 0) & (first + rest >= match)
    return out


def blocked_links(left: pa.Table, right: pa.Table, percent: int, match: int) -> tuple[list[int], list[int]]:
    """Links between two blocks of (node, component, sig, shingles): for each left node one to every component."""

    def side(t: pa.Table):
        n = len(t)
        flat, offs = _flat(t.column("shingles"))
        sig = _flat(t.column("sig"))[0].reshape(n, -1)
        return t.column("node").to_numpy(), t.column("component").to_numpy(), np.diff(offs), flat, np.repeat(np.arange(n), np.diff(offs)), sig

    ln, lc, ls, lf, lr, lsig = side(left)
    rn, rc, rs, rf, rr, rsig = side(right)
    hit = collisions(lsig, rsig, match) & (lc[:, None] != rc[None, :])
    least = np.minimum(ls[:, None], rs[None, :])
    hit &= 100 * least >= percent * np.maximum(ls[:, None], rs[None, :])
    i, j = hit.any(1)[lr], hit.any(0)[rr]  # only sets of retained pairs are compared
    lf, lr, rf, rr = lf[i], lr[i], rf[j], rr[j]
    both = np.intersect1d(lf, rf)
    i, j = np.isin(lf, both), np.isin(rf, both)
    lf, lr, rf, rr = np.searchsorted(both, lf[i]), lr[i], np.searchsorted(both, rf[j]), rr[j]
    shared = np.zeros(hit.shape, np.float32)
    for lo in range(0, len(both), 4096):
        x, y = np.zeros((len(ln), 4096), np.float32), np.zeros((len(rn), 4096), np.float32)
        i, j = (lf >= lo) & (lf < lo + 4096), (rf >= lo) & (rf < lo + 4096)
        x[lr[i], lf[i] - lo] = 1
        y[rr[j], rf[j] - lo] = 1
        shared += x @ y.T
    shared = shared.astype(np.int64)
    i, j = np.nonzero(hit & (100 * shared >= percent * (ls[:, None] + rs[None, :] - shared)))
    _, one = np.unique(np.column_stack([i, rc[j]]), axis=0, return_index=True) if len(i) else (None, i)
    return ln[i[one]].tolist(), rn[j[one]].tolist()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and their offsets."""
    arr = column.combine_chunks()
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    offs = np.asarray(arr.offsets, np.int64)
    return arr.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], offs - offs[0]


def _links_between(mixed: DataFrame, sets: DataFrame, percent: int, match: int) -> DataFrame:
    """Links (a, b) between different components of the lists in `mixed` (head, node, component): of each node at least one to every component that it is linked with.

    Nodes of lists that overlap form a cluster. All nodes outside the largest component of their
    cluster are compared with all of other components whose size allows it, block against block, so
    that a task holds two blocks of bounded size and no pair is a row unless it is a link."""
    step = math.log(100 / percent) * 1.000001  # sets above the similarity are at most one class of sizes apart
    cluster = components(mixed.select(F.col("head").alias("a"), F.col("node").alias("b")))
    nodes = mixed.select("node", "component").distinct().join(sets.select("node", F.col("n").alias("weight")), "node").join(cluster.select("node", F.col("component").alias("cluster")), "node")
    nodes = settle(nodes.withColumn("size", F.floor(F.log("weight") / F.lit(step))), "clusters")
    main = nodes.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("n"))
    main = settle(main.select("cluster", F.col("m.component").alias("main"), "n"), "mains")
    placed = skewed_join(nodes, main.select("cluster", "main"), ["cluster"], main, rows_of(main)).withColumn("asks", F.col("component") != F.col("main"))
    sides = F.explode(F.when(F.col("asks"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("asking")
    blocks = placed.select("cluster", "size", "weight", sides).groupBy("cluster", "size", "asking")
    blocks = settle(blocks.agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("weight") / BLOCK_SHINGLES)).alias("blocks")), "blocks")
    key = ["cluster", "qsize", "q", "asize", "a"]

    def spread(rows: DataFrame, asking: bool, own: str, other: str) -> DataFrame:
        """Each row in its block, once for every block of the other side that its size allows, with its set."""
        mine, others = blocks.where("asking" if asking else "not asking"), blocks.where("not asking" if asking else "asking")
        rows = skewed_join(rows, mine.select("cluster", "size", "blocks"), ["cluster", "size"], mine, rows_of(blocks))
        near = F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias(other + "size")
        rows = rows.select("cluster", "node", "component", F.col("size").alias(own + "size"), F.pmod(F.xxhash64("node"), "blocks").alias(own), near)
        to = others.select("cluster", F.col("size").alias(other + "size"), "blocks")
        counts = mine.select("cluster", F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias(other + "size"), "n").groupBy("cluster", other + "size").agg(F.sum("n").alias("n"))
        rows = skewed_join(rows, to, ["cluster", other + "size"], counts, rows_of(blocks)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        return rows.join(sets.select("node", "sig", "shingles"), "node").select(*key, "node", "component", "sig", "shingles")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([c.removeprefix("other_") for c in right.column_names])
        a, b = blocked_links(left, right, percent, match) if len(left) and len(right) else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    asked, all_ = spread(placed.where("asks"), True, "q", "a"), spread(placed, False, "a", "q")
    all_ = all_.select(*(F.col(c).alias("other_" + c) for c in all_.columns))  # both come from `nodes`
    links = settle(asked.groupBy(*key).cogroup(all_.groupBy(*("other_" + c for c in key))).applyInArrow(compare, "a bigint, b bigint"), "rest")
    release(cluster, nodes, main, blocks)
    return links


def _postings(classes: DataFrame, prefix: int, coords: int) -> DataFrame:
    """(node, token) of the prefix lists with two nodes or more."""
    tokens = settle(classes.select("node", F.posexplode("sig")).select("node", F.xxhash64("pos", "col").alias("token")), "tokens")
    longer = settle(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    order = skewed_join(tokens, longer, ["token"], longer, rows_of(longer)).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    # values of no other node come first in the order, so they take their part of the prefix
    taken = F.greatest(F.lit(0), F.lit(prefix - coords) + F.size("o"))
    post = settle(order.select("node", F.explode(F.slice("o", F.lit(1), taken)).alias("o")).select("node", F.col("o.token").alias("token")), "prefixes")
    shared = settle(post.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    out = settle(skewed_join(post, shared, ["token"], shared, rows_of(shared)).select("node", "token"), "postings")
    release(tokens, longer, post, shared)
    return out


def _links(classes: DataFrame, base: DataFrame, words: int, percent: int, coords: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) between classes (node, key, digest, sig) that connect all that the similarity connects, and the components if they are known; base has (key, text)."""
    match = match_threshold(percent, coords)
    post = _postings(classes, coords - match + 1, coords)
    nodes = settle(classes.join(post.select("node").distinct(), "node", "left_semi").select("node", "key", F.col("digest").alias("want")), "nodes")
    sets = settle(_shingled(base.join(small(nodes), "key").select("node", "text", "want"), words, coords), "sets")
    if rows_of(sets) != rows_of(nodes):  # rows that repeat both an id and its text
        again, sets = sets, settle(sets.dropDuplicates(["node"]), "sets")
        release(again)
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("u"))
    size = sets.select("node", "n").join(alone, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))
    live = settle(post.join(size.where(f"100 * (n - u) >= {percent} * n"), "node"), "live")

    star = live.groupBy("token").agg(F.count("*").alias("count"), F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "node", "n", "u")).alias("p"))
    star = settle(star.select("token", F.col("count").alias("n"), *(F.col(f"p.{x}").alias("p_" + x) for x in ("node", "n", "u"))), "stars")
    most = "least(n - u, p_n - p_u)"  # as many shingles can be shared
    pairs = skewed_join(live, star.drop("n"), ["token"], star, rows_of(star)).where("node <> p_node").where(f"100 * {most} >= {percent} * (n + p_n - {most})")
    pairs = settle(pairs.select(F.col("p_node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    side = lambda c: sets.select(F.col("node").alias(c), *(F.col(x).alias(c + x) for x in ("n", "sig", "shingles")))
    both = skewed_join(pairs, side("a"), ["a"], pairs.groupBy("a").agg(F.count("*").alias("n")), NEVER).join(side("b"), "b")
    probed = F.size(F.filter(F.zip_with("asig", "bsig", lambda x, y: x == y), lambda x: x))
    shared = F.size(F.array_intersect("ashingles", "bshingles"))
    links = settle(both.where(probed >= match).where(100 * shared >= percent * (F.col("an") + F.col("bn") - shared)).select("a", "b"), "links")
    group = components(links)

    placed = live.select("node", "token").join(group.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = settle(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("head")).where("lo < hi").select("token", "head")
    mixed = settle(skewed_join(placed, mixed, ["token"], star, rows_of(star)).drop("token"), "mixed")
    if rows_of(mixed):
        more = _links_between(mixed, sets, percent, match)
        if rows_of(more):
            links = links.unionByName(more)
            release(group)
            group = None
    release(post, nodes, sets, live, star, pairs, placed, mixed)
    return links, group


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, coords: int = COORDS) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable over links), kept (component_id is the key)."""
    base = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = settle(_shingled(base, words, coords), "signatures")
    classes = signed.where("n > 0 and key is not null").groupBy("n", "digest").agg(F.min("key").alias("key"), F.first("sig").alias("sig"), F.count("*").alias("members"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links, group = _links(classes, base, words, percent, coords)

    sized = classes.withColumnRenamed("n", "size")
    members, known = sized.select("size", "digest", F.col("members").alias("n")), rows_of(classes)
    rows = signed.select("key", F.col("n").alias("size"), "digest")
    own = rows.where("size > 0 and key is not null")
    repeated = own.groupBy("key").count().where("count > 1").select("key")
    repeats = not repeated.isEmpty()
    if repeats:  # a document is linked through each of its texts
        named = skewed_join(own, sized.select("size", "digest", "node"), ["size", "digest"], members, known)
        again = settle(named.join(repeated, "key", "left_semi").select("key", "node").distinct(), "repeats")
        low = again.groupBy("key").agg(F.min("node").alias("a"))
        links, group = links.unionByName(again.join(low, "key").where("node <> a").select("a", F.col("node").alias("b"))), None
    group = components(links) if group is None else group
    least = group.join(classes.select("node", "key"), "node").groupBy("component").agg(F.min("key").alias("component_id"), F.count("*").alias("n"))
    least = settle(least, "least")
    found = skewed_join(group.select("node", "component"), least.drop("n"), ["component"], least, rows_of(least))
    label = settle(sized.join(found, "node", "left").select("size", "digest", F.coalesce("component_id", "key").alias("component_id")), "label")
    release(group, least)
    out = skewed_join(rows, label, ["size", "digest"], members, known, "left").select("key", "size", F.coalesce("component_id", "key").alias("component_id"))
    if repeats:  # a text without words goes with the other texts of its id
        out = settle(out, "rows")
        least_of = out.where("key is not null").groupBy("key").agg(F.min("component_id").alias("component_id"))
        out = out.drop("component_id").join(least_of, "key", "left")
    component = F.when(F.col("key").isNotNull(), F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each group of near-duplicates: the smallest id."""
    gone = settle(near_components(docs, key, text, words, percent).where("not kept").select(key).distinct(), "gone")
    return docs.join(small(gone), key, "left_anti").select(*docs.columns)
