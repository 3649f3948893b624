"""Exact links between sets that meet in buckets, by a grouped join.

Sets with the same size and the same keys are one group, and groups meet in the buckets of their
keys. In a bucket, group pairs are filtered by their sizes and by the places of the shared key; the pairs that
are left are expanded to their members, which an exact bound from parity sketches filters. What is left
is verified pair by pair on the whole sets.

Links are wanted as components, so pairs inside a component need no verification:
1. star rounds: each bucket gives a spanning star of its candidates that are not yet connected and, if it is
   large, a few random candidates of each set; a bucket of over `bucket_rows` rows goes in blocks, dealt anew in
   each round, so a row is sent once; the pairs are verified and the links make components. Where a bucket is that large, the first round
   takes one in FIRST_PART buckets only: members of a family share most of theirs, so one part connects most of it and spares the others' pairs;
2. last round: buckets that hold one component only are done, and so are those that were met whole and hold no
   two sets of failed pairs: all that their stars connect is linked. The others give all their candidate
   pairs of different components that were not tried yet. In a large one, rows of its largest
   component meet the rest only, not each other, so a family of copies costs no square.

Sets have one order in all buckets, so buckets of the same sets give the same pairs. Sketches join the rows
last, when these are dealt to their buckets, and so move once a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, mixed, runs, sized_broadcast, stored

BUCKET_ROWS = 3000
MOST_BITS = 1 << 12
GROUP_ROWS = 64
#: Candidates that each set of a bucket of over 48 sets gives in a star round besides the star; fewer do where all sets are in many buckets.
RANDOM_PAIRS = 6
FIRST_PART = 4
#: Rows of a table that a join here broadcasts; several may be held at once.
LOCAL_ROWS = 100_000
#: Bytes of sets that a join broadcasts; their hashes do not compress, and the driver holds them several times over.
LOCAL_BYTES = 4_000_000
_PAIR = "a long, b long"


def sketch(items: np.ndarray, spread: int = 1) -> bytes:
    """Parity of the set's items over about `spread` bits an item, a power of 2: two sketches differ in no more bits than the sets differ in items."""
    bits = min(MOST_BITS, max(64, spread << (len(items) - 1).bit_length()))
    parity = (np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").tobytes()


def sketches(items: np.ndarray, sizes: np.ndarray, spread: int = 1) -> list[bytes]:
    """Sketches of many sets at once: items of all, of which `sizes` belong to each."""
    out: list[bytes] = [b""] * len(sizes)
    bits = np.array([min(MOST_BITS, max(64, spread << (n - 1).bit_length())) for n in sizes.tolist()])
    first = np.cumsum(sizes) - sizes
    for w in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == w)
        n = sizes[rows]
        at = np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(np.arange(len(rows)), n) * w + (items[at] & np.uint64(w - 1)).astype(np.int64)
        parity = (np.bincount(place, minlength=w * len(rows)) & 1).astype(np.uint8)
        packed = np.packbits(parity.reshape(len(rows), w), axis=1, bitorder="little").tobytes()
        for k, r in enumerate(rows.tolist()):
            out[r] = packed[k * w // 8 : (k + 1) * w // 8]
    return out


def least_overlap(n, m, percent: int):
    """Items that two sets of n and m items share at least if they link."""
    return -(-percent * (n + m) // (100 + percent))


class Forest:
    """Union-find over set ids; a component is a node of its own."""

    def __init__(self):
        self.root: dict = {}

    def find(self, x):
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[y] = x
        return x != y


def candidates(groups: list[tuple], percent: int, own: bool, spanning: bool, random_pairs: int = RANDOM_PAIRS) -> list[tuple[int, int]]:
    """Pairs of set ids of a bucket that may link and are in different components, or of these a spanning star.

    groups: (gid, block, n, place, sids, comps, sketches). Pairs of one group meet in the bucket of the
    group itself only (own). Blocks that are not null say which pairs meet here: those of two blocks.
    """
    groups = sorted(groups, key=lambda g: (g[2], g[0], g[4]))
    forest, out = Forest(), []

    def take(s1, c1, s2, c2):
        if s1 == s2:
            return
        if spanning:
            if forest.join(c1, c2):
                out.append((s1, s2))
        elif c1 != c2:
            out.append((min(s1, s2), max(s1, s2)))

    if sum(len(g[4]) for g in groups) <= 48:
        bits = [[int.from_bytes(x, "little") for x in g[6]] for g in groups]
        for i, (g1, block1, n, p1, s1, c1, k1) in enumerate(groups):
            for j in range(i if own else i + 1, len(groups)):
                g2, block2, m, p2, s2, c2, k2 = groups[j]
                if 100 * n < percent * m:
                    break
                least = least_overlap(n, m, percent)
                if min(n - p1, m - p2) < least or (g1 == g2) != own or (block1 is not None and block1 == block2):
                    continue
                for x in range(len(s1)):
                    for y in range(x + 1 if i == j else 0, len(s2)):
                        v, w, wide = bits[j][y], 8 * len(k1[x]), 8 * len(k2[y])
                        while wide > w:  # fold the wider sketch
                            wide //= 2
                            v = (v >> wide) ^ (v & ((1 << wide) - 1))
                        if (bits[i][x] ^ v).bit_count() <= n + m - 2 * least:
                            take(s1[x], c1[x], s2[y], c2[y])
        return out
    flat = [(*g[:4], s, c, k) for g in groups for s, c, k in zip(*g[4:], strict=True)]
    sids = np.array([f[4] for f in flat], np.int64).view(np.uint64)
    gid, size, place = (np.array([f[k] for f in flat], np.int64) for k in (0, 2, 3))
    block = np.array([-1 if f[1] is None else f[1] for f in flat])
    width = np.array([len(f[6]) for f in flat])
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        x = np.stack([np.frombuffer(f[6], np.uint64) if len(f[6]) == w else np.frombuffer(f[6][:w], np.uint64) ^ np.frombuffer(f[6][w:], np.uint64) for f in (flat[r] for r in rows)])
        n, p, g, b = size[rows], place[rows], gid[rows], block[rows]
        for at in np.flatnonzero(width[rows] == w).tolist():
            last = int(np.searchsorted(n, 100 * n[at] // percent, side="right"))
            m = n[at + 1 : last]
            least = least_overlap(n[at], m, percent)
            near = (np.minimum(n[at] - p[at], m - p[at + 1 : last]) >= least) & ((g[at + 1 : last] == g[at]) == own) & ((b[at] < 0) | (b[at + 1 : last] != b[at]))
            near = np.flatnonzero(near)
            near = near[np.bitwise_count(x[at + 1 + near] ^ x[at]).sum(1) <= n[at] + m[near] - 2 * least[near]]
            f, near = flat[rows[at]], rows[at + 1 + near]
            for j in near.tolist():
                take(f[4], f[5], flat[j][4], flat[j][5])
            if spanning and random_pairs and len(near) > 1:  # and a few at random, the same in all buckets: one star would leave a family whose hub links to few in pieces
                pick = near[np.argsort(mixed(sids[near] ^ sids[rows[at]]))[:random_pairs]]
                out.extend((f[4], flat[j][4]) for j in pick.tolist() if f[5] != flat[j][5])
    return out


def group_members(sets: DataFrame, comps: DataFrame | None, failed: DataFrame | None, single: bool) -> DataFrame:
    """(m_gid, chunk, sids, comps, sketches, comp, open) of each group, in rows of about GROUP_ROWS members.

    comp is null if they differ; open counts the members in failed (f_sid). single: each set is a group of its own.
    """
    s = sets.withColumn("comp", F.col("sid")) if comps is None else sets.join(sized_broadcast(comps, LOCAL_ROWS), F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sid"))
    s = s.withColumn("open", F.lit(0)) if failed is None else s.join(sized_broadcast(failed, LOCAL_ROWS), F.col("sid") == F.col("f_sid"), "left").withColumn("open", F.col("f_sid").isNotNull().cast("int"))
    if single:
        return s.select(F.col("gid").alias("m_gid"), F.lit(0).cast("long").alias("chunk"), F.array("sid").alias("sids"), F.array("comp").alias("comps"), F.array("sketch").alias("sketches"), "comp", F.col("open").cast("long").alias("open"))
    chunks = s.groupBy(F.col("gid").alias("c_gid")).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("chunks")).filter("chunks > 1")
    s = s.join(sized_broadcast(stored(chunks), LOCAL_ROWS), F.col("gid") == F.col("c_gid"), "left")
    chunk = F.pmod(F.xxhash64("sid"), F.coalesce("chunks", F.lit(1))).alias("chunk")
    out = s.groupBy("gid", chunk).agg(F.collect_list("sid").alias("sids"), F.collect_list("comp").alias("comps"), F.collect_list("sketch").alias("sketches"), F.sum("open").alias("open"))
    return out.select(F.col("gid").alias("m_gid"), "chunk", "sids", "comps", "sketches", F.when(F.array_min("comps") == F.array_max("comps"), F.array_min("comps")).alias("comp"), "open")


def bucket_pairs(rows: DataFrame, members: DataFrame, percent: int, bucket_rows: int, star: int | None, random_pairs: int = RANDOM_PAIRS) -> DataFrame:
    """Distinct candidate pairs (a, b) of all buckets, from rows (h, own, gid, n, place) and stored members; star: number of the star round, None for the last."""
    thin = members.select("m_gid", "chunk", F.element_at("sids", 1).alias("lead"), "comp", "open")
    met = rows.join(thin, F.col("gid") == F.col("m_gid")).drop("m_gid")
    per = met.groupBy("h", "own", "comp").agg(F.count("*").alias("rows"), F.sum("open").alias("open"))
    major = F.max_by("comp", F.when(F.col("comp").isNotNull(), F.col("rows")).otherwise(0))
    shape = per.groupBy("h", "own").agg(F.sum("rows").alias("rows"), F.sum("open").alias("open"), F.count("*").alias("kinds"), F.max(F.col("comp").isNull()).alias("mixed"), major.alias("major"), F.max(F.when(F.col("comp").isNotNull(), F.col("rows"))).alias("most"))
    shape = shape.filter("kinds > 1 OR mixed")
    if star is None:
        shape = shape.filter((F.col("open") > 1) | (F.col("rows") > bucket_rows))
    shape = stored(shape.select(F.col("h").alias("s_h"), F.col("own").alias("s_own"), "rows", "major", F.coalesce("most", F.lit(0)).alias("most")))
    met = met.join(sized_broadcast(shape, LOCAL_ROWS), (F.col("h") == F.col("s_h")) & (F.col("own") == F.col("s_own"))).drop("s_h", "s_own")
    deal = F.xxhash64("gid", "lead", F.lit(star or 0))
    if star is not None:
        dealt = met.withColumn("i", F.pmod(deal, F.ceil(F.col("rows") / bucket_rows)).cast("int")).withColumn("j", F.lit(0)).withColumn("block", F.lit(None).cast("int"))
    else:
        is_major = F.coalesce(F.col("comp") == F.col("major"), F.lit(False))
        small, large = F.ceil((F.col("rows") - F.col("most")) / bucket_rows).cast("int"), F.ceil(F.col("most") / bucket_rows).cast("int")
        one = F.col("rows") <= bucket_rows
        mine = F.when(is_major, small + F.pmod(deal, F.greatest(large, F.lit(1))).cast("int")).otherwise(F.pmod(deal, F.greatest(small, F.lit(1))).cast("int"))
        met = met.withColumn("mine", F.when(one, 0).otherwise(mine)).withColumn("small", small).withColumn("all", small + large)
        until = F.when(is_major, F.col("small")).otherwise(F.col("all")) - 1
        others = F.when(one | (until < 0), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), until))
        dealt = met.withColumn("other", F.explode(others)).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
        dealt = dealt.withColumn("block", F.when(F.col("i") != F.col("j"), F.col("mine")))
    dealt = dealt.select("h", "own", "i", "j", "gid", F.col("chunk").alias("d_chunk"), "block", "n", "place")
    dealt = dealt.join(members, (F.col("gid") == F.col("m_gid")) & (F.col("d_chunk") == F.col("chunk")))
    dealt = dealt.select("h", "own", "i", "j", "gid", "block", "n", "place", "sids", "comps", "sketches")
    dealt = dealt.repartition("h", "own", "i", "j").sortWithinPartitions("h", "own", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()

        def flush():
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for bucket in runs(batches, 4):
            out.update(candidates(list(zip(*bucket[4:], strict=True)), percent, bucket[1][0], star is not None, random_pairs))
            if len(out) > 100_000:
                yield flush()
        if out:
            yield flush()

    pairs = dealt.mapInArrow(run, _PAIR)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of items (id, items: sorted distinct 64-bit values)."""
    whole = items.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    side = F.broadcast(items) if whole <= LOCAL_BYTES else items
    both = pairs.join(side.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, _PAIR)


def one_of_each_id(items: DataFrame) -> DataFrame:
    """A stored copy of items, of each id one row; only ids move unless some repeat."""
    out = stored(items)
    if not out.groupBy("id").count().filter("count > 1").limit(1).count():
        return out
    once = stored(out.dropDuplicates(["id"]))
    discard(out)
    return once


def link_components(rows: DataFrame, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, bucket_rows: int = BUCKET_ROWS, random_pairs: int = RANDOM_PAIRS, single: bool = False) -> DataFrame:
    """(node, component) of every set that links to another one; component is the smallest set id.

    rows: stored (h, gid, n, place) of each group in each of its buckets, deleted once copied; place counts the keys of
    the group before h in an order that all groups share. sets: stored (sid, gid, sketch); single: gid is sid in all.
    fetch gives (id, items) for a table of ids, which may repeat. An empty table gives no rows.
    """
    met = rows.select("h", F.lit(False).alias("own"), "gid", "n", "place")
    if not single:
        twins = sets.groupBy("gid").agg(F.count("*").alias("members"), F.max("n").alias("n")).filter("members > 1")
        met = met.unionByName(twins.select(F.col("gid").alias("h"), F.lit(True).alias("own"), "gid", "n", F.lit(0).alias("place")))
    met = stored(met)
    discard(rows)
    meeting = stored(met.select(F.col("gid").alias("r_gid")).distinct())
    sets = stored(sets.select("sid", "gid", "sketch").join(sized_broadcast(meeting, LOCAL_ROWS), F.col("gid") == F.col("r_gid"), "left_semi"))
    discard(meeting)
    largest = met.groupBy("h", "own").count().agg(F.max("count")).first()[0] or 0
    comps = tried = items = links = failed = None

    def grown(table: DataFrame | None, more: DataFrame) -> DataFrame:
        """Both tables as one; the parts are deleted."""
        if table is None:
            return more
        out = stored(table.unionByName(more))
        discard(table, more)
        return out

    for star in [0, *([1] if largest > bucket_rows else []), None]:
        some = F.col("own") | (F.pmod("h", F.lit(FIRST_PART)) == 0)
        here = met.filter(some) if star == 0 and largest > bucket_rows else met
        members = stored(group_members(sets, comps, failed, single))
        pairs = bucket_pairs(here, members, percent, bucket_rows, star, random_pairs)
        if tried is not None:
            pairs = pairs.join(sized_broadcast(tried, LOCAL_ROWS), ["a", "b"], "left_anti")
        pairs = stored(pairs)
        discard(members)
        if not pairs.limit(1).count():
            continue
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        fresh = ids if items is None else stored(ids.join(items.select("id"), "id", "left_anti"))
        items = grown(items, one_of_each_id(fetch(fresh)))
        wanted = items if fresh is ids else items.join(sized_broadcast(ids, LOCAL_ROWS), "id", "left_semi")
        links = grown(links, stored(verified(pairs, wanted, percent)))
        discard(ids, fresh)
        tried = grown(tried, pairs)
        comps = stored(connected_components(links))
        if star is not None:
            failed = stored(tried.join(links, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("f_sid")).distinct())
    if comps is None:
        comps = stored(met.select(F.col("gid").alias("node"), F.col("gid").alias("component")).filter("false"))
    discard(met, sets, *(t for t in (tried, items, links) if t is not None))
    return comps
