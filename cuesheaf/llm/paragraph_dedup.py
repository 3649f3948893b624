"""Substring dedup: paragraphs that repeat, by MinHash banding and exact Jaccard, and passages inside them.

Units of a text are its lines and its blocks; a block is a run of lines that have words, so a wrapped
paragraph is one, whatever its line breaks. Lines meet lines and blocks meet blocks, of any length.
1. one pass over the texts gives units and anchors; units of the same words (A-Z lower-cased, ASCII punctuation dropped) are one from here on (pid);
2. BANDS bands of ROWS MinHash values of a unit's word 5-grams give its keys: at similarity 0.8 a
   pair shares a key with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.9997;
3. only units that share a key get sets and sketches; they meet in its bucket, where sizes and parity sketches filter the pairs; the exact
   Jaccard similarity of the 5-gram sets decides each pair (set_links.py). A unit of fewer than five words is one
   shingle and links with its equals only;
4. components of the links are clusters: the first unit by (doc_id, place) stays, the others are removed.

repeated_passages finds what stands below or across lines: every run of PASSAGE words that occurs
twice, whatever the line breaks. Unspaced scripts count a character as a word there. Texts choose
anchors among their windows by value, so equal passages have equal anchors. Runs of windows of one shared
anchor are segments; equal segments are one, and the windows of the different ones are compared.

Defined cases: null and empty texts have no unit; repeated rows of a document repeat its units; rows of the
same doc_id, unit and place with other texts are units of their own, and the same verdict holds for those that tie as first; a
null doc_id counts as the largest; a very long line or text is a unit like others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mixed, numbered, release, shingles, sized_broadcast, small_batches, stored, utf8, word_hashes
from .decontaminate import windows
from .set_links import LOCAL_ROWS, link_components, sketches

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 8, 2
UNITS = ("line", "block")
#: ASCII characters other than letters and digits end a word.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Words of a repeated passage, and of the windows among which its anchors are chosen.
PASSAGE, ANCHOR = 50, 25
#: Windows of a passage that go as one row, and as the bits of a long.
SEGMENT = 64
#: Number of a row of text_marks that is an anchor, beside those of UNITS.
ANCHORS = 2
#: Characters of texts whose shingles are held at once, so that their arrays stay small; ids of units known to have given their keys.
MARK_CHARS, MOST_SEEN = 400_000, 200_000
#: Bits of a sketch for each item: near copies that just miss the limit seldom pass.
SPREAD = 4
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(f"[{_UNSPACED}]|[^\\x00-/:-@\\[-`{{-\\x7f{_UNSPACED}]+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SEEDS = np.random.default_rng(3).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def units(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(unit, place, words) of the lines and blocks of a text; place is the number of the (first) line, from 0."""
    out, block, start = [], [], 0
    for at, line in enumerate([*text.lower().split(b"\n"), b""]):
        words = line.translate(_BREAKS).split()
        if words:
            out.append((0, at, words))
            start = start if block else at
            block.extend(words)
        elif block:
            out.append((1, start, block))
            block = []
    return out


def content_id(unit: int, words: list[bytes]) -> int:
    """Id of a unit's words; units of one word alone that have the same one shingle have one id."""
    if len(words) > SHINGLE and words[0] == words[-1] and words.count(words[0]) == len(words):
        words = words[:SHINGLE]
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed=unit) - (1 << 63)


def band_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band keys (units x BANDS) of shingles h, of which `sizes` belong to each unit; repeated shingles change none."""
    first = np.cumsum(sizes) - sizes
    keys = np.empty((len(sizes), BANDS), np.uint64)
    product = np.empty_like(h)
    for band in range(BANDS):
        key = np.full(len(sizes), band + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key ^ np.minimum.reduceat(np.multiply(h, _SEEDS[band * ROWS + r], out=product), first))  # h is mixed already
        keys[:, band] = key
    return keys.view(np.int64)


def _shingled(unit: int, words: list[bytes]) -> np.ndarray:
    return np.unique(shingles(word_hashes(words), SHINGLE) ^ np.uint64(unit))  # lines and blocks share nothing


def all_shingles(parts: list[np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each of many units of SHINGLE words or more, given as word hashes, one unit after the other, and their numbers."""
    n = np.array([len(p) for p in parts])
    h = shingles(np.concatenate(parts), SHINGLE)
    inside = np.ones(n.sum(), bool)
    ends = np.cumsum(n)
    for j in range(1, SHINGLE):
        inside[ends - j] = False  # windows that run into the next unit
    sizes = n - SHINGLE + 1
    return h[inside[: len(h)]] ^ np.repeat(unit, sizes), sizes


def distinct_shingles(parts: list[np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ones of all_shingles of each unit, and their numbers."""
    h, sizes = all_shingles(parts, unit)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        h[start:end].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(sizes))


def shingled(parts: list[list[bytes]], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """distinct_shingles of units given as words."""
    return distinct_shingles([word_hashes(p) for p in parts], unit)


def text_marks(docs: DataFrame, paragraphs: bool = True, passage: int | None = None) -> DataFrame:
    """(row, doc_id, unit, at, n_words, id, keys) of docs (row, doc_id, text), by one pass over the texts that hashes each word once.

    paragraphs: a row for each unit, id is its pid; keys holds the band keys of units of more than SHINGLE words, at least in one row of
    each pid, and is empty in the others. passage: a row of unit ANCHORS for each anchor of a text for passages of so many words, its
    value as id and the windows that have it as n_words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small_batches(batches, MARK_CHARS):
            owner, unit, at, size, ids, keyed, parts, anchor, times = [], [], [], [], [], [], [], [], []
            if len(seen) > MOST_SEEN:
                seen.clear()
            for k, t in enumerate(utf8(b.column(2))):
                found = units(t)
                h = word_hashes([w for u, _, words in found if u == 0 for w in words])
                if paragraphs:
                    until = [0] * len(UNITS)
                    for u, place, words in found:
                        until[u] += len(words)
                        pid = content_id(u, words)
                        if len(words) > SHINGLE and pid not in seen:
                            seen.add(pid)
                            keyed.append(len(ids))
                            parts.append(h[until[u] - len(words) : until[u]])
                        owner.append(k)
                        unit.append(u)
                        at.append(place)
                        size.append(len(words))
                        ids.append(pid)
                if passage:
                    values = anchor_windows(passage_words(t, h), passage)
                    anchor.append(np.unique(anchors(values, passage)))
                    ordered = np.sort(values)
                    times.append(np.searchsorted(ordered, anchor[-1], side="right") - np.searchsorted(ordered, anchor[-1]))
            keys, ends = np.zeros(0, np.int64), np.zeros(len(ids) + 1, np.int32)
            if parts:
                keys = band_keys(*all_shingles(parts, np.array([unit[i] for i in keyed], np.uint64))).ravel()
                ends[np.array(keyed) + 1] = BANDS
                ends = np.cumsum(ends, dtype=np.int32)
            owner, unit, at, size, ids = (np.array(x, np.int64) for x in (owner, unit, at, size, ids))
            if passage:
                n = np.array([len(x) for x in anchor])
                owner = np.concatenate([owner, np.repeat(np.arange(len(n)), n)])
                unit, at = (np.concatenate([x, np.full(n.sum(), fill)]) for x, fill in ((unit, ANCHORS), (at, 0)))
                size, ids = np.concatenate([size, *times]), np.concatenate([ids, *(x.view(np.int64) for x in anchor)])
                ends = np.concatenate([ends, np.full(n.sum(), ends[-1])])
            rows = pa.array(owner)
            cols = [b.column(0).take(rows), b.column(1).take(rows), *(pa.array(x.astype(np.int32)) for x in (unit, at, size)), pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "unit", "at", "n_words", "id", "keys"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, unit int, at int, n_words int, id long, keys array<long>")


def unit_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """A stored table (sid, n, sketch, items) of the chosen units (row, unit, at, pid) of more than SHINGLE words; items are the shingles."""
    wanted = stored(chosen.groupBy(F.col("row").alias("w_row")).agg(F.collect_list(F.struct("unit", "at", "pid")).alias("parts")))
    texts = docs.join(sized_broadcast(wanted, 200_000), F.col("row") == F.col("w_row")).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, MARK_CHARS):
            found = {}
            for t, asked in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                have = {(u, at): words for u, at, words in units(t)}
                for p in asked:
                    found[p["pid"]] = (p["unit"], have[p["unit"], p["at"]])
            if not found:
                continue
            items, sizes = shingled([w for _, w in found.values()], np.array([u for u, _ in found.values()], np.uint64))
            ends = np.cumsum(sizes)
            sets = [items[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(sizes), pa.array(sketches(items, sizes, SPREAD), pa.binary()), pa.array(sets, pa.binary())], ["sid", "n", "sketch", "items"])

    out = stored(texts.mapInArrow(run, "sid long, n long, sketch binary, items binary"))
    discard(wanted)
    return out


def meeting_sets(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (h, gid, n, place) of the units that share a band key h, and their unit_sets; from stored docs and their text_marks."""
    rows = marks.select(F.explode("keys").alias("h"), F.col("id").alias("gid"))
    shared = stored(rows.groupBy("h").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).filter("low < high").select(F.col("h").alias("s_h")))
    release(docs.sparkSession)
    alive = stored(rows.join(sized_broadcast(shared), F.col("h") == F.col("s_h"), "left_semi").distinct())
    meeting = stored(alive.select(F.col("gid").alias("m_gid")).distinct())
    rep = F.min(F.struct("row", "unit", "at")).alias("rep")
    reps = marks.filter(F.col("unit") < ANCHORS).join(sized_broadcast(meeting), F.col("id") == F.col("m_gid")).groupBy(F.col("id").alias("pid")).agg(rep)
    sets = unit_sets(docs, reps.select("rep.row", "rep.unit", "rep.at", "pid"))
    met = stored(alive.join(sized_broadcast(sets.select("sid", "n"), LOCAL_ROWS), F.col("gid") == F.col("sid")).select("h", "gid", "n", F.lit(0).alias("place")))
    discard(shared, alive, meeting)
    return met, sets


def clusters(met: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component): pid and cluster of the units of meeting_sets that link to another one; both tables are deleted."""

    def fetch(ids: DataFrame) -> DataFrame:
        return sets.join(sized_broadcast(ids, LOCAL_ROWS), F.col("sid") == F.col("id"), "left_semi").select(F.col("sid").alias("id"), "items")

    out = link_components(met, sets.withColumn("gid", F.col("sid")), fetch, percent, random_pairs=1, single=True)  # a unit is in BANDS buckets
    discard(sets)
    return out


def unit_table(marks: DataFrame) -> DataFrame:
    """A stored table (doc_id, unit, at, n_words, pid) of the units of text_marks."""
    return stored(marks.filter(F.col("unit") < ANCHORS).select("doc_id", "unit", "at", "n_words", F.col("id").alias("pid")))


def paragraph_rows(table: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of repeated_paragraphs, of the unit_table and its clusters."""
    rows = table.join(sized_broadcast(found), F.col("pid") == F.col("node"), "left")
    rows = rows.select("doc_id", "unit", "at", "n_words", F.coalesce("component", "pid").alias("cluster"))
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    sizes = stored(rows.groupBy("cluster").agg(F.count("*").alias("copies"), F.min(here).alias("first")).filter("copies > 1").withColumnRenamed("cluster", "s_cluster"))
    out = rows.join(sized_broadcast(sizes), F.col("cluster") == F.col("s_cluster"))
    return out.select(
        "doc_id", F.element_at(F.array(*map(F.lit, UNITS)), F.col("unit") + 1).alias("unit"), F.col("at").cast("long").alias("paragraph"), F.col("n_words").cast("long").alias("n_words"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").cast("long").alias("first_paragraph"), F.col("copies").cast("long").alias("copies"), (here != F.col("first")).alias("removed"),
    )


def located(docs: DataFrame) -> DataFrame:
    """A stored copy of docs as (row, doc_id, text)."""
    return numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, unit, paragraph, n_words, first_doc_id, first_paragraph, copies, removed) of every line and block that repeats.

    paragraph counts the lines of the text from 0; copies is the number of units in the cluster.
    """
    d = located(docs)
    marks = stored(text_marks(d))
    met, sets = meeting_sets(d, marks)
    table = unit_table(marks)
    discard(d, marks)
    return paragraph_rows(table, clusters(met, sets, percent))


def passage_words(text: bytes, lines: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text, ASCII letters lower-cased; line breaks are gaps like any other. lines: those of the words of its lines."""
    if not text.isascii() and _ANY_UNSPACED.search(whole := text.decode()):
        return word_hashes([w.encode().lower() for w in _WORDS.findall(whole)])
    return lines


def anchor_windows(h: np.ndarray, words: int) -> np.ndarray:
    """The value of each window of half a passage; those that are least among the windows of a passage are its anchor."""
    return mixed(windows(h, min(ANCHOR, words)))


def anchors(values: np.ndarray, words: int) -> np.ndarray:
    """The anchor of each window of `words` words of a text; equal passages have the same one."""
    n, size = words - min(ANCHOR, words) + 1, 1
    if len(values) < n:
        return values[:0]
    while size < n:  # least of `size` values, from those of fewer
        step = min(size, n - size)
        values, size = np.minimum(values[:-step], values[step:]), size + step
    return values


def segments(anchor: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of windows of one wanted anchor, cut every SEGMENT windows."""
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    end = np.append(edge[1:], len(anchor))[: len(edge)]
    keep = np.isin(anchor[edge], wanted)
    edge, end = edge[keep], end[keep]
    pieces = -(-(end - edge) // SEGMENT)
    start = np.repeat(edge, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start, np.minimum(start + SEGMENT, np.repeat(end, pieces))


def passage_segments(docs: DataFrame, marks: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(row, doc_id, at, seg, windows) of the segments of an anchor that occurs twice, from stored docs (row, doc_id, text) and their text_marks.

    windows holds the hashes of the segment's windows of `words` words, at least in one of its rows. Windows that
    occur once only are among them; none that occurs twice is missing.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            owner, places, keys, lists, sizes, seen = [], [], [], [], [], set()
            for k, (t, wanted) in enumerate(zip(utf8(b.column(2)), b.column(3).to_pylist(), strict=True)):
                h = passage_words(t, word_hashes(t.lower().translate(_BREAKS).split()))
                start, end = segments(anchors(anchor_windows(h, words), words), np.array(wanted, np.int64).view(np.uint64))
                whole = windows(h, words).view(np.int64)
                for x, y in zip(start.tolist(), end.tolist(), strict=True):
                    keys.append(key := xxhash.xxh3_64_intdigest(whole[x:y]) - (1 << 63))
                    sizes.append(0 if key in seen else y - x)
                    if key not in seen:
                        seen.add(key)
                        lists.append(whole[x:y])
                places.append(start)
                owner.extend([k] * len(start))
            at, sizes = pa.array(owner, pa.int64()), np.array(sizes, np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *lists])), mask=pa.array(sizes == 0))
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(places), pa.int64()), pa.array(keys, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "at", "seg", "windows"])

    chosen = marks.filter(F.col("unit") == ANCHORS).select("row", F.col("id").alias("anchor"), F.col("n_words").alias("times"))
    shared = stored(chosen.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select(F.col("anchor").alias("s_anchor")))
    wanted = stored(chosen.join(sized_broadcast(shared), F.col("anchor") == F.col("s_anchor")).groupBy(F.col("row").alias("w_row")).agg(F.collect_list("anchor").alias("wanted")))
    discard(shared)
    texts = docs.join(sized_broadcast(wanted), F.col("row") == F.col("w_row")).select("row", "doc_id", "text", "wanted")
    out = stored(texts.mapInArrow(cut, "row long, doc_id long, at long, seg long, windows array<long>"))
    discard(wanted)
    return out


def bit_runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the mask, first bit, bits) of the runs of set bits of 64-bit masks."""
    bits = np.unpackbits(np.ascontiguousarray(masks, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    edge = np.diff(bits, axis=1, prepend=np.int8(0), append=np.int8(0))
    of, start = np.nonzero(edge == 1)
    return of, start, np.nonzero(edge == -1)[1] - start


def mask_runs(masks: DataFrame) -> DataFrame:
    """(r_seg, removed, k, n): the runs of the windows of each segment, given as masks (seg, repeated, removed), as a whole (removed is null) and by removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            repeated, gone = (b.column(c).to_numpy() for c in (1, 2))
            for kind, mask in ((None, repeated), (True, gone), (False, repeated & ~gone)):
                of, start, n = bit_runs(mask)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array([kind] * len(of), pa.bool_()), pa.array(start.astype(np.int32)), pa.array(n)], ["r_seg", "removed", "k", "n"])

    return masks.select("seg", "repeated", "removed").mapInArrow(run, "r_seg long, removed boolean, k int, n long")


def repeated_passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(doc_id, first_word, n_words, removed) of the maximal runs of words whose windows of `words` words all occur twice or more.

    Of each window the occurrence first by (doc_id, place) stays, the others are removed; words
    count from 0 over the whole text. Equal segments are one before their windows are compared, so rows and shuffles
    grow with the segments of the repeated text, not with its words or pairs.
    """
    d = located(docs)
    marks = stored(text_marks(d, False, words))
    found = passage_segments(d, marks, words)
    discard(d, marks)
    return passage_rows(found, words)


def passage_rows(found: DataFrame, words: int) -> DataFrame:
    """Rows of repeated_passages, of its stored passage_segments."""
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "row")
    parts = stored(found.groupBy("seg").agg(F.count("*").alias("times"), F.min(here).alias("rep"), F.first("windows", ignorenulls=True).alias("windows")))
    release(found.sparkSession)
    each = parts.select("seg", "times", "rep", F.posexplode("windows").alias("k", "window"))
    each = each.select("seg", "k", "window", "times", F.struct("rep.none", "rep.doc_id", (F.col("rep.at") + F.col("k")).alias("at"), "rep.row").alias("here"))
    sizes = stored(each.groupBy(F.col("window").alias("s_window")).agg(F.sum("times").alias("copies"), F.min("here").alias("first")).filter("copies > 1"))
    release(found.sparkSession)
    met = each.join(sized_broadcast(sizes), F.col("window") == F.col("s_window")).select("seg", F.expr("shiftleft(1L, k)").alias("bit"), (F.col("here") != F.col("first")).alias("removed"))
    masks = met.groupBy("seg").agg(F.bit_or("bit").alias("repeated"), F.bit_or(F.when(F.col("removed"), F.col("bit")).otherwise(0)).alias("removed"))
    islands = stored(mask_runs(masks))
    discard(sizes)
    release(found.sparkSession)
    any_run, own_runs = islands.filter("removed IS NULL").drop("removed"), islands.filter("removed IS NOT NULL")
    reps = parts.select("seg", F.col("rep.row").alias("row"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.at").alias("at"))
    others = found.select("seg", "row", "doc_id", "at").join(sized_broadcast(any_run, LOCAL_ROWS), F.col("seg") == F.col("r_seg"))
    others = others.join(sized_broadcast(stored(reps.select(F.col("row").alias("f_row"), F.col("at").alias("f_at"))), LOCAL_ROWS), (F.col("row") == F.col("f_row")) & (F.col("at") == F.col("f_at")), "left_anti")
    firsts = reps.join(sized_broadcast(own_runs, LOCAL_ROWS), F.col("seg") == F.col("r_seg"))
    start = (F.col("at") + F.col("k")).alias("start")
    runs = others.select("row", "doc_id", F.lit(True).alias("removed"), start, "n").unionByName(firsts.select("row", "doc_id", "removed", start, "n"))
    order = Window.partitionBy("row", "removed").orderBy("start")
    fresh = F.coalesce(F.lag(F.col("start") + F.col("n")).over(order) != F.col("start"), F.lit(True)).cast("long")
    runs = runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    runs = runs.groupBy("row", "doc_id", "removed", "run").agg(F.min("start").alias("first_word"), F.sum("n").alias("windows"))
    return runs.select("doc_id", "first_word", (F.col("windows") + words - 1).alias("n_words"), "removed")


def repeats(docs: DataFrame, percent: int = PERCENT, words: int = PASSAGE) -> DataFrame:
    """Rows of repeated_paragraphs and of repeated_passages; for these, unit is passage and paragraph the place of the first word."""
    d = located(docs)
    marks = stored(text_marks(d, passage=words))
    segs = passage_segments(d, marks, words)
    met, sets = meeting_sets(d, marks)
    table = unit_table(marks)
    discard(d, marks)
    release(docs.sparkSession)
    found = clusters(met, sets, percent)
    release(docs.sparkSession)
    inner = passage_rows(segs, words)
    none = F.lit(None).cast("long")
    inner = inner.select("doc_id", F.lit("passage").alias("unit"), F.col("first_word").alias("paragraph"), "n_words", none.alias("first_doc_id"), none.alias("first_paragraph"), none.alias("copies"), "removed")
    return paragraph_rows(table, found).unionByName(inner)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, t.line, t.place - 1 AS place FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, place)),
w AS (SELECT r, doc_id, place, regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM lines),
full_ AS (SELECT * FROM w WHERE len(w) > 0),
island AS (SELECT *, place - row_number() OVER (PARTITION BY r ORDER BY place) AS k FROM full_),
p AS (SELECT doc_id, 'line' AS unit, place, len(w) AS n_words, w, array_to_string(w, ' ') AS t FROM full_
  UNION ALL SELECT doc_id, 'block', min(place), sum(len(w))::BIGINT, flatten(list(w ORDER BY place)) AS ws, array_to_string(ws, ' ') FROM island GROUP BY r, doc_id, k),
u AS (SELECT DISTINCT unit, t, w FROM p),
pid AS (SELECT unit, t, w, row_number() OVER (ORDER BY unit, t) AS k FROM u),
sh AS (SELECT DISTINCT k, unit, unnest(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM pid),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
shared AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.unit = y.unit AND x.k <> y.k GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT k, k FROM pid UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
cl AS (SELECT a AS k, min(b) AS cluster FROM reach GROUP BY a),
occ AS (SELECT doc_id, p.unit, place, n_words, cluster FROM p JOIN pid ON p.unit = pid.unit AND p.t = pid.t JOIN cl USING (k)),
sizes AS (SELECT cluster, count(*) AS copies, min(doc_id) AS first_doc_id FROM occ GROUP BY cluster HAVING count(*) > 1),
firsts AS (SELECT sizes.cluster, copies, first_doc_id, min(place) AS first_at FROM sizes JOIN occ ON occ.cluster = sizes.cluster AND occ.doc_id = first_doc_id GROUP BY ALL),
pw AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'PATTERN') AS w FROM d),
win AS (SELECT r, doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM pw)),
marked AS (SELECT r, doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos, r) > 1 AS removed, count(*) OVER (PARTITION BY k) AS c FROM win),
runs AS (SELECT r, doc_id, pos, removed, pos - row_number() OVER (PARTITION BY r, removed ORDER BY pos) AS run FROM marked WHERE c > 1)
SELECT doc_id, unit, place AS paragraph, n_words, first_doc_id, first_at AS first_paragraph, copies, doc_id <> first_doc_id OR place <> first_at AS removed FROM occ JOIN firsts USING (cluster)
UNION ALL SELECT doc_id, 'passage', min(pos), count(*) + 49, NULL, NULL, NULL, removed FROM runs GROUP BY r, doc_id, removed, run
""".replace("PATTERN", f"[{_UNSPACED}]|[^\\x00-/:-@\\[-`{{-\\x7f{_UNSPACED}]+")
