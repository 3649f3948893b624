"""Benchmark decontamination by greedy string tiling.

Texts are word sequences, lower-cased, without ASCII punctuation; a character of an unspaced script is a
word. Windows of MIN_MATCH words that a document shares with a benchmark item are the seeds (Karp-Rabin hashes
against the seed table of a bounded block of items). Equal windows are counted, never paired. For each document
and item whose seeds can cover enough, the longest match that overlaps no marked word is
marked, again and again, until none of MIN_MATCH words is left: a bisection with rolling hashes
of growing windows finds the longest length, and one pass marks its matches. The share of the
item's words that are marked decides: order does not matter, so passages with their parts moved are caught.

Defined cases: null and empty texts match nothing; an item of fewer than MIN_MATCH words is matched only whole, as one
tile; one without words is never matched; of equally long matches the first in the text is marked, then the first in
the item; a very long text, or one word repeated, costs its length times a logarithm for each length of a tile; repeated rows
of documents or items are matched alike; null ids stay null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MIN_MATCH = 5
COVERAGE_PERCENT = 60
#: Characters of benchmark text that one pass over the documents holds on every executor.
BLOCK_CHARS = 16_000_000
#: ASCII characters other than letters and digits end a word.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Thai to Lao, Burmese, Khmer, kana and Han: scripts without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words."""
    if text and not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    found = text.lower().encode().translate(_BREAKS).split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of the k-word windows."""
    if len(h) < k:
        return h[:0]
    out, size = h, 1  # windows of `size` words
    for bit in bin(k)[3:]:
        out, size = out[:-size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + out[size:], 2 * size
        if bit == "1":
            out, size = out[:-1] * _BASE + h[size:], size + 1
    return out ^ (out >> np.uint64(29))


class Rolling:
    """Karp-Rabin hashes of all windows of any length of a sequence, each in one vector operation."""

    def __init__(self, h: np.ndarray):
        n, self.h = len(h), h
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE), dtype=np.uint64)])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.power[:n], dtype=np.uint64)])
        self.used = np.zeros(n, bool)

    def free(self, length: int) -> np.ndarray:
        """Starts of the windows without a marked word."""
        taken = np.concatenate([[0], np.cumsum(self.used)])
        return np.flatnonzero(taken[length:] == taken[: len(taken) - length])

    def at(self, starts: np.ndarray, length: int, longest: int) -> np.ndarray:
        """Hashes of the windows at the starts, all brought to the same power; odd factors lose nothing modulo 2^64."""
        return (self.sums[starts + length] - self.sums[starts]) * self.power_to(longest - starts)

    def power_to(self, n: np.ndarray) -> np.ndarray:
        if len(self.power) <= n.max(initial=0):
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(n.max()), _BASE), dtype=np.uint64)])
        return self.power[n]


def tiles(text: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (length, text place, item place) of each tile, the longest first, then by text place and item place."""
    if not len(text) or not len(item):
        return []
    a, b = Rolling(text), Rolling(item)
    far = max(len(text), len(item))
    out: list[tuple[int, int, int]] = []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        x, y = a.free(length), b.free(length)
        if not len(x) or not len(y):
            return None
        u, v = a.at(x, length, far), b.at(y, length, far)
        x, u = x[hit := np.isin(u, v)], u[hit]
        return (x, u, y, v) if len(x) else None

    top = min(len(text), len(item))
    while top >= k:
        low, high, found = k - 1, top, None
        while low < high:  # the longest length that has a match: whatever is shared has shorter parts that are
            middle = (low + high + 1) // 2
            if now := common(middle):
                low, found = middle, (middle, now)
            else:
                high = middle - 1
        if found is None:
            break
        length, (x, u, y, v) = found
        places: dict[int, list[int]] = {}
        for j, value in zip(y.tolist(), v.tolist(), strict=True):
            places.setdefault(value, []).append(j)
        last = -length
        for i, value in zip(x.tolist(), u.tolist(), strict=True):
            if i < last + length:
                continue
            left = places[value]
            while left and (b.used[left[0] : left[0] + length].any() or not np.array_equal(text[i : i + length], item[left[0] : left[0] + length])):
                left.pop(0)
            if left:
                j = left.pop(0)
                a.used[i : i + length] = b.used[j : j + length] = True
                out.append((length, i, j))
                last = i
        top = length - 1
    return out


class Seeds:
    """The seed table of a block of items: each different window of an item once, with the number of its places."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.ids, self.items = k, [i for i, _ in items], [tokens(t) for _, t in items]
        table = [np.unique(windows(h, k), return_counts=True) for h in self.items]
        keys = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in table)])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.repeat(np.arange(len(table)), [len(w) for w, _ in table])[order]
        self.times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in table)])[order]
        self.size = np.array([len(h) for h in self.items], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        #: Items of fewer words than a seed, by their number of words: the hash of each and its place.
        self.short: dict[int, dict[int, list[int]]] = {}
        for at, h in enumerate(self.items):
            if 0 < len(h) < k:
                self.short.setdefault(len(h), {}).setdefault(int(windows(h, len(h))[0]), []).append(at)

    def whole(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """The short items that stand whole in a text of words h."""
        found = [(n, at) for n, items in self.short.items() for value in np.intersect1d(windows(h, n), np.array(list(items), np.uint64)).tolist() for at in items[value]]
        return [(self.ids[at], 1.0, 1, n) for n, at in sorted(found, key=lambda f: f[1])]

    def matches(self, text: str | None, percent: int) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, words matched) of the items that a text covers enough."""
        h = tokens(text)
        w = windows(h, self.k)
        near = np.flatnonzero(self.filter[w >> np.uint64(64 - _FILTER_BITS)])
        values = np.unique(w[near])
        lo, hi = np.searchsorted(self.keys, values), np.searchsorted(self.keys, values, side="right")
        lo, n = lo[hi > lo], (hi - lo)[hi > lo]
        out = self.whole(h) if self.short else []
        if not len(lo):
            return out
        met = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # rows of the table that the text has
        used, at = np.unique(self.item[met], return_inverse=True)
        most = np.minimum(np.bincount(at, self.times[met]) * self.k, self.size[used])
        for item in used[100 * most >= percent * self.size[used]].tolist():
            here = near[np.isin(w[near], self.keys[met[self.item[met] == item]])]
            inside = np.zeros(len(h) + 1, np.int64)
            np.add.at(inside, here, 1)
            np.add.at(inside, here + self.k, -1)
            inside = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            part = h[inside]
            gaps = np.flatnonzero(np.diff(inside) > 1) + 1  # words that no seed covers become one word that no item has
            found = tiles(np.insert(part, gaps, np.uint64(0)), self.items[item], self.k)
            words = sum(length for length, _, _ in found)
            if 100 * words >= percent * self.size[item]:
                out.append((self.ids[item], round(words / int(self.size[item]), 6), len(found), words))
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, percent: int = COVERAGE_PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, words) of documents (doc_id, text) that cover an item (item_id, text).

    A benchmark within `block_chars` is one block; a larger one is dealt by hash into blocks,
    each of which meets all documents in a pass of its own.
    """
    sc, out = docs.sparkSession.sparkContext, None
    for block in blocks_of(benchmark, block_chars):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Seeds(sent.value, k)
            for b in small_batches(batches):
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in table.matches(t, percent)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "coverage", "tiles", "words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, coverage double, tiles long, words long")
        out = found if out is None else out.union(found)
    return out


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_chars` characters, one after the other: the driver holds one at a time."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for k in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").filter("text IS NOT NULL")
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def clean(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, percent: int = COVERAGE_PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents that cover a benchmark item; all columns stay and nothing is shuffled."""
    sc = docs.sparkSession.sparkContext
    for block in blocks_of(benchmark, block_chars):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Seeds(sent.value, k)
            for b in small_batches(batches):
                yield b.filter(pa.array([not table.matches(t, percent) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
