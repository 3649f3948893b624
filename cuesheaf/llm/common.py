"""Shared helpers of the training-data operators: tables in the shared folder,
Arrow batches of words, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, release, stored

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
#: Rows of a side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A stored copy of df with a number of its own for each row."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcasting if it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def n_words(text) -> F.Column:
    """Words of a text; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.size(F.filter(parts, lambda x: x != "")).cast("long")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):
    _LIBC.mallopt(-3, 1 << 20)  # arrays of over 1 MB are mapped, so they leave the process when they are freed


def give_back() -> None:
    """Return unused memory to the system: a worker process goes on to other tasks, others wait beside it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `chars` bytes of its text column; one long text may exceed it."""
    for b in batches:
        sizes = np.zeros(b.num_rows, np.int64)
        for k in range(b.num_columns):
            if pa.types.is_string(b.column(k).type) or pa.types.is_large_string(b.column(k).type):
                sizes += np.array([x or 0 for x in pc.binary_length(b.column(k)).to_pylist()], np.int64)
        start, total = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if total and total + s > chars:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += s
        if start < b.num_rows:
            yield b.slice(start)
    give_back()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def trigram_slots(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the 3-byte n-grams of all words with < and > at their ends, one word after the other, and how many each word has."""
    whole = [w or b">" for w in words]
    c = np.frombuffer(b"<" + b"><".join(whole) + b">", np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    inside = np.ones(len(h) + 2, bool)
    ends = np.cumsum(size + 2)
    inside[ends - 1] = inside[ends - 2] = False
    return (h >> np.uint32(32 - bits))[inside[: len(h)]].astype(np.int64), size


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-word window of word hashes; fewer words give one window of them all, no word none."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * _ODD[j]
    return mixed(out + np.uint64(k))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins; nothing is
    collected. Each round is a stored table. Loops are ignored; an empty table gives no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        last, now = now, stored(small)
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = state
    raise RuntimeError("connected components did not settle")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of equal leading `keys` columns, from batches sorted by these; each run as a list of columns."""
    held: list[list] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_pylist() for c in b.columns]
        cols = [x + y for x, y in zip(held, cols, strict=True)] if held else cols
        start = 0
        for i in range(1, len(cols[0])):
            if any(cols[k][i] != cols[k][i - 1] for k in range(keys)):
                yield [c[start:i] for c in cols]
                start = i
        held = [c[start:] for c in cols]
    if held:
        yield held


def in_fold(doc_id, folds: int, fold: int) -> F.Column:
    """Whether crc32 of doc_id as text, modulo `folds`, is `fold`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


#: Rows that a training sample holds in all, however many labels there are, and bytes of a text in it.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 1_000_000


def labelled_sample(docs: DataFrame, known: DataFrame, per_class: int, most_rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, object]], dict]:
    """At most `per_class` (text, label) of each label, by hash of doc_id, and the count of every label.

    known: (doc_id, label). The ids are picked among the labels alone, so only the sample's texts move. The sample
    is bounded: with more than `most_rows` / `per_class` labels each gives fewer rows, of more than `most_rows` labels the
    most frequent ones teach, and a text of over `most_bytes` bytes teaches nothing.
    """
    often = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_rows).collect()
    counts = {r["label"]: r["count"] for r in often}
    per_class = max(1, min(per_class, most_rows // max(1, len(often))))
    keyed = known.select(F.col("doc_id").alias("k_doc_id"), "label", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key"))
    if len(often) == most_rows:
        keyed = keyed.filter(F.col("label").isin(list(counts)))
    keyed = keyed.withColumn("part", F.substring("key", -2, 2))
    for parts in (["label", "part"], ["label"]):  # a label of a third of all rows is first cut in 256 parts
        order = Window.partitionBy(*parts).orderBy("key", "k_doc_id")
        keyed = keyed.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_class).drop("at")
    ids = keyed.select("k_doc_id", "label")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("k_doc_id")).select("doc_id", "label", "text").collect()  # ids: at most most_rows
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], str(r["label"]), r["text"]))], counts
