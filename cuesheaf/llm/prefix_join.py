"""N-gram Jaccard join: documents whose sets of word n-grams are similar, as components.

A grouped prefix join (after Bouros, Ge and Mamoulis 2012):
1. n-grams have one order for all sets: those that many texts hold last (gram_levels counts them over
   all documents, in a table of fixed size), then the longest first. Any fixed order keeps the join exact;
2. documents with the same set are one set (sid), and sets of the same size and prefix, the first n - ceil(t n) + 1
   n-grams, are one group (gid). Two sets that link share an n-gram of their prefixes, so n-grams in the
   prefix of one group only find no partner and go;
3. groups that share a prefix n-gram meet in its bucket, where sizes and places filter group pairs; the
   rest are expanded to members, filtered by parity sketches and verified on their whole sets, pair by pair
   (set_links.py); sets of one group meet in a bucket of their own;
4. components of the links are the result.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and keep their
own doc_id; a text of fewer words than n has one n-gram; a very long text has a long set and a sketch of at most
MOST_BITS; rows of one doc_id with different texts are separate documents, linked only by their own sets; a null
doc_id links like any other, and counts as the largest one; ties cannot occur, as a component has one smallest id;
repeated rows stay, each with the same answer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shingles, sized_broadcast, small_batches, stored, utf8, word_hashes
from .set_links import BUCKET_ROWS, link_components, sketch

NGRAM = 3
PERCENT = 90
#: Slots of the table that tells frequent n-grams from others, and its parts, which tasks send apart.
SLOT_BITS, PARTS = 20, 16


def gram_hashes(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length in bytes of each word n-gram, A-Z lower-cased."""
    words = text.lower().split()
    h = shingles(word_hashes(words), k)
    size = np.cumsum([0, *map(len, words)])
    return h, size[min(k, len(words)) :] - size[: len(h)]


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def ngram_set(text: bytes, k: int = NGRAM, levels: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct keys of the word n-grams: level of frequency, then the longest first, then a hash of 51 bits."""
    h, wide = gram_hashes(text, k)
    key = h >> np.uint64(13) | (np.uint64(127) - np.minimum(wide, 127).astype(np.uint64) << np.uint64(51))
    if levels is not None:
        key |= levels[slots(h)].astype(np.uint64) << np.uint64(58)
    return np.unique(key)


def set_id(items: np.ndarray, seed: int | None = None) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes(), seed=len(items) if seed is None else seed) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def gram_levels(docs: DataFrame, k: int = NGRAM) -> np.ndarray:
    """Binary digits of the number of documents' n-grams in each slot, from all documents; 1 MB at any size."""
    size = (1 << SLOT_BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in small_batches(batches):
            found = [np.unique(gram_hashes(t, k)[0]) for t in utf8(b.column(0))]
            if found:
                total += np.bincount(slots(np.concatenate(found)), minlength=1 << SLOT_BITS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(total[p * size : (p + 1) * size].astype(np.uint32).tobytes(), 1) for p in range(PARTS)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                part = b.column(0)[k].as_py()
                total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(b.column(1)[k].as_py()), np.uint32).astype(np.int64)
        for part, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.frexp(counts.astype(np.float64))[1].astype(np.uint8).tobytes()], pa.binary())], ["part", "counts"])

    rows = docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary").collect()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in rows:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], np.uint8)
    return np.minimum(out, 63)


def version_of(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, levels, k: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n, sid, gid, prefix, sketch) of each row of docs (doc_id, text); version is a hash of the text, levels a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [ngram_set(t, k, levels.value) for t in utf8(b.column(2))]
            prefix = [s[: prefix_length(len(s), percent)] if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, prefix)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_id, sets), pa.int64()),
                 pa.array([set_id(p, len(s)) for p, s in zip(prefix, sets, strict=True)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64))),
                 pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary())],
                ["doc_id", "version", "n", "sid", "gid", "prefix", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version_of(F.col("text")).alias("version"), "text")
    return rows.mapInArrow(run, "doc_id long, version long, n long, sid long, gid long, prefix array<long>, sketch binary")


def set_components(docs: DataFrame, sig: DataFrame, levels, k: int = NGRAM, percent: int = PERCENT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(sid, first) of each set of the stored sig: first is (none, doc_id, version, sid) of its component's smallest doc_id."""
    some = sig.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("rep")
    sets = stored(some.groupBy("sid").agg(first, F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("sketch").alias("sketch")))
    groups = some.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = groups.select(F.posexplode("prefix").alias("place", "h"), "gid", "n")
    rows = stored(rows)
    shared = rows.groupBy("h").agg(F.count("*").alias("members")).filter("members > 1").select(F.col("h").alias("s_h"))
    alive = stored(rows.join(shared, F.col("h") == F.col("s_h"), "left_semi"))
    discard(rows)

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = sets.join(sized_broadcast(ids), F.col("sid") == F.col("id")).select("id", F.xxhash64("rep.doc_id", "rep.version").alias("w_key"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches):
                items = [ngram_set(t, k, levels.value) for t in utf8(b.column(1))]
                same = [set_id(s) == i for s, i in zip(items, b.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in items], pa.binary())], ["id", "items"]).filter(pa.array(same, pa.bool_()))

        here = docs.select(F.xxhash64(F.col("doc_id").cast("long"), version_of(F.col("text"))).alias("key"), "text")
        texts = here.join(sized_broadcast(stored(wanted)), F.col("key") == F.col("w_key")).select("id", "text")  # run checks the set itself
        return texts.mapInArrow(run, "id long, items binary")

    linked = link_components(alive, sets, fetch, percent, bucket_rows)
    whole = sets.select("sid", "rep").join(sized_broadcast(linked), F.col("sid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "sid"))
    lowest = whole.groupBy("component").agg(F.min(F.struct("rep.none", "rep.doc_id", "rep.version", "sid")).alias("first"))
    return whole.select("sid", "component").join(lowest, "component").select("sid", "first")


def prepared(docs: DataFrame, k: int, percent: int) -> tuple:
    """Broadcast levels and stored signatures of docs."""
    levels = docs.sparkSession.sparkContext.broadcast(gram_levels(docs, k))
    return levels, stored(signatures(docs, levels, k, percent))


def join_components(docs: DataFrame, k: int = NGRAM, percent: int = PERCENT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    levels, sig = prepared(docs, k, percent)
    found = set_components(docs, sig, levels, k, percent, bucket_rows)
    return sig.select("doc_id", "n", "sid").join(found, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = NGRAM, percent: int = PERCENT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of docs, of each component one: that of the smallest doc_id; all columns stay.

    Wordless documents all stay; of rows that repeat doc_id and text one stays.
    """
    levels, sig = prepared(docs, k, percent)
    found = sig.select("doc_id", "version", "n", "sid").join(set_components(docs, sig, levels, k, percent, bucket_rows), "sid", "left")
    out = found.filter((F.col("n") > 0) & ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))))
    again = sig.groupBy("doc_id", "version").count().filter("count > 1")
    key = [F.col("doc_id").alias("__doc_id"), F.col("version").alias("__version")]
    out, again = stored(out.select(*key).distinct()), stored(again.select(*key))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__doc_id")) & (version_of(docs["text"]) == F.col("__version"))
    kept = docs.join(sized_broadcast(out), same, "left_anti")
    if again.limit(1).count():
        twice = kept.join(sized_broadcast(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(sized_broadcast(again), same, "left_anti").unionByName(twice)
    return kept


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, n.n::BIGINT AS n_shingles, min(b) AS component_id FROM reach JOIN n ON a = n.doc_id GROUP BY a, n.n
"""
