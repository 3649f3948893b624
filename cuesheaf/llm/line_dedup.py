"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of under LEAST code points never count. The index
holds for every key how many documents refer to it and the first and the last of these (references), which documents those are
(postings), and a cuckoo filter of the keys of each shard. A batch's keys meet the filter of their shard first: a key that the
filter does not know is new and is appended without any look at the references; only keys that it may know are joined
with them. Deleting documents takes their postings away, counts the touched keys anew and takes keys without a reference out
of the filters, so an index after insert and delete equals one that never saw the documents.

A key is inserted in its filter once, when its first reference comes (false positives as well, after the exact join), and removed
once, so a removal never takes another key's entry away. A filter that has become too small is built anew from the exact keys of its
shard; one that cannot seat a key counts every key as known, and the exact join decides.

Defined cases: a null text is one empty line; a null doc_id is a document that comes last (as the largest long); rows of one doc_id are one
document; a line that repeats inside its first document stays; texts of any length are split whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, sized_broadcast, small_batches, stored, utf8

LEAST = 10
SHARDS, KEYS_A_SHARD = 1024, 1_000_000
SEATS, LOAD, ROUNDS = 4, 0.8, 500
LAST = 2**63 - 1
KEY = ("shard", "hi", "lo")


def line_key(line: bytes) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    k = line.strip(b" \t\n\x0b\f\r").lower()
    return k if len(k) >= 4 * LEAST or (len(k) >= LEAST and len(k.decode()) >= LEAST) else None


class CuckooFilter:
    """2 ** bits buckets of SEATS 16-bit fingerprints, 0 where free; arrays of keys are handled at once.

    A key's second bucket comes from its first one and its fingerprint, so a fingerprint can move without its key.
    """

    def __init__(self, bits: int, seats: bytes | None = None):
        self.mask = np.int64(2**bits - 1)
        self.full = seats == b""
        self.seats = np.zeros((2**bits, SEATS), np.uint16) if not seats else np.frombuffer(seats, np.uint16).reshape(-1, SEATS).copy()
        self.random = np.random.default_rng(0)

    def to_bytes(self) -> bytes:
        return b"" if self.full else self.seats.tobytes()

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mixed(mark.astype(np.uint64)).astype(np.int64) & self.mask)

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (mixed(lo.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        return np.maximum(mark, np.uint16(1)), mixed(hi.view(np.uint64)).astype(np.int64) & self.mask

    def knows(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(hi), bool)
        mark, at = self._places(hi, lo)
        return (self.seats[at] == mark[:, None]).any(1) | (self.seats[self._other(at, mark)] == mark[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Seat each key once: in its first bucket, else its second one, else in place of another that moves to its own other bucket."""
        mark, at = self._places(hi, lo)
        for turn in range(ROUNDS):
            if self.full or not len(mark):
                return
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            first = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            taken = self.seats[at] != 0
            fits = rank < SEATS - taken.sum(1)
            seat = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.seats[at[fits], seat] = mark[fits]
            mark, at, first = mark[~fits], at[~fits], first[~fits]
            if turn:
                here, seat = at[first], self.random.integers(0, SEATS, int(first.sum()))
                mark[first], self.seats[here, seat] = self.seats[here, seat], mark[first]
            at = self._other(at, mark)
        self.full = len(mark) > 0

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Free one seat of each key; the keys must have been inserted."""
        if self.full:
            return
        mark, at = self._places(hi, lo)
        tried = np.zeros(len(mark), bool)
        while len(mark):
            _, now = np.unique(at, return_index=True)  # one key a bucket and round
            equal = self.seats[at[now]] == mark[now][:, None]
            hit = equal.any(1)
            self.seats[at[now[hit]], equal[hit].argmax(1)] = 0
            missed = now[~hit]
            again = missed[~tried[missed]]
            at[again], tried[again] = self._other(at[again], mark[again]), True
            left = np.ones(len(mark), bool)
            left[now[hit]] = left[np.setdiff1d(missed, again)] = False
            mark, at, tried = mark[left], at[left], tried[left]


@dataclass
class LineIndex:
    """postings (shard, hi, lo, doc), references (shard, hi, lo, refs, first, last) and filters (shard, bits, seats), all stored."""

    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int


_POSTING = "shard int, hi long, lo long, doc long"
_REFERENCE = "shard int, hi long, lo long, refs long, first long, last long"
_FILTER = "shard int, bits int, seats binary"


def empty_index(spark, shards: int = SHARDS) -> LineIndex:
    return LineIndex(*(spark.createDataFrame([], s) for s in (_POSTING, _REFERENCE, _FILTER)), shards)


def shards_for(docs: DataFrame, least: int = SHARDS, keys_a_shard: int = KEYS_A_SHARD) -> int:
    """Shards of an index that is to hold about the lines of docs."""
    lines = docs.select(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1)).first()[0]
    return max(least, (lines or 0) // keys_a_shard)


def _ranked(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def line_keys(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, hi, lo, doc): 128-bit hashes of the distinct keys of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [{xxhash.xxh3_128_digest(k) for line in t.split(b"\n") if (k := line_key(line)) is not None} for t in utf8(b.column(1))]
            h = np.frombuffer(b"".join(k for f in found for k in sorted(f)), ">i8").astype(np.int64).reshape(-1, 2)
            doc = np.repeat(b.column(0).to_numpy(), [len(f) for f in found])
            for i in range(0, len(doc), 50_000):
                hi, lo = np.ascontiguousarray(h[i : i + 50_000, 0]), np.ascontiguousarray(h[i : i + 50_000, 1])
                yield pa.RecordBatch.from_arrays([pa.array((hi % shards).astype(np.int32)), pa.array(hi), pa.array(lo), pa.array(doc[i : i + 50_000])], ["shard", "hi", "lo", "doc"])

    return docs.select(_ranked("doc_id").alias("doc"), "text").mapInArrow(run, _POSTING)


#: What a row asks of its shard's filter.
_IS, _REMOVE, _INSERT, _MEET = 0, 1, 2, 3


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, ask): the filter, then keys to remove, to insert, and to meet, which are inserted if not known. Gives the keys met with `known`, and each shard's filter."""
    now, f, bits, changed = None, None, 0, False
    names = ["shard", "hi", "lo", "refs", "first", "last", "known", "bits", "seats"]
    kinds = [pa.int32(), *([pa.int64()] * 5), pa.bool_(), pa.int32(), pa.binary()]

    def emitted(columns: list, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for b in batches:
        shard, ask = b.column(0).to_numpy(), b.column(1).to_numpy()
        keys = [b.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 7)]
        cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (ask[1:] != ask[:-1])]) if len(shard) else np.zeros(0, np.int64)
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            if ask[i] == _IS:
                if f is not None:
                    yield emitted([[now], None, None, None, None, None, None, [bits], [f.to_bytes()]], 1)
                now, bits = int(shard[i]), b.column(7)[i].as_py()
                f = CuckooFilter(bits, b.column(8)[i].as_py())
                continue
            hi, lo = keys[0][i:j], keys[1][i:j]
            if ask[i] == _REMOVE:
                f.remove(hi, lo)
            elif ask[i] == _INSERT:
                f.insert(hi, lo)
            else:
                known = f.knows(hi, lo)
                f.insert(hi[~known], lo[~known])
                yield emitted([shard[i:j], *(k[i:j] for k in keys), known, None, None], j - i)
    if f is not None:
        yield emitted([[now], None, None, None, None, None, None, [bits], [f.to_bytes()]], 1)


def _visited(filters: DataFrame, asks: DataFrame) -> DataFrame:
    """What _visit gives for stored filters (all shards that are asked) and asks (ask, shard, hi, lo, refs, first, last), stored."""
    null = [F.lit(None).cast("long").alias(c) for c in ("hi", "lo", "refs", "first", "last")]
    own = filters.select("shard", F.lit(_IS).alias("ask"), *null, "bits", "seats")
    rows = own.unionByName(asks.select("shard", "ask", "hi", "lo", "refs", "first", "last"), allowMissingColumns=True)
    laid = rows.repartition("shard").sortWithinPartitions("shard", "ask")
    return stored(laid.mapInArrow(_visit, f"{_REFERENCE}, known boolean, bits int, seats binary"))


def _asks(keys: DataFrame, ask: int) -> DataFrame:
    more = [F.lit(None).cast("long").alias(c) for c in ("refs", "first", "last") if c not in keys.columns]
    return keys.select("*", *more, F.lit(ask).alias("ask"))


def _bits(keys: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.log2(keys / (SEATS * LOAD)))).cast("int")


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents of docs (doc_id, text)."""
    new = stored(line_keys(docs, index.shards))
    arriving = new.groupBy("shard").agg(F.approx_count_distinct("lo").alias("n"))
    held = index.references.groupBy("shard").agg(F.count("*").alias("n"))
    need = arriving.unionByName(held).groupBy("shard").agg(F.sum("n").alias("n"))
    need = need.join(index.filters, "shard", "left")
    small = F.col("seats").isNull() | (F.length("seats") < 2 * F.col("n") / LOAD)  # an empty one failed and is built anew
    sized = stored(need.select("shard", F.when(small, _bits(F.col("n") * 1.5)).otherwise(F.col("bits")).alias("bits"), F.when(~small, F.col("seats")).alias("seats")))
    again = index.references.join(F.broadcast(sized.filter("seats IS NULL").select("shard")), "shard", "left_semi")  # one row a shard
    met = _visited(sized, _asks(_counted(new), _MEET).unionByName(_asks(again.select(*KEY), _INSERT)))
    keys, filters = met.filter("seats IS NULL").select(*KEY, "refs", "first", "last", "known"), met.filter("seats IS NOT NULL").select("shard", "bits", "seats")
    known = keys.filter("known").drop("known")
    old, hit = _split(index.references, known)
    both = hit.withColumn("held", F.lit(True)).unionByName(known.withColumn("held", F.lit(False)))
    merged = stored(both.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("held").alias("held")))
    references = old.unionByName(merged.drop("held")).unionByName(keys.filter("NOT known").drop("known"))
    missed = merged.filter("NOT held").select(*KEY)
    if not missed.isEmpty():  # false positives of the filters
        filters = _visited(filters, _asks(missed, _INSERT)).filter("seats IS NOT NULL").select("shard", "bits", "seats")
    return LineIndex(index.postings.unionByName(new), stored(references), filters, index.shards)


def _split(rows: DataFrame, keys: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a key of stored `keys`."""
    some = sized_broadcast(keys.select(*(by or KEY)).distinct())
    return rows.join(some, list(by or KEY), "left_anti"), rows.join(some, list(by or KEY), "left_semi")


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without all documents of ids (doc_id)."""
    rest, gone = _split(index.postings, stored(ids.select(_ranked("doc_id").alias("doc"))), "doc")
    rest, touched = stored(rest), stored(gone.select(*KEY).distinct())
    old, hit = _split(index.references, touched)
    now = stored(_counted(_split(rest, touched)[1]))
    lost = hit.join(now.select(*KEY), list(KEY), "left_anti").select(*KEY)
    filters = _visited(index.filters, _asks(lost, _REMOVE)).filter("seats IS NOT NULL").select("shard", "bits", "seats")
    return LineIndex(rest, stored(old.unionByName(now)), filters, index.shards)


def dropped(index: LineIndex) -> DataFrame:
    """(doc, lines): the keys that each document loses, as (hi, lo), because a smaller one has them.

    Of keys that over a thousandth of all postings have there are at most a thousand: these are broadcast and their postings never shuffled.
    """
    hot = index.postings.count() // 1000 + 1
    shared = index.references.filter("first < last").select("hi", "lo", "refs", "first")
    often = shared.filter(F.col("refs") > hot).select("hi", "lo", F.col("first").alias("owner"))
    p = index.postings.select("hi", "lo", "doc").join(F.broadcast(often), ["hi", "lo"], "left")
    rest = p.filter("owner IS NULL").drop("owner").join(shared.filter(F.col("refs") <= hot).select("hi", "lo", F.col("first").alias("owner")), ["hi", "lo"])
    rows = p.filter("owner IS NOT NULL").unionByName(rest).filter("doc <> owner")
    return rows.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("lines"))


def deduplicated(docs: DataFrame, index: LineIndex) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of each row of docs, whose documents the index holds: the lines that stay, joined by line ends."""
    gone = dropped(index).select(F.col("doc").alias("g_doc"), "lines")
    rows = docs.select("doc_id", "text").join(gone, _ranked("doc_id") == F.col("g_doc"), "left").select("doc_id", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts, counts, lost = [], [], []
            lines = b.column(2)
            ends = np.r_[0, np.cumsum([n or 0 for n in lines.value_lengths().to_pylist()], dtype=np.int64)]
            flat = lines.flatten()
            raw = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype(">i8").tobytes()
            for k, t in enumerate(utf8(b.column(1))):
                parts = t.split(b"\n")
                counts.append(len(parts))
                if ends[k + 1] > ends[k]:
                    away = {raw[16 * i : 16 * i + 16] for i in range(ends[k], ends[k + 1])}
                    parts = [p for p in parts if (key := line_key(p)) is None or xxhash.xxh3_128_digest(key) not in away]
                    t = b"\n".join(parts)
                lost.append(counts[-1] - len(parts))
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def in_batches(docs: DataFrame, batches: int = 2) -> LineIndex:
    """An index of docs, which arrive in batches by a hash of doc_id."""
    index = empty_index(docs.sparkSession, shards_for(docs))
    for k in range(batches):
        index = insert(index, docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index


def digest(rows: DataFrame) -> DataFrame:
    """The query's columns of deduplicated rows."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, r, u.i, u.line, translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(string_split(t, chr(10))) WITH ORDINALITY AS u(line, i)),
s AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.owner AS gone FROM l LEFT JOIN s USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
