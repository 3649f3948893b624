"""Cross-tokenizer alignment: two tokenizers' tokens of one text, aligned by galloping intersection of their byte ends.

The ends of the shorter list drive an exponential and then a binary search into the longer one. Ends that both lists hold cut
the tokens into groups: the common indices slice the groups, and the differences of their ranks give how many tokens of each side a group has, so
that overlaps come as ranges. All token pairs of a group are linked. How many documents hold a pair linked is counted over the
corpus, and each document is then described by the counts of its links.

The texts are read once: a document's distinct links and how often each stands are stored as packed arrays. Counts are gathered inside a
task before they are shuffled. The counted pairs (at most the product of both vocabularies, whatever the corpus) meet the
stored links in parts of PART_PAIRS, each one broadcast, so no task or driver holds more than one part.

Defined cases: a null or empty text, or one whose joined tokens differ from blank + text, has no tokens (zeros, empty string); repeated rows
are documents of their own; a null doc_id is kept; a text of any length is encoded whole, in the memory of one task; equal counts all are the
highest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how the byte-level tokenizer cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counted pairs that one part broadcasts (12 bytes each), links expanded at once, and distinct pairs a task gathers before it sends them on.
PART_PAIRS, LINKS_AT_ONCE, GATHERED = 4_000_000, 2_000_000, 2_000_000


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Index of the first entry of `long` not under each entry of `short`; both ascend and long's last is not under short's last.

    Every 32nd entry is sought first, by the same method. From the place of that one all others search at once: steps double
    until they pass the entry, then the last step is halved.
    """
    lo = np.zeros(len(short), np.int64) if len(short) <= 32 else np.repeat(gallop(short[::32], long), 32)[: len(short)]
    hi, last, step = lo.copy(), len(long) - 1, 1
    on = np.flatnonzero(long[hi] < short)
    while len(on):
        lo[on] = hi[on] + 1
        hi[on] = np.minimum(hi[on] + step, last)
        step *= 2
        on = on[long[hi[on]] < short[on]]
    on = np.flatnonzero(lo < hi)
    while len(on):
        mid = (lo[on] + hi[on]) // 2
        under = long[mid] < short[on]
        lo[on], hi[on] = np.where(under, mid + 1, lo[on]), np.where(under, hi[on], mid)
        on = on[lo[on] < hi[on]]
    return hi


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in a and in b of the ends that both hold; the last ends are equal."""
    if len(b) < len(a):
        at_b, at_a = common_ends(b, a)
        return at_a, at_b
    place = gallop(a, b)
    own = np.flatnonzero(b[place] == a)
    return own, place[own]


def _byte_chars() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Tokenizers:
    """Both tokenizers: ids of a text, and the bytes of each id."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken

        model, chars = json.loads(byte_json), _byte_chars()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a[i] = t
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        p = self.pieces
        self.b = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(p.id_to_piece(list(range(p.vocab_size()))))]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.a, self.b))
        self.names = [f"{i}{mark}".encode() for n, marks in ((len(self.a), ",|"), (len(self.b), ",;")) for mark in marks for i in range(n)]

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; both empty if it is null or empty, or if the tokens' bytes are not blank + text."""
        none = np.zeros(0, np.int64)
        out = [(none, none)] * len(texts)
        at = [k for k, t in enumerate(texts) if t]
        for k, b in zip(at, self.pieces.encode([texts[k] for k in at], num_threads=1), strict=True):
            whole = " " + texts[k]
            a = self.encoding.encode_ordinary(whole)
            want = whole.encode()
            if b"".join(map(self.b.__getitem__, b)) == want and b"".join(map(self.a.__getitem__, a)) == want:
                out[k] = np.array(a, np.int64), np.array(b, np.int64)
        return out


@cache
def _tokenizers(byte_json: bytes, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_json, piece_model)


def loaded(folder: str = FOLDER) -> tuple[bytes, bytes]:
    """The two vocabulary files, as the tasks get them."""
    out = []
    for name in (BYTE_FILE, PIECE_FILE):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each entry, `counts` of them, one after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _distinct(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the times of each."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def links(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (doc * width + id of A) * width + id of B of all linked occurrences, and how often each is linked.

    own_a and own_b are the indices of the groups' last tokens, doc the document of each group. A group of more than LINKS_AT_ONCE
    links is counted by its distinct ids, a block of them at a time.
    """
    from_a, from_b = np.r_[0, own_a[:-1] + 1], np.r_[0, own_b[:-1] + 1]
    n_a, n_b = own_a + 1 - from_a, own_b + 1 - from_b
    product = n_a * n_b
    keys, times = [], []
    large = product > LINKS_AT_ONCE
    small = np.flatnonzero(~large)
    cuts = np.flatnonzero(np.diff(np.cumsum(product[small]) // LINKS_AT_ONCE)) + 1
    for g in np.split(small, cuts):
        at_a = _ragged(from_a[g], n_a[g])
        group = np.repeat(g, n_a[g])
        left = np.repeat(doc[group] * width + a[at_a], n_b[group]) * width
        k, t = np.unique(left + b[_ragged(from_b[group], n_b[group])], return_counts=True)
        keys.append(k)
        times.append(t)
    for g in np.flatnonzero(large):
        x, m = np.unique(a[from_a[g] : own_a[g] + 1], return_counts=True)
        y, n = np.unique(b[from_b[g] : own_b[g] + 1], return_counts=True)
        block = max(1, LINKS_AT_ONCE // len(y))
        for i in range(0, len(x), block):
            keys.append((((doc[g] * width + x[i : i + block]) * width)[:, None] + y).ravel())
            times.append((m[i : i + block, None] * n).ravel())
    return _distinct(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary of each slice of the values."""
    raw = np.ascontiguousarray(values)
    offsets = np.r_[0, ends] * raw.itemsize
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    return pa.array([raw[i:j].tobytes() for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)], pa.large_binary())


def align(texts: list[str | None], t: Tokenizers) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: n_a, n_b, n_groups and n_links, the hash of the groups, and the distinct links with their times, whose last column says where each text's end."""
    coded = t.encoded(texts)
    n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
    a, b = (np.concatenate([c[k] for c in coded]) if coded else np.zeros(0, np.int64) for k in (0, 1))
    if not len(a):
        zero = np.zeros(len(texts), np.int64)
        return [n_a, n_b, zero, zero], [""] * len(texts), np.zeros(0, np.int64), np.zeros(0, np.int64), zero
    own_a, own_b = common_ends(np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b]))  # a text's end is an end of both
    last_a = np.cumsum(n_a)
    doc = np.searchsorted(last_a, own_a, "right")
    size_a, size_b = np.diff(np.r_[-1, own_a]), np.diff(np.r_[-1, own_b])
    n_groups = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    sums = np.r_[0, np.cumsum(size_a * size_b)]
    edges = np.r_[0, np.cumsum(n_groups)]
    n_links = sums[edges[1:]] - sums[edges[:-1]]
    names = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ends_a[own_a] = ends_b[own_b] = True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    names[np.arange(len(a)) + (own_b + 1 - size_b)[group_a]] = a + len(t.a) * ends_a
    names[np.arange(len(b)) + (own_a + 1)[group_b]] = 2 * len(t.a) + b + len(t.b) * ends_b
    ends = np.cumsum(n_a + n_b)
    digests = ["" if i == j else hashlib.sha256(b"".join(map(t.names.__getitem__, names[i:j].tolist()))[:-1]).hexdigest() for i, j in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True)]
    width = max(len(t.a), len(t.b))
    keys, times = links(a, b, own_a, own_b, doc, width)
    return [n_a, n_b, n_groups, n_links], digests, keys % (width * width), times, np.searchsorted(keys, np.arange(1, len(texts) + 1) * (width * width))


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """ALIGNED of each row of docs (doc_id, text): pairs are 64-bit id of A * width + id of B, times 32-bit."""
    files = docs.sparkSession.sparkContext.broadcast(loaded(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(*files.value)
        for b in small_batches(batches, 1_000_000):
            counts, digests, pairs, times, ends = align(b.column(1).to_pylist(), t)
            columns = [b.column(0), *(pa.array(c) for c in counts), pa.array(digests), _packed(pairs.astype(np.int64), ends), _packed(times.astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of packed arrays, and where each row's end."""
    raw = [x or b"" for x in column.to_pylist()]
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.cumsum([len(x) // size for x in raw], dtype=np.int64)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of stored ALIGNED rows, stored: how many rows hold a pair, and whether that is the highest of its id of A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["pair", "n"])

        keys, times, more, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for b in batches:
            values, _ = _flat(b.column(0), np.int64)
            more.append(values)
            waiting += len(values)
            if waiting >= GATHERED:
                new = np.concatenate(more)
                keys, times = _distinct(np.concatenate([keys, new]), np.concatenate([times, np.ones(len(new), np.int64)]))
                more, waiting = [], 0
                if len(keys) >= GATHERED:
                    yield from rows_of(keys, times)
                    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([np.zeros(0, np.int64), *more])
        yield from rows_of(*_distinct(np.concatenate([keys, new]), np.concatenate([times, np.ones(len(new), np.int64)])))

    n = stored(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    of = F.floor(F.col("pair") / width)
    top = n.groupBy(of.alias("t_a")).agg(F.max("n").alias("most"))  # at most one row an id of A
    return stored(n.join(F.broadcast(top), of == F.col("t_a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _described(rows: DataFrame, part: DataFrame) -> DataFrame:
    """n_best and count_sum of the rows over the pairs of one part of the counts, which is broadcast."""
    t = part.sort("pair").toArrow()
    keys, n = (t.column(c).to_numpy() for c in ("pair", "n"))
    held = rows.sparkSession.sparkContext.broadcast((keys, np.where(t.column("best").to_numpy(zero_copy_only=False), n, -n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, signed = held.value
        for b in batches:
            names = b.schema.names
            pairs, ends = _flat(b.column(names.index("pairs")), np.int64)
            times, _ = _flat(b.column(names.index("times")), np.int32)
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            count = np.where(keys[at] == pairs, signed[at], 0)
            sums = [np.r_[0, np.cumsum(x)] for x in (times * (count > 0), times * np.abs(count))]
            starts = np.r_[0, ends[:-1]]
            own = [b.column(k) for k, c in enumerate(names) if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(own + [pa.array(s[ends] - s[starts]) for s in sums], [*(c for c in names if c not in ("pairs", "times")), "n_best", "count_sum"])

    own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pairs", "times")]
    return rows.mapInArrow(run, ", ".join([*own, "n_best long", "count_sum long"]))


def alignment(docs: DataFrame, folder: str = FOLDER, part_pairs: int = PART_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text)."""
    t = _tokenizers(*loaded(folder))
    rows = stored(aligned(docs, folder).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(rows, max(len(t.a), len(t.b)))
    n = counts.count()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if not n:
        zero = F.lit(0).cast("long")
        return rows.select(*columns[:5], zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256")
    parts = -(-n // part_pairs)
    cuts = counts.approxQuantile("pair", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = [-1.0, *sorted(set(cuts)), float(2**62)]
    of = [_described(rows, counts.filter((F.col("pair") > lo) & (F.col("pair") <= hi))) for lo, hi in zip(edges, edges[1:], strict=False)]
    out = of[0]
    for more in of[1:]:
        out = out.unionByName(more)
    if len(of) > 1:
        out = out.groupBy("row", *columns).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(*columns[:5], "n_best", "count_sum", "groups_sha256")
