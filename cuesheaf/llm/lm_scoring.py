"""LM scoring by cross-entropy difference of two n-gram models.

Target documents (by label) and all others give two models that share one vocabulary: a word model
and a bigram model each, with pseudo-counts in proportion to the words of their side, so that a word of
equal rate on both sides has no difference. A token's loss is MIX times its bigram loss plus 1 - MIX
times its word loss; the end of a text is a token too. A document's score is the mean of its
tokens' loss differences, target minus background (lower: closer to the target).

Every word and bigram of every document is counted. Words that occur once in all texts form one
unknown word; bigrams that occur once count as not seen: they tell of no other text. This limit (LEAST)
is a count, the same at every size, so the models grow with the corpus. They are Spark tables:

1. each task counts its own words and bigrams, packs the counts by bucket of the hash and sends one row
   a bucket; a bucket's counts are added up and stored (counted);
2. features that hold at least one in HOT of all occurrences, so at most HOT of them, are broadcast; all others of a
   text go to their bucket, packed by block of texts, and meet the bucket's counts there (partial_sums),
   so no key has more than one in HOT of the rows and no model is held whole anywhere;
3. the partial sums of a block come together by block and give its documents' scores.

Defined cases: null, empty and wordless texts have no loss (null) and 0 words; without target or
background documents that model is uniform; repeated rows, and rows of one doc_id with other texts, are
documents of their own and counted as such; a very long text is a block of its own; equal scores are no
tie to break, as no order is made; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, sized_broadcast, small_batches, stored, utf8, word_hashes

#: Share of the bigram loss.
MIX = 0.7
#: Pseudo-count of a word and of a bigram, on a side that has half of all tokens.
WORD_ADD, PAIR_ADD = 0.5, 0.05
#: Occurrences in all texts from which a word or a bigram is known.
LEAST = 2
#: Features of at least one in HOT of all occurrences are broadcast.
HOT = 1 << 20
#: Bytes of text whose features one bucket holds, about, and that one block of texts holds.
BUCKET_BYTES, BLOCK_BYTES = 24_000_000, 4_000_000
#: Stand for a text's start and end.
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COUNTED = "bucket int, high binary, low binary, t binary, b binary, words long, words_t long, words_b long, known_t long, known_b long, pairs_t long, pairs_b long"
_SENT = "bucket int, kind int, block long, high binary, low binary, t binary, b binary"
_SUMS = "block long, doc_ids array<long>, n_words array<long>, places binary, t binary, b binary"


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, is_target): whether target (doc_id) has the document. Beyond the size of a broadcast the texts are stored."""
    ids = stored(target.select(F.col("doc_id").alias("t_doc_id")).distinct())
    small = sized_broadcast(ids)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = marked.join(small, F.col("doc_id") == F.col("t_doc_id"), "left").select("doc_id", "text", F.col("t_doc_id").isNotNull().alias("is_target"))
    return marked if small is not ids else stored(marked)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (even) and bigram hashes (odd) of all texts, and how many words and bigrams each text has."""
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    h = word_hashes(list(chain.from_iterable(split)))
    full = n > 0
    whole = np.empty(len(h) + 2 * int(full.sum()), np.uint64)
    ends = np.cumsum(n[full] + 2) - 1
    starts = ends - n[full] - 1
    inside = np.ones(len(whole), bool)
    inside[starts] = inside[ends] = False
    whole[inside], whole[starts], whole[ends] = h, _START, _END
    follows = np.ones(max(len(whole) - 1, 0), bool)
    follows[ends[:-1]] = False
    pairs = mixed(whole[:-1] * _LEFT + whole[1:] * _RIGHT)[follows] if len(whole) else whole
    return mixed(h) & ~np.uint64(1), pairs | np.uint64(1), n, n + full


def packed(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """48 bits of each hash, the lowest among them, which tells words from bigrams; buckets hold some of the rest."""
    return (hashes >> np.uint64(32)).astype(np.uint32).tobytes(), (hashes & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def unpacked(high: bytes, low: bytes) -> np.ndarray:
    return (np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16)) | np.frombuffer(low, np.uint16)


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings the hashes together by bucket, their order kept, and where each bucket ends."""
    bucket = ((hashes >> np.uint64(8)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.cumsum(np.bincount(bucket, minlength=buckets))


def added_up(hashes: np.ndarray, t: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return (hashes[first], *(np.add.reduceat(x[order], first, dtype=np.int64) if len(first) else x.astype(np.int64) for x in (t, b)))


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one at a time: a row holds much."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def counted(docs: DataFrame, buckets: int, least: int = LEAST, hold: int = 2_500_000) -> DataFrame:
    """A stored row for each bucket: counts of its known features, and sums over all its words and bigrams; docs (text, is_target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            hashes = np.concatenate([h for h, _ in held])
            side = np.repeat(np.array([s for _, s in held], np.int8), [len(h) for h, _ in held])
            hashes, t, b = added_up(hashes, side, 1 - side)
            order, ends = by_bucket(hashes, buckets)
            out = [[], [], [], [], []]
            for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if hi > lo:
                    at = order[lo:hi]
                    for c, x in zip(out, (k, *packed(hashes[at]), t[at].astype(np.uint32).tobytes(), b[at].astype(np.uint32).tobytes()), strict=True):
                        c.append(x)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "high", "low", "t", "b"])

        for batch in small_batches(batches, BLOCK_BYTES):
            texts, target = utf8(batch.column(0)), batch.column(1).to_pylist()
            for side in (0, 1):
                words, pairs, _, _ = features([x for x, is_target in zip(texts, target, strict=True) if is_target == side])
                held += [(words, side), (pairs, side)]
                total += len(words) + len(pairs)
            if total > hold:
                yield flush()
                total = 0
        if total:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket, held):
            h, t, b = added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
            known, word = t + b >= least, h & np.uint64(1) == 0
            sums = [x[m].sum() for x, m in ((t, word), (b, word), (t, word & known), (b, word & known), (t, ~word), (b, ~word))]
            values = [bucket, (h[known] >> np.uint64(16)).astype(np.uint32).tobytes(), (h[known] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), t[known].tobytes(), b[known].tobytes(), int((word & known).sum()), *map(int, sums)]
            kinds = [pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _COUNTED.split(", ")])

        last, held, size = None, [], 0
        for bucket, high, low, t, b in records(batches):
            if bucket != last and held:
                yield done(last, held)
                held, size = [], 0
            last = bucket
            held.append((unpacked(high, low), np.frombuffer(t, np.uint32), np.frombuffer(b, np.uint32)))
            size += len(held[-1][0])
            if len(held) > 1 and size > 1.3 * len(held[0][0]) + 1_000_000:  # what the tasks share is added up now and then
                held = [added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
        if held:
            yield done(last, held)

    parts = docs.select("text", "is_target").mapInArrow(count, "bucket int, high binary, low binary, t binary, b binary")
    return stored(parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, _COUNTED))


class Losses:
    """Losses of features by their counts, on both sides, from the sums over all texts."""

    def __init__(self, sums: dict[str, int]):
        words = [sums["words_t"], sums["words_b"]]
        texts = [sums["pairs_t"] - words[0], sums["pairs_b"] - words[1]]  # a text has a bigram more than words
        tokens = [w + d for w, d in zip(words, texts, strict=True)]
        size = sums["words"] + 2  # with the unknown word and the end
        share = [2 * max(n, 1) / max(sum(tokens), 1) for n in tokens]
        word_add, self.add = [WORD_ADD * s for s in share], [PAIR_ADD * s for s in share]
        mass = [a * size for a in self.add]
        self.total = [n + a * size for n, a in zip(tokens, word_add, strict=True)]
        self.word_add, self.mass = word_add, mass
        unknown = [words[0] - sums["known_t"], words[1] - sums["known_b"]]
        self.unknown_word = [self.word(np.array(unknown[s]), s, 0) for s in (0, 1)]
        self.unknown_pair = [self.pair(np.array(0), s) for s in (0, 1)]
        self.edges = [self.word(np.array(texts[s]), s, texts[s]) for s in (0, 1)]  # the end as a word, the start as a history

    def word(self, count: np.ndarray, side: int, history) -> np.ndarray:
        """Of a word as a token and as the one before a token."""
        return -(1 - MIX) * np.log((count + self.word_add[side]) / self.total[side]) + MIX * np.log(history + self.mass[side])

    def pair(self, count: np.ndarray, side: int) -> np.ndarray:
        return -MIX * np.log(count + self.add[side])

    def of(self, h: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        odd = (h & np.uint64(1)).astype(bool)
        return [np.where(odd, self.pair(c, s), self.word(c, s, c)) for s, c in enumerate(counts)]

    def met(self, h: np.ndarray, table: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        """Losses of h by a sorted table of known features; all others are unknown."""
        odd = (h & np.uint64(1)).astype(bool)
        at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
        hit = table[at] == h if len(table) else np.zeros(len(h), bool)
        return [np.where(hit, values[s][at] if len(table) else 0.0, np.where(odd, self.unknown_pair[s], self.unknown_word[s])) for s in (0, 1)]


def hot_features(table: DataFrame, occurrences: int, hot: int = HOT) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted features of at least one in `hot` of all occurrences, and their two counts; at most `hot` of them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for high, low, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t, o = np.frombuffer(t, np.int64), np.frombuffer(o, np.int64)
                m = (t + o) * hot >= occurrences
                if m.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (unpacked(high, low)[m], t[m], o[m])], ["h", "t", "b"])

    rows = table.select("high", "low", "t", "b").mapInArrow(pick, "h binary, t binary, b binary").collect()
    h, t, b = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) if rows else np.zeros(0, kind) for c, kind in (("h", np.uint64), ("t", np.int64), ("b", np.int64)))
    order = np.argsort(h)
    return h[order], [t[order], b[order]]


def partial_sums(docs: DataFrame, table: DataFrame, losses: Losses, hot: tuple[np.ndarray, list[np.ndarray]], buckets: int) -> DataFrame:
    """Sums of losses of each block of texts, from its hot features and from each bucket; docs (doc_id, text).

    A row of _SENT is a bucket's counts (kind 0), the features of a block that fall in the bucket with the
    place of their text (kind 1), or a block's own row (kind 2: ids, words and hot sums).
    """
    sent = docs.sparkSession.sparkContext.broadcast((hot[0], losses.of(*hot)))
    names, kinds = [c.split()[0] for c in _SENT.split(", ")], [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    sum_kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = sent.value
        block = TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, BLOCK_BYTES):
            for lo in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(lo, 1 << 16)
                words, pairs, n, m = features(utf8(part.column(1)))
                h = np.concatenate([words, pairs])
                h48 = (h >> np.uint64(32) << np.uint64(16)) | (h & np.uint64(0xFFFF))
                place = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), m)])
                at = np.minimum(np.searchsorted(known, h48), max(len(known) - 1, 0))
                hit = known[at] == h48 if len(known) else np.zeros(len(h), bool)
                own = [np.bincount(place[hit], values[s][at[hit]], len(n)) + losses.edges[s] for s in (0, 1)]
                ids = part.column(0)
                has_id = np.array([x is not None for x in ids.to_pylist()], bool)
                out = [(int(block % buckets), 2, block, np.array([x or 0 for x in ids.to_pylist()], np.int64).tobytes() + has_id.tobytes(), n.tobytes(), own[0].tobytes(), own[1].tobytes())]
                h, place = h[~hit], place[~hit].astype(np.uint16)
                order, ends = by_bucket(h, buckets)
                h, place = h[order], place[order]
                for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if hi > lo:
                        out.append((k, 1, block, *packed(h[lo:hi]), place[lo:hi].tobytes(), b""))
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, values = None, np.zeros(0, np.uint64), [np.zeros(0)] * 2
        for bucket, kind, block, high, low, t, b in records(batches):
            if bucket != last:
                last, known, values = bucket, np.zeros(0, np.uint64), [np.zeros(0)] * 2
            if kind == 0:
                known = unpacked(high, low)
                values = losses.of(known, (np.frombuffer(t, np.int64), np.frombuffer(b, np.int64)))
                continue
            if kind == 1:
                h, place = unpacked(high, low), np.frombuffer(t, np.uint16)
                used, at = np.unique(place, return_inverse=True)
                sums = [np.bincount(at, x, len(used)) for x in losses.met(h, known, values)]
                row = (block, None, None, used.tobytes(), sums[0].tobytes(), sums[1].tobytes())
            else:
                n = np.frombuffer(low, np.int64)
                ids = [i if x else None for i, x in zip(np.frombuffer(high, np.int64, len(n)).tolist(), high[8 * len(n) :], strict=True)]
                row = (block, ids, n.tolist(), np.arange(len(n)).astype(np.uint16).tobytes(), t, b)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, sum_kinds, strict=True)], [c.split()[0] for c in _SUMS.split(", ")])

    counts = table.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "high", "low", "t", "b")
    texts = docs.select("doc_id", "text").mapInArrow(split, _SENT)
    return counts.union(texts).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(meet, _SUMS)


def scores(sums: DataFrame) -> DataFrame:
    """(doc_id, n_words, ce_target, ce_background, ce_difference) from the partial sums of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, n, t, b):
            tokens = [None if x == 0 else x + 1 for x in n]
            cols = [[None if k is None else round(x / k, 6) for x, k in zip(v, tokens, strict=True)] for v in (t, b, [x - y for x, y in zip(t, b, strict=True)])]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", "n_words", "ce_target", "ce_background", "ce_difference"])

        last, total, own = None, None, None
        for block, ids, n, places, t, b in records(batches):
            if block != last:
                if own:
                    yield done(*own, total[0].tolist(), total[1].tolist())
                last, own, total = block, (ids, n), np.zeros((2, len(ids)))
            at = np.frombuffer(places, np.uint16)
            total[0, at] += np.frombuffer(t, np.float64)
            total[1, at] += np.frombuffer(b, np.float64)
        if own:
            yield done(*own, total[0].tolist(), total[1].tolist())

    return sums.repartition("block").sortWithinPartitions("block", F.col("doc_ids").isNull()).mapInArrow(run, "doc_id long, n_words long, ce_target double, ce_background double, ce_difference double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, least: int = LEAST, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of every document of docs (doc_id, text) against the documents that target (doc_id) names."""
    d = flagged(docs, target)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(-(-size // bucket_bytes)) or 1
    table = counted(d, buckets, least)
    names = ("words", "words_t", "words_b", "known_t", "known_b", "pairs_t", "pairs_b")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first().asDict()
    occurrences = sum(sums[c] for c in ("words_t", "words_b", "pairs_t", "pairs_b"))
    return scores(partial_sums(d, table, Losses(sums), hot_features(table, occurrences, hot), buckets))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS tgt, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
full_ AS (SELECT r, tgt, list_concat([NULL], w, [NULL]) AS s FROM d WHERE len(w) > 0),
pair AS (SELECT r, tgt, unnest(list_transform(range(1, len(s)), lambda i: {'p': s[i], 'c': s[i + 1]}), recursive := true) FROM full_),
uni AS (SELECT c AS word, count(*) FILTER (WHERE tgt)::DOUBLE AS t, count(*) FILTER (WHERE NOT tgt)::DOUBLE AS b FROM pair WHERE c IS NOT NULL GROUP BY c),
voc AS (SELECT * FROM uni WHERE t + b >= 2),
big AS (SELECT p, c, count(*) FILTER (WHERE tgt)::DOUBLE AS t, count(*) FILTER (WHERE NOT tgt)::DOUBLE AS b FROM pair GROUP BY p, c HAVING count(*) >= 2),
n AS (SELECT count(*) FILTER (WHERE tgt)::DOUBLE AS t, count(*) FILTER (WHERE NOT tgt)::DOUBLE AS b, count(*) FILTER (WHERE tgt AND c IS NULL)::DOUBLE AS dt, count(*) FILTER (WHERE NOT tgt AND c IS NULL)::DOUBLE AS db FROM pair),
k AS (SELECT count(*) + 2 AS v, coalesce(sum(t), 0) AS t, coalesce(sum(b), 0) AS b FROM voc),
g AS (SELECT n.*, k.v, n.t - n.dt - k.t AS ut, n.b - n.db - k.b AS ub, 2::DOUBLE * greatest(n.t, 1) / greatest(n.t + n.b, 1) AS st, 2::DOUBLE * greatest(n.b, 1) / greatest(n.t + n.b, 1) AS sb FROM n, k),
joined AS (SELECT r, g.*, CASE WHEN pair.c IS NULL THEN g.dt ELSE coalesce(u.t, g.ut) END AS ct, CASE WHEN pair.c IS NULL THEN g.db ELSE coalesce(u.b, g.ub) END AS cb,
  CASE WHEN pair.p IS NULL THEN g.dt ELSE coalesce(h.t, 0) END AS ht, CASE WHEN pair.p IS NULL THEN g.db ELSE coalesce(h.b, 0) END AS hb, coalesce(big.t, 0) AS pt, coalesce(big.b, 0) AS pb
  FROM pair CROSS JOIN g LEFT JOIN voc u ON u.word = pair.c LEFT JOIN voc h ON h.word = pair.p LEFT JOIN big ON big.p IS NOT DISTINCT FROM pair.p AND big.c IS NOT DISTINCT FROM pair.c),
loss AS (SELECT r, -0.3::DOUBLE * ln((ct + 0.5::DOUBLE * st) / (t + 0.5::DOUBLE * st * v)) - 0.7::DOUBLE * ln((pt + 0.05::DOUBLE * st) / (ht + 0.05::DOUBLE * st * v)) AS lt,
  -0.3::DOUBLE * ln((cb + 0.5::DOUBLE * sb) / (b + 0.5::DOUBLE * sb * v)) - 0.7::DOUBLE * ln((pb + 0.05::DOUBLE * sb) / (hb + 0.05::DOUBLE * sb * v)) AS lb FROM joined)
SELECT doc_id, len(w)::BIGINT AS n_words, round(x.lt, 6) AS ce_target, round(x.lb, 6) AS ce_background, round(x.ld, 6) AS ce_difference
FROM d LEFT JOIN (SELECT r, avg(lt) AS lt, avg(lb) AS lb, avg(lt - lb) AS ld FROM loss GROUP BY r) x USING (r)
"""
