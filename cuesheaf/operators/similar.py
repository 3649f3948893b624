"""Merging similar texts: ordered folds whose state changes, one group at a time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

_MARKS = "、。,!?"
_DROP = re.compile(f"[{_MARKS}]")
_MARK_CODES = np.array([ord(c) for c in _MARKS], np.uint32)
#: Bytes of texts whose characters are counted at once, and cells of a table of counts.
PART_BYTES, TABLE_CELLS = 1 << 20, 1 << 20
#: How a pair was decided: by equal texts, by the lengths, by the characters of both, or by the full comparison.
WAYS = ("equal", "length", "characters", "full")


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio without punctuation."""
    return 1.0 if a == b else SequenceMatcher(None, _DROP.sub("", a), _DROP.sub("", b)).ratio()


@lru_cache(4096)
def _profile(text: str) -> tuple[str, Counter]:
    """The text without punctuation, and its characters with their counts."""
    t = _DROP.sub("", text)
    return t, Counter(t)


def decided(a: str, b: str, threshold: float) -> tuple[bool, str]:
    """Whether the similarity is over the threshold, and the first of WAYS that says so.

    Matching blocks hold at most the shorter text, and at most the characters that both texts share, each as often as in the text that has
    fewer of it; twice that over both lengths is an upper bound, so a pair that it leaves under the threshold needs no comparison.
    """
    if a == b:
        return threshold < 1.0, "equal"
    (x, in_x), (y, in_y) = _profile(a), _profile(b)
    both = len(x) + len(y)
    if both and 2.0 * min(len(x), len(y)) / both <= threshold:
        return False, "length"
    if both and 2.0 * sum((in_x & in_y).values()) / both <= threshold:
        return False, "characters"
    return SequenceMatcher(None, x, y).ratio() > threshold, "full"


def text_similarity(a, b):
    """The similarity as a column; null if a side is null."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else similarity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def is_similar(a, b, threshold: float = 0.7):
    """struct (similar, way): whether the similarity is over the threshold and how that was decided; null if a side is null."""

    @pandas_udf("similar boolean, way string")
    def over(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [(None, None) if p is None or q is None else decided(p, q, threshold) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(found, columns=["similar", "way"])

    return over(a, b)


def similarity_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Both upper bounds of the similarity as columns, by the lengths and by the shared characters; 1 for two texts without characters."""

    @F.arrow_udf("struct<x: bigint, y: bigint, shared: bigint>")
    def counted(p: pa.Array, q: pa.Array) -> pa.Array:
        out = [shared_characters(*part) for part in _parts(p, q)] or [np.zeros((3, 0), np.int64)]
        empty = pc.or_(p.is_null(), q.is_null()).to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(c, mask=empty) for c in np.concatenate(out, axis=1)], ["x", "y", "shared"])

    n = counted(a, b)
    both = n["x"] + n["y"]
    return tuple(F.when(both == 0, F.lit(1.0)).otherwise(2.0 * k / both) for k in (F.least(n["x"], n["y"]), n["shared"]))


def _parts(p: pa.Array, q: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Pairs of texts in parts of about PART_BYTES; one long pair may exceed it."""
    ends = np.cumsum([np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in (p, q)], axis=1).sum(axis=0)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + PART_BYTES, "right")))
        yield p.slice(start, end - start), q.slice(start, end - start)
        start = end


def shared_characters(p: pa.Array, q: pa.Array) -> np.ndarray:
    """Per pair of texts without punctuation: the characters of each, and those that both share, each as often as in the text that has fewer of it.

    Counts are a table of pairs by characters, made for so many pairs at once that it has about TABLE_CELLS.
    """
    sides = []
    for texts in (p, q):
        texts = pc.fill_null(texts, "")
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(texts)), np.asarray(pc.utf8_length(texts)))
        keep = ~np.isin(codes, _MARK_CODES)
        sides.append((codes[keep], row[keep]))
    met = np.zeros(0x110000, bool)
    for codes, _ in sides:
        met[codes] = True
    rank = np.cumsum(met) - 1
    width = max(1, int(rank[-1]) + 1)
    sizes = [np.bincount(row, minlength=len(p)) for _, row in sides]
    shared, step = [], max(1, TABLE_CELLS // width)
    for k in range(0, len(p), step):
        n = min(step, len(p) - k)
        tables = []
        for codes, row in sides:
            i, j = np.searchsorted(row, (k, k + n))
            tables.append(np.bincount((row[i:j] - k) * width + rank[codes[i:j]], minlength=n * width).reshape(n, width))
        shared.append(np.minimum(*tables).sum(axis=1))
    return np.stack([*sizes, np.concatenate(shared)])


def _folded(rows: DataFrame, key: list[str], joins) -> DataFrame:
    """Fold each group in order of (start_ms, seq): `joins(last, row)` says if a row goes into the last kept one, and changes it.

    Rows come sorted by Spark and are folded as a stream, so a group is never held whole.
    """
    schema = rows.schema
    names = schema.names
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "start_ms", "seq")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict | None = None
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                if last is None or any(last[k] != row[k] for k in key) or not joins(last, row):
                    if last is not None:
                        out.append(last)
                    last = row
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame([last], columns=names)

    return ordered.mapInPandas(fold, schema)


def merge_similar_segments(segments: DataFrame, overlap_ms: int = 100, gap_ms: int = 300, threshold: float = 0.7) -> DataFrame:
    """Within a chunk, a row that overlaps the last kept one by over overlap_ms or starts under gap_ms after it, with a similar text, goes into it.

    Its end becomes the row's; text and confidence too if the row is more confident. Blank rows go.
    """

    def joins(last: dict, row: dict) -> bool:
        overlap = min(last["end_ms"], row["end_ms"]) - max(last["start_ms"], row["start_ms"])
        if (overlap <= overlap_ms and row["start_ms"] - last["end_ms"] >= gap_ms) or not decided(last["text"], row["text"], threshold)[0]:
            return False
        last["end_ms"] = row["end_ms"]
        if row["confidence"] > last["confidence"]:
            last["text"], last["confidence"] = row["text"], row["confidence"]
        return True

    return _folded(segments.filter(F.coalesce("text", F.lit("")) != ""), ["media_id", "chunk_id"], joins)


def merge_similar_chunks(segments: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Over all chunks of a media, a row similar to the last kept one goes into it whatever the time between; the first text stays."""

    def joins(last: dict, row: dict) -> bool:
        if not decided(last["text"], row["text"], threshold)[0]:
            return False
        last["end_ms"] = row["end_ms"]
        return True

    return _folded(segments, ["media_id"], joins)


def chunk_results(segments: DataFrame) -> DataFrame:
    """(media_id, chunk_id, segments): the rows of a chunk as an array."""
    return segments.groupBy("media_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "seq", "end_ms", "text", "confidence"))).alias("segments"))


def union_chunk_segments(results: DataFrame) -> DataFrame:
    """All segments of all chunk results as rows."""
    return results.select("media_id", "chunk_id", F.explode("segments").alias("s")).select("media_id", "chunk_id", "s.*")
