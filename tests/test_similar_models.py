"""Similar texts: bounds against the full ratio, and the folds against plain loops, on random rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheaf.operators import reports, similar

SEGMENT = "media_id long, chunk_id long, seq long, start_ms long, end_ms long, text string, confidence double"


def random_text(rng):
    words = ["the cat", "sat on", "a mat,", "and then", "it left!", "x", "。", "went home", "a b c d e f"]
    text = " ".join(rng.choice(words, rng.integers(0, 6)))
    return text * int(rng.choice([1, 1, 1, 12]))


def random_segments(seed, n=250):
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, 60_000, n))
    texts = [random_text(rng) for _ in range(12)]
    out = []
    for k in range(n):
        text = str(rng.choice(texts)) + rng.choice(["", "", "!", " again"])
        out.append((int(k % 2), int(rng.integers(0, 3)), k, int(start[k]), int(start[k] + rng.integers(50, 1500)), text, float(rng.choice([-1.0, -0.5, -0.2]))))
    return out


def ordered(rows, *keys):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        groups.setdefault(tuple(r[k] for k in keys), []).append(list(r))
    return groups.values()


def segments_by_loop(rows):
    out = []
    for group in ordered(rows, 0, 1):
        kept = []
        for r in group:
            if not r[5]:
                continue
            if kept:
                last = kept[-1]
                close = min(last[4], r[4]) - max(last[3], r[3]) > 100 or r[3] - last[4] < 300
                if close and similar.similarity(last[5], r[5]) > 0.7:
                    last[4] = r[4]
                    if r[6] > last[6]:
                        last[5:7] = r[5:7]
                    continue
            kept.append(list(r))
        out += map(tuple, kept)
    return out


def chunks_by_loop(rows):
    out = []
    for group in ordered(rows, 0):
        kept = []
        for r in group:
            if kept and similar.similarity(kept[-1][5], r[5]) > 0.7:
                kept[-1][4] = r[4]
            else:
                kept.append(list(r))
        out += map(tuple, kept)
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.7, 0.95, 1.0])
def test_bounds_change_no_decision(threshold):
    rng = np.random.default_rng(4)
    ways = set()
    for _ in range(600):
        a, b = random_text(rng), random_text(rng)
        over, way = similar.decided(a, b, threshold)
        assert over == (similar.similarity(a, b) > threshold)
        ways.add(way)
    assert ways <= set(similar.WAYS)


def test_bounds_as_expressions_are_upper_bounds(spark):
    rng = np.random.default_rng(5)
    pairs = [(random_text(rng), random_text(rng)) for _ in range(300)]
    by_length, by_characters = similar.similarity_bounds(F.col("a"), F.col("b"))
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", by_length.alias("n"), by_characters.alias("c")).collect():
        assert similar.similarity(r["a"], r["b"]) <= r["c"] + 1e-12 <= r["n"] + 2e-12


@pytest.mark.parametrize("seed", range(3))
def test_similarity_column(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(random_text(rng), random_text(rng)) for _ in range(100)] + [(None, "a"), ("a", None)]
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar.text_similarity(F.col("a"), F.col("b")).alias("x"), similar.is_similar(F.col("a"), F.col("b")).alias("s")).collect()
    for r in out:
        if r["a"] is None or r["b"] is None:
            assert r["x"] is None and r["s"]["similar"] is None
        else:
            assert r["x"] == similar.similarity(r["a"], r["b"]) and r["s"]["similar"] == (r["x"] > 0.7)


@pytest.mark.parametrize("seed", range(3))
def test_merge_similar_segments(spark, seed):
    rows = random_segments(seed)
    out = similar.merge_similar_segments(spark.createDataFrame(rows, SEGMENT))
    assert sorted(map(tuple, out.collect())) == sorted(segments_by_loop(rows))


@pytest.mark.parametrize("seed", range(3))
def test_merge_similar_chunks(spark, seed):
    rows = random_segments(seed)
    out = similar.merge_similar_chunks(spark.createDataFrame(rows, SEGMENT))
    assert sorted(map(tuple, out.collect())) == sorted(chunks_by_loop(rows))


@pytest.mark.parametrize("seed", range(3))
def test_merged_chunked_transcript(spark, seed):
    rows = random_segments(seed)
    per_chunk = similar.merge_similar_segments(spark.createDataFrame(rows, SEGMENT))
    merged = similar.merge_similar_chunks(similar.union_chunk_segments(similar.chunk_results(per_chunk)).select("media_id", "chunk_id", "seq", "start_ms", "end_ms", "text", "confidence"))
    expected = {}
    for r in sorted(chunks_by_loop(segments_by_loop(rows)), key=lambda r: (r[3], r[2])):
        expected.setdefault(r[0], []).append(r[5])
    assert {r["media_id"]: r["text"] for r in reports.transcript_text(merged).collect()} == {m: " ".join(t).strip() for m, t in expected.items()}


def test_shared_characters_against_a_plain_count(spark, monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(6)
    pairs = [(random_text(rng), random_text(rng)) for _ in range(200)] + [("", ""), ("、。", "a"), ("a\U0001f600a\U0001f600", "\U0001f600a\U0001f600,"), ("".join(map(chr, range(40, 4000))), "x" * 9000 + "".join(map(chr, range(3000, 5000))))]
    marks = str.maketrans("", "", "、。,!?")
    expected = []
    for a, b in pairs:
        x, y = a.translate(marks), b.translate(marks)
        expected.append([len(x), len(y), sum((Counter(x) & Counter(y)).values())])
    p, q = (similar.pa.array(c) for c in zip(*pairs, strict=True))
    for cells in (1, 4000, similar.TABLE_CELLS):
        monkeypatch.setattr(similar, "TABLE_CELLS", cells)
        assert similar.shared_characters(p, q).T.tolist() == expected
    monkeypatch.setattr(similar, "PART_BYTES", 100)
    parts = list(similar._parts(p, q))
    assert len(parts) > 50 and [r for a, b in parts for r in similar.shared_characters(a, b).T.tolist()] == expected
    bounds = similar.similarity_bounds(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string").coalesce(1).select(*bounds).collect()
    both = [x + y for x, y, _ in expected]
    assert [tuple(r) for r in rows[:-2]] == [(2.0 * min(x, y) / n, 2.0 * s / n) if n else (1.0, 1.0) for n, (x, y, s) in zip(both, expected, strict=True)]
    assert [tuple(r) for r in rows[-2:]] == [(None, None)] * 2


def test_bounds_of_long_texts_take_time_by_their_length():
    import time

    text = "".join(map(chr, range(0x4E00, 0x9E00)))  # 20,480 different characters, of which each took a pass over both texts
    began = time.process_time()
    assert similar.shared_characters(*(similar.pa.array([t * 10] * 3) for t in (text, text[::-1]))).tolist() == [[len(text) * 10] * 3] * 3
    assert time.process_time() - began < 20
