"""Media cut into ranges against one window a media, on random rows with ties, and how evenly a long media is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheaf.operators import intervals, ranges, reports, rules
from cuesheaf.plans import pipelines

CUE = "media_id long, seq long, start_ms long, end_ms long, text string, confidence double"
NEVER = 10**9


def random_cues(seed, n=600, starts=4000):
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, starts, n)) * 40
    media = rng.choice([None, 1, 1, 1, 1, 2, 3], n)
    texts = ["ab", "cd", "yes", " ab", "a longer text", "one more text", None, ""]
    return [(m, k, int(start[k]), int(start[k] + rng.integers(1, 4000)), str(t) if (t := rng.choice(texts)) is not None else None, [0.0, -2.0, None][rng.integers(0, 3)]) for k, m in enumerate(media)]


def table(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


OPERATORS = {
    "repeats": rules.with_repeats,
    "merge_adjacent": intervals.merge_adjacent_duplicates,
    "merge_intervals": intervals.merge_intervals,
    "renumber": intervals.renumbered,
    "batches": intervals.batched,
    "clean_transcript": pipelines.clean_transcript,
    "filter_report": reports.filter_report,
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize(("seed", "starts"), [(1, 4000), (2, 12)])
def test_ranges_equal_one_window(spark, name, seed, starts):
    df = spark.createDataFrame(random_cues(seed, starts=starts), CUE)
    whole = table(OPERATORS[name](df, above=NEVER))
    assert table(OPERATORS[name](df, above=100)) == whole
    assert table(OPERATORS[name](df, above=0)) == whole


@pytest.mark.parametrize("seed", range(3))
def test_chunk_offsets_equal_one_window_and_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(m, i, None if rng.random() < 0.1 else int(rng.integers(1, 90_000)), bool(rng.random() > (0.02, 0.3)[m % 2])) for m in range(4) for i in range((3, 400, 700, 50)[m])]
    df = spark.createDataFrame(rows, "media_id long, chunk_idx long, dur_ms long, readable boolean")
    expected, total = [], 0
    for m, i, d, readable in rows:
        total = 0 if i == 0 else total
        if not readable:
            expected.append((m, i, i * 60_000))
            total = (i + 1) * 60_000
        else:
            expected.append((m, i, 0 if d is None else total))
            total += d or 0
    for above in (NEVER, 100, 0):
        out = intervals.chunk_offsets(df, above=above).select("media_id", "chunk_idx", "start_ms")
        assert sorted(tuple(r) for r in out.collect()) == expected


def test_long_interval_over_many_ranges(spark):
    rows = [(1, 0, 10_000), (1, 50_000, 50_020), *((1, s, s + 60) for s in range(200, 40_000, 200)), (1, 60_000, 90_000), (1, 60_010, 60_020)]
    df = spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long")
    whole = table(intervals.merge_intervals(df, least_ms=0, above=NEVER))
    assert table(intervals.merge_intervals(df, least_ms=0, above=0)) == whole and len(whole) > 100


def test_a_long_media_is_cut_evenly(spark):
    df = spark.range(300_000).select(F.lit(1).cast("long").alias("media_id"), (F.col("id") * F.col("id") % 1_000_003).alias("start_ms"))
    counts = []
    ranges.by_size(df, lambda c: c, lambda c: counts.append(c.groupBy("_range").count()) or c.drop("_range"), above=1000)
    n = [r["count"] for r in counts[0].collect()]
    assert len(n) > 0.9 * ranges.RANGES and max(n) < 3 * 300_000 / ranges.RANGES


def test_repeats_hold_no_lists_and_no_whole_frames(spark):
    plan = rules.with_repeats(spark.createDataFrame(random_cues(1), CUE))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "unboundedfollowing" not in plan


def test_expected_properties(spark):
    df = spark.createDataFrame(random_cues(3), CUE)
    clean = pipelines.clean_transcript(df)
    assert clean.count() <= df.count()
    once = intervals.merge_adjacent_duplicates(df.filter("media_id IS NOT NULL AND text IS NOT NULL"))
    assert table(intervals.merge_adjacent_duplicates(once).drop("merged")) == table(once.drop("merged"))


@pytest.mark.parametrize("quantile", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_exact_quantile_equals_percentile(spark, quantile):
    rng = np.random.default_rng(8)
    rows = [(int(m), int(v)) for m, n in ((1, 1), (2, 2), (3, 500), (4, 997)) for v in rng.integers(-(10 ** (m + 1)), 10 ** (m + 1), n)]
    rows += [(5, 7)] * 40 + [(6, v // 9) for v in range(400)] + [(None, 3), (None, 8), (3, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", quantile).alias("p")).collect()}
    for width in (2**20, 16, 1):
        out = intervals.exact_quantile(df, "k", "v", quantile, width)
        assert {r["k"]: r["quantile"] for r in out.collect()} == pytest.approx(want)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_energy_intervals_equal_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(m, i, float(x)) for m in range(3) for i, x in enumerate(rng.choice([0.0, 0.01, 0.2, 0.5, -0.9], 150 + m))]
    expected = []
    for m in range(3):
        x = np.array([r[2] for r in rows if r[0] == m])
        db = np.round(10 * np.log10(x * x + 1e-10), 9)
        active = db > np.round(np.quantile(db, 0.3), 9)
        start = None
        for i, a in enumerate([*active, None]):
            if a and start is None:
                start = i
            elif not a and start is not None:
                if i - start >= 5 or a is None:
                    expected.append((m, start * 10, i * 10))
                start = None
    f = spark.createDataFrame(rows, "media_id long, frame_idx long, sample double")
    assert sorted(tuple(r) for r in intervals.energy_intervals(f).collect()) == expected


@pytest.mark.parametrize("seed", range(2))
def test_gaps_and_head_equal_a_loop(spark, seed):
    rows = [r for r in random_cues(seed, n=200) if r[0] is not None]
    groups = {m: sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])) for m in {r[0] for r in rows}}
    gaps = [(m, y[1], "overlap" if y[2] < x[3] else "gap", abs(y[2] - x[3])) for m, g in groups.items() for x, y in zip(g, g[1:], strict=False) if y[2] < x[3] or y[2] - x[3] > 2000]
    df = spark.createDataFrame(rows, CUE)
    assert sorted(tuple(r) for r in intervals.gaps_and_overlaps(df).collect()) == sorted(gaps)
    for percent in (0, 7, 50, 100, 130):
        head = [(m, r[1]) for m, g in groups.items() for r in sorted(g, key=lambda r: r[1])[: max(1, min(len(g), len(g) * percent // 100))]]
        assert sorted((r["media_id"], r["seq"]) for r in intervals.head_fraction(df, percent, order="seq").collect()) == sorted(head)
