"""Window forms against plain loops, on random rows; and properties."""

from pathlib import Path

import numpy as np
import pytest

from cuesheaf.operators import intervals, rules, runs, translate

CUE = "media_id long, seq long, start_ms long, end_ms long, text string, confidence double"


def random_cues(seed, n=120):
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, 60_000, n))
    return [(int(k % 3), k, int(start[k]), int(start[k] + rng.integers(1, 4000)), str(rng.choice(["ab", "cd", "yes", "long text"])), 0.0) for k in range(n)]


def of_media(rows):
    return {m: sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])) for m in {r[0] for r in rows}}


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rows, expected = random_cues(seed), set()
    for group in of_media(rows).values():
        n = len(group)
        for i, r in enumerate(group):
            near = group[max(0, i - 5) : min(n, i + 6)][-5:]
            if r[4] != "yes" and any(x[4] == r[4] for x in near if x[2:] != r[2:]):
                expected.add(r[1])
    out = rules.with_repeats(spark.createDataFrame(rows, CUE)).filter("repeated").collect()
    assert {r["seq"] for r in out} == expected


@pytest.mark.parametrize("seed", range(3))
def test_merge_adjacent(spark, seed):
    rows, expected = random_cues(seed), []
    for group in of_media(rows).values():
        last = None
        for r in group:
            if last and last[4] == r[4] and r[2] - last[3] < 5000:
                last[3] = r[3]
            else:
                last = list(r)
                expected.append(last)
    df = spark.createDataFrame(rows, CUE)
    once = intervals.merge_adjacent_duplicates(df)
    out = sorted((r["media_id"], r["seq"], r["start_ms"], r["end_ms"], r["text"]) for r in once.collect())
    assert out == sorted(tuple(r[:5]) for r in expected)
    assert len(out) <= len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_merge_intervals(spark, seed):
    rows, expected = random_cues(seed), []
    for m, group in of_media(rows).items():
        merged = []
        for r in sorted(group, key=lambda r: (r[2], r[3])):
            if merged and r[2] <= merged[-1][1] + 100:
                merged[-1][1] = max(merged[-1][1], r[3])
            else:
                merged.append([r[2], r[3]])
        expected += [(m, s, e) for s, e in merged if e - s >= 150]
    out = sorted(tuple(r) for r in intervals.merge_intervals(spark.createDataFrame(rows, CUE)).collect())
    assert out == sorted(expected)
    assert all(b[1] - a[2] > 100 for a, b in zip(out, out[1:], strict=False) if a[0] == b[0])


@pytest.mark.parametrize("seed", range(3))
def test_best_attempt(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(m, a, float(rng.choice([-3.0, -2.0, -1.0, -0.5]))) for m in range(40) for a in (1, 2, 3)]
    expected = []
    for m in range(40):
        best = None
        for r in rows[3 * m : 3 * m + 3]:
            if best is None or r[2] > best[2]:
                best = r
            if best[2] > -1.0:
                break
        expected.append(best)
    df = spark.createDataFrame(rows, "media_id long, attempt int, confidence double")
    assert sorted(tuple(r) for r in intervals.best_attempt(df).collect()) == expected


def test_library_code_never_collects():
    for path in Path(__file__).parent.parent.joinpath("cuesheaf").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(x in path.read_text() for x in (".collect(", ".toPandas(", ".rdd")), path


@pytest.mark.parametrize("sizes", [(10**9, 10**9), (40, 300)])
def test_run_dirs_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    names = [f"{rng.choice(['a', 'film', 'é'])}{k % 40}_part001" for k in range(80)] + ["part001", "1", "", "x", "_part001"]
    dirs = [f"{n}_{rng.integers(0, 99)}_base" for n in names] + [f"{n}_small" for n in names] + ["base", "film3_part0011_base", None]
    media = [(k, n) for k, n in enumerate(names)] + [(900, "x"), (901, None)]
    out = runs.match_run_dirs(spark.createDataFrame(media, "media_id long, name string"), spark.createDataFrame([(d,) for d in dirs], "dir string"), "base", *sizes)
    want = {(m, d) for m, n in media for d in dirs if n and d and n in d and "base" in d}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    if sizes[0] == 10**9:
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_every_text_is_in_the_memory_or_listed_once(spark, seed):
    rng = np.random.default_rng(seed)
    texts = ["a", "<i>a</i>", " b ", "c d", "", " ", "<b></b>", "e", "e", '<font size="16" color="white">x\\ny</font>']
    rows = [(k % 3, k, k, k + 1, str(rng.choice(texts)), 0.0) for k in range(60)]
    cues = spark.createDataFrame(rows, CUE)
    memory = spark.createDataFrame([("en", "xx", "a", "A"), ("en", "yy", "e", "E"), ("xx", "en", "b", "B")], "src string, tgt string, text string, translation string")
    known = translate.translate_from_memory(cues, memory, spark.createDataFrame([], "word string, gloss string"), "en", "xx").collect()
    assert len(known) == len(rows)
    missing = [r["text"] for r in translate.missing_translations(cues, memory, "en", "xx").collect()]
    open_texts = {r["clean"] for r in known if r["status"] != "bilingual" and r["clean"]}
    assert len(missing) == len(set(missing)) and set(missing) == {t for t in open_texts if t not in {r["clean"] for r in known if r["status"] == "memory"}}
