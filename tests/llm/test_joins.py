"""Prefix join, paragraph dedup and components against brute force and SQL."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from cuesheaf.llm import common, paragraph_dedup, prefix_join, queries, set_links

from ..conftest import SMALL
from .helpers import empty_documents, odd_documents, rows


def shingle_set(text, k=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def smallest_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def family(seed, n=70):
    """Texts around a few bases, with 0 to 6 words changed; many at the edge of the threshold."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = random.Random(seed * 100 + i % 3)
        w = [f"w{r.randrange(400)}" for _ in range(r.choice([60, 90, 120]))]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("bucket_rows", [3000, 5])
def test_components_equal_brute_force(spark, bucket_rows):
    docs = family(1)
    sets = {i: shingle_set(t) for i, t in docs}
    expected = smallest_reachable(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    out = prefix_join.join_components(spark.createDataFrame(docs, "doc_id long, text string"), bucket_rows=bucket_rows)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == expected
    assert len(set(expected.values())) > 10


@pytest.mark.parametrize("bucket_rows", [3000, 7])
def test_sets_of_one_prefix_are_one_group(spark, bucket_rows):
    """Texts that differ by common words, long ones in four places and short ones in five: few groups, many sets."""
    rng = random.Random(3)
    docs = []
    for i in range(150):
        words = [f"c{k}" for k in range(110)]
        for k in range(9):
            words[k * 12 + 5] = rng.choice("ab") * (30 if k < 4 else 1)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    levels, sig = prefix_join.prepared(df, 3, 90)
    groups, sids = sig.select("gid").distinct().count(), sig.select("sid").distinct().count()
    assert groups < 40 < sids
    sets = {i: shingle_set(t) for i, t in docs}
    expected = smallest_reachable(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    out = prefix_join.join_components(df, bucket_rows=bucket_rows)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == expected and 1 < len(set(expected.values())) < 100


def test_rare_ngrams_come_first(spark):
    docs = spark.createDataFrame([(i, f"common words stand here own{i} text{i} of{i}") for i in range(40)], "doc_id long, text string")
    levels = prefix_join.gram_levels(docs, 3)
    often, seldom = prefix_join.ngram_set(b"common words stand", 3, levels)[0], prefix_join.ngram_set(b"own1 text1 of1", 3, levels)[0]
    assert seldom < often and levels.max() == 6 and int(often >> np.uint64(58)) == 6 and int(seldom >> np.uint64(58)) == 1


@pytest.mark.parametrize("spanning", [True, False])
@pytest.mark.parametrize("n", [12, 150])
def test_candidates_cover_all_links(n, spanning):
    docs = family(2, n)
    sets = {i: prefix_join.ngram_set(t.encode()) for i, t in docs}
    groups = [(i, None, len(s), 0, [i], [i], [set_links.sketch(s)]) for i, s in sets.items()]
    found = set(set_links.candidates(groups, 90, False, spanning))
    parts = smallest_reachable(list(sets), lambda a, b: (a, b) in found or (b, a) in found)
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                assert parts[a] == parts[b] and (spanning or (a, b) in found)
    assert not spanning or len(found) <= n * (1 + set_links.RANDOM_PAIRS)


@pytest.mark.parametrize("n", [40, 150])
def test_stars_of_equal_buckets_are_equal(n):
    """The rows of a bucket come in any order."""
    sets = {i: prefix_join.ngram_set(t.encode()) for i, t in family(2, n)}
    groups = [(i, None, len(s), 0, [i], [i], [set_links.sketch(s)]) for i, s in sets.items()]
    found = [{tuple(sorted(p)) for p in set_links.candidates(random.Random(k).sample(groups, n), 90, False, True)} for k in range(3)]
    assert found[0] == found[1] == found[2] and found[0]


def test_last_round_meets_only_buckets_with_a_failed_pair(spark):
    """Of two buckets with the same candidate pair, that one goes on where it failed before; a bucket cut in blocks always does."""
    s = set_links.sketch(np.arange(60, dtype=np.uint64))
    rows_ = spark.createDataFrame([(h, False, g, 60, 0) for h, g in ((1, 1), (1, 2), (2, 3), (2, 4))], "h long, own boolean, gid long, n long, place int")
    sets = spark.createDataFrame([(g, g, bytearray(s)) for g in range(1, 5)], "sid long, gid long, sketch binary")
    failed = spark.createDataFrame([(3,), (4,)], "f_sid long")
    for single in (True, False):
        members = set_links.group_members(sets, None, failed, single)
        assert rows(set_links.bucket_pairs(rows_, members, 90, 3000, None), "a", "b") == [(3, 4)]
        assert rows(set_links.bucket_pairs(rows_, members, 90, 1, None), "a", "b") == [(1, 2), (3, 4)]


def test_many_sketches_and_shingles_equal_single_ones():
    rng = random.Random(1)
    parts = [[b"w%d" % rng.randrange(9) for _ in range(rng.choice([6, 7, 40, 300]))] for _ in range(30)]
    items, sizes = paragraph_dedup.shingled(parts, np.array([i % 2 for i in range(30)], np.uint64))
    ends = np.cumsum(sizes)
    each = [items[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    assert all(np.array_equal(x, paragraph_dedup._shingled(i % 2, p)) for i, (x, p) in enumerate(zip(each, parts, strict=True)))
    assert set_links.sketches(items, sizes) == [set_links.sketch(x) for x in each]


def test_null_ids_link_like_others(spark):
    base = [f"b{i}" for i in range(60)]
    near = [*base[:59], "other"]
    rows_ = [(None, " ".join(base)), (2, " ".join(near)), (None, " ".join([*near[1:], "more"])), (1, " ".join(base))]
    out = prefix_join.join_components(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(None, 1), (2, 1), (1, 1)}
    alone = prefix_join.join_components(spark.createDataFrame(rows_[:1], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in alone] == [None]


def test_prefix_join_odd_documents(spark):
    out = rows(prefix_join.join_components(odd_documents(spark)), "doc_id", "n_shingles", "component_id")
    assert (0, 0, 0) in out and (2, 0, 2) in out and (3, 1, 3) in out and (3, 4, 3) in out and (4, 1, 4) in out
    assert [r for r in out if r[0] in (6, 7)] == [(6, 3, 6), (6, 3, 6), (7, 3, 6)]
    assert prefix_join.join_components(empty_documents(spark)).count() == 0


def test_one_of_each(spark):
    docs = odd_documents(spark)
    kept = prefix_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(3) == 2 and {0, 1, 2} <= set(ids) and None in ids
    assert prefix_join.one_of_each(empty_documents(spark)).count() == 0


def test_near_duplicate_stage_equals_brute_force(spark):
    docs = [(i, t) for i, t in family(1)]
    base = [f"b{i}" for i in range(50)]
    docs += [(200, " ".join(base)), (201, " ".join([*base[:25], "other", *base[26:]]))]  # 0.81 of the 5-grams, 0.88 of the 3-grams
    sets = {i: shingle_set(t, 5) for i, t in docs}
    expected = smallest_reachable(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values())) and expected[201] == 200


@pytest.mark.parametrize("name", ["op4_paragraph_minhash", "op8_prefix_join"])
def test_query_equals_sql(name, spark, same):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name])


def test_paragraphs_in_other_places(spark):
    p = " ".join(f"word{i}" for i in range(40))
    near = p.replace("word20 ", "Word20, ")
    changed = p.replace("word3 ", "other ").replace("word35 ", "new ")
    docs = spark.createDataFrame([(5, f"intro\n{p}"), (2, f"{near}\nend"), (9, p.replace("word7", "x")), (4, changed), (3, "short line\n" * 5), (1, None)], "doc_id long, text string")
    found = paragraph_dedup.repeated_paragraphs(docs).filter("unit = 'line'")
    out = rows(found.filter("n_words > 2"), "doc_id", "paragraph", "first_doc_id", "copies", "removed")
    sets = {d: shingle_set(t, 5) for d, t in ((5, p), (9, p.replace("word7", "x")), (4, changed))}

    def close(a, b):
        return 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])

    assert not close(5, 4)
    n = 3 if close(5, 9) else 2
    assert (2, 0, 2, n, False) in out and (5, 1, 2, n, True) in out and len(out) == n
    assert rows(found.filter("n_words = 2"), "doc_id", "paragraph", "copies", "removed") == [(3, i, 5, i > 0) for i in range(5)]
    assert paragraph_dedup.repeated_paragraphs(empty_documents(spark)).count() == 0


def test_short_and_wrapped_paragraphs(spark):
    line = " ".join(f"w{i}" for i in range(24))
    long = [f"p{i}" for i in range(120)]

    def wrapped(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    changed = [*long[:60], "new", *long[61:]]
    docs = [(1, f"one intro\n\n{line}"), (2, f"{line}\n\nother end"), (3, f"head a\n \n{wrapped(long, 12)}"), (4, f"{wrapped(changed, 17)}\n\ntail b"), (5, " ".join(long))]
    out = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(out.filter("unit = 'line'"), "doc_id", "paragraph", "first_doc_id", "copies", "removed") == [(1, 2, 1, 2, False), (2, 0, 1, 2, True)]
    assert {r[:4] for r in rows(out.filter("unit = 'block'"), "doc_id", "paragraph", "first_doc_id", "copies", "removed")} == {(1, 2, 1, 2), (2, 0, 1, 2), (3, 2, 3, 3), (4, 0, 3, 3), (5, 0, 3, 3)}


def test_units_with_one_shingle_link_whatever_their_length(spark):
    docs = [(1, "a a a a a"), (2, "a a a a a a"), (3, "a " * 40), (4, "a a a a"), (5, "a a a a b"), (6, "a a a a b"), (7, "a a a a a b")]
    out = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).filter("unit = 'line'")
    assert rows(out, "doc_id", "first_doc_id", "copies", "removed") == [(1, 1, 3, False), (2, 1, 3, True), (3, 1, 3, True), (5, 5, 2, False), (6, 5, 2, True)]


def test_null_ids_keep_their_links(spark):
    p = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, p), (None, p), (2, p.replace("word30 ", "x "))], "doc_id long, text string")
    out = paragraph_dedup.repeated_paragraphs(docs).filter("unit = 'line'")
    assert rows(out, "doc_id", "first_doc_id", "copies", "removed") == sorted([(1, 1, 3, False), (2, 1, 3, True), (None, 1, 3, True)], key=repr)


def test_paragraphs_odd_documents(spark):
    out = rows(paragraph_dedup.repeats(odd_documents(spark)), "doc_id", "unit", "first_doc_id", "copies", "removed")
    assert [r for r in out if r[1] == "line"] == [(6, "line", 6, 3, False), (6, "line", 6, 3, False), (7, "line", 6, 3, True)]
    assert (7, "passage", None, None, True) in out
    assert paragraph_dedup.repeats(empty_documents(spark)).count() == 0


def naive_passages(docs, split, words=50):
    """Runs of windows that occur twice, by comparing all windows."""
    texts = [(d, i, split(t or "")) for i, (d, t) in enumerate(docs)]
    places = {}
    for d, i, w in texts:
        for at in range(len(w) - words + 1):
            places.setdefault(tuple(w[at : at + words]), []).append((d, at, i))
    flags = {}
    for found in places.values():
        if len(found) > 1:
            for d, at, i in found:
                flags[i, d, at] = (d, at, i) != min(found)
    out = []
    for (i, d, at), removed in flags.items():
        if flags.get((i, d, at - 1)) != removed:
            n = next(n for n in range(1, len(flags) + 1) if flags.get((i, d, at + n)) != removed)
            out.append((d, at, n + words - 1, removed))
    return sorted(out, key=repr)


def test_passages_ignore_lines(spark):
    rng = random.Random(5)

    def other(n):
        return [f"o{rng.randrange(10**9)}" for _ in range(n)]

    p, q = other(55), other(50)
    han = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(60))
    docs = [
        (7, " ".join([*other(150), *p, *other(150)])), (3, " ".join([*other(90), *p, *other(80)]).upper()),  # inside longer lines
        (4, "\n".join(" ".join(q[i : i + 10]) for i in range(0, 50, 10)) + "\n" + " ".join(other(30))), (5, " ".join([*other(30), *q])),  # over short lines
        (6, " ".join(other(9)) + " " + han), (8, han + "字 " + " ".join(other(9))),  # without spaces
        (9, " ".join([*p[:49], *other(60)])), (10, " ".join(["again", "and"] * 60)), (11, None), (12, ""), (4, "short"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {3, 4, 5, 6, 7, 8} == {r["doc_id"] for r in paragraph_dedup.repeats(df).filter("unit = 'passage' OR n_words > 9").collect()} - {10}
    out = rows(paragraph_dedup.repeated_passages(df), "doc_id", "first_word", "n_words", "removed")
    assert out == naive_passages(docs, lambda t: re.findall("[\u4e00-\u9fff]|[a-z0-9]+", t.lower()))
    assert {(7, 150, 55, True), (3, 90, 55, False), (5, 30, 50, True), (8, 0, 60, True)} <= set(out) and 9 not in {r[0] for r in out}


def test_passages_equal_brute_force_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = rows(paragraph_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "first_word", "n_words", "removed")
    assert out == naive_passages(docs, lambda t: [w.encode().lower() for w in paragraph_dedup._WORDS.findall(t)]) and len(out) > 10


def test_passages_odd_documents(spark):
    out = rows(paragraph_dedup.repeated_passages(odd_documents(spark)), "doc_id", "first_word", "n_words", "removed")
    assert (7, 0, 90, True) in out and not {0, 1, 2, 3, 4, 8} & {r[0] for r in out}
    assert paragraph_dedup.repeated_passages(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    expected = smallest_reachable(ids, lambda a, b: (a, b) in edges or (b, a) in edges)
    out = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == expected


def test_near_copies_that_just_fail_are_rarely_candidates():
    """A family of near copies below the limit: one bit an item lets most of its pairs through, four few; pairs that link all pass."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 147, dtype=np.uint64)
    sets = [np.sort(np.concatenate([np.delete(base, rng.choice(147, 19, replace=False)), rng.integers(0, 1 << 63, 19, dtype=np.uint64)])) for _ in range(60)]
    near = [np.sort(np.concatenate([base[i:], rng.integers(0, 1 << 63, i, dtype=np.uint64)])) for i in (3, 6, 9, 12)]

    def passed(spread):
        sizes = np.array([len(x) for x in sets + near])
        groups = [(i, None, 147, 0, [i], [i], [x]) for i, x in enumerate(set_links.sketches(np.concatenate(sets + near), sizes, spread))]
        return set(set_links.candidates(groups, 80, False, False))

    def links(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 80 * (len(a) + len(b) - both)

    every = sets + near
    true = {(i, j) for i in range(len(every)) for j in range(i + 1, len(every)) if links(every[i], every[j])}
    assert len(true) > 5 and true <= passed(paragraph_dedup.SPREAD) and true <= passed(1)
    assert len(passed(paragraph_dedup.SPREAD) - true) * 4 < len(passed(1) - true)


def test_runs_of_bits():
    masks = np.array([-1, 0, 1, -(1 << 63), 0b1101100, (1 << 63) - 1], np.int64)
    assert [x.tolist() for x in paragraph_dedup.bit_runs(masks)] == [[0, 2, 3, 4, 4, 5], [0, 0, 63, 2, 5, 0], [64, 1, 1, 2, 2, 63]]


def test_only_units_that_share_a_band_key_get_sets(spark, monkeypatch):
    docs = [(i, "\n".join(" ".join(f"{c}{i}{k}{j}" for j in range(9)) for k, c in enumerate("abcd")) + "\n" + " ".join(f"z{j}" for j in range(40)) + f" z{i}") for i in range(8)]
    seen = []
    monkeypatch.setattr(paragraph_dedup, "link_components", lambda met, sets, *a, **k: seen.append(sets.count()) or set_links.link_components(met, sets, *a, **k))
    out = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"))
    assert out.filter("unit = 'line' AND copies = 8").count() == 8 and 8 <= seen[0] < 20  # of 48 units
