"""LM scoring, decontamination, line frequency, secrets and mixing."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheaf.llm import decontaminate, line_frequency, lm_scoring, mixing, queries, secret_ledger

from ..conftest import SMALL
from .helpers import empty_documents, odd_documents, rows


@pytest.mark.parametrize("name", ["op1_cross_entropy", "op3_line_frequency", "op9_source_mixing"])
def test_query_equals_sql(name, spark, same):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name])


def test_scores_follow_the_target(spark):
    docs = spark.createDataFrame([(i, "red green blue " * 9 if i < 5 else "one two three " * 9) for i in range(10)], "doc_id long, text string")
    out = lm_scoring.cross_entropy_difference(docs, docs.filter("doc_id < 3").select("doc_id"))
    diff = {r["doc_id"]: r["ce_difference"] for r in out.collect()}
    assert max(diff[i] for i in range(5)) < 0 < min(diff[i] for i in range(5, 10))


def test_scores_of_odd_documents(spark):
    docs = odd_documents(spark)
    none = docs.filter("false").select("doc_id")
    for target in (none, docs.select("doc_id"), docs.filter("doc_id = 6").select("doc_id", "label")):
        out = lm_scoring.cross_entropy_difference(docs, target).collect()
        assert len(out) == docs.count()
        assert all((r["ce_difference"] is None) == (r["n_words"] == 0) for r in out)
    assert lm_scoring.cross_entropy_difference(empty_documents(spark), none).count() == 0


def test_scores_see_words_that_are_rare_in_the_corpus(spark):
    texts = ["rare term here"] * 3 + ["seldom seen thing"] * 2 + ["common words all over " * 9000] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["ce_difference"] for r in lm_scoring.cross_entropy_difference(docs, docs.filter("doc_id < 2").select("doc_id")).collect()}
    assert found[2] < 0 < found[3] and 0.5 < found[3] - found[2]


@pytest.mark.parametrize(("hot", "bucket_bytes"), [(1, 10_000), (50, 100_000), (lm_scoring.HOT, 3_000)])
def test_scores_do_not_depend_on_buckets(spark, same, hot, bucket_bytes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    target = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1")
    same(lm_scoring.cross_entropy_difference(docs, target, hot=hot, bucket_bytes=bucket_bytes), lm_scoring.SQL)


def test_documents_that_occur_twice_differ_from_those_that_occur_once(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 100_000}" for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[150:])), "doc_id long, text string")
    found = {r["doc_id"]: r["ce_difference"] for r in lm_scoring.cross_entropy_difference(docs, docs.filter("doc_id < 60").select("doc_id")).collect()}
    assert max(found[i] for i in range(60, 150)) < min(found[i] for i in range(150, 250))


def naive_tiles(text, item, k):
    """Greedy string tiling by trying all pairs: the longest match, then the first in the text, then in the item."""
    used_t, used_i, out = [False] * len(text), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used_t[i + n] and not used_i[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return out
        out.append((n, i, j))
        used_t[i : i + n] = used_i[j : j + n] = [True] * n


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_naive_tiling(seed):
    rng = random.Random(seed)
    kinds = rng.choice([2, 4, 12])
    item = [rng.randrange(kinds) for _ in range(30)]
    cut = rng.randrange(30)
    text = [rng.randrange(kinds) for _ in range(10)] + item[cut:] + [rng.randrange(kinds) for _ in range(3)] + item[:cut]
    hashes = np.random.default_rng(seed).integers(1, 1 << 63, kinds, dtype=np.uint64)
    for k in (3, 5):
        assert decontaminate.tiles(hashes[text], hashes[item], k) == naive_tiles(text, item, k)


def test_matches_equal_naive_tiling_on_documents(spark):
    split = re.compile("[^\\x00-/:-@\\[-`{-\\x7f]+")
    items = [(r["item_id"], split.findall(r["text"].lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = []
    for r in docs.collect():
        w = split.findall(r["text"].lower())
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item_id, item in items:
            if 60 * len(item) <= 500 * sum(tuple(item[i : i + 5]) in have for i in range(len(item) - 4)):
                found = naive_tiles(w, item, 5)
                n = sum(length for length, _, _ in found)
                if 100 * n >= 60 * len(item):
                    expected.append((r["doc_id"], item_id, round(n / len(item), 6), len(found), n))
    assert rows(queries.op2_string_tiling(spark, SMALL), "doc_id", "item_id", "coverage", "tiles", "words") == sorted(expected, key=repr) and len(expected) >= 3


def test_repeated_words_cost_no_square():
    table = decontaminate.Seeds([(1, "a " * 400), (2, "b " * 30 + "a " * 30)], 5)
    began = time.monotonic()
    assert table.matches("a " * 100_000 + "b " * 100_000, 60) == [(1, 1.0, 1, 400), (2, 1.0, 2, 60)]
    assert time.monotonic() - began < 5


def test_unspaced_scripts_match_by_character():
    item = "".join(chr(0x4E00 + 7 * i) for i in range(20))
    table = decontaminate.Seeds([(1, item)], 5)
    assert table.matches(f"before{item[10:]}、{item[:10]}after", 60) == [(1, 1.0, 2, 20)] and not table.matches(item[:8], 60)


def test_reordered_passages_are_leaks(spark):
    words = [f"q{i}" for i in range(40)]
    moved = " ".join([*words[20:], "filler", *words[:20]]).upper().replace(" ", ", ")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    docs = odd_documents(spark, (50, f"start {moved} end", "en", "s", 0, 0, 0, "", 0, ""), (51, " ".join(words[:20]), "en", "s", 0, 0, 0, "", 0, ""), (52, "too short", "en", "s", 0, 0, 0, "", 0, ""))
    for block in (16_000_000, 60):
        assert rows(decontaminate.leaks(docs, bench, block_chars=block), "doc_id", "item_id", "coverage", "tiles", "words") == [(50, 7, 1.0, 2, 40), (52, 8, 1.0, 1, 2)]
        kept = decontaminate.clean(docs, bench, block_chars=block)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 2 and kept.filter("doc_id IN (50, 52)").count() == 0
    assert decontaminate.leaks(empty_documents(spark), bench).count() == 0
    assert decontaminate.leaks(docs, bench.filter("false")).count() == 0


def test_short_items_are_matched_whole():
    table = decontaminate.Seeds([(1, "one two"), (2, "Four; five, six seven!"), (3, "漢字"), (4, " . "), (5, "two"), (6, "one two three four five six"), (7, "one two")], 5)
    assert table.matches("zero one, TWO four five six eight", 60) == [(1, 1.0, 1, 2), (5, 1.0, 1, 1), (7, 1.0, 1, 2)]
    assert table.matches("漢字 four five six seven", 60) == [(2, 1.0, 1, 4), (3, 1.0, 1, 2)]
    assert table.matches("one two three four five six", 60) == [(1, 1.0, 1, 2), (5, 1.0, 1, 1), (7, 1.0, 1, 2), (6, 1.0, 1, 6)]
    assert table.matches("one too", 60) == [] == table.matches(None, 60) == table.matches("", 60)


def naive_line_frequency(docs, most=20):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    norm = [[(re.sub(r"[\W_]+", " ", x).lower().strip(" "), len(split.findall(x))) for x in (t or "").split("\n")] for _, t, _ in docs]
    count = {}
    for (_, _, host), lines in zip(docs, norm, strict=True):
        for n in {n for n, _ in lines if n}:
            count[host, n] = count.get((host, n), 0) + 1
    out = []
    for (d, t, host), lines in zip(docs, norm, strict=True):
        w = split.findall(t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        removed = sum(k for n, k in lines if n and count[host, n] > most)
        failed = len(w) < 50 or 2 * len(repeated) > len(w)
        out.append((d, len(w), len(repeated), removed, failed, not failed and 2 * removed <= len(w)))
    return sorted(out, key=repr)


def test_line_frequency_equals_brute_force(spark):
    rng = random.Random(4)
    common = "This Line, stands  everywhere it can stand."
    docs = [(i, "\n".join([common] * (i % 3) + [" ".join(f"a{rng.randrange(300)}" for _ in range(rng.choice([3, 60])))] + [f"{common}!"]), None if i % 2 else "h") for i in range(60)]
    docs += [(100, None, "h"), (101, "", None), docs[0], docs[0], (103, "x y z " * 20, "h")]
    out = line_frequency.line_frequency(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert rows(out, "doc_id", "n_words", "n_repeat_words", "removed_words", "base_failed", "kept") == naive_line_frequency(docs)


def test_line_frequency_odd_documents(spark):
    docs = odd_documents(spark)
    out = {(r["doc_id"], r["n_words"]): r for r in line_frequency.line_frequency(docs).collect()}
    assert out[0, 0]["base_failed"] and not out[0, 0]["kept"] and out[6, 90]["n_repeat_words"] == 90
    assert out[5, 30_000]["word_chars"] == sum(len(f"w{i % 977}") for i in range(30_000))
    assert line_frequency.line_frequency(empty_documents(spark)).count() == 0


def naive_scan(text):
    found = []
    at = 0
    pattern = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    while m := pattern.search(text, at):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
        at = m.end()
    for kind, alphabet, start, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 16), (2, "0123456789abcdef", "", 32)):
        i = 0
        while i < len(text):
            j = i + len(start)
            if text.startswith(start, i):
                while j < len(text) and text[j] in alphabet:
                    j += 1
            if text.startswith(start, i) and j > i + len(start):
                if j - i >= least:
                    found.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(found)


@pytest.mark.parametrize("seed", range(40))
def test_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    parts = ["token", "API_KEY", "apikey", "Secret", "passwd", "pässword", "ſecret", " = ", ":", "'", '"', "\n", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "abc-D.e/f+g=", "é😀", " "]
    text = "".join(rng.choice(parts) for _ in range(60))
    own = [(s, secret_ledger.KINDS.index(k), e) for k, s, e in secret_ledger.scan(text) if k in secret_ledger.KINDS]
    assert own == naive_scan(text)
    if own:
        assert re.search(secret_ledger.KEYWORDS.replace("(?i)", "").replace("(?-i)", ""), text.lower() + text)


def test_ledger_scans_only_what_is_new(spark):
    v1 = spark.createDataFrame([("a", "token = abcdefgh1"), ("b", "nothing"), ("c", "token = abcdefgh1"), ("d", None)], "path string, text string")
    out, ledger, findings = secret_ledger.scan_versions(v1)
    assert {r["path"]: len(r["spans"]) for r in out.collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}
    assert ledger.count() == 3 and findings.count() == 1
    v2 = v1.union(spark.createDataFrame([("e", "secret: 'zzzzzzzzz'"), ("f", "nothing")], v1.schema))
    more, found = secret_ledger.unseen_findings(v2, ledger)
    assert more.count() == 1 and found.count() == 1
    out, ledger, findings = secret_ledger.scan_versions(v2, ledger, findings)
    assert {r["path"]: len(r["spans"]) for r in out.collect()} == {"a": 1, "b": 0, "c": 1, "d": 0, "e": 1, "f": 0}
    assert secret_ledger.unseen_findings(v2, ledger, version="2")[0].count() == 4


def test_batches_scan_each_blob_once(spark, monkeypatch):
    docs = [(f"p{i}", f"token = abcdefgh{i % 7}" if i % 2 else f"nothing {i % 5}") for i in range(40)] + [("z", None), ("p1", "again"), (None, "token = abcdefgh1")]
    df = spark.createDataFrame(docs, "path string, text string")
    seen, scan = [], secret_ledger.unseen_findings
    monkeypatch.setattr(secret_ledger, "unseen_findings", lambda *a: seen.append(scan(*a)) or seen[-1])
    out, ledger, findings = secret_ledger.scan_batches(df, 3)
    blobs = {secret_ledger.sha256(t or "") for _, t in docs}
    assert len(seen) == 3 and sum(m.count() for m, _ in seen) == ledger.count() == len(blobs) and findings.count() == 7
    whole = secret_ledger.scan_versions(df)[0]
    assert rows(out, "path", "blob", "spans") == rows(whole, "path", "blob", "spans") and out.count() == len(docs)


def test_digest_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for d, text in docs:
        found = naive_scan(text or "")
        base = ",".join(f"{secret_ledger.KINDS[k]}:{s}:{e}" for s, k, e in found)
        expected.append((d, *(sum(k == x for _, x, _ in found) for k in range(3)), secret_ledger.sha256(base)))
    out = queries.op5_secret_ledger(spark, SMALL)
    assert rows(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=repr)


def test_redacted(spark):
    docs = odd_documents(spark)
    out = secret_ledger.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = {r["doc_id"]: r for r in out.collect()}
    assert changed[8]["text"] == "é ß 漢字 😀 [secret]" and changed[8]["n_chars"] == len(changed[8]["text"]) and changed[0]["text"] is None
    assert secret_ledger.redacted(empty_documents(spark)).count() == 0


def naive_targets(sizes):
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes))}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.remove(s)


@pytest.mark.parametrize("seed", range(4))
def test_mixture(spark, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(["w"] * rng.randrange(20)), rng.choice(["a", "b", "Z", "é", None, "c"][: rng.randrange(2, 7)])) for i in range(200)]
    docs += [(500, None, "a"), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=repr)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = naive_targets(sizes)
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert abs(own[0]["target"] - targets[s]) < 1e-6 and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - targets[s]) < 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)


@pytest.mark.parametrize("epochs", [2, 3])
def test_mixture_rows(spark, epochs):
    rng = random.Random(epochs)
    docs = [(i, "\n ".join(f"{i}.{k}" for k in range(rng.randrange(20))) + " ", "abc"[(i % 20 > 0) + (i % 20 > 12)], i) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    whole, out = {d: t for d, t, _, _ in docs}, mixing.mixture(df, percent=100, epochs=epochs)
    assert out.columns == [*df.columns, "epoch", "taken"]
    for r in out.collect():
        words = whole[r["doc_id"]].split()
        assert 0 < r["taken"] <= len(words) and r["text"].split() == words[: r["taken"]] and whole[r["doc_id"]].startswith(r["text"])
        assert r["text"] == whole[r["doc_id"]] if r["taken"] == len(words) else r["n_chars"] == len(r["text"])
        assert 1 <= r["epoch"] <= epochs
    rest = mixing.mix(df, percent=100, epochs=epochs)
    assert rows(mixing.digest(df, out, percent=100, epochs=epochs), *rest.columns) == rows(rest, *rest.columns)
    taken, targets = {}, {r["source"]: r["target"] for r in rest.collect()}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(int(targets[s]) == taken[s] for s in targets) and max(r["epoch"] for r in out.collect()) == epochs
    assert 0 < rest.filter("taken = 0 AND size > 0").count() == rest.filter("size > 0").count() - out.select("doc_id").distinct().count()


def test_mixture_rows_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = mixing.mixture(docs)
    assert sum(r["taken"] for r in out.collect()) == sum(r["taken"] for r in mixing.mix(docs).collect())
    assert all(len(r["text"].split()) == r["taken"] for r in out.collect())
    assert mixing.mixture(empty_documents(spark)).count() == 0


def test_cleaned_texts_lack_the_counted_lines(spark):
    common = "This Line, stands  everywhere it can stand."
    docs = [(i, "\n".join(["", common, f"own {i}", f"  {common.upper()}!", ""]), None if i % 2 else "h", 7) for i in range(60)] + [(100, common, "other", 7), (101, None, "h", 7), (102, common, "h", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r for r in line_frequency.cleaned(df).collect()}
    assert all(out[i]["text"] == f"\nown {i}\n" and out[i]["n_chars"] == len(out[i]["text"]) for i in range(60))
    assert (out[100]["text"], out[100]["n_chars"], out[101]["text"], out[102]["text"]) == (common, 7, None, "")
    lost = {r["doc_id"]: r["n_words"] - r["removed_words"] for r in line_frequency.line_frequency(df).collect()}
    assert {d: len((r["text"] or "").split()) for d, r in out.items()} == lost
    odd = odd_documents(spark)
    assert line_frequency.cleaned(odd).columns == odd.columns and line_frequency.cleaned(odd).count() == odd.count()


def test_mixture_odd_documents(spark):
    docs = odd_documents(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(empty_documents(spark)).count() == 0
    small = mixing.mixed(docs.select("doc_id", "source", F.lit(5).cast("long").alias("size")), spark.createDataFrame([("s", 20, 3, 13.5), (None, 40, 1, 0.0)], "source string, source_size long, weight long, target double"), range_rows=1)
    assert sum(r["taken"] for r in small.collect()) == 13
