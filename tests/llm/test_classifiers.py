"""The three trained classifiers, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuesheaf.llm import common, queries, secret_ledger, string_kernel, subword_classifier, toxicity

from ..conftest import SMALL
from .helpers import empty_documents, odd_documents

MEDIUM = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def accuracy(out, truth, column, answer):
    both = out.filter("held_out").join(truth, "doc_id").select(column, answer).collect()
    return sum(r[0] == r[1] for r in both) / len(both)


def precision_recall(out, truth, answer):
    both = [(r["predicted"], r[answer]) for r in out.filter("held_out").join(truth, "doc_id").select("predicted", answer).collect()]
    hit = sum(p * t for p, t in both)
    return hit / sum(p for p, _ in both), hit / sum(t for _, t in both)


def test_language_of_held_out_documents(spark):
    out = queries.op6_string_kernel(spark, MEDIUM).cache()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert out.count() == docs.count()
    assert accuracy(out, docs, "lang_pred", "lang") > 0.98
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_quality_of_held_out_documents(spark):
    out = queries.op10_subword_quality(spark, MEDIUM).cache()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    precision, recall = precision_recall(out, labels, "quality")
    assert precision > 0.95 and recall > 0.95 and accuracy(out, labels, "predicted", "quality") > 0.95
    assert out.filter("score < 0 OR score > 1").count() == 0


@pytest.mark.parametrize(("folder", "least_precision", "least_recall"), [(MEDIUM, 0.55, 0.6), (LARGE, 0.7, 0.9)])
def test_toxicity_of_held_out_documents(spark, folder, least_precision, least_recall):
    out = queries.op7_bigru_toxicity(spark, folder).cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    precision, recall = precision_recall(out, labels, "toxic")
    assert precision > least_precision and recall > least_recall
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_exact_ridge_regression_with_all_landmarks():
    """Every document a landmark: the answers of one-versus-rest kernel ridge regression, solved directly."""
    rng = np.random.default_rng(1)
    words = {"aa": ["uno", "due", "tre", "sei"], "bb": ["one", "two", "six", "ten"], "cc": ["een", "twee", "zes", "tien"]}
    sample = [(" ".join(rng.choice(w, 5)) + f" {lang}{i}", lang) for lang, w in words.items() for i in range(6)]
    m = string_kernel.Machine(sample, landmarks=100)
    new = [" ".join(rng.choice(w, 4)) for w in words.values()]

    def grams(t):
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    def kernel(x, y):
        return np.array([[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in y] for a in x])

    texts = [t for t, _ in sample]
    y = np.array([[1.0 if lang == other else -1.0 for other in sorted(words)] for _, lang in sample])
    weight = 1 / 6
    k, mean = kernel(texts, texts), y.mean(0)
    alpha = np.linalg.solve(k * weight + string_kernel.RIDGE * weight * np.eye(len(texts)), weight * (y - mean))
    margin = kernel(new, texts) @ alpha + mean
    langs, scores = m.answers(new)
    assert langs == [sorted(words)[i] for i in margin.argmax(1)] == list(words)
    assert np.allclose(scores, np.clip((margin.max(1) + 1) / 2, 0, 1), atol=2e-3)


def test_quality_scores_equal_a_plain_loop():
    texts = [b"", b"one", b"good words go here", b"bad bad bad junk", b"good \xc3\xa9 " * 50, b"x" * 300]
    model = subword_classifier.Model().train(texts * 6, [0, 1, 1, 0, 1, 0] * 6)
    found = subword_classifier.Scorer(model.slot_logits(), float(model.bias[1] - model.bias[0]), model.prior, most=3)
    e = model.embedding.astype(np.float64)
    for text, score in zip(texts, found.scores(texts), strict=True):
        words = text.split()
        total = np.zeros(subword_classifier.DIM)
        for i, w in enumerate(words):
            slots = [*common.trigram_slots([w], subword_classifier.GRAM_BITS)[0], *subword_classifier.word_slots(common.word_hashes([w]))]
            total += e[slots].mean(0)
            if i:
                total += e[subword_classifier.pair_slots(common.word_hashes(words[i - 1 : i + 1]))[0]]
        z = total / max(1, len(words)) @ model.out + model.bias
        assert abs(score - (np.exp(z[1]) / np.exp(z).sum() if words else model.prior)) < 1e-4
    assert np.allclose([found.scores([t])[0] for t in texts], found.scores(texts))


def test_window_scores_equal_a_plain_loop():
    """One word at a time, by the equations of the net."""
    net = toxicity.Net().train([b"a bad word here", b"all is fine"] * 20, [1, 0] * 20)
    w, n = {k: v.astype(np.float64) for k, v in net.w.items()}, toxicity.HIDDEN

    def window(words):
        x = [np.concatenate([w["word"][net.words.get(v, 0)], w["char"][toxicity.char_slots([v])[0]].mean(0)]) for v in words]
        both = []
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, states = np.zeros(n), [None] * len(x)
            for t in order:
                p, u = x[t] @ w[f"x{side}"] + w[f"c{side}"], h @ w[f"u{side}"]
                z, r = toxicity.sigmoid(p[:n] + u[:n]), toxicity.sigmoid(p[n : 2 * n] + u[n : 2 * n])
                h = states[t] = z * h + (1 - z) * np.tanh(p[2 * n :] + r * u[2 * n :])
            both.append(states)
        s = np.concatenate([np.array(b) for b in both], 1)
        e = np.exp(np.tanh(s @ w["wa"] + w["ba"]) @ w["va"])
        return toxicity.sigmoid((e / e.sum()) @ s @ w["wo"] + w["bo"][0])

    texts = [b"bad", b"fine all is", b"fine " * 70 + b"bad " + b"is " * 40, b"a word, here! " * 30]
    for text, score in zip(texts, toxicity.Scorer(net).scores(texts), strict=True):
        words = toxicity.normal(text)
        assert abs(score - max(window(words[s : s + toxicity.WINDOW]) for s in toxicity.windows(len(words)))) < 1e-3


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (i + 1), f"l{i % 50}") for i in range(400)], "doc_id long, text string, label string")
    sample, counts = common.labelled_sample(docs, docs.select("doc_id", "label"), 5, most_rows=100, most_bytes=300)
    assert len(counts) == 50 and len(sample) <= 100 and max(len(t) for t, _ in sample) <= 300
    few, _ = common.labelled_sample(docs, docs.select("doc_id", "label"), 5, most_rows=10)
    assert len(few) == 10 and len({label for _, label in few}) == 10


def test_presence_kernel_equals_sets():
    texts = ["the cat sat", "a dog ran by", "le chat dort"]
    m = string_kernel.Machine([(t, str(i)) for i, t in enumerate(texts)])
    marks = [string_kernel.presence(t) for t in texts]
    k = m.kernel(np.stack(marks))
    for i, a in enumerate(marks):
        assert abs(k[i, i] - 1) < 1e-5
        for j, b in enumerate(marks):
            assert abs(k[i, j] - (a & b).sum() / np.sqrt(a.sum() * b.sum())) < 1e-5


def test_languages_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = {r["doc_id"]: r for r in string_kernel.identify(docs).collect()}
    assert len(out) == 10 and out[0]["lang_pred"] == out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and out[0]["score"] == 0
    assert out[5]["lang_pred"] in ("en", "de")
    assert string_kernel.identify(empty_documents(spark)).count() == 0
    unknown = string_kernel.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}


def test_gradients_equal_differences():
    net = toxicity.Net(3)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    rng = np.random.default_rng(0)
    words = rng.standard_normal((7, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    ids, mask = toxicity.packed([[0, 1, 2, 3], [4, 5], [6, 1, 1]])
    y = np.array([1.0, 0.0, 1.0])

    def forward_loss():
        x = words[ids]
        states = np.concatenate([net.one_way(x @ net.w[f"x{s}"] + net.w[f"c{s}"], mask, s, False)[0].astype(np.float64) for s in "fb"], 2)
        p = net.pooled(states, mask)[3]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, dwords = net.gradients(words, ids, mask, y)
    for name, grad in [*g.items(), ("words", dwords)]:
        value = words if name == "words" else net.w[name]
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(3)]:
            old, step = value[at], 1e-2
            value[at] = old + step
            up = forward_loss()
            value[at] = old - step
            down = forward_loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3, name


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200, 1000])
def test_windows_cover_and_overlap(n):
    starts = toxicity.windows(n)
    assert set().union(*(range(s, min(n, s + toxicity.WINDOW)) for s in starts)) == set(range(n))
    assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_scores_do_not_depend_on_the_batch():
    net = toxicity.Net().train([b"a bad word here", b"all is fine"] * 20, [1, 0] * 20)
    texts = [b"", b"fine", b"bad", b"fine " * 500 + b"bad " + b"fine " * 300, b"all " * 64]
    whole = toxicity.Scorer(net).scores(texts)
    alone = [toxicity.Scorer(net).scores([t])[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-4) and whole[0] == 0 and whole[2] > 0.5 > whole[1]


def test_character_ngrams_reach_the_end_of_a_long_word():
    long = b"x" * 200
    assert toxicity.char_slots([long + b"bad", b"", b"bad"])[1].tolist() == [203, 1, 3]
    assert toxicity.char_slots([long + b"bad"])[0][-2:].tolist() == toxicity.char_slots([b"xbad"])[0][-2:].tolist()
    assert {int(x) for x in common.trigram_slots([b"xbad"], subword_classifier.GRAM_BITS)[0][-3:]} <= {int(x) for x in subword_classifier.features(long + b"bad")[0]}
    table = np.random.default_rng(0).random((toxicity.CHAR_SLOTS, 3))
    words = [long, b"a", b"", b"some", b"y" * 77 + long, b"z"]
    expected = [table[toxicity.char_slots([w])[0]].mean(0) for w in words]
    assert all(np.allclose(toxicity.char_means(table, words, step), expected) for step in (1 << 20, 1, 7, 100))


def test_classifiers_bear_odd_documents(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, None, None), (7, 0, 1), (8, 1, 0), (99, 1, 1), (None, 1, 0)], none.schema)
    for labels in (none, some, some.filter("quality = 1")):
        for f in (subword_classifier.classify, toxicity.detect):
            out = f(docs, labels).collect()
            assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
            assert f(empty_documents(spark), labels).count() == 0


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).cache()
        assert out.schema.names == first.schema.names and 0 < out.count() <= docs.count(), name
        docs = out
    assert all(not [k for k, _, _ in secret_ledger.scan(r["text"]) if k in secret_ledger.KINDS] for r in docs.collect())
    kept = {r["doc_id"] for r in docs.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()}
    assert len(kept & good) > 0.7 * len(good)
    mixed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in mixed} == kept
    assert abs(sum(r["taken"] for r in mixed) - 1.5 * sum(r["size"] for r in mixed)) < len({r["source"] for r in mixed})


def test_quality_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "quality AS label")
    model = subword_classifier.trained(docs, labels)
    rows = docs.collect()
    embedding, scores = model.embedding.astype(np.float64), []
    for r in rows:
        slots, weight = subword_classifier.features(r["text"].encode())
        z = weight @ embedding[slots] @ model.out + model.bias
        scores.append(np.exp(z[1]) / np.exp(z).sum() if len(slots) else model.prior)
    expected = {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= 0.3}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SMALL).collect()} == expected


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_pipeline_of_odd_and_empty_documents(spark, tmp_path, make):
    docs = make(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        last, now = now, stage(spark, now, str(tmp_path))
        assert now.columns == (docs.columns if stage is not corpus_pipeline.mixture else [*(c for c in docs.columns if c not in ("taken", "epoch")), "epoch", "taken"])
        assert now.count() <= max(last.count(), 1) * 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) <= docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
