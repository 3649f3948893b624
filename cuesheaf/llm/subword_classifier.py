"""Quality classifier on supervised subword embeddings.

A word is the mean of the vectors of its hashed form and of its hashed character 3-grams; a hashed word
2-gram has a vector of its own. A document is the mean over its words of the word and of the 2-gram that
ends with it; a linear layer and softmax give the class. The vectors and the layer are trained by
numpy stochastic gradient descent on a bounded, hash-ordered sample of labelled documents; every
document is scored over its whole text by the executors, each different word of a batch once.

Defined cases: a null text counts as empty, and an empty one gets the share of label 1 among the
training rows; with no training row or one class only, that share (or 0.5) is every score; a very long text or word is read to
its end; equal scores need no order; repeated rows are scored alike; labels of one doc_id that differ count as rows of
their own; null ids and labels teach nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, mixed, small_batches, trigram_slots, utf8, word_hashes

#: Binary digits of the slots of character 3-grams, of words and of word 2-grams, one after the other in one table.
GRAM_BITS, WORD_BITS, PAIR_BITS = 16, 16, 18
WORDS = 1 << GRAM_BITS
PAIRS = WORDS + (1 << WORD_BITS)
SLOTS = PAIRS + (1 << PAIR_BITS)
DIM = 12
#: Labelled rows that training reads at most, per class.
SAMPLE_PER_CLASS = 1500
EPOCHS = 5
THRESHOLD = 0.3
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_slots(hashes: np.ndarray) -> np.ndarray:
    return WORDS + (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def pair_slots(hashes: np.ndarray) -> np.ndarray:
    """Slot of each 2-gram of a sequence of word hashes."""
    return PAIRS + (mixed(hashes[:-1] * _LEFT + hashes[1:] * _RIGHT) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and the weight of each."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    h = word_hashes(words)
    grams, size = trigram_slots(words, GRAM_BITS)
    own = 1 / (size + 1)
    slots = np.concatenate([grams, word_slots(h), pair_slots(h)])
    weight = np.concatenate([np.repeat(own, size), own, np.ones(len(h) - 1)]) / len(words)
    used, at = np.unique(slots, return_inverse=True)
    return used, np.bincount(at, weight).astype(np.float32)


class Model:
    """Embedding (SLOTS x DIM), output weights (DIM x 2) and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.random((SLOTS, DIM), np.float32) - 0.5) / DIM
        self.embedding[PAIRS:] = 0
        self.out, self.bias, self.prior = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32), 0.5

    def train(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> Model:
        y = np.array(labels, np.int64)
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(set(labels)) < 2:
            return self
        docs = [features(t) for t in texts]
        weight = len(y) / (2 * np.bincount(y, minlength=2).clip(1))
        prior_shift = np.log(np.bincount(y, minlength=2) / len(y))
        rng, steps, step = np.random.default_rng(seed), epochs * len(y), 0
        for _ in range(epochs):
            for k in rng.permutation(len(y)):
                ids, share = docs[k]
                step += 1
                if not len(ids):
                    continue
                vec = share @ self.embedding[ids]
                z = vec @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1
                p *= np.float32(rate * (1 - step / (steps + 1)) * weight[y[k]])
                grad = self.out @ p
                self.out -= np.outer(vec, p)
                self.bias -= 0.1 * p
                self.embedding[ids] -= (share * 20)[:, None] * grad[None, :]
        self.bias = (self.bias + prior_shift).astype(np.float32)  # from even classes to those of the rows
        return self

    def slot_logits(self) -> np.ndarray:
        """What each slot adds to the difference of the two logits."""
        return (self.embedding @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


class Scorer:
    """Scores texts by slot logits, bias and prior; keeps the logits and hashes of the words met, up to a bound."""

    def __init__(self, logits: np.ndarray, bias: float, prior: float, most: int = 300_000):
        self.logits, self.bias, self.prior, self.most = logits, bias, prior, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.values, self.hashes = np.zeros(4096), np.zeros(4096, np.uint64)

    def places(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list({words[k]: None for k in missing})
            known = len(self.place)
            if len(self.values) < known + len(new):
                room = max(known + len(new), 2 * len(self.values))
                self.values, self.hashes = np.resize(self.values, room), np.resize(self.hashes, room)
            h = word_hashes(new)
            grams, size = trigram_slots(new, GRAM_BITS)
            first = np.cumsum(size) - size
            self.values[known : known + len(new)] = (np.add.reduceat(self.logits[grams].astype(np.float64), first) + self.logits[word_slots(h)]) / (size + 1)
            self.hashes[known : known + len(new)] = h
            self.place.update(zip(new, range(known, known + len(new)), strict=True))
            out[missing] = [self.place[words[k]] for k in missing]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        out = np.full(len(texts), self.prior)
        if len(self.place) > self.most:
            self.clear()
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        full = n > 0
        if not full.any():
            return out
        at = self.places(list(chain.from_iterable(split)))
        value = self.values[at]
        value[1:] += self.logits[pair_slots(self.hashes[at])]
        first = (np.cumsum(n) - n)[full]
        value[first] = self.values[at[first]]  # no 2-gram ends with a text's first word
        out[full] = 1 / (1 + np.exp(-np.clip(np.add.reduceat(value, first) / n[full] + self.bias, -30, 30)))
        return out


def trained(docs: DataFrame, known: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of the texts of docs whose label known (doc_id, label 0/1) holds; at most `per_class` of each label are read."""
    picked, counts = labelled_sample(docs, known.filter(F.col("label").isin(0, 1)), per_class)
    model = Model().train([t.encode() for t, _ in picked], [y for _, y in picked])
    total = sum(counts.values())
    if total:
        share, used = counts.get(1, 0) / total, sum(y for _, y in picked) / max(1, len(picked))
        if 0 < share < 1 and 0 < used < 1:  # from the sample's classes to those of all labels
            model.bias += np.array([np.log((1 - share) / (1 - used)), np.log(share / used)], np.float32)
        model.prior = share
    return model


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((model.slot_logits(), float(model.bias[1] - model.bias[0]), model.prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(utf8(b.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more; all columns stay and nothing is shuffled."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in small_batches(batches):
            texts = utf8(b.column(b.schema.get_field_index("text")))
            yield b.filter(pa.array(scorer.scores(texts) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out_fold: int = 0, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose crc32 of doc_id mod `folds` is `held_out_fold` teach nothing."""

    known = labels.select("doc_id", F.col(label).alias("label")).filter(~in_fold(F.col("doc_id"), folds, held_out_fold))
    out = score(docs, trained(docs, known, per_class))
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held_out_fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
