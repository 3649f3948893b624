"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character 1- to 3-grams that both hold (presence, not
counts), over the root of the product of the numbers that each holds. The n-grams stand in 65,536 hashed slots; those
that share a slot count as one, which matters only for texts of tens of thousands of different n-grams.
A Nyström map on landmark documents, picked by a hash of their text, turns kernel ridge regression,
one language against the rest, into a product with the landmarks' presence matrix; batches of
documents are scored by two matrix products. With all training documents as landmarks it is the exact regression.

Defined cases: a null text or one without a letter is `und` with score 0; rows without lang teach
nothing; with no language to learn every answer is `und`; of languages with the same margin the first by code point is
the answer; a very long text has its n-grams all counted; repeated rows are answered alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, small_batches

SLOT_BITS = 16
LONGEST = 3
#: Training documents per language, and landmarks in all (at least 4 per language).
SAMPLE_PER_LANG = 250
LANDMARKS = 64
RIDGE = 1e-2


def presence(text: str) -> np.ndarray:
    """Which of the hashed 1- to 3-grams the lower-cased text holds."""
    out = np.zeros(1 << SLOT_BITS, bool)
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        out[((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)] = True
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[:64].isalpha() or any(map(str.isalpha, text)))


class Machine:
    """Landmark rows (slots x landmarks), their sizes, and the weights of each language."""

    def __init__(self, sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        by_lang = defaultdict(list)
        for text, lang in sorted(sample, key=lambda x: (xxhash.xxh3_64_intdigest(x[0] or ""), x[1])):
            if has_letter(text):
                by_lang[lang].append(presence(text))
        self.langs = sorted(by_lang)
        if not self.langs:
            return
        each = max(4, landmarks // len(self.langs))
        marks = np.stack([x for lang in self.langs for x in by_lang[lang][:each]])  # in the order of the hash
        rows = np.stack([x for lang in self.langs for x in by_lang[lang]])
        truth = np.repeat(np.arange(len(self.langs)), [len(by_lang[lang]) for lang in self.langs])
        self.marks, self.sizes = np.ascontiguousarray(marks.T.astype(np.float32)), marks.sum(1).astype(np.float32)
        values, vectors = np.linalg.eigh(self.kernel(marks).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        z = self.kernel(rows) @ root
        y = np.where(truth[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = 1 / np.bincount(truth)[truth]
        zw = z * weight[:, None]
        self.mean = (weight @ y) / weight.sum()
        self.weights = (root @ np.linalg.solve(z.T @ zw + ridge * np.eye(z.shape[1]) * weight.mean(), zw.T @ (y - self.mean))).astype(np.float32)

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        size = rows.sum(1).astype(np.float32)
        return (rows.astype(np.float32) @ self.marks) / np.sqrt(np.maximum(size, 1)[:, None] * self.sizes)

    def answers(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for lo in range(0, len(known), batch):
            part = known[lo : lo + batch]
            margin = self.kernel(np.stack([presence(texts[i]) for i in part])) @ self.weights + self.mean
            best = margin.argmax(1)
            for i, k, m in zip(part, best.tolist(), margin.max(1).tolist(), strict=True):
                langs[i], scores[i] = self.langs[k], min(1.0, max(0.0, (m + 1) / 2))
        return langs, scores


def identify(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs (doc_id, text, lang)."""
    known = docs.select("doc_id", F.col("lang").alias("label")).filter(~in_fold(F.col("doc_id"), folds, held_out_fold) & F.col("label").isNotNull())
    sample, _ = labelled_sample(docs, known, per_lang)
    sent = docs.sparkSession.sparkContext.broadcast(Machine(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            langs, scores = sent.value.answers(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held_out_fold).alias("held_out"), "lang_pred", "score")
