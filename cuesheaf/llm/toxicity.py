"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the vector of the word itself, if training knew it, joined to the mean of its hashed character
n-gram vectors. A window of WINDOW words runs through a GRU in both directions, attention pools
its states, and a sigmoid gives its probability; windows overlap and cover the whole text, and a
document has the probability of its worst window. Training reads a bounded, hash-ordered sample
of labelled documents; vectors start from log-odds of the labels, each toxic document gives its
likeliest window and the others give theirs and random ones.

Defined cases: a null text counts as empty; an empty one, or any where training saw fewer than two
classes, scores 0; a very long text is scored in all its windows, a very long word by all its 3-grams; of equally likely windows the
first trains; null ids and labels teach nothing; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, small_batches, trigram_slots, utf8

WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 6, 8, 6
CHAR_BITS = 14
CHAR_SLOTS = 1 << CHAR_BITS
SAMPLE_PER_CLASS = 1200
EPOCHS = 5
THRESHOLD = 0.3
LEAST_STEPS = 260
#: ASCII characters other than letters and digits end a word.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: bytes) -> list[bytes]:
    return text.lower().translate(_BREAKS).split()


def char_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character 3-grams of all words, one word after the other, and how many each word has."""
    return trigram_slots(words, CHAR_BITS)


def char_means(table: np.ndarray, words: list[bytes], step: int = 1 << 20) -> np.ndarray:
    """Mean of the table's rows at each word's slots; at most `step` rows are held at a time, however long a word is."""
    slots, size = char_slots(words)
    first = np.cumsum(size) - size
    out = np.zeros((len(words), table.shape[1]), table.dtype)
    for lo in range(0, len(slots), step):
        a, b = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + step)
        out[a:b] += np.add.reduceat(table[slots[lo : lo + step]], np.maximum(first[a:b] - lo, 0))
    return out / size[:, None]


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Net:
    """Weights by name; words: place of a known word in the table `word`."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def start(*shape):
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.words: dict[bytes, int] = {}
        self.w = {"char": start(CHAR_SLOTS, CHAR_DIM) * 0.1, "word": np.zeros((1, WORD_DIM), np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": start(d, 3 * h), f"u{side}": start(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.w |= {"wa": start(2 * h, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": start(ATTENTION), "wo": start(2 * h), "bo": np.zeros(1, np.float32)}
        self.ready = False

    def vectors(self, words: list[bytes]) -> np.ndarray:
        chars = char_means(self.w["char"], words)
        return np.concatenate([self.w["word"][[self.words.get(w, 0) for w in words]], chars], 1, dtype=np.float32)

    def one_way(self, x: np.ndarray, mask: np.ndarray | None, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps x rows x HIDDEN) of projected inputs x (steps x rows x 3 HIDDEN), in reading order."""
        u, n = self.w[f"u{side}"], HIDDEN
        h, out, saved = np.zeros((x.shape[1], n), np.float32), np.empty((x.shape[0], x.shape[1], n), np.float32), []
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            hu = h @ u
            gates = sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
            if keep:
                saved.append((t, h, z, r, new, hu[:, 2 * n :]))
            h = new + z * (h - new)
            if mask is not None:
                h *= mask[t]
            out[t] = h
        return out, saved

    def pooled(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a = np.tanh(states @ self.w["wa"] + self.w["ba"])
        e = np.exp(a @ self.w["va"])
        if mask is not None:
            e *= mask[:, :, 0]
        share = e / np.maximum(e.sum(0), 1e-9)
        s = np.einsum("tr,trh->rh", share, states)
        return a, share, s, sigmoid(s @ self.w["wo"] + self.w["bo"][0])

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.w[f"x{s}"] + self.w[f"c{s}"] for s in "fb"], 1)

    def forward(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Probabilities of windows: ids (steps x rows) into the table of projected words."""
        x = table[ids]
        n = 3 * HIDDEN
        f, _ = self.one_way(x[:, :, :n], mask, "f", False)
        b, _ = self.one_way(x[:, :, n:], mask, "b", False)
        return self.pooled(np.concatenate([f, b], 2), mask)[3]

    def gradients(self, words: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy: by weight, and of each row of the word vectors."""
        w, n = self.w, HIDDEN
        x = words[ids]
        p = {s: x @ w[f"x{s}"] + w[f"c{s}"] for s in "fb"}
        run = {s: self.one_way(p[s], mask, s, True) for s in "fb"}
        states = np.concatenate([run["f"][0], run["b"][0]], 2)
        a, share, s, prob = self.pooled(states, mask)
        g: dict[str, np.ndarray] = {}
        d = ((prob - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = s.T @ d, d.sum(keepdims=True)
        ds = d[:, None] * w["wo"]
        dstates = share[:, :, None] * ds
        dshare = np.einsum("rh,trh->tr", ds, states)
        de = share * (dshare - (share * dshare).sum(0))
        g["va"] = np.einsum("tr,tra->a", de, a)
        da = de[:, :, None] * w["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("trh,tra->ha", states, da), da.sum((0, 1))
        dstates = dstates + da @ w["wa"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            part, u = dstates[:, :, k * n : (k + 1) * n], w[f"u{side}"]
            dh, gu, dp = np.zeros((x.shape[1], n), np.float32), np.zeros_like(u), np.zeros_like(p[side])
            for t, h, z, r, new, hn in reversed(run[side][1]):
                dh = (dh + part[t]) * mask[t]
                dz = dh * (h - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * hn * r * (1 - r)
                dp[t] = np.concatenate([dz, dr, dn], 1)
                back = np.concatenate([dz, dr, dn * r], 1)
                gu += h.T @ back
                dh = dh * z + back @ u.T
            g[f"u{side}"], g[f"c{side}"] = gu, dp.sum((0, 1))
            g[f"x{side}"] = np.einsum("trd,trg->dg", x, dp)
            dx += dp @ w[f"x{side}"].T
        dwords = np.zeros_like(words)
        np.add.at(dwords, ids, dx)
        return g, dwords

    def train(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11, batch: int = 64, from_odds: bool = True) -> Net:
        if len(set(labels)) < 2:
            return self
        rng = np.random.default_rng(seed)
        docs, y = [normal(t) for t in texts], np.array(labels)
        seen = [Counter(w for d, k in zip(docs, labels, strict=True) if k == c for w in set(d)) for c in (0, 1)]
        total = np.bincount(y, minlength=2)
        odds = {}
        for w in seen[0].keys() | seen[1].keys():
            n0, n1 = seen[0][w], seen[1][w]
            odds[w] = (np.log((n1 + 0.5) / (total[1] + 1)) - np.log((n0 + 0.5) / (total[0] + 1))) * (n0 + n1) / (n0 + n1 + 3)
        ranked = sorted((w for w in odds if w and seen[0][w] + seen[1][w] >= 3), key=lambda w: (-abs(odds[w]), w))
        self.words = {w: k for k, w in enumerate(ranked, 1)}
        self.w["word"] = (rng.standard_normal((len(ranked) + 1, WORD_DIM)) * 0.05).astype(np.float32)
        self.w["word"][0] = 0
        if from_odds:
            self.w["word"][1:, 0] = [odds[w] for w in ranked]
        sums = np.zeros((2, CHAR_SLOTS))
        if ranked:
            slots, size = char_slots(ranked)
            np.add.at(sums[0], slots, np.repeat([odds[w] for w in ranked], size))
            np.add.at(sums[1], slots, 1)
        if from_odds:
            self.w["char"][:, 0] = sums[0] / (sums[1] + 1)
        pieces = []
        for d, label in zip(docs, labels, strict=True):
            starts = windows(len(d))
            if not starts:
                continue
            value = [sum(max(0.0, odds[w]) ** 2 for w in d[s : s + WINDOW] if w in self.words) for s in starts]
            best = starts[int(np.argmax(value))]
            pieces.append((d[best : best + WINDOW], label))
            if label == 0 and len(starts) > 1:
                s = starts[int(rng.integers(len(starts)))]
                pieces.append((d[s : s + WINDOW], 0))
        toxic = [p for p in pieces if p[1]]
        pieces += toxic * min(4, len(pieces) // (3 * len(toxic) or 1) - 1)
        vocabulary = {w: k for k, w in enumerate(sorted({w for p, _ in pieces for w in p}))}
        place = np.array([self.words.get(w, 0) for w in vocabulary])
        flat, size = char_slots(list(vocabulary))
        first = np.cumsum(size) - size
        moments: dict[str, list[np.ndarray]] = {}
        step = 0
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(pieces))))):
            order = rng.permutation(len(pieces))
            for lo in range(0, len(order), batch):
                part = [pieces[k] for k in order[lo : lo + batch]]
                ids, mask = packed([[vocabulary[w] for w in p] for p, _ in part])
                used, ids = np.unique(ids, return_inverse=True)
                ids = ids.reshape(mask.shape[:2])
                n = size[used]
                at = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                chars = np.add.reduceat(self.w["char"][flat[at]], np.cumsum(n) - n) / n[:, None]
                words = np.concatenate([self.w["word"][place[used]], chars], 1, dtype=np.float32)
                g, dwords = self.gradients(words, ids, mask, np.array([k for _, k in part], np.float32))
                step += 1
                rate = 0.01 * min(1, step / 10)
                for name, grad in g.items():
                    m = moments.setdefault(name, [np.zeros_like(self.w[name]), np.zeros_like(self.w[name])])
                    m[0] += 0.1 * (grad - m[0])
                    m[1] += 0.01 * (grad * grad - m[1])
                    self.w[name] = self.w[name] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
                known = place[used] > 0
                np.subtract.at(self.w["word"], place[used][known], 0.5 * dwords[known, :WORD_DIM])
                np.subtract.at(self.w["char"], flat[at], np.repeat(0.5 * dwords[:, WORD_DIM:] / n[:, None], n, 0))
        self.ready = True
        return self


def packed(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask, steps first, of windows padded to the longest."""
    steps = max(map(len, rows))
    ids, mask = np.zeros((steps, len(rows)), np.int64), np.zeros((steps, len(rows), 1), np.float32)
    for k, r in enumerate(rows):
        ids[: len(r), k] = r
        mask[: len(r), k] = 1
    return ids, mask


class Scorer:
    """Scores texts by a net; keeps the projected vectors of the words met, up to a bound."""

    def __init__(self, net: Net, most: int = 400_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list({words[k] for k in missing})
            known = len(self.place)
            while len(self.table) < known + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[known : known + len(new)] = self.net.projected(self.net.vectors(new))
            self.place.update(zip(new, range(known, known + len(new)), strict=True))
            out[missing] = [self.place[words[k]] for k in missing]
        return out

    def scores(self, texts: list[bytes], rows: int = 512) -> np.ndarray:
        """The highest probability of a window of each text."""
        out = np.zeros(len(texts))
        if not self.net.ready:
            return out
        if len(self.place) > self.most:
            self.clear()
        docs = [normal(t) for t in texts]
        ids = self.ids(list(chain.from_iterable(docs)))
        at = np.cumsum([0, *map(len, docs)]).tolist()
        full = [(at[k] + s, k) for k, d in enumerate(docs) if len(d) >= WINDOW for s in windows(len(d))]
        for lo in range(0, len(full), rows):
            starts, owner = np.array(full[lo : lo + rows]).T
            p = self.net.forward(self.table, ids[starts + np.arange(WINDOW)[:, None]], None)
            np.maximum.at(out, owner, p)
        short = sorted((len(d), k) for k, d in enumerate(docs) if 0 < len(d) < WINDOW)
        for lo in range(0, len(short), rows):
            owner = [k for _, k in short[lo : lo + rows]]
            out[owner] = self.net.forward(self.table, *packed([ids[at[k] : at[k + 1]] for k in owner]))
        return out


def detect(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out_fold: int = 2, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text); labels (doc_id, toxic)."""
    known = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1) & ~in_fold(F.col("doc_id"), folds, held_out_fold))
    sample, _ = labelled_sample(docs, known, per_class)
    net = Net().train([t.encode() for t, _ in sample], [y for _, y in sample])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in small_batches(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(utf8(b.column(1))), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held_out_fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
