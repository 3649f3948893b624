"""Token alignment against a plain loop, the byte-level tokenizer against its own library, and galloping against bisection."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cuesheaf.llm import token_alignment as T

from ..conftest import SMALL
from .helpers import empty_documents, odd_documents, rows

FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["  a\tb 　c d", "x" * 3000, "\x00a\x00", "a\r\nb", "é漢字😀 <s></s> <0x41> <|endoftext|>", "▁ block", "ﬁ Å", "١٢٣ ²½ Ⅷ", " ", "\n\n\n   \n", "don't I'LL", "don't I'LL", "<unk>"]


@pytest.fixture(scope="module")
def tokenizers():
    return T.Tokenizers(*T.loaded())


def brute(docs, t):
    """Rows of (doc_id, text), with ids from the byte-level tokenizer's own library."""
    own = Tokenizer.from_file(f"{T.FOLDER}/{T.BYTE_FILE}")
    own.encode_special_tokens = True
    found = []
    for doc, text in docs:
        groups = []
        if text:
            a, b = own.encode(" " + text, add_special_tokens=False).ids, t.pieces.encode(text)
            want = (" " + text).encode()
            if b"".join(t.a[i] for i in a) == want == b"".join(t.b[i] for i in b):
                left, right, i, j, x, y = [], [], 0, 0, 0, 0
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        left.append(a[i])
                        x += len(t.a[a[i]])
                        i += 1
                    else:
                        right.append(b[j])
                        y += len(t.b[b[j]])
                        j += 1
                    if x == y and right:
                        groups.append((left, right))
                        left, right = [], []
        found.append((doc, groups))
    linked = [Counter((p, q) for g in groups for p in g[0] for q in g[1]) for _, groups in found]
    count = Counter(k for c in linked for k in c)
    top = {}
    for (p, _), n in count.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for (doc, groups), c in zip(found, linked, strict=True):
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        best = sum(n for k, n in c.items() if count[k] == top[k[0]])
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()), best, sum(n * count[k] for k, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_galloping_equals_bisection():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 400), (40, 41), (300, 20_000), (5000, 5000)):
        long = np.cumsum(r.integers(1, 9, m))
        short = np.unique(np.r_[r.integers(1, long[-1] + 1, n), long[-1]])
        assert T.gallop(short, long).tolist() == [bisect_left(long.tolist(), x) for x in short.tolist()]
        at_a, at_b = T.common_ends(long, short)
        assert long[at_a].tolist() == sorted(set(long.tolist()) & set(short.tolist())) == short[at_b].tolist()


@pytest.mark.parametrize("part_pairs", [T.PART_PAIRS, 150])
def test_alignment_equals_plain_loop(spark, tokenizers, part_pairs):
    docs = odd_documents(spark, *((100 + k, x, None, None, None, 1, 2, "x", 3, "p") for k, x in enumerate(ODD)))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], tokenizers)
    assert rows(T.alignment(docs.repartition(3), part_pairs=part_pairs), *FIELDS) == want


def test_alignment_of_documents_equals_plain_loop(spark, tokenizers):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows(T.alignment(docs), *FIELDS) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], tokenizers)


def test_links_of_large_groups(monkeypatch):
    r = random.Random(5)
    a, b = np.array([r.randrange(9) for _ in range(120)]), np.array([r.randrange(7) for _ in range(90)])
    own_a, own_b, doc = np.array([0, 59, 60, 119]), np.array([0, 9, 40, 89]), np.array([0, 0, 1, 2])
    want = T.links(a, b, own_a, own_b, doc, 10)
    monkeypatch.setattr(T, "LINKS_AT_ONCE", 20)
    for x, y in zip(want, T.links(a, b, own_a, own_b, doc, 10), strict=True):
        assert x.tolist() == y.tolist()


def test_no_documents_and_none_with_tokens(spark):
    assert T.alignment(empty_documents(spark)).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(T.alignment(only), *FIELDS) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
