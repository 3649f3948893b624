"""Reversible line dedup against a plain loop and its SQL; an index after deletions against one that never saw the documents."""

import hashlib

import numpy as np
import pytest

from cuesheaf.llm import line_dedup as L

from ..conftest import SMALL
from .helpers import empty_documents, odd_documents, rows

FIELDS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def brute(docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    rank = lambda d: L.LAST if d is None else d
    owners = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(rank(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(o := owners.get(key(x), ())) > 1 and rank(d) != min(o))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def with_lines(spark):
    more = ["Shared line A\nown line of one\nshared line a", " shared LINE a\t\nshort\nshort", "漢字漢字漢字漢字漢字\nshared line a", "漢字漢字漢字漢字漢字\n漢字漢字漢字漢字漢", "\nÀ shared line\n\n", "à shared line\n", "À shared line", "\x0bÀ shared line\x0c"]
    return odd_documents(spark, *((50 + k, x, None, None, None, 1, 2, "x", 3, "p") for k, x in enumerate(more)))


def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def state(index):
    return rows(index.postings, "hi", "lo", "doc"), rows(index.references, "hi", "lo", "refs", "first", "last")


@pytest.mark.parametrize("batches", [1, 3])
def test_dedup_equals_plain_loop(spark, batches):
    docs = with_lines(spark).repartition(3)
    assert rows(L.digest(L.deduplicated(docs, L.in_batches(docs, batches))), *FIELDS) == brute(table(docs))


def test_dedup_of_documents_equals_sql(spark, same):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    same(L.digest(L.deduplicated(docs, L.in_batches(docs))), L.SQL)


def test_deleted_documents_leave_no_trace(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    gone, rest = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    index = L.insert(L.insert(L.empty_index(spark, 8), docs.filter("doc_id % 2 = 0")), docs.filter("doc_id % 2 = 1"))
    index = L.delete(index, gone.select("doc_id"))
    assert state(index) == state(L.insert(L.empty_index(spark, 8), rest))
    assert rows(L.digest(L.deduplicated(rest, index)), *FIELDS) == brute(table(rest))
    seats = {r["shard"]: np.frombuffer(bytes(r["seats"]), np.uint16) for r in index.filters.collect()}
    held = {r["shard"]: r["n"] for r in index.references.groupBy("shard").agg(L.F.count("*").alias("n")).collect()}
    assert {k: int((v != 0).sum()) for k, v in seats.items()} == {k: held.get(k, 0) for k in seats}
    again = L.insert(index, gone)
    assert rows(L.digest(L.deduplicated(docs, again)), *FIELDS) == brute(table(docs))


def test_filter_knows_what_it_holds_and_forgets_what_it_lost():
    r = np.random.default_rng(2)
    hi, lo = (r.integers(-(2**63), 2**63, 13_000) for _ in range(2))
    f = L.CuckooFilter(12)
    f.insert(hi[:6000], lo[:6000])
    f.insert(hi[6000:], lo[6000:])
    assert not f.full and f.knows(hi, lo).all() and (f.seats != 0).sum() == 13_000
    other = [r.integers(-(2**63), 2**63, 100_000) for _ in range(2)]
    assert f.knows(*other).mean() < 0.001
    f.remove(hi[:9000], lo[:9000])
    assert f.knows(hi[9000:], lo[9000:]).all() and (f.seats != 0).sum() == 4000 and f.knows(hi[:9000], lo[:9000]).mean() < 0.001
    tiny = L.CuckooFilter(1)
    tiny.insert(hi, lo)
    assert tiny.full and tiny.knows(*other).all() and L.CuckooFilter(1, tiny.to_bytes()).full


def test_false_positives_and_filters_that_cannot_seat_their_keys_change_nothing(spark, monkeypatch):
    docs = with_lines(spark)
    monkeypatch.setattr(L.CuckooFilter, "knows", lambda self, hi, lo: np.ones(len(hi), bool))
    assert rows(L.digest(L.deduplicated(docs, L.in_batches(docs))), *FIELDS) == brute(table(docs))


def test_no_documents(spark):
    docs = empty_documents(spark)
    assert L.digest(L.deduplicated(docs, L.in_batches(docs))).count() == 0
