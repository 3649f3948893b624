"""Conversation repair against a plain search over edits, and the segments of a long conversation against the whole."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cuesheaf.llm import conversation_repair as C

from .helpers import rows

COLUMNS = "conv_id long, turn long, role string, text string, n long, cost string"
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
BLANKS = " \t\n\x0b\f\r"


def damaged(table):
    out = {}
    for conv, turn, role, text in table:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def cheapest(rows):
    """(cost, audit, repaired lines) by one best (cost, audit) for each count of rows used and state of the grammar, from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        t = text.rstrip(BLANKS)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    grow = {"": "u", "s": "u", "u": "a", "a": "u"}
    after = None
    for i in range(len(rows), -1, -1):
        best = {q: [(0, "", ())] if after is None and q in ("", "a") else [] for q in grow}
        for q in grow if after else ():
            _, role, text = rows[i]
            cut = 3 * (faults[i] == "truncated")
            more = [(4, "D", q, ())]
            if faults[i] not in ("blank", "duplicate"):
                if (q, role[:1]) in step:
                    more.append((cut, "K", role[:1], (f"{role}:{text}",)))
                more.append((3 + cut, "R", grow[q], (f"{ {'u': 'user', 'a': 'assistant'}[grow[q]] }:{text}",)))
            best[q] += [(c + x[0], e + x[1], line + x[2]) for c, e, t, line in more for x in after[t]]
        for _ in range(3):
            for q, t in grow.items():
                name = {"u": "user:", "a": "assistant:"}[t]
                best[q] = sorted(set(best[q] + [(x[0] + 3, "I" + x[1], (name,) + x[2]) for x in best[t]]))[:1]
        after = best
    return after[""][0], faults


def brute(table):
    out = []
    for conv, r in damaged(table).items():
        (cost, audit, lines), faults = cheapest(r)
        t = {x[0] for x in r} - {None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(r, r[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, max(t) - min(t) + 1 - len(t) if t else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_table(seed, conversations, most):
    r = random.Random(seed)
    out = []
    for conv in range(conversations):
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((conv, r.choice([turn, turn, turn, None]), role, r.choice(["Yes.", "no", "", " \t", "What? ", "x" * 9 + "!", None, f"{turn}."])))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_repair_equals_plain_search(spark, parts):
    table = random_table(parts, 120, 9) + [(None, 1, "user", "no id."), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in table], COLUMNS).repartition(parts)
    assert rows(C.repair(C.damaged(df)), *FIELDS) == brute(table)


def test_one_long_conversation_over_all_partitions(spark):
    table = random_table(7, 1, 1) + [(0, t, "user" if t % 2 else ("assistant", "system", "tool")[t % 3], f"{t % 700}" + "." * (t % 5 > 0)) for t in range(3000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in table], COLUMNS)
    assert rows(C.repair(C.damaged(df)), *FIELDS) == brute(table)


def test_segments_compose_to_the_whole():
    r = np.random.default_rng(3)
    for _ in range(60):
        s = r.integers(0, C.N_SYMBOLS, r.integers(2, 40))
        k = int(r.integers(1, len(s)))
        now, cost, state = C.passed(s)
        right, cost_r, state_r = C.passed(s[k:])
        left, cost_l, state_l = C.passed(s[:k])
        assert (left[right] == now).all() and (cost_r + cost_l[right] == cost).all()
        assert all(state_r[v, state_l[right[v], q]] == state[v, q] for v in range(len(now)) for q in range(4))
        assert C.audited(s)[0] == cost[0] + C.tables()[0][now[0]][0]


def test_normal_vectors_are_few():
    assert len(C.tables()[0]) < 256


def test_empty_and_null_only(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], COLUMNS))).count() == 0
    df = spark.createDataFrame([(None, None, None, None, 1, "c")], COLUMNS)
    assert rows(C.repair(C.damaged(df)), *FIELDS) == brute([(None, None, None, None)])
