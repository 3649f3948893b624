"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`, by Four-Russians block tables.

A row is one of nine symbols: to be deleted (blank, duplicate), or its role's initial (s, u, a, other), truncated or not. The
costs still to pay from each of the four states of the role grammar are a vector; less its least entry it is one of a few normal
vectors. Tables hold, for every normal vector after a block of up to BLOCK symbols, the normal vector before it and the cost added,
so a conversation is processed from its end a block at a time by lookup. Tracing expands one block after the other: the vectors
inside it are found backward from the one behind it, and each row takes the ASCII-least of the cheapest edits; a state and an edit
determine the next state, so the audit is the least of all cheapest ones.

Rows are sorted by ranges of (conversation, turn), not dealt by conversation: a conversation that crosses partitions is cut into
segments. Each one gives its map of vectors and states, the maps are composed in order (one row a partition), and the segments are
traced apart; only the hash and the audit, which are one value, pass the parts in order as a stream.

Defined cases: a null conv_id is a conversation, a null turn stands before others, a null role or text is one blank. Rows of equal
turn are ordered by role and text after damage; repeated rows are rows of their own (the later ones duplicates). A text of any length is one row.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after s, after u, after a. The one u or a that may follow each, and what a kept initial leads to.
GROW = (2, 2, 3, 2)
NEXT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
N_SYMBOLS, BLOCK = 9, 4
_BLANKS = " \t\n\x0b\f\r"


def symbol(role: str, text: str, repeated: bool) -> tuple[int, str]:
    """The symbol of a row and its fault."""
    t = text.rstrip(_BLANKS)
    if not t:
        return 0, "blank"
    if repeated:
        return 0, "duplicate"
    cut = t[-1] not in ".!?"
    return 1 + 2 * ("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3) + cut, "truncated" if cut else ""


def _closed(g: list[float]) -> list[float]:
    """Costs with insertions before whatever comes next."""
    h = list(g)
    for _ in range(4):
        h = [min(h[q], INSERT + h[GROW[q]]) for q in range(4)]
    return h


def _edits(s: int, q: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state) of a row of symbol s in state q, insertion apart, in ASCII order."""
    yield "D", DELETE, q
    if s:
        role, cut = divmod(s - 1, 2)
        if q in NEXT[role]:
            yield "K", KEEP + TRUNCATED * cut, NEXT[role][q]
        yield "R", REROLE + TRUNCATED * cut, GROW[q]


@cache
def tables() -> tuple[list[tuple], list[np.ndarray], list[np.ndarray], list, np.ndarray]:
    """Normal vectors (the first is that of the end), block tables by length (vector before, cost added), and for (vector after, symbol, state) the edits and the state after.

    A block's code counts its first symbol lowest: s0 + 9 * s1 + 81 * s2 ...
    """
    vectors, at, step, extra = [tuple(_closed([0, np.inf, np.inf, 0]))], {}, [], []
    at[vectors[0]] = 0
    for v in vectors:  # grows while it is read
        row, add = [], []
        for s in range(N_SYMBOLS):
            h = _closed([min(c + v[t] for _, c, t in _edits(s, q)) for q in range(4)])
            low = min(h)
            n = tuple(x - low for x in h)
            if n not in at:
                at[n] = len(vectors)
                vectors.append(n)
            row.append(at[n])
            add.append(low)
        step.append(row)
        extra.append(add)
    one, cost = np.array(step, np.int32), np.array(extra, np.int64)
    nexts, adds = [one], [cost]
    for _ in range(BLOCK - 1):
        rest, spent = nexts[-1], adds[-1]
        nexts.append(one[rest].reshape(len(vectors), -1))
        adds.append((spent[:, :, None] + cost[rest]).reshape(len(vectors), -1))
    traces = [[[_trace(v, vectors[step[k][s]], extra[k][s], s, q) for q in range(4)] for s in range(N_SYMBOLS)] for k, v in enumerate(vectors)]
    ends = np.array([[[t[1] for t in by_state] for by_state in by_symbol] for by_symbol in traces], np.int8)
    return vectors, nexts, adds, traces, ends


def _trace(after: tuple, before: tuple, low: float, s: int, q: int) -> tuple[str, int]:
    edits = ""
    while True:
        want = before[q] + low
        options = [(e, t) for e, c, t in _edits(s, q) if c + after[t] == want]
        if INSERT + before[GROW[q]] + low == want and not (options and options[0][0] == "D"):
            edits, q = edits + "I", GROW[q]
            continue
        return edits + options[0][0], options[0][1]


def _blocks(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, code) of the blocks of a sequence."""
    out = []
    weights = N_SYMBOLS ** np.arange(BLOCK)
    for i in range(0, len(symbols), BLOCK):
        part = symbols[i : i + BLOCK]
        out.append((i, len(part), int(part @ weights[: len(part)])))
    return out


def passed(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a segment does: for each vector behind it the vector before it and the cost added, and for each such vector and state before it the state behind it."""
    vectors, nexts, adds, _, ends = tables()
    now, cost, state = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.tile(np.arange(4, dtype=np.int8), (len(vectors), 1))
    behind = []
    for start, n, code in reversed(_blocks(symbols)):
        inside = now
        for s in symbols[start : start + n][::-1]:
            behind.append(inside.astype(np.uint8))
            inside = nexts[0][inside, s]
        cost += adds[n - 1][now, code]
        now = nexts[n - 1][now, code]
    for v, s in zip(reversed(behind), symbols, strict=True):
        state = ends[v[:, None], s, state]
    return now, cost, state


def audited(symbols: np.ndarray, end: int = 0, state: int = 0) -> tuple[int, list[str], int]:
    """Cost from the starting state, the edits before and of each row, and the state behind the last row, given the vector behind it."""
    vectors, nexts, adds, traces, _ = tables()
    blocks = _blocks(symbols)
    behind, cost = [0] * len(blocks), 0
    v = end
    for k in range(len(blocks) - 1, -1, -1):
        behind[k] = v
        _, n, code = blocks[k]
        cost += int(adds[n - 1][v, code])
        v = int(nexts[n - 1][v, code])
    cost += int(vectors[v][state])
    edits = []
    for (start, n, _), v in zip(blocks, behind, strict=True):
        inside = []
        for s in symbols[start : start + n][::-1].tolist():
            inside.append(traces[v][s])
            v = int(nexts[0][v, s])
        for row in reversed(inside):
            e, state = row[state]
            edits.append(e)
    return cost, edits, state


def closing(state: int) -> str:
    """The insertions that bring a conversation to its end."""
    return ("", "II", "I", "")[state]


def repaired(roles: list[str], texts: list[str], edits: list[str], state: int) -> Iterator[str]:
    """The lines `role:text` after the edits, the last of which may have no row."""
    for k, e in enumerate(edits):
        for x in e:
            if x == "D":
                continue
            if x == "K":
                yield f"{roles[k]}:{texts[k]}"
                state = NEXT["sua".index(roles[k][0])][state]
                continue
            state = GROW[state]
            yield ("user:" if state == 2 else "assistant:") + (texts[k] if x == "R" else "")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): each row by crc32 of `conv_id:turn` modulo 20 dropped (gone), emptied, without [.!?], repeated or a user's."""
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    c = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")
    return c.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies, (F.col("k") == 0).alias("gone"))


_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


def _gaps(turns: list) -> int:
    t = {x for x in turns if x is not None}
    return max(t) - min(t) + 1 - len(t) if t else 0


def _illegal(initials: list[str]) -> int:
    return sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False))


def _whole(turns: list, roles: list[str], texts: list[str]) -> list:
    """The result of a conversation that is whole."""
    seen, symbols, faults = set(), [], []
    for row in zip(roles, texts, strict=True):
        s, fault = symbol(*row, row in seen)
        seen.add(row)
        symbols.append(s)
        faults.append(fault)
    cost, edits, state = audited(np.array(symbols, np.int64))
    lines = repaired(roles, texts, [*edits, closing(state)], 0)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return [_gaps(turns), *counts, _illegal([r[:1] for r in roles]), cost, "".join(edits) + closing(state), hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: results of those inside the partition, the rows themselves of its first and last one."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()),
                        *((n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (x.split()[0] for x in _DONE.split(", ")))])

    def open_rows(run: list[list]) -> pa.RecordBatch:
        ids, turns, roles, texts, _, gone = run
        n = len(ids)
        own = [ids, [part] * n, list(range(n)), turns, roles, texts, gone]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own + [[None] * n] * 8, schema, strict=True)], schema=schema)

    done: list[list] = []

    def flush() -> pa.RecordBatch:
        columns = [[r[0] for r in done], *([[None] * len(done)] * 6), *zip(*(r[1:] for r in done), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held = None
    for k, run in enumerate(runs(small_batches(batches), 1)):
        if held is not None:
            ids, turns, roles, texts, _, gone = held
            here = [i for i, g in enumerate(gone) if not g]
            done.append([ids[0], *_whole([turns[i] for i in here], [roles[i] for i in here], [texts[i] for i in here])])
            if len(done) >= 5000:
                yield flush()
                done = []
        if k == 0:
            yield open_rows(run)
        else:
            held = run
    if done:
        yield flush()
    if held is not None:
        yield open_rows(held)


def _segment(table: pa.Table) -> tuple[list, list[str], list[str], np.ndarray, list[str]]:
    """Turns, roles, texts, symbols and faults of a segment's rows in order."""
    t = table.sort_by("pos")
    roles, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
    marked = [symbol(r, x, d) for r, x, d in zip(roles, texts, t.column("repeated").to_pylist(), strict=True)]
    return t.column("turn").to_pylist(), roles, texts, np.array([m[0] for m in marked], np.int64), [m[1] for m in marked]


def _summary(table: pa.Table) -> pa.Table:
    turns, roles, _, symbols, faults = _segment(table)
    now, cost, state = passed(symbols)
    numbers = [faults.count(f) for f in ("blank", "duplicate", "truncated")] + [_illegal([r[:1] for r in roles])]
    out = {"conv_id": table["conv_id"][:1].to_pylist(), "seg": table["seg"][:1].to_pylist(), "before": [now.tolist()], "cost": [cost.tolist()], "state": [state.ravel().tolist()],
           "numbers": [numbers], "first": [roles[0][:1]], "last": [roles[-1][:1]]}
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.string()]
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _composed(table: pa.Table) -> pa.Table:
    """Segments of a conversation in order: the vector behind each one, the state before it, and in the first one the totals."""
    rows = table.sort_by("seg").to_pylist()
    v, cost, behind = 0, 0, []
    for r in reversed(rows):
        behind.append(v)
        cost += r["cost"][v]
        v = r["before"][v]
    cost += int(tables()[0][v][0])
    q, starts = 0, []
    for r, b in zip(rows, reversed(behind), strict=True):
        starts.append(q)
        q = r["state"][4 * b + q]
    totals = [sum(x) for x in zip(*(r["numbers"] for r in rows), strict=True)]
    totals[3] += sum(x["last"] + y["first"] not in _LEGAL for x, y in zip(rows, rows[1:], strict=False))
    n = len(rows)
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    out = [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["seg"] for r in rows], pa.int32()), pa.array(behind[::-1], pa.int32()), pa.array(starts, pa.int32()), pa.array([""] * (n - 1) + [closing(q)], pa.string())]
    return pa.table(out + [pa.array([x] + [0] * (n - 1), pa.int64()) for x in (*totals, cost)], names=["conv_id", "seg", "behind", "start", "closing", *names])


def _traced(table: pa.Table) -> pa.Table:
    _, roles, texts, symbols, _ = _segment(table)
    start = table["start"][0].as_py()
    _, edits, _ = audited(symbols, table["behind"][0].as_py(), start)
    edits.append(table["closing"][0].as_py())
    text = "\n".join(repaired(roles, texts, edits, start))
    out = {"conv_id": table["conv_id"][:1].to_pylist(), "seg": table["seg"][:1].to_pylist(), "audit": ["".join(edits)], "text": [text if any(x != "D" for e in edits for x in e) else None]}
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=list(out))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, repaired_sha256) of the parts (conv_id, seg, audit, text) in order; a part without a line has a null text."""
    now, audit, digest, lines = object(), [], hashlib.sha256(), 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    begun = False
    for b in batches:
        for conv, a, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if not begun or conv != now:
                if begun:
                    yield row()
                begun, now, audit, digest, lines = True, conv, [], hashlib.sha256(), 0
            audit.append(a)
            if text is not None:
                digest.update((("\n" if lines else "") + text).encode())
                lines += 1
    if begun:
        yield row()


def repair(rows: DataFrame) -> DataFrame:
    """gaps, faults, cost, audit and hash of each conversation of rows (conv_id, turn, role, text, copy, gone)."""
    names = [x.split()[0] for x in _DONE.split(", ")]
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    laid = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text", "copy")
    first = stored(laid.mapInArrow(_first_pass, f"conv_id long, seg int, pos long, turn long, role string, text string, gone boolean, {_DONE}"))
    done = first.filter("seg IS NULL").select("conv_id", *names)
    every = first.filter("seg IS NOT NULL").select("conv_id", "seg", "pos", "turn", "role", "text", "gone")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("seg", "pos")
    rows = stored(every.filter("NOT gone").withColumn("repeated", F.row_number().over(same) > 1).drop("gone"))
    parts = rows.groupBy("conv_id", "seg").applyInArrow(_summary, "conv_id long, seg int, before array<int>, cost array<long>, state array<int>, numbers array<long>, first string, last string")
    plan = stored(parts.groupBy("conv_id").applyInArrow(_composed, "conv_id long, seg int, behind int, start int, closing string, blank long, duplicate long, truncated long, illegal long, cost long"))
    by = plan.select(F.col("conv_id").alias("p_conv_id"), F.col("seg").alias("p_seg"), "behind", "start", "closing")
    both = rows.join(by, F.col("conv_id").eqNullSafe(F.col("p_conv_id")) & (F.col("seg") == F.col("p_seg")))
    pieces = both.groupBy("conv_id", "seg").applyInArrow(_traced, "conv_id long, seg int, audit string, text string")
    hashes = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    turns = every.groupBy("conv_id").agg((F.max(F.when(~F.col("gone"), F.col("turn"))) - F.min(F.when(~F.col("gone"), F.col("turn"))) + 1 - F.count_distinct(F.when(~F.col("gone"), F.col("turn")))).alias("gaps"))
    numbers = names[1:6]
    totals = plan.groupBy(F.col("conv_id").alias("t_conv_id")).agg(*(F.sum(n).alias(n) for n in numbers))
    hashes = hashes.select(F.col("conv_id").alias("h_conv_id"), "audit", "repaired_sha256")
    out = turns.join(totals, F.col("conv_id").eqNullSafe(F.col("t_conv_id")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("h_conv_id")), "left")
    zero = F.lit(0).cast("long")
    out = out.select("conv_id", *(F.coalesce(n, zero).alias(n) for n in ("gaps", *numbers)), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return done.unionByName(out)
