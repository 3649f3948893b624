"""Cues of running media as a stream: adjacent duplicates merged and numbered over micro-batches, with keyed state and a watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuesheaf.functions.text import strip

MERGED = "media_id long, number long, seq long, start_ms long, end_ms long, text string, confidence double, merged long"
_ROW = ("start_ms", "seq", "end_ms", "text", "confidence", "at_ms")


def merged_stream(cues: DataFrame, delay: str = "30 seconds", within_ms: int = 5000) -> DataFrame:
    """MERGED rows of a stream of cues (media_id, seq, start_ms, end_ms, text, confidence, at), each once no later cue can change it.

    `at` is the event time of a cue's start, so that the cues of a media are in one order by `at` and by start_ms. Cues wait in the state of their media
    until the watermark, the largest `at` less `delay`, has passed them; they are then merged and numbered in order as a batch does it. An open
    row is given when the next one does not join it, or when the watermark is past the time in which one could. A cue that comes at
    or behind the watermark is late: it is dropped, and counted by the query's progress (numRowsDroppedByWatermark). State is the
    cues of the last `delay`, one open row and a counter a media.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"pending": [], "open": None, "number": 0}
        if not state.hasTimedOut:
            for f in frames:
                f = f.astype(object).where(f.notna(), None)
                s["pending"] += f[list(_ROW)].values.tolist()
        mark = state.getCurrentWatermarkMs()
        s["pending"].sort(key=lambda r: r[:2])
        out = []

        def close() -> None:
            if s["open"]:
                s["number"] += 1
                out.append((key[0], s["number"], *s["open"][:-1]))

        while s["pending"] and s["pending"][0][-1] <= mark:
            start, seq, end, text, confidence, at = s["pending"].pop(0)
            last, end_at = s["open"], at + end - start
            if last and text is not None and last[3] == text and start - last[2] < within_ms:
                last[2], last[5], last[6] = end, last[5] + 1, end_at
            else:
                close()
                s["open"] = [seq, start, end, text, confidence, 1, end_at]
        if s["open"] and not s["pending"] and mark >= s["open"][-1] + within_ms - 1:
            close()
            s["open"] = None
        state.update((json.dumps(s),))
        waits = [s["pending"][0][-1]] if s["pending"] else [s["open"][-1] + within_ms] if s["open"] else []
        if waits:
            state.setTimeoutTimestamp(max(waits[0], mark + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])

    rows = cues.withWatermark("at", delay).select("media_id", "seq", "start_ms", "end_ms", strip(F.col("text")).alias("text"), "confidence", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("media_id").applyInPandasWithState(run, MERGED, "state string", "append", GroupStateTimeout.EventTimeTimeout)
