"""Clock expressions; all times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column, width: int = 2) -> Column:
    s = x.cast("long").cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def format_hms(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s / 60) % 60), _two(s % 60))


def format_srt_time(ms: Column) -> Column:
    return F.concat(format_hms(ms), F.lit(","), _two(ms % 1000, 3))


def srt_clock(clock: Column) -> Column:
    """A clock text with a comma stays; a fraction after a point is cut and padded to three digits; else none."""
    point = F.instr(clock, ".") > 0
    fraction = F.rpad(F.substring(F.element_at(F.split(clock, r"\."), 2), 1, 3), 3, "0")
    return F.when(F.instr(clock, ",") > 0, clock).when(point, F.concat(F.element_at(F.split(clock, r"\."), 1), F.lit(","), fraction)).otherwise(F.concat(clock, F.lit(",000")))


def clock_ms(clock: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm; null for another form."""

    def part(k: int) -> Column:
        return F.regexp_extract(clock, r"^\s*(\d+):(\d+):(\d+)[,.](\d{3})\s*$", k).try_cast("long")

    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def rescaled(start: Column, end: Column, limit: Column, actual: Column, processed: Column, offset: Column) -> tuple[Column, Column]:
    """Start and end clamped to [0, limit] (an end at least 0.1 s after its start), scaled by actual / processed and moved by offset."""
    s = F.greatest(F.lit(0), F.least(start, limit))
    e = F.greatest(s + 100, F.least(end, limit))

    def scaled(x: Column) -> Column:
        return F.when(actual != processed, F.floor((x * actual) / processed)).otherwise(x).cast("long") + offset

    return scaled(s), scaled(e)


def repaired_end(start: Column, end: Column, chunk_start: Column, segment_ms: int) -> Column:
    """An end that is not after its start becomes start + 0.5 s; one too far past its chunk is cut to 30 s."""
    e = F.when(end <= start, start + 500).otherwise(end)
    return F.when(e > chunk_start + 2 * segment_ms, start + F.least(F.lit(30_000), e - start)).otherwise(e)
