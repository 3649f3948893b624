"""Ordered rows of a media: gaps, islands, merges, plans and numbering.

Each function works on one partition of windows by media_id, ordered by (start_ms, seq) or as said; those with `above` cut
the largest media of more rows than that into ranges (`ranges.py`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheaf.functions.text import strip

from .ranges import RANGE_ROWS, by_size, earlier, fed, inside, over_ranges


def by_start(*more: str) -> Window:
    return Window.partitionBy("media_id").orderBy("start_ms", *(more or ("seq",)))


def merged_whole(cues: DataFrame, within_ms: int = 5000) -> DataFrame:
    """merge_adjacent_duplicates with one window a media."""
    w = by_start()
    t = strip(F.col("text"))
    starts = F.coalesce((F.lag(t).over(w) != t) | (F.col("start_ms") - F.lag("end_ms").over(w) >= within_ms), F.lit(True))
    c = cues.withColumn("_new", starts.cast("int"))
    c = c.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _islands(c.withColumn("_t", t))


def _islands(c: DataFrame) -> DataFrame:
    at = F.struct("start_ms", "seq")
    return c.groupBy("media_id", "_island").agg(
        F.min_by("seq", at).alias("seq"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"),
        F.min_by("_t", at).alias("text"), F.min_by("confidence", at).alias("confidence"), F.count("*").alias("merged"),
    ).drop("_island")


def merged_cut(cues: DataFrame, within_ms: int = 5000) -> DataFrame:
    """The same over ranges: an island is named by its first row; a range carries its first and last row and its last break."""
    w, at = inside("start_ms", "seq"), F.struct("start_ms", "seq")
    c = cues.withColumn("_t", strip(F.col("text"))).withColumns({"_last_t": F.lag("_t").over(w), "_last_end": F.lag("end_ms").over(w), "_in": F.lag(F.lit(True)).over(w)})
    breaks = F.coalesce((F.col("_last_t") != F.col("_t")) | (F.col("start_ms") - F.col("_last_end") >= within_ms), F.lit(True))
    c = c.withColumn("_break", F.when(F.col("_in") & breaks, at))
    own = c.groupBy("media_id", "_range").agg(
        F.min_by(F.struct("start_ms", "seq", "_t"), at).alias("_first"), F.max_by(F.struct("end_ms", "_t"), at).alias("_end"), F.max("_break").alias("_break"),
    )
    last = F.lag("_end").over(over_ranges())
    opens = F.coalesce((last["_t"] != F.col("_first._t")) | (F.col("_first.start_ms") - last["end_ms"] >= within_ms), F.lit(True))
    own = own.withColumn("_opened", F.when(opens, F.struct("_first.start_ms", "_first.seq")))
    before = F.last(F.coalesce("_break", "_opened"), ignorenulls=True).over(earlier())
    c = fed(c, own.select("media_id", "_range", F.coalesce("_opened", before).alias("_entry")))
    here = F.last("_break", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _islands(c.withColumn("_island", F.coalesce(here, "_entry")))


def merge_adjacent_duplicates(cues: DataFrame, within_ms: int = 5000, above: int = RANGE_ROWS) -> DataFrame:
    """Rows of the same text that start under `within_ms` after the end of the one before become one; its end is the last row's."""
    return by_size(cues, lambda c: merged_whole(c, within_ms), lambda c: merged_cut(c, within_ms), above=above)


def _local_islands(intervals: DataFrame, gap_ms: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = intervals.select(*keys, "start_ms", "end_ms").withColumn("_new", F.coalesce(F.col("start_ms") > before + gap_ms, F.lit(True)).cast("int"))
    c = c.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def _intervals_cut(intervals: DataFrame, gap_ms: int, key: str) -> DataFrame:
    """Islands of each range, joined across ranges: those that start by the largest end before them belong to the last one that does not; it is named by its start."""
    c = _local_islands(intervals, gap_ms, key, "_range")
    own = c.groupBy(key, "_range").agg(F.max("end_ms").alias("_end"), F.max("start_ms").alias("_start"))
    own = own.withColumn("_reach", F.max("_end").over(earlier(key)) + gap_ms)
    apart = F.when(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach")), F.col("_start"))
    c = fed(c, own.select(key, "_range", "_reach", F.last(apart, ignorenulls=True).over(earlier(key)).alias("_entry")), key)
    name = F.when(F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach")), F.col("start_ms")).otherwise(F.col("_entry"))
    return c.groupBy(key, name.alias("start_ms")).agg(F.max("end_ms").alias("end_ms"))


def merge_intervals(intervals: DataFrame, gap_ms: int = 100, least_ms: int = 150, key: str = "media_id", above: int = RANGE_ROWS) -> DataFrame:
    """Intervals at most `gap_ms` apart become one; those under `least_ms` go."""
    out = by_size(intervals, lambda x: _local_islands(x, gap_ms, key), lambda x: _intervals_cut(x, gap_ms, key), above=above, key=key)
    return out.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def gaps_and_overlaps(cues: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """(media_id, seq, kind, ms) of each row that starts before the end of the one before, or over `gap_ms` after it."""
    gap = F.col("start_ms") - F.lag("end_ms").over(by_start())
    c = cues.select("media_id", "seq", gap.alias("gap"))
    kind = F.when(F.col("gap") < 0, "overlap").when(F.col("gap") > gap_ms, "gap")
    return c.select("media_id", "seq", kind.alias("kind"), F.abs("gap").alias("ms")).filter("kind IS NOT NULL")


def _offsets(chunks: DataFrame, segment_ms: int, *keys: str) -> DataFrame:
    """Adds start_ms and `_resets`, the unreadable chunks up to the row, of rows whose sum starts at 0 with the first of `keys`."""
    w = Window.partitionBy(*keys).orderBy("chunk_idx")
    bad = (~F.col("readable")).cast("int")
    c = chunks.withColumn("_resets", F.sum(bad).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*keys, "_resets").orderBy("chunk_idx")
    base = F.first(F.when(~F.col("readable"), (F.col("chunk_idx") + 1) * segment_ms)).over(island.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    run = F.coalesce(F.sum(F.when(F.col("readable"), F.col("dur_ms"))).over(island.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.when(~F.col("readable"), F.col("chunk_idx") * segment_ms).when(F.col("dur_ms").isNull(), F.lit(0)).otherwise(F.coalesce(base, F.lit(0)) + run)
    return c.withColumn("start_ms", start.cast("long"))


def _offsets_cut(chunks: DataFrame, segment_ms: int) -> DataFrame:
    """The same over ranges: a range carries the sum behind its last row, which an unreadable chunk in it makes independent of what came before."""
    c = _offsets(chunks, segment_ms, "media_id", "_range")
    bad = ~F.col("readable")
    parts = c.groupBy("media_id", "_range", "_resets").agg((F.coalesce(F.max(F.when(bad, (F.col("chunk_idx") + 1) * segment_ms)), F.lit(0)) + F.coalesce(F.sum(F.when(~bad, F.col("dur_ms"))), F.lit(0))).alias("_sum"))
    own = parts.groupBy("media_id", "_range").agg(F.max_by("_sum", "_resets").alias("_sum"), (F.max("_resets") > 0).cast("int").alias("_fresh"))
    own = own.withColumn("_since", F.sum("_fresh").over(over_ranges()))
    behind = F.sum("_sum").over(Window.partitionBy("media_id", "_since").orderBy("_range"))
    own = own.withColumn("_behind", behind).select("media_id", "_range", F.coalesce(F.lag("_behind").over(over_ranges()), F.lit(0)).alias("_carry"))
    moved = (F.col("_resets") == 0) & F.col("dur_ms").isNotNull()
    return fed(c, own).withColumn("start_ms", F.when(moved, F.col("start_ms") + F.col("_carry")).otherwise(F.col("start_ms"))).drop("_carry", "_range", "_resets")


def chunk_offsets(chunks: DataFrame, segment_ms: int = 60_000, above: int = RANGE_ROWS) -> DataFrame:
    """Adds start_ms: the sum of the earlier durations; an unreadable chunk i starts at i * segment_ms and the sum goes on at (i + 1) * segment_ms.

    A row whose duration is null is a missing file: it starts at 0 and adds nothing.
    """
    return by_size(chunks, lambda c: _offsets(c, segment_ms, "media_id").drop("_resets"), lambda c: _offsets_cut(c, segment_ms), "chunk_idx", above)


def exact_quantile(rows: DataFrame, key: str, value: str, quantile: float, width: int = 2**20) -> DataFrame:
    """(key, quantile) of the whole numbers `value` of each key, between neighbours by linear interpolation; no aggregate holds a key's rows.

    Rows are counted by ranges of `width` values; running counts say which range has the wanted rank. Only the values of that
    range are then counted one by one. A key has at most its span over `width` ranges, and a range at most `width` values.
    """
    rows = rows.select(key, F.col(value).alias("_v")).filter("_v IS NOT NULL").withColumn("_part", F.floor(F.col("_v") / width))
    parts = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    parts = parts.withColumns({"_place": (F.sum("_n").over(w) - 1) * F.lit(quantile), "_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))

    low, high = F.floor("_place"), F.ceil("_place")
    wanted = parts.filter(holds(low) | holds(high)).select(F.col(key).alias("_key"), F.col("_part").alias("_of"), "_place", F.col("_before").alias("_start"))
    near = rows.join(wanted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    near = near.groupBy(key, "_part", "_place", "_start", "_v").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(key, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(run), F.lit(0)))
    ends = near.groupBy(key).agg(F.max("_place").alias("_place"), F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"))
    return ends.select(key, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_place") - low)).alias("quantile"))


#: Energies are compared as whole numbers of a thousand-millionth of a decibel.
_DB = 1_000_000_000


def energy_intervals(frames: DataFrame, hop_ms: int = 10, least_frames: int = 5, quantile: float = 0.3) -> DataFrame:
    """Runs of at least `least_frames` frames over the media's quantile of energy; a run open at the end stays whatever its length."""
    f = frames.select("media_id", "frame_idx", F.round(F.round(10 * F.log10(F.col("sample") * F.col("sample") + 1e-10), 9) * _DB).cast("long").alias("db"))
    limit = exact_quantile(f, "media_id", "db", quantile).select("media_id", F.round("quantile").cast("long").alias("limit"))
    last = f.groupBy("media_id").agg(F.max("frame_idx").alias("last"))
    f = f.join(limit.join(last, "media_id"), "media_id").filter("db > limit")
    w = Window.partitionBy("media_id").orderBy("frame_idx")
    f = f.withColumn("_island", F.col("frame_idx") - F.row_number().over(w))
    runs = f.groupBy("media_id", "_island", "last").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    runs = runs.filter((F.col("hi") - F.col("lo") + 1 >= least_frames) | (F.col("hi") == F.col("last")))
    return runs.select("media_id", (F.col("lo") * hop_ms).alias("start_ms"), ((F.col("hi") + 1) * hop_ms).alias("end_ms"))


def head_fraction(rows: DataFrame, percent: int, key: str = "media_id", order: str = "chunk_idx") -> DataFrame:
    """The first percent of a media's rows, at least one."""
    n = F.count("*").over(Window.partitionBy(key))
    most = F.greatest(F.lit(1), F.least(n, F.floor(n * percent / 100)))
    out = rows.withColumns({"_at": F.row_number().over(Window.partitionBy(key).orderBy(order)), "_most": most})
    return out.filter("_at <= _most").drop("_at", "_most")


def _numbers_cut(cues: DataFrame, column: str) -> DataFrame:
    rows = cues.groupBy("media_id", "_range").agg(F.count("*").alias("_rows"))
    base = rows.select("media_id", "_range", F.coalesce(F.sum("_rows").over(earlier()), F.lit(0)).alias("_base"))
    own = cues.withColumn(column, F.row_number().over(inside("start_ms", "seq")))
    return fed(own, base).withColumn(column, (F.col(column) + F.col("_base")).cast("long")).drop("_base", "_range")


def renumbered(cues: DataFrame, column: str = "number", above: int = RANGE_ROWS) -> DataFrame:
    """Adds the row's number in its media, from 1."""
    return by_size(cues, lambda c: c.withColumn(column, F.row_number().over(by_start()).cast("long")), lambda c: _numbers_cut(c, column), above=above)


def batched(cues: DataFrame, size: int = 10, above: int = RANGE_ROWS) -> DataFrame:
    """Adds batch_id: every `size` rows of a media in order."""
    return renumbered(cues, "_number", above).withColumn("batch_id", F.floor((F.col("_number") - 1) / size)).drop("_number")


def best_attempt(attempts: DataFrame, enough: float = -1.0) -> DataFrame:
    """Of attempts (media_id, attempt, confidence) in order: none after the first that makes the best so far over `enough`; of these the most confident, the earliest of equals."""
    w = Window.partitionBy("media_id").orderBy("attempt")
    before = F.max("confidence").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tried = attempts.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") <= enough)).drop("_before")
    best = Window.partitionBy("media_id").orderBy(F.desc("confidence"), "attempt")
    return tried.withColumn("_at", F.row_number().over(best)).filter("_at = 1").drop("_at")


def first_out_of_range(cues: DataFrame, limits: DataFrame, k: int = 3) -> DataFrame:
    """The first k rows of each media that end after its duration_ms."""
    c = cues.join(limits, "media_id").filter("end_ms > duration_ms")
    return c.withColumn("place", F.row_number().over(by_start())).filter(F.col("place") <= k)


def union_detectors(first: DataFrame, second: DataFrame) -> DataFrame:
    return merge_intervals(first.select("media_id", "start_ms", "end_ms").unionByName(second.select("media_id", "start_ms", "end_ms")))


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b)


def plan_overlapping_chunks(media: DataFrame, chunk_ms: int = 180_000, overlap_ms: int = 2000, least_ms: int = 1000) -> DataFrame:
    """(media_id, chunk_idx, start_ms, end_ms) of overlapping chunks of duration_ms; those under least_ms go."""
    step = chunk_ms - overlap_ms
    n = F.greatest(F.lit(1), _ceil_div(F.col("duration_ms") - overlap_ms, step))
    c = media.select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk_idx"))
    c = c.select("media_id", "chunk_idx", (F.col("chunk_idx") * step).alias("start_ms"), F.least(F.col("chunk_idx") * step + chunk_ms, F.col("duration_ms")).alias("end_ms"))
    return c.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def plan_fixed_chunks(media: DataFrame, segment_ms: int = 60_000) -> DataFrame:
    """(media_id, chunk_idx, start_ms, end_ms) of chunks one after the other; an exact multiple has no empty last one."""
    n = _ceil_div(F.col("duration_ms"), segment_ms)
    c = media.filter("duration_ms > 0").select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk_idx"))
    return c.select("media_id", "chunk_idx", (F.col("chunk_idx") * segment_ms).alias("start_ms"), F.least((F.col("chunk_idx") + 1) * segment_ms, F.col("duration_ms")).alias("end_ms"))
