"""Counts and summaries per media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheaf.functions.text import strip

from . import rules
from .intervals import by_start, merged_cut
from .ranges import RANGE_ROWS, by_size


def continuity_stats(cues: DataFrame, limits: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """One row a media: span, overlaps, gaps and order; limits (media_id, duration_ms)."""
    c = cues.withColumn("_gap", F.col("start_ms") - F.lag("end_ms").over(by_start())).join(limits, "media_id", "left")
    over, gap = F.when(F.col("_gap") < 0, -F.col("_gap")), F.when(F.col("_gap") > gap_ms, F.col("_gap"))
    out = c.groupBy("media_id").agg(
        F.count("*").alias("segments"), F.min("start_ms").alias("first_start_ms"), F.max_by("end_ms", F.struct("start_ms", "seq")).alias("last_end_ms"),
        F.count(over).alias("overlaps"), F.coalesce(F.sum(over), F.lit(0)).alias("overlap_ms"), F.count(gap).alias("gaps"), F.coalesce(F.sum(gap), F.lit(0)).alias("gap_ms"),
        F.bool_and(F.col("start_ms") <= F.col("end_ms")).alias("ordered"), F.count_if(F.col("end_ms") * 10 > F.col("duration_ms") * 11).alias("late"),
    )
    span = F.col("last_end_ms") - F.col("first_start_ms")
    return out.withColumns({
        "span_ms": span, "mean_span_ms": F.round(span / F.col("segments"), 3),
        "mean_overlap_ms": F.round(F.try_divide("overlap_ms", "overlaps"), 3), "mean_gap_ms": F.round(F.try_divide("gap_ms", "gaps"), 3),
    })


_REASONS = ("blank", "confidence", "pattern", "run", "slow", "fast", "too_short", "too_long", "repeat")


def _counts(marked: DataFrame, *more: Column) -> DataFrame:
    return marked.groupBy("media_id").agg(
        F.count("*").alias("original"), F.count_if(F.col("reason").isNull()).alias("filtered"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in _REASONS), *more
    )


def _report_whole(cues: DataFrame, within_ms: int = 5000) -> DataFrame:
    """One pass: a kept row is one of the deduplicated if it does not go into the kept one before it."""
    marked = rules.repeats_whole(cues).withColumn("reason", rules.drop_reason())
    kept = F.when(F.col("reason").isNull(), F.struct(F.xxhash64(strip(F.col("text"))).alias("t"), "end_ms"))
    marked = marked.withColumn("_kept", kept).withColumn("_before", F.last("_kept", ignorenulls=True).over(by_start().rowsBetween(Window.unboundedPreceding, -1)))
    joins = (F.col("_before.t") == F.col("_kept.t")) & (F.col("start_ms") - F.col("_before.end_ms") < within_ms)
    return _counts(marked, F.count_if(F.col("reason").isNull() & ~F.coalesce(joins, F.lit(False))).alias("deduplicated"))


def _report_cut(cues: DataFrame) -> DataFrame:
    marked = rules.repeats_cut(cues).withColumn("reason", rules.drop_reason())
    merged = merged_cut(marked.filter("reason IS NULL")).groupBy("media_id").agg(F.count("*").alias("deduplicated"))
    out = _counts(marked).join(merged, "media_id", "left")
    return out.withColumn("deduplicated", F.coalesce("deduplicated", F.lit(0).cast("long")))


def filter_report(cues: DataFrame, above: int = RANGE_ROWS) -> DataFrame:
    """original, kept, merged and removed rows of each media, and those of every reason."""
    out = by_size(cues, _report_whole, _report_cut, above=above)
    return out.withColumn("removed", F.col("original") - F.col("deduplicated"))


def transcript_text(cues: DataFrame) -> DataFrame:
    """(media_id, text) of all texts in order, with one space between."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "seq", F.col("text").alias("t"))))
    return cues.groupBy("media_id").agg(strip(F.array_join(F.transform(rows, lambda x: x["t"]), " ")).alias("text"))


def stage_durations(events: DataFrame, media_ms: int = 3_600_000) -> DataFrame:
    """Time of each checkpoint since the one before and since the first, and the latter as a share of the media."""
    w = Window.partitionBy("run_id").orderBy("ts_ms", "event_id")
    total = F.col("ts_ms") - F.min("ts_ms").over(w)
    return events.select(
        "run_id", "event_id", "stage", (F.col("ts_ms") - F.coalesce(F.lag("ts_ms").over(w), F.col("ts_ms"))).alias("stage_ms"),
        total.alias("total_ms"), (F.floor(total * 1000 / media_ms) / 1000).alias("real_time_factor"),
    )


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Totals of detected, transcribed, filtered and weak segments of a media's chunks; missing counts are 0, missing transcribed is the array's size."""

    def total(c: str, default=None):
        return F.sum(F.coalesce(F.col(c), F.lit(0) if default is None else default)).cast("long").alias(c)

    return chunks.groupBy("media_id").agg(
        F.count("*").alias("chunks"), total("speech_segments"), total("transcribed_segments", F.size("segments")), total("filtered"),
        F.sum(F.size(F.filter("segments", lambda s: s["is_weak"]))).cast("long").alias("weak"),
    )
