"""Media with very many rows, cut into ranges of their order.

Most media are one partition of a window. The few that are far larger than the others would be one task each; they are cut into
RANGES ranges by quantiles of their order column. An operator then works on each range alone, gives a small carry for each range (a count, a
largest end, a last text), scans the carries of a media, and feeds what came before back to the rows of the range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A media of more rows than this may be cut; the MOST_CUT largest of these are.
RANGE_ROWS, MOST_CUT = 1_000_000, 1000
#: Ranges of a media that is cut, a power of 2; at most RANGES * MOST_CUT carries exist, so carries are broadcast.
RANGES = 1024


def by_size(rows: DataFrame, whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], order: str = "start_ms", above: int = RANGE_ROWS, key: str = "media_id") -> DataFrame:
    """`whole` over the rows of all media but the very large ones, and `cut` over those, whose rows have their range in `_range`.

    Rows of equal `order` share a range. Where no media is large the second part's joins meet an empty side, and adaptive execution drops them.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > above)
    large = F.broadcast(n.orderBy(F.desc("_n"), key).limit(MOST_CUT).select(key))
    at = [k / RANGES for k in range(1, RANGES)]
    cuts = rows.select(key, order).join(large, key, "left_semi").groupBy(key).agg(F.percentile_approx(order, at, 10 * RANGES).alias("_cuts"))
    hot = rows.join(F.broadcast(cuts), key).withColumn("_range", F.lit(0))
    half = RANGES // 2
    while half:  # a binary search: how many cuts lie before the row
        hot = hot.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (half - 1)) < F.col(order), half).otherwise(0))
        half //= 2
    hot = hot.drop("_cuts")
    return whole(rows.join(large, key, "left_anti")).unionByName(cut(hot))


def inside(*order: str, key: str = "media_id") -> Window:
    """The window of a range."""
    return Window.partitionBy(key, "_range").orderBy(*order)


def over_ranges(key: str = "media_id") -> Window:
    """The window of the carries of a media."""
    return Window.partitionBy(key).orderBy("_range")


def earlier(key: str = "media_id") -> Window:
    """All ranges before this one."""
    return over_ranges(key).rowsBetween(Window.unboundedPreceding, -1)


def fed(rows: DataFrame, carries: DataFrame, key: str = "media_id") -> DataFrame:
    """Rows with what their range carries in; a range that carries has one row in `carries`."""
    return rows.join(F.broadcast(carries), [key, "_range"])
