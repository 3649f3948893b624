"""Mixing sources to target weights.

Each document gets a hash-random key. Documents are ordered by key inside their source, cut into
key ranges, and the running word count of a document is the sum of the earlier ranges (a small
table) plus its place in its own range. A source is taken up to its budget, in a second epoch too.

Defined cases: null and empty text have size 0; a very long text is one document, cut at a budget like others; a null source is a
source of its own and comes last; a null doc_id is ordered as an empty one; rows of equal doc_id are ordered by size, repeated rows stay rows of their
own; an empty table gives no rows; other columns are ignored, those of the names epoch and taken give way to the mixture's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, sized_broadcast, stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
#: Documents of a source that one key range holds, about; a source of a third of all rows gets many ranges.
RANGE_ROWS = 5_000


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Target of each source, from (source, source_size): one row a source, so its windows are small.

    Sources in code point order, null last, weigh `weights` in turn and share `percent` of all
    words; a target stops at `epochs` times its source. Those with the lowest cap per weight fill
    up first, so the level of the rest follows from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.select("source", "source_size", w.cast("long").alias("weight")).withColumn("cap", epochs * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") * 60 / F.col("weight")), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    whole = Window.partitionBy()
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * (percent / 100) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    t = t.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return t.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight")).alias("target"))


def passes(sized: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and passes: the words taken from each row in each epoch.

    The first pass takes documents in key order until the budget; the part of the target beyond
    the source is taken in the same order again, up to `epochs` times. The document at the cut
    gives only the words that are missing, so a source's sum is its target rounded down.
    """
    keyed = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    counts = keyed.groupBy("source").agg(F.count("*").alias("docs")).select(F.col("source").alias("s"), F.ceil(F.col("docs") / range_rows).alias("ranges"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = keyed.join(targets, keyed["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    dealt = dealt.join(counts, dealt["source"].eqNullSafe(counts["s"])).drop("s").withColumn("part", F.floor(place * F.col("ranges") / 4294967296).cast("long"))
    parts = dealt.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), before.alias("part_start"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    dealt = dealt.join(parts, dealt["source"].eqNullSafe(parts["s"]) & (dealt["part"] == parts["p"]))
    start = F.col("part_start") + F.col("inner_start")

    def cut(budget: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), budget - start))

    budget = F.floor("target").cast("long")
    cuts = F.array(*(cut(budget - e * F.col("source_size")) for e in range(epochs)))
    return dealt.select(*sized.columns, "source_size", "target", cuts.alias("passes"))


def mixed(sized: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Words taken from each row of sized (doc_id, source, size), by the targets of the sources."""
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)
    return passes(sized, targets, range_rows, epochs).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs (doc_id, text, source)."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mixed(sized, source_targets(totals, weights, percent, epochs), epochs=epochs)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, gaps as they are."""
    pieces = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])", -1)
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mixture itself: a row of docs (doc_id, text, source, ...) for each epoch that takes it, with epoch (from 1) and taken.

    The text at a budget's end is cut to its first `taken` words; n_chars follows the text. Documents
    of which nothing is taken are left out. Own columns epoch and taken of docs are dropped; only names that start with two
    underscores are used beside the others.
    """
    docs = docs.select(*(F.col(c) for c in docs.columns if c.lower() not in ("epoch", "taken")))
    d = numbered(docs, "__row")
    sized = stored(d.select("__row", "doc_id", "source", n_words(F.col("text")).alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs)
    rows = passes(sized, targets, epochs=epochs).select(F.col("__row").alias("__of"), F.col("size").alias("__size"), F.posexplode("passes").alias("__epoch", "__taken")).filter("__taken > 0")
    out = d.join(sized_broadcast(stored(rows)), F.col("__row") == F.col("__of"))
    cut = F.col("__taken") < F.col("__size")
    text = F.when(cut, first_words(F.col("text"), F.col("__taken"))).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns), (F.col("__epoch") + 1).alias("epoch"), F.col("__taken").alias("taken"))


def digest(docs: DataFrame, mixture: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """The columns of mix, from docs and their mixture by summing; rows of docs of equal doc_id and source count as one."""
    sized = stored(docs.groupBy("doc_id", "source").agg(F.sum(n_words(F.col("text"))).alias("size")))
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, epochs).withColumnRenamed("source", "t_source")
    took = mixture.groupBy(F.col("doc_id").alias("m_doc_id"), F.col("source").alias("m_source")).agg(F.sum("taken").alias("taken"))
    out = sized.join(totals, F.col("source").eqNullSafe(F.col("t_source"))).join(took, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("source").eqNullSafe(F.col("m_source")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM totals),
filled AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER f, 0)::DOUBLE) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM weighed WINDOW f AS (ORDER BY cap * 60 / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE (max(level) FILTER (WHERE level * weight <= cap) OVER ()) * weight END AS target FROM filled),
placed AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(size, greatest(0, floor(target)::BIGINT - start)) + least(size, greatest(0, floor(target)::BIGINT - source_size - start)))::BIGINT AS taken FROM placed
"""
