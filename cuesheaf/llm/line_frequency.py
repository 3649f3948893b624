"""Quality rules: cross-document line frequency, in DataFrame functions only.

A document's words, lines and repeated windows are counted inside its row with array functions,
so the base rules need no shuffle. Lines are normalised and hashed; the distinct documents of
each (host, line) are counted; lines in more than `max_docs` documents of a host are removed,
and a document is rejected when the removed lines hold over half of its words.

Defined cases: null text counts as empty (it fails the base rules); a null host is a host of its
own; repeated rows of one doc_id count as documents of their own; lines without a letter or digit
are never counted; a very long text is split and counted whole, in its row; a line in exactly `max_docs` documents stays, and one half
of the words lost exactly keeps a document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, numbered, sized_broadcast, stored

MAX_DOCS = 20
DEPLETED_PERCENT = 50


def _let(value: Column, body) -> Column:
    """Evaluate a value once and hand it to `body`: an expression inside a lambda is otherwise evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda x: x != "")


def repeated_window_words(w: Column, k: int = 3) -> Column:
    """How many words stand in k-word windows that occur twice or more in the array w."""

    def marked(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            at = F.sequence(F.lit(1), F.size(s))
            twin = F.filter(at, lambda j: ((j > 1) & (F.get(s, j - 2)["h"] == F.get(s, j - 1)["h"])) | (F.get(s, j)["h"] == F.get(s, j - 1)["h"]))
            return F.sort_array(F.transform(twin, lambda j: F.get(s, j - 1)["i"]))

        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            _let(ordered, positions), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n")), lambda a: a["n"]
        )

    def count(x: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(x) - k), lambda i: F.xxhash64(*(F.get(x, i + j) for j in range(k))))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))

    return F.when(F.size(w) < k, F.lit(0)).otherwise(_let(w, count)).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, version, host, the five counts and base_failed of each row of docs (doc_id, text, source)."""
    t = F.coalesce("text", F.lit(""))
    blanks, symbols = " \t\n\x0b\f\r", "#*$%&|<>"
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.select("doc_id", F.xxhash64(t).alias("version"), F.col("source").alias("host"), t.alias("t"), words(t).alias("w"), lines.alias("lines"))
    d = d.select(
        "doc_id", "version", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", blanks, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", symbols, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, "[^\\p{L}\\p{N}]+", " ")))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) hashes of lines that over `max_docs` documents of a host have."""
    t = F.coalesce("text", F.lit(""))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split(t, "\n", -1), normalised), lambda x: x != ""), lambda x: F.xxhash64(x)))
    lines = docs.select(F.col("source").alias("host"), F.explode(keys).alias("line"))
    return lines.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs)


def line_frequency(docs: DataFrame, max_docs: int = MAX_DOCS, depleted_percent: int = DEPLETED_PERCENT) -> DataFrame:
    """Base counts, removed_lines, removed_words and kept of each document.

    Lines are exploded with their word counts, joined to the frequent lines (few, each standing
    for over `max_docs` documents) and summed for each text version of a document.
    """
    frequent = frequent_lines(docs, max_docs).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    t = F.coalesce("text", F.lit(""))
    version = F.xxhash64(t).alias("version")
    parts = F.transform(F.split(t, "\n", -1), lambda x, i: F.struct(i.alias("at"), normalised(x).alias("norm"), F.size(words(x)).alias("n")))
    parts = F.transform(F.filter(parts, lambda x: x["norm"] != ""), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["norm"]).alias("line"), x["n"].alias("n")))
    exploded = docs.select("doc_id", version, F.col("source").alias("host"), F.explode(parts).alias("p")).select("doc_id", "version", "host", "p.*")
    hit = exploded.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
    hit = hit.dropDuplicates(["doc_id", "version", "host", "at"])
    lost = hit.groupBy("doc_id", "version", "host").agg(F.count("*").alias("removed_lines"), F.sum("n").alias("removed_words"))
    lost = lost.select(*(F.col(c).alias(f"l_{c}") for c in ("doc_id", "version", "host")), "removed_lines", "removed_words")
    d = base(docs)
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in ("doc_id", "version", "host")]
    d = d.join(lost, same[0] & same[1] & same[2], "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * removed <= depleted_percent * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), removed.alias("removed_words"),
    )


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs without the lines that line_frequency counts as removed; columns and rows stay, n_chars follows the text.

    Only names that start with two underscores are used beside the columns of docs.
    """
    d = numbered(docs, "__row")
    frequent = stored(frequent_lines(d, max_docs).select(F.col("host").alias("__host"), F.col("line").alias("__line")))
    lines = F.split("text", "\n", -1)
    parts = F.transform(lines, lambda x, i: F.struct(i.alias("at"), normalised(x).alias("norm")))
    parts = F.transform(F.filter(parts, lambda x: x["norm"] != ""), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["norm"]).alias("line")))
    exploded = d.select(F.col("__row").alias("__of"), F.col("source").alias("__source"), F.explode(parts).alias("__p"))
    hit = exploded.join(sized_broadcast(frequent), (F.col("__p.line") == F.col("__line")) & F.col("__source").eqNullSafe(F.col("__host")))
    gone = stored(hit.groupBy("__of").agg(F.collect_set("__p.at").alias("__gone")))
    out = d.join(sized_broadcast(gone), F.col("__row") == F.col("__of"), "left")
    hit = F.col("__gone").isNotNull()
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(hit, left).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, unnest(range(0, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
keyed AS (SELECT r, i, w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM keyed) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 3) AS x(j) GROUP BY r),
lines AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (SELECT r, host, trim(lower(regexp_replace(line, '[^\p{L}\p{N}]+', ' ', 'g'))) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
freq AS (SELECT host, k FROM norm WHERE k <> '' GROUP BY host, k HAVING count(DISTINCT r) > 20),
lost AS (SELECT r, count(*) AS c, sum(n) AS n FROM norm SEMI JOIN freq ON norm.k = freq.k AND norm.host IS NOT DISTINCT FROM freq.host GROUP BY r),
counted AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lost.c, 0)::BIGINT AS removed_lines, coalesce(lost.n, 0)::BIGINT AS removed_words FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= 50 * n_words AS kept FROM counted
"""
