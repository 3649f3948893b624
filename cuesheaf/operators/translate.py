"""Translating cues from a memory and a lexicon."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheaf.functions.text import is_bilingual, strip_tags

from .intervals import batched

#: Dropped from a word before it is looked up.
WORD_MARKS = "、。！？…・"
#: Rows of a lexicon that is sent to all tasks.
LEXICON_ROWS = 100_000
#: White space as Java has it with (?U).
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARK = re.compile(f"[{WORD_MARKS}]")


def lexicon_gloss(cues: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(media_id, seq, gloss, hits) of cues (media_id, seq, text): each word's gloss or the word, with one space between; hits are the words found."""
    words = cues.select("media_id", "seq", F.posexplode(F.split(F.col("text"), r"(?U)\s+")).alias("at", "w")).filter("w <> ''")
    words = words.withColumn("word", F.regexp_replace("w", f"[{WORD_MARKS}]", ""))
    found = words.join(lexicon.select("word", "gloss"), "word", "left")
    g = found.groupBy("media_id", "seq").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("gloss", "w").alias("t")))).alias("x"), F.count("gloss").alias("hits"))
    return g.select("media_id", "seq", F.array_join(F.transform("x", lambda v: v["t"]), " ").alias("gloss"), "hits")


def translate_from_memory(cues: DataFrame, memory: DataFrame, lexicon: DataFrame, src: str, tgt: str) -> DataFrame:
    """cues with clean, translation and status: bilingual already, memory, lexicon (a word at least was found), or failed.

    A gloss that only repeats the source is no translation, and none is added to the memory.
    """
    c = _known(cues.withColumns({"clean": strip_tags(F.col("text")), "_both": is_bilingual(F.col("text"))}), memory, src, tgt)
    return _outcomes(_glossed(c, lexicon))


def translate_media(blocks: DataFrame, memory: DataFrame, lexicon: DataFrame, src: str, tgt: str) -> DataFrame:
    """translate_from_memory for the blocks (media_id, at, timestamp, text) of whole media, `at` once in a media: only clean texts go to the memory, and only translations come back.

    The blocks of a media meet its answers, which are as many, in one row a media, so blocks that lie by media already are not moved, nor is what is made of them by media.
    Of several translations of a text the greatest counts.
    """
    asked = _known(blocks.select("media_id", F.col("at").alias("seq"), strip_tags(F.col("text")).alias("clean"), is_bilingual(F.col("text")).alias("_both")), memory, src, tgt)
    answers = _glossed(asked, lexicon).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", "_from_memory", "_gloss"))).alias("_answers"))
    answers = answers.withColumn("_answers", F.filter("_answers", lambda x, i: F.coalesce(F.get("_answers", i + 1)["seq"] != x["seq"], F.lit(True))))
    media = blocks.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("at", "timestamp", "text"))).alias("_blocks"))
    rows = media.join(answers, "media_id").select("media_id", F.explode(F.arrays_zip("_blocks", "_answers")).alias("_x"))
    c = rows.select("media_id", "_x._blocks.*", "_x._answers.*")
    return _outcomes(c.withColumns({"clean": strip_tags(F.col("text")), "_both": is_bilingual(F.col("text"))}))


def _known(cues: DataFrame, memory: DataFrame, src: str, tgt: str) -> DataFrame:
    """cues with `_from_memory`, the memory's translation of `clean`."""
    known = memory.filter((F.col("src") == src) & (F.col("tgt") == tgt)).select(F.col("text").alias("_m"), F.col("translation").alias("_from_memory"))
    return cues.join(known, F.col("clean") == F.col("_m"), "left").drop("_m")


def _outcomes(cues: DataFrame) -> DataFrame:
    """Status and translation of cues with `_both`, `_from_memory` and `_gloss`, which go."""
    status = F.when(F.col("_both"), "bilingual").when(F.col("_from_memory").isNotNull(), "memory").when(F.col("_gloss").isNotNull(), "lexicon").otherwise("failed")
    return cues.withColumns({"status": status, "translation": F.when(~F.col("_both"), F.coalesce("_from_memory", "_gloss"))}).drop("_both", "_from_memory", "_gloss")


def _glossed(cues: DataFrame, lexicon: DataFrame) -> DataFrame:
    """cues with `_gloss` of `clean` where neither `_both` nor `_from_memory` gives a translation, null if no word was found.

    A lexicon of at most LEXICON_ROWS goes to all tasks; a larger one is joined with the words.
    """
    wanted = ~F.col("_both") & F.col("_from_memory").isNull() & (F.col("clean") != "")
    found = lexicon.select("word", "gloss").filter("word IS NOT NULL").limit(LEXICON_ROWS + 1).collect()
    if len(found) > LEXICON_ROWS:
        gloss = lexicon_gloss(cues.filter(wanted).select("media_id", "seq", F.col("clean").alias("text")), lexicon).filter("hits > 0")
        return cues.join(gloss.select("media_id", "seq", F.col("gloss").alias("_gloss")), ["media_id", "seq"], "left")
    table: dict[str, list] = {}
    for word, gloss in found:
        table.setdefault(word, []).append(gloss)

    @F.arrow_udf("string")
    def glosses(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else gloss_of(t, table) for t in texts.to_pylist()], pa.string())

    return cues.withColumn("_gloss", glosses(F.when(wanted, F.col("clean"))))


def gloss_of(text: str, table: dict[str, list]) -> str | None:
    """The gloss of a text as lexicon_gloss has it, from the glosses of each word; none if no word has one."""
    out, hits = [], 0
    for w in filter(None, _GAP.split(text)):
        found = table.get(_MARK.sub("", w), (None,))
        hits += sum(g is not None for g in found)
        out += sorted(w if g is None else g for g in found)
    return " ".join(out) if hits else None


def missing_translations(cues: DataFrame, memory: DataFrame, src: str, tgt: str) -> DataFrame:
    """Distinct clean texts that the memory lacks: what a translator has to do."""
    clean = cues.filter(~is_bilingual(F.col("text"))).select(strip_tags(F.col("text")).alias("text")).filter("text <> ''").distinct()
    return clean.join(memory.filter((F.col("src") == src) & (F.col("tgt") == tgt)).select("text"), "text", "left_anti")


def translation_report(translated: DataFrame) -> DataFrame:
    """Counts of each media by outcome; a cue that is blank without tags has failed."""
    s = F.col("status")
    return translated.groupBy("media_id").agg(
        F.count("*").alias("total"), F.count_if(s.isin("memory", "lexicon")).alias("success"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "bilingual").alias("already")
    )


def batch_network_need(cues: DataFrame, memory: DataFrame, src: str, tgt: str, size: int = 10) -> DataFrame:
    """(media_id, batch_id, needs_network): a batch needs the translator for a blank cue, or for the first cue of a text that the memory lacks."""
    c = batched(cues, size).withColumns({"clean": strip_tags(F.col("text")), "_both": is_bilingual(F.col("text"))})
    known = memory.filter((F.col("src") == src) & (F.col("tgt") == tgt)).select(F.col("text").alias("_m"))
    c = c.join(known, F.col("clean") == F.col("_m"), "left")
    first = F.row_number().over(Window.partitionBy("media_id", "_both", "clean").orderBy("start_ms", "seq")) == 1
    c = c.withColumn("_first", first)
    need = ~F.col("_both") & ((F.col("clean") == "") | (F.col("_m").isNull() & F.col("_first")))
    return c.groupBy("media_id", "batch_id").agg(F.bool_or(need).alias("needs_network"))


