"""Whole jobs, as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheaf.functions import text as T
from cuesheaf.functions import times
from cuesheaf.operators import intervals, ranges, rules, translate
from cuesheaf.sources import transcripts


def clean_transcript(cues: DataFrame, above: int = ranges.RANGE_ROWS) -> DataFrame:
    """Cues that no rule drops, adjacent duplicates merged, with their rendered line; one exchange by media_id (or by its range) serves all windows."""
    kept = ranges.by_size(cues, lambda c: rules.kept_whole(c).transform(intervals.merged_whole), lambda c: rules.kept_cut(c).transform(intervals.merged_cut), above=above)
    line = F.concat(F.lit("["), times.format_hms(F.abs("start_ms")), F.lit(" - "), times.format_hms(F.abs("end_ms")), F.lit("] "), "text")
    return kept.select("media_id", "seq", "start_ms", "end_ms", "text", "confidence", line.alias("line"))


def bilingual_blocks(blocks: DataFrame, memory: DataFrame, lexicon: DataFrame, src: str = "en", tgt: str = "xx") -> DataFrame:
    """Blocks (media_id, at, timestamp, text) with status and the text in both languages; blocks that have both stay as they are."""
    t = translate.translate_media(blocks, memory, lexicon, src, tgt)
    text = F.when(F.col("status") == "bilingual", F.col("text")).otherwise(T.format_bilingual(F.col("clean"), F.col("translation")))
    return t.select("media_id", "at", "timestamp", "status", text.alias("text"))


def bilingual_subtitles(files: DataFrame, memory: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Subtitle files to bilingual subtitle files (media_id, content)."""
    return transcripts.write_srt(bilingual_blocks(transcripts.read_srt(files), memory, lexicon))


def transcript_to_subtitles(files: DataFrame, memory: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Transcript text files to bilingual subtitle files (media_id, content)."""
    rows = transcripts.read_transcript_txt(files)
    blocks = rows.select("media_id", F.col("number").alias("at"), F.concat_ws(" --> ", "start", "end").alias("timestamp"), "text")
    return transcripts.write_srt(bilingual_blocks(blocks, memory, lexicon))
