"""Transcript and subtitle files: reading contents into cues, and cues into contents.

The readers take (media_id, content); `whole_files` makes such rows of a folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheaf.functions import times
from cuesheaf.functions.text import strip

# The beginnings of header lines; where no line has a time, only the first six count.
HEADERS = ("视频:", "模型:", "语言:", "音频预处理:", "转录时间:", "音频时长:", "原始片段数:", "过滤后片段数:", "去重后片段数:", "=")
WEAK_MARK = "[弱]"
MEMORY_ROW = "src string, tgt string, text string, translation string"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, content) of each file under a path; media_id is the path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content"))


def _starts(line: Column, prefixes: tuple[str, ...]) -> Column:
    return line.rlike("^(?:" + "|".join(prefixes) + ")")


def read_transcript_txt(files: DataFrame) -> DataFrame:
    """(media_id, number, start, end, text) of lines `[t0 - t1] text`, with subtitle clocks.

    A weak mark is dropped, then blank texts, and what is left is numbered. A file without such a
    line gives each line that is neither blank nor a header, line i (from 1) from second i - 1 to i.
    """
    lines = files.select("media_id", F.posexplode(F.split("content", "\n", -1)).alias("i", "raw")).select("media_id", "i", strip(F.col("raw")).alias("line"))
    timed = r"^\[([^\]]*?) - ([^\]]*)\](.*)$"
    text = strip(F.regexp_extract("line", timed, 3))
    text = F.when(F.startswith(text, F.lit(WEAK_MARK)), strip(F.substr(text, F.lit(len(WEAK_MARK) + 1)))).otherwise(text)
    lines = lines.withColumns({"hit": F.col("line").rlike(timed) & ~_starts(F.col("line"), HEADERS), "text": text})
    lines = lines.withColumn("hit", F.col("hit") & (F.col("text") != "")).withColumn("hits", F.count_if("hit").over(Window.partitionBy("media_id")))
    kept = lines.filter(F.col("hit") | ((F.col("hits") == 0) & (F.col("line") != "") & ~_starts(F.col("line"), HEADERS[:6])))
    number = F.when(F.col("hit"), F.row_number().over(Window.partitionBy("media_id").orderBy("i"))).otherwise(F.col("i") + 1).cast("long")

    def clock(k: int, second: Column) -> Column:
        return F.when(F.col("hit"), times.srt_clock(strip(F.regexp_extract("line", timed, k)))).otherwise(times.format_srt_time(second.cast("long") * 1000))

    return kept.select("media_id", number.alias("number"), clock(1, F.col("i")).alias("start"), clock(2, F.col("i") + 1).alias("end"), F.when(F.col("hit"), F.col("text")).otherwise(F.col("line")).alias("text"))


def read_srt(files: DataFrame) -> DataFrame:
    """(media_id, at, index, timestamp, text) of the well-formed blocks: a whole number, a time line and at least one line of text."""
    blocks = files.select("media_id", F.posexplode(F.split(strip(F.col("content")), r"(?U)\n\s*\n", -1)).alias("at", "block"))
    lines = blocks.select("media_id", "at", F.split(strip(F.col("block")), "\n", -1).alias("l")).filter(F.size("l") >= 3)
    index = strip(F.col("l")[0]).try_cast("int")
    out = lines.select("media_id", F.col("at").cast("long").alias("at"), index.alias("index"), strip(F.col("l")[1]).alias("timestamp"), strip(F.array_join(F.slice("l", 3, F.size("l")), "\n")).alias("text"))
    return out.filter("index IS NOT NULL")


def _joined(rows: DataFrame, text: Column, between: str) -> DataFrame:
    """One text a media, of the rows in the order of `at`."""
    parts = F.transform(_in_order(text.alias("t")), lambda x: x["t"])
    return rows.groupBy("media_id").agg(F.array_join(parts, between).alias("content"))


def _in_order(*columns: Column | str) -> Column:
    return F.array_sort(F.collect_list(F.struct("at", *columns)))


def write_srt(blocks: DataFrame) -> DataFrame:
    """(media_id, content) of blocks (media_id, at, timestamp, text), numbered anew from 1."""
    parts = F.transform(_in_order("timestamp", "text"), lambda x, i: F.concat_ws("\n", (i + 1).cast("string"), x["timestamp"], x["text"], F.lit("")))
    return blocks.groupBy("media_id").agg(F.array_join(parts, "\n").alias("content"))


def write_transcript_txt(cues: DataFrame, counts: DataFrame) -> DataFrame:
    """(media_id, content): a header with counts (media_id, original, filtered, deduplicated), then a line a cue; weak cues carry the mark."""
    line = F.concat(F.lit("["), times.format_hms(F.abs("start_ms")), F.lit(" - "), times.format_hms(F.abs("end_ms")), F.lit("] "), F.when(F.col("is_weak"), F.lit(f"{WEAK_MARK} ")).otherwise(F.lit("")), F.col("text"))
    body = _joined(cues.withColumn("at", F.struct("start_ms", "seq")), line, "\n")
    head = F.concat(F.lit(HEADERS[6] + " "), F.col("original").cast("string"), F.lit("\n" + HEADERS[7] + " "), F.col("filtered").cast("string"), F.lit("\n" + HEADERS[8] + " "), F.col("deduplicated").cast("string"), F.lit("\n" + "=" * 50 + "\n"))
    return body.join(counts, "media_id").select("media_id", F.concat(head, "content").alias("content"))


def write_transcript_json(cues: DataFrame) -> DataFrame:
    """(media_id, content): text, segments and info of each media as JSON."""
    segments = F.array_sort(F.collect_list(F.struct("start_ms", "seq", "end_ms", "text", "confidence")))
    g = cues.groupBy("media_id").agg(segments.alias("segments"))
    text = F.trim(F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    info = F.struct(F.size("segments").alias("segments"), F.try_element_at("segments", F.lit(-1))["end_ms"].alias("last_end_ms"))
    return g.select("media_id", F.to_json(F.struct(text.alias("text"), "segments", info.alias("info"))).alias("content"))


def read_translation_memory(files: DataFrame) -> DataFrame:
    """(src, tgt, text, translation) of JSON maps (src, tgt, content) with keys `src_tgt_text`; an unreadable file is an empty memory.

    Python parses the files: Spark's parser gives up a file with a key of over 50,000 characters.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield memory_rows(*(b.column(name)[k].as_py() for name in ("src", "tgt", "content")))

    return files.select("src", "tgt", "content").mapInArrow(parsed, MEMORY_ROW)


def memory_rows(src: str | None, tgt: str | None, content: str | None) -> pa.RecordBatch:
    """The entries of one file of a memory; a value that is no text is given as JSON."""
    try:
        entries = json.loads(content or "")
    except (ValueError, RecursionError):
        entries = None
    start = f"{src}_{tgt}_"
    known = isinstance(entries, dict) and src is not None and tgt is not None
    rows = [(k[len(start) :], v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for k, v in entries.items() if k.startswith(start)] if known else []
    if "\\u" in (content or ""):  # half of a pair alone is no character
        rows = [tuple(x and x.encode("utf-8", "replace").decode() for x in r) for r in rows]
    columns = [[src] * len(rows), [tgt] * len(rows), [t for t, _ in rows], [v for _, v in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["src", "tgt", "text", "translation"])


def write_files(contents: DataFrame, path: str) -> None:
    """One folder a media with its content as a text file."""
    contents.select("media_id", F.col("content").alias("value")).write.partitionBy("media_id").text(path)
