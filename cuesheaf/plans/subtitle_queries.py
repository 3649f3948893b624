"""Queries over transcript and subtitle files and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheaf.operators import reports, translate
from cuesheaf.sources import storage, subtitle_files, transcripts
from cuesheaf.sources.keyed_store import memory_store

from . import fixtures as X
from . import pipelines
from .base import query
from .cue_queries import MERGED_CTE, REASON_CTE, _clock, _srt, bilingual_sql

_SPACE = r"'^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'"
_TXT = rf"""
lines AS (SELECT media_id, u.i, regexp_replace(u.raw, {_SPACE}) AS line FROM txt_files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(raw, i)),
parsed AS (SELECT *, regexp_matches(line, '^\[([^\]]*?) - ([^\]]*)\]') AS timed, regexp_replace(regexp_replace(regexp_replace(line, '^\[[^\]]*\]', ''), {_SPACE}), '^\[弱\][\s]*', '') AS t FROM lines),
hits AS (SELECT *, timed AND t <> '' AS hit, count(*) FILTER (WHERE timed AND t <> '') OVER (PARTITION BY media_id) AS n FROM parsed),
txt AS (SELECT media_id, CASE WHEN hit THEN row_number() OVER (PARTITION BY media_id ORDER BY i) ELSE i END AS number,
  CASE WHEN hit THEN replace(regexp_extract(line, '^\[([^\]]*?) - ([^\]]*)\]', 1), '.', ',') ELSE {_srt('((i - 1) * 1000)')} END AS "start",
  CASE WHEN hit THEN replace(regexp_extract(line, '^\[([^\]]*?) - ([^\]]*)\]', 2), '.', ',') ELSE {_srt('(i * 1000)')} END AS "end", CASE WHEN hit THEN t ELSE line END AS text
  FROM hits WHERE hit OR (n = 0 AND line <> '' AND NOT regexp_matches(line, '^(视频:|模型:)')))
"""
_SRT = rf"""
blocks AS (SELECT media_id, u.i - 1 AS at_, string_split(regexp_replace(u.b, {_SPACE}), chr(10)) AS l FROM srt_files, unnest(regexp_split_to_array(content, '\n\s*\n')) WITH ORDINALITY AS u(b, i)),
srt AS (SELECT media_id, at_, try_cast(l[1] AS INT) AS index, l[2] AS "timestamp", regexp_replace(array_to_string(l[3:], chr(10)), {_SPACE}) AS text FROM blocks WHERE len(l) >= 3 AND try_cast(l[1] AS INT) IS NOT NULL)
"""


def _gloss(table: str, text: str) -> str:
    return rf"""
words AS (SELECT media_id, k, u.i, u.w FROM {table}, unnest(regexp_split_to_array({text}, '\s+')) WITH ORDINALITY AS u(w, i) WHERE u.w <> ''),
gloss AS (SELECT media_id, k, string_agg(coalesce(gloss, w), ' ' ORDER BY i) AS gloss, count(gloss) AS hits FROM words LEFT JOIN lexicon ON regexp_replace(w, '[、。！？…・]', '', 'g') = word GROUP BY media_id, k)
"""


def _translated(table: str, key: str) -> str:
    """clean, translation and status of a table with media_id, `key` and text."""
    return rf"""
src AS (SELECT *, {key} AS k, regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), {_SPACE}) AS clean, contains(text, '<font') AND contains(text, chr(92) || 'n') AS both_ FROM {table}),
{_gloss('src', 'clean')},
tr AS (SELECT src.*, CASE WHEN both_ THEN 'bilingual' WHEN memory.translation IS NOT NULL THEN 'memory' WHEN hits > 0 THEN 'lexicon' ELSE 'failed' END AS status,
  CASE WHEN NOT both_ THEN coalesce(memory.translation, CASE WHEN hits > 0 THEN gloss END) END AS translation
  FROM src LEFT JOIN memory ON memory.text = clean LEFT JOIN gloss ON gloss.media_id = src.media_id AND gloss.k = src.k)
"""


@query(f"WITH {_TXT} SELECT * FROM txt", "cues", "txt_files")
def read_transcript_txt(spark, sf_dir):
    return transcripts.read_transcript_txt(X.txt_files(spark, sf_dir))


@query(f"WITH {_SRT} SELECT media_id, index, \"timestamp\", text FROM srt", "cues", "srt_files")
def read_srt(spark, sf_dir):
    return transcripts.read_srt(X.srt_files(spark, sf_dir)).drop("at")


_SRT_OUT = """string_agg(n || chr(10) || "timestamp" || chr(10) || text || chr(10), chr(10) ORDER BY n) AS content"""


@query(f"WITH {_SRT}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY at_) AS n FROM srt) SELECT media_id, {_SRT_OUT} FROM r GROUP BY media_id", "cues", "srt_files")
def write_srt(spark, sf_dir):
    return transcripts.write_srt(transcripts.read_srt(X.srt_files(spark, sf_dir)))


@query(
    f"""WITH {REASON_CTE}, {MERGED_CTE}, c AS (SELECT media_id, count(*) AS o, count(*) FILTER (WHERE reason IS NULL) AS f FROM reasons GROUP BY media_id),
    b AS (SELECT media_id, count(*) AS d, string_agg('[' || {_clock('abs(start_ms)')} || ' - ' || {_clock('abs(end_ms)')} || '] ' || CASE WHEN seq % 5 = 0 THEN '[弱] ' ELSE '' END || text, chr(10) ORDER BY start_ms, seq) AS body FROM merged GROUP BY media_id)
    SELECT media_id, '原始片段数: ' || o || chr(10) || '过滤后片段数: ' || f || chr(10) || '去重后片段数: ' || d || chr(10) || repeat('=', 50) || chr(10) || body AS content FROM b JOIN c USING (media_id)""", "cues")  # fmt: skip
def write_transcript_txt(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    kept = pipelines.clean_transcript(cues).withColumn("is_weak", F.col("seq") % 5 == 0)
    return transcripts.write_transcript_txt(kept, reports.filter_report(cues))


@query(
    """WITH g AS (SELECT media_id, trim(string_agg(text, ' ' ORDER BY start_ms, seq)) AS t, count(*) AS n, arg_max(end_ms, (start_ms, seq)) AS e FROM cues GROUP BY media_id)
    SELECT media_id, t AS text, n AS segments, n AS info_segments, e AS info_last_end_ms FROM g""", "cues")  # fmt: skip
def write_transcript_json(spark, sf_dir):
    """The written documents, read again."""
    made = transcripts.write_transcript_json(X.cues(spark, sf_dir))
    parsed = F.from_json("content", "text string, segments array<struct<text:string>>, info struct<segments:long,last_end_ms:long>")
    d = made.select("media_id", parsed.alias("d"))
    return d.select("media_id", "d.text", F.size("d.segments").cast("long").alias("segments"), F.col("d.info.segments").alias("info_segments"), F.col("d.info.last_end_ms").alias("info_last_end_ms"))


def _through_files(rows, kind):
    """Rows as they come back from the files that they were written to."""
    path = storage.shared_path(rows.sparkSession)
    subtitle_files.write_subtitles(rows, path, kind)
    return subtitle_files.read_subtitles(rows.sparkSession, path, kind).withColumn("media_id", F.col("media_id").cast("long"))


@query(f"WITH {_SRT} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY at_) AS index, \"timestamp\", text FROM srt", "cues", "srt_files")
def srt_files_again(spark, sf_dir):
    return _through_files(transcripts.read_srt(X.srt_files(spark, sf_dir)), "srt").drop("at")


@query(f"WITH {REASON_CTE}, {MERGED_CTE} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS number, {_clock('abs(start_ms)')} || ',000' AS \"start\", {_clock('abs(end_ms)')} || ',000' AS \"end\", text FROM merged", "cues")
def txt_files_again(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    kept = pipelines.clean_transcript(cues).withColumn("is_weak", F.col("seq") % 5 == 0)
    return _through_files(kept.join(reports.filter_report(cues), "media_id"), "txt")


@query("SELECT media_id, seq, start_ms, end_ms, text, confidence FROM cues", "cues")
def json_files_again(spark, sf_dir):
    return _through_files(X.cues(spark, sf_dir), "json")


@query("SELECT src, tgt, text, translation FROM memory", "memory")
def read_translation_memory(spark, sf_dir):
    m = X.memory(spark, sf_dir)
    bucket = F.pmod(F.xxhash64("text"), F.lit(m.count() // 5000 + 1))  # files of about 5,000 entries
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "src", "tgt", "text"), F.col("translation"))))
    files = m.groupBy("src", "tgt", bucket.alias("b")).agg(F.to_json(entries).alias("content")).drop("b")
    return transcripts.read_translation_memory(files)


@query(f"WITH b AS (SELECT media_id, seq AS k, text FROM cues), {_gloss('b', 'text')} SELECT media_id, k AS seq, gloss, hits FROM gloss", "cues", "lexicon")
def lexicon_gloss(spark, sf_dir):
    return translate.lexicon_gloss(X.cues(spark, sf_dir), X.lexicon(spark, sf_dir))


@query(f"WITH {_translated('cues', 'seq')} SELECT media_id, seq, clean, status, translation FROM tr", "cues", "memory", "lexicon")
def translate_from_memory(spark, sf_dir):
    t = translate.translate_from_memory(X.cues(spark, sf_dir), X.memory(spark, sf_dir), X.lexicon(spark, sf_dir), "en", "xx")
    return t.select("media_id", "seq", "clean", "status", "translation")


@query("SELECT DISTINCT trim(text) AS text FROM cues WHERE trim(text) <> '' AND trim(text) NOT IN (SELECT text FROM memory)", "cues", "memory")
def missing_translations(spark, sf_dir):
    return translate.missing_translations(X.cues(spark, sf_dir), X.memory(spark, sf_dir), "en", "xx")


@query(
    """WITH m AS (SELECT DISTINCT trim(text) AS text FROM cues WHERE trim(text) <> ''), b AS (SELECT media_id, trim(text) AS clean, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) - 1) // 10 AS batch_id FROM cues)
    SELECT media_id, batch_id, bool_or(clean = '') AS needs_network, (SELECT count(*) FROM m WHERE text NOT IN (SELECT text FROM memory)) AS missing_before, 0 AS missing_after FROM b GROUP BY media_id, batch_id""", "cues", "memory")  # fmt: skip
def memory_after_upsert(spark, sf_dir):
    """Batches that need the translator once its answers to all missing texts are in the lasting memory, and the missing texts before and after."""
    cues, store = X.cues(spark, sf_dir), memory_store(spark, storage.shared_path(spark), "en", "xx", 8)
    store.upsert(X.memory(spark, sf_dir))
    missing = storage.stored(translate.missing_translations(cues, store.current(), "en", "xx"))
    store.upsert(missing.select("text", F.lit("en").alias("src"), F.lit("xx").alias("tgt"), F.reverse("text").alias("translation")))
    left = translate.missing_translations(cues, store.current(), "en", "xx")
    out = translate.batch_network_need(cues, store.current(), "en", "xx")
    return out.withColumns({"missing_before": F.lit(missing.count()), "missing_after": F.lit(left.count())})


@query(f"WITH {_translated('cues', 'seq')} SELECT media_id, count(*) AS total, count(*) FILTER (WHERE status IN ('memory', 'lexicon')) AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'bilingual') AS already FROM tr GROUP BY media_id", "cues", "memory", "lexicon")
def translation_report(spark, sf_dir):
    return translate.translation_report(translate.translate_from_memory(X.cues(spark, sf_dir), X.memory(spark, sf_dir), X.lexicon(spark, sf_dir), "en", "xx"))


@query(
    """WITH c AS (SELECT media_id, trim(text) AS clean, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) - 1) // 10 AS batch_id, row_number() OVER (PARTITION BY media_id, trim(text) ORDER BY start_ms, seq) AS r FROM cues)
    SELECT media_id, batch_id, bool_or(clean = '' OR (r = 1 AND memory.text IS NULL)) AS needs_network FROM c LEFT JOIN memory ON memory.text = clean GROUP BY media_id, batch_id""", "cues", "memory")  # fmt: skip
def batch_network_need(spark, sf_dir):
    return translate.batch_network_need(X.cues(spark, sf_dir), X.memory(spark, sf_dir), "en", "xx")


def _subtitles(table: str, key: str, stamp: str) -> str:
    block = bilingual_sql("clean", "translation")
    return f"""{_translated(table, key)}, r AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY k) AS n, {stamp} AS "timestamp", CASE WHEN status = 'bilingual' THEN text ELSE {block} END AS text FROM tr)
    SELECT media_id, {_SRT_OUT} FROM r GROUP BY media_id"""


@query(f"WITH {_SRT}, {_subtitles('srt', 'at_', '\"timestamp\"')}", "cues", "srt_files", "memory", "lexicon")
def bilingual_subtitles(spark, sf_dir):
    return pipelines.bilingual_subtitles(X.srt_files(spark, sf_dir), X.memory(spark, sf_dir), X.lexicon(spark, sf_dir))


@query(f"WITH {_TXT}, {_subtitles('txt', 'number', '\"start\" || chr(32) || chr(45) || chr(45) || chr(62) || chr(32) || \"end\"')}", "cues", "txt_files", "memory", "lexicon")
def transcript_to_subtitles(spark, sf_dir):
    return pipelines.transcript_to_subtitles(X.txt_files(spark, sf_dir), X.memory(spark, sf_dir), X.lexicon(spark, sf_dir))
