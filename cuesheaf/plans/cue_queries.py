"""Queries over timed text: expressions, rules, ordered rows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheaf.functions import text as T
from cuesheaf.functions import times
from cuesheaf.operators import intervals as I
from cuesheaf.operators import reports, rules

from . import fixtures as X
from . import pipelines
from .base import query

_S = r"regexp_replace({0}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"
_STRIP = _S.format("text")
_CHARS = f"length(regexp_replace({_STRIP}, '[、。，．,.\\s]', '', 'g'))"


def _clock(x: str) -> str:
    return f"(CASE WHEN {x} // 3600000 < 10 THEN '0' ELSE '' END || ({x} // 3600000) || ':' || lpad((({x} // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad((({x} // 1000) % 60)::VARCHAR, 2, '0'))"


def _srt(x: str) -> str:
    return f"{_clock(x)} || ',' || lpad(({x} % 1000)::VARCHAR, 3, '0')"


def _wrap(x: str, n: int) -> str:
    return f"array_to_string(list_transform(range(0, (greatest(length({x}), 1) - 1) // {n} + 1), lambda k: substring({x}, k * {n} + 1, {n})), chr(92) || 'n')"


def _size(x: str) -> str:
    return f"(CASE WHEN length({x}) <= 20 THEN 16 WHEN length({x}) <= 40 THEN 14 WHEN length({x}) <= 60 THEN 12 ELSE 10 END)"


def bilingual_sql(s: str, t: str) -> str:
    return f"""CASE WHEN length(coalesce({t}, '')) > 0 THEN '<font size="' || greatest(8, {_size(t)} - 2) || '" color="gold">' || {_wrap(s, 20)} || '</font>' || chr(10) || '<font size="' || {_size(t)} || '" color="white">' || {_wrap(t, 25)} || '</font>' ELSE '<font size="16" color="white">' || {s} || '</font>' END"""


@query(f"SELECT media_id, seq, {_S.format('''regexp_replace('<i>' || text || '</i> ', '<[^>]+>', '', 'g')''')} AS clean FROM cues", "cues")
def strip_tags(spark, sf_dir):
    return X.cues(spark, sf_dir).select("media_id", "seq", T.strip_tags(F.concat(F.lit("<i>"), "text", F.lit("</i> "))).alias("clean"))


@query(f"SELECT media_id, seq, {_clock('abs(start_ms)')} AS clock FROM cues", "cues")
def format_hms(spark, sf_dir):
    return X.cues(spark, sf_dir).select("media_id", "seq", times.format_hms(F.abs("start_ms")).alias("clock"))


@query(f"SELECT media_id, seq, {_srt('abs(start_ms)')} AS clock FROM cues", "cues")
def format_srt_time(spark, sf_dir):
    return X.cues(spark, sf_dir).select("media_id", "seq", times.format_srt_time(F.abs("start_ms")).alias("clock"))


@query(
    f"""SELECT media_id, seq, CASE seq % 3 WHEN 0 THEN {_clock('abs(start_ms)')} || ',000' WHEN 1 THEN {_srt('abs(start_ms)')} ELSE {_clock('abs(start_ms)')} || ',' || rpad((abs(start_ms) % 1000 // 100)::VARCHAR, 3, '0') END AS clock,
    CASE seq % 3 WHEN 0 THEN abs(start_ms) // 1000 * 1000 WHEN 1 THEN abs(start_ms) ELSE abs(start_ms) // 100 * 100 END AS ms FROM cues""", "cues")  # fmt: skip
def parse_srt_time(spark, sf_dir):
    s = F.abs("start_ms")
    raw = F.when(F.col("seq") % 3 == 0, times.format_hms(s)).when(F.col("seq") % 3 == 1, times.format_srt_time(s)).otherwise(F.concat(times.format_hms(s), F.lit("."), F.floor(s % 1000 / 100).cast("string")))
    c = X.cues(spark, sf_dir).select("media_id", "seq", times.srt_clock(raw).alias("clock"))
    return c.withColumn("ms", times.clock_ms(F.col("clock")))


@query(f"SELECT media_id, seq, CASE WHEN end_ms > start_ms THEN round(length(regexp_replace(text, '[、。，．,.\\s]', '', 'g')) * 1000 / (end_ms - start_ms), 6) ELSE 0 END::DOUBLE AS rate FROM cues", "cues")
def speech_rate(spark, sf_dir):
    return X.cues(spark, sf_dir).select("media_id", "seq", T.speech_rate(F.col("text"), F.col("end_ms") - F.col("start_ms")).alias("rate"))


@query(f"SELECT media_id, seq, {_wrap('text', 20)} AS source, {_wrap('text', 25)} AS target FROM cues", "cues")
def wrap_text(spark, sf_dir):
    return X.cues(spark, sf_dir).select("media_id", "seq", T.wrap_text(F.col("text"), 20).alias("source"), T.wrap_text(F.col("text"), 25).alias("target"))


@query(f"SELECT media_id, seq, {_size('text')} AS target_size, greatest(8, {_size('text')} - 2) AS source_size FROM cues", "cues")
def font_size_bucket(spark, sf_dir):
    size = T.font_size(F.col("text"))
    return X.cues(spark, sf_dir).select("media_id", "seq", size.alias("target_size"), F.greatest(F.lit(8), size - 2).alias("source_size"))


@query(f"SELECT media_id, seq, {bilingual_sql('text', '''(CASE WHEN seq % 4 = 0 THEN NULL ELSE reverse(text) END)''')} AS block FROM cues", "cues")
def format_bilingual(spark, sf_dir):
    target = F.when(F.col("seq") % 4 != 0, F.reverse("text"))
    return X.cues(spark, sf_dir).select("media_id", "seq", T.format_bilingual(F.col("text"), target).alias("block"))


@query(
    """WITH c AS (SELECT *, greatest(0, least(rel_start_ms, processed_ms)) AS s FROM segments_raw WHERE trim(text) <> ''),
    d AS (SELECT *, greatest(s + 100, least(rel_end_ms, processed_ms)) AS e FROM c)
    SELECT media_id, seq, CASE WHEN actual_ms <> processed_ms THEN floor(s * actual_ms / processed_ms)::BIGINT ELSE s END + chunk_start_ms AS start_ms, CASE WHEN actual_ms <> processed_ms THEN floor(e * actual_ms / processed_ms)::BIGINT ELSE e END + chunk_start_ms AS end_ms, text FROM d""", "segments_raw")  # fmt: skip
def rescale_segment_times(spark, sf_dir):
    s, e = times.rescaled(F.col("rel_start_ms"), F.col("rel_end_ms"), F.col("processed_ms"), F.col("actual_ms"), F.col("processed_ms"), F.col("chunk_start_ms"))
    return X.segments_raw(spark, sf_dir).filter(~rules.is_blank(F.col("text"))).select("media_id", "seq", s.alias("start_ms"), e.alias("end_ms"), "text")


@query(
    """WITH c AS (SELECT *, CASE WHEN end_ms <= start_ms THEN start_ms + 500 ELSE end_ms END AS e FROM segments_raw)
    SELECT media_id, seq, start_ms, CASE WHEN e > chunk_start_ms + 120000 THEN start_ms + least(30000, e - start_ms) ELSE e END AS end_ms FROM c""", "segments_raw")  # fmt: skip
def repair_segment_times(spark, sf_dir):
    return X.segments_raw(spark, sf_dir).select("media_id", "seq", "start_ms", times.repaired_end(F.col("start_ms"), F.col("end_ms"), F.col("chunk_start_ms"), 60_000).alias("end_ms"))


# Rules. The SQL of each is its own: lists in place of back references, self joins in place of frames.
_D = "(end_ms - start_ms)"
_RULES = {
    "blank": f"{_STRIP} = ''",
    "confidence": "coalesce(confidence, 0) < -1.0 AND text <> 'yes'",
    "pattern": "contains(text, 'Thanks for watching')",
    "run": f"length({_STRIP}) > 5 AND len(list_filter(range(1, length({_STRIP}) - 3), lambda k: substring({_STRIP}, k, 5) = repeat(substring({_STRIP}, k, 1), 5))) > 0",
    "slow": f"{_CHARS} * 10000 < 3 * {_D} AND {_D} > 3000 AND text <> 'yes'",
    "fast": f"{_D} > 0 AND {_CHARS} * 1000 > 20 * {_D} AND text <> 'yes'",
    "too_short": f"{_D} < 300 AND text <> 'yes'",
    "too_long": f"{_D} > 30000",
}
REASON_CTE = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS a, count(*) OVER (PARTITION BY media_id) AS n FROM cues),
twin AS (SELECT DISTINCT x.media_id, x.seq FROM ranked x JOIN ranked y ON x.media_id = y.media_id AND y.a > least(x.n, x.a + 5) - 5 AND y.a <= least(x.n, x.a + 5) AND {_S.format('x.text')} = {_S.format('y.text')}
  AND (x.start_ms, x.end_ms, x.text, x.confidence) IS DISTINCT FROM (y.start_ms, y.end_ms, y.text, y.confidence) WHERE {_S.format('x.text')} <> 'yes'),
reasons AS (SELECT cues.*, CASE {' '.join(f"WHEN {v} THEN '{k}'" for k, v in _RULES.items())} WHEN twin.seq IS NOT NULL THEN 'repeat' END AS reason FROM cues LEFT JOIN twin USING (media_id, seq))
"""
MERGED_CTE = f"""
kept AS (SELECT media_id, seq, start_ms, end_ms, {_STRIP} AS text, confidence FROM reasons WHERE reason IS NULL),
breaks AS (SELECT *, CASE WHEN lag(text) OVER w = text AND start_ms - lag(end_ms) OVER w < 5000 THEN 0 ELSE 1 END AS b FROM kept WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seq)),
isl AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS g FROM breaks),
merged AS (SELECT media_id, arg_min(seq, (start_ms, seq)) AS seq, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, seq)) AS end_ms, min(text) AS text, arg_min(confidence, (start_ms, seq)) AS confidence, count(*) AS merged FROM isl GROUP BY media_id, g)
"""


@query(f"SELECT media_id, seq, text FROM cues WHERE NOT ({_RULES['blank']})", "cues")
def filter_blank_text(spark, sf_dir):
    return X.cues(spark, sf_dir).filter(~rules.is_blank(F.col("text"))).select("media_id", "seq", "text")


@query(f"SELECT media_id, seq, confidence FROM cues WHERE NOT ({_RULES['confidence']})", "cues")
def filter_low_confidence(spark, sf_dir):
    return X.cues(spark, sf_dir).filter(~rules.low_confidence(F.col("confidence"), F.col("text"))).select("media_id", "seq", "confidence")


@query(f"SELECT media_id, seq, text FROM cues WHERE NOT ({_RULES['pattern']})", "cues")
def filter_boilerplate(spark, sf_dir):
    return X.cues(spark, sf_dir).filter(~rules.is_boilerplate(F.col("text"))).select("media_id", "seq", "text")


@query(f"SELECT media_id, seq, text FROM cues WHERE NOT ({_RULES['run']})", "cues")
def filter_char_runs(spark, sf_dir):
    return X.cues(spark, sf_dir).filter(~rules.has_char_run(F.col("text"))).select("media_id", "seq", "text")


@query(f"SELECT media_id, seq, {_D} AS dur_ms FROM cues WHERE NOT ({_RULES['slow']}) AND NOT ({_RULES['fast']})", "cues")
def filter_speech_rate(spark, sf_dir):
    d = F.col("end_ms") - F.col("start_ms")
    return X.cues(spark, sf_dir).filter(~rules.too_slow(F.col("text"), d) & ~rules.too_fast(F.col("text"), d)).select("media_id", "seq", d.alias("dur_ms"))


@query(f"SELECT media_id, seq, {_D} AS dur_ms FROM cues WHERE NOT ({_RULES['too_short']}) AND NOT ({_RULES['too_long']})", "cues")
def filter_duration(spark, sf_dir):
    d = F.col("end_ms") - F.col("start_ms")
    return X.cues(spark, sf_dir).filter(~rules.too_short(F.col("text"), d) & ~rules.too_long(d)).select("media_id", "seq", d.alias("dur_ms"))


@query(f"WITH {REASON_CTE} SELECT media_id, seq, reason FROM reasons", "cues")
def segment_drop_reason(spark, sf_dir):
    return rules.with_drop_reason(X.cues(spark, sf_dir)).select("media_id", "seq", "reason")


@query(
    f"""SELECT media_id, seq, {_STRIP} AS text FROM (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN text || repeat(' ', 20) ELSE text END AS text) FROM cues) WHERE {_STRIP} <> '' AND NOT starts_with({_STRIP}, 'Thanks for watching')
    AND NOT ({_D} > 3000 AND length(text) * 2000 < {_D}) AND NOT ({_D} > 0 AND length(text) * 1000 > 12 * {_D})""", "cues")  # fmt: skip
def filter_hallucination(spark, sf_dir):
    padded = F.when(F.col("seq") % 3 == 0, F.concat("text", F.lit(" " * 20))).otherwise(F.col("text"))
    return X.cues(spark, sf_dir).withColumn("text", padded).filter(~rules.is_hallucination(F.col("text"), F.col("end_ms") - F.col("start_ms"))).select("media_id", "seq", T.strip(F.col("text")).alias("text"))


@query(f"WITH b AS (SELECT media_id, seq, {bilingual_sql('text', 'reverse(text)')} AS block FROM cues) SELECT media_id, seq, contains(block, '<font') AND contains(block, chr(92) || 'n') AS bilingual FROM b", "cues")
def is_bilingual(spark, sf_dir):
    c = X.cues(spark, sf_dir).select("media_id", "seq", T.format_bilingual(F.col("text"), F.reverse("text")).alias("block"))
    return c.select("media_id", "seq", T.is_bilingual(F.col("block")).alias("bilingual"))


@query(f"WITH {REASON_CTE} SELECT cues.media_id, cues.seq, twin.seq IS NOT NULL AS repeated FROM cues LEFT JOIN twin USING (media_id, seq)", "cues")
def repeats_in_context(spark, sf_dir):
    return rules.with_repeats(X.cues(spark, sf_dir)).select("media_id", "seq", "repeated")


@query(f"WITH {REASON_CTE}, {MERGED_CTE} SELECT * FROM merged", "cues")
def merge_adjacent_duplicates(spark, sf_dir):
    return I.merge_adjacent_duplicates(rules.with_drop_reason(X.cues(spark, sf_dir)).filter("reason IS NULL"))


@query(f"WITH {REASON_CTE}, {MERGED_CTE} SELECT media_id, seq, start_ms, end_ms, text, confidence, '[' || {_clock('abs(start_ms)')} || ' - ' || {_clock('abs(end_ms)')} || '] ' || text AS line FROM merged", "cues")
def clean_transcript(spark, sf_dir):
    return pipelines.clean_transcript(X.cues(spark, sf_dir))


@query(
    f"""WITH {REASON_CTE}, {MERGED_CTE}, c AS (SELECT media_id, count(*) AS original, count(*) FILTER (WHERE reason IS NULL) AS filtered, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS n_{r}" for r in (*_RULES, 'repeat'))} FROM reasons GROUP BY media_id),
    m AS (SELECT media_id, count(*) AS deduplicated FROM merged GROUP BY media_id)
    SELECT c.*, coalesce(deduplicated, 0) AS deduplicated, original - coalesce(deduplicated, 0) AS removed FROM c LEFT JOIN m USING (media_id)""", "cues")  # fmt: skip
def filter_report(spark, sf_dir):
    return reports.filter_report(X.cues(spark, sf_dir))


_EVENTS_SQL = """e AS (SELECT media_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {0}),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY media_id, k HAVING max(end_ms) - min(start_ms) >= 150"""


@query("WITH " + _EVENTS_SQL.format("intervals"), "intervals")
def merge_intervals(spark, sf_dir):
    return I.merge_intervals(X.intervals(spark, sf_dir))


@query("WITH b AS (SELECT media_id, start_ms, end_ms FROM intervals WHERE src NOT IN ('click', 'view') UNION ALL SELECT media_id, start_ms, end_ms FROM intervals WHERE src IN ('click', 'view')), " + _EVENTS_SQL.format("b"), "intervals")
def union_detectors(spark, sf_dir):
    x = X.intervals(spark, sf_dir)
    second = F.col("src").isin("click", "view")
    return I.union_detectors(x.filter(~second), x.filter(second))


@query(
    """WITH g AS (SELECT media_id, seq, start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS gap FROM cues)
    SELECT media_id, seq, CASE WHEN gap < 0 THEN 'overlap' ELSE 'gap' END AS kind, abs(gap) AS ms FROM g WHERE gap < 0 OR gap > 2000""", "cues")  # fmt: skip
def gaps_and_overlaps(spark, sf_dir):
    return I.gaps_and_overlaps(X.cues(spark, sf_dir))


@query(
    """WITH f AS (SELECT media_id, frame_idx, round(10 * log10(sample * sample + 1e-10), 9) AS db FROM frames), l AS (SELECT media_id, round(quantile_cont(db, 0.3), 9) AS lim, max(frame_idx) AS last FROM f GROUP BY media_id),
    a AS (SELECT f.media_id, frame_idx, last, frame_idx - row_number() OVER (PARTITION BY f.media_id ORDER BY frame_idx) AS k FROM f JOIN l USING (media_id) WHERE db > lim)
    SELECT media_id, min(frame_idx) * 10 AS start_ms, (max(frame_idx) + 1) * 10 AS end_ms FROM a GROUP BY media_id, k, last HAVING count(*) >= 5 OR max(frame_idx) = last""", "frames")  # fmt: skip
def energy_intervals(spark, sf_dir):
    return I.energy_intervals(X.frames(spark, sf_dir))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS number FROM cues)", "cues")
def renumber(spark, sf_dir):
    return I.renumbered(X.cues(spark, sf_dir))


@query("SELECT media_id, seq, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) - 1) // 10 AS batch_id FROM cues", "cues")
def batch_id(spark, sf_dir):
    return I.batched(X.cues(spark, sf_dir)).select("media_id", "seq", "batch_id")


_TRIES = "(SELECT media_id, seq // 3 AS part, seq % 3 + 1 AS attempt, confidence * 2 + 0.2 AS confidence FROM cues)"


@query(
    f"""WITH a AS (SELECT media_id * 1000000 + part AS media_id, attempt, confidence FROM {_TRIES}), b AS (SELECT *, max(confidence) OVER (PARTITION BY media_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY confidence DESC, attempt) AS r FROM b WHERE p IS NULL OR p <= -1.0) SELECT media_id, attempt, round(confidence, 6) AS confidence FROM c WHERE r = 1""", "cues")  # fmt: skip
def best_attempt(spark, sf_dir):
    part = F.floor(F.col("seq") / 3)
    a = X.cues(spark, sf_dir).select((F.col("media_id") * 1000000 + part).alias("media_id"), (F.col("seq") % 3 + 1).alias("attempt"), (F.col("confidence") * 2 + 0.2).alias("confidence"))
    return I.best_attempt(a).select("media_id", "attempt", F.round("confidence", 6).alias("confidence"))


@query("SELECT media_id, seq, start_ms, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS place FROM cues", "cues")
def sort_by_start(spark, sf_dir):
    c = X.cues(spark, sf_dir)
    return c.select("media_id", "seq", "start_ms", F.row_number().over(I.by_start()).cast("long").alias("place")).orderBy("media_id", "place")


_LIMITS = "lim AS (SELECT media_id, max(end_ms) * 8 // 10 AS duration_ms FROM cues GROUP BY media_id)"


def _limits(c):
    return c.groupBy("media_id").agg(F.floor(F.max("end_ms") * 8 / 10).alias("duration_ms"))


@query(f"WITH {_LIMITS}, r AS (SELECT cues.media_id, seq, end_ms, row_number() OVER (PARTITION BY cues.media_id ORDER BY start_ms, seq) AS place FROM cues JOIN lim USING (media_id) WHERE end_ms > duration_ms) SELECT * FROM r WHERE place <= 3", "cues")
def first_k_out_of_range(spark, sf_dir):
    c = X.cues(spark, sf_dir)
    return I.first_out_of_range(c, _limits(c)).select("media_id", "seq", "end_ms", "place")


@query(
    f"""WITH {_LIMITS}, g AS (SELECT cues.*, duration_ms, start_ms - lag(end_ms) OVER (PARTITION BY cues.media_id ORDER BY start_ms, seq) AS gap FROM cues JOIN lim USING (media_id)),
    a AS (SELECT media_id, count(*) AS segments, min(start_ms) AS first_start_ms, arg_max(end_ms, (start_ms, seq)) AS last_end_ms, count(*) FILTER (WHERE gap < 0) AS "overlaps", coalesce(sum(-gap) FILTER (WHERE gap < 0), 0)::BIGINT AS overlap_ms,
      count(*) FILTER (WHERE gap > 2000) AS gaps, coalesce(sum(gap) FILTER (WHERE gap > 2000), 0)::BIGINT AS gap_ms, bool_and(start_ms <= end_ms) AS ordered, count(*) FILTER (WHERE end_ms * 10 > duration_ms * 11) AS late FROM g GROUP BY media_id)
    SELECT *, last_end_ms - first_start_ms AS span_ms, round((last_end_ms - first_start_ms) / segments, 3) AS mean_span_ms, round(overlap_ms / nullif("overlaps", 0), 3) AS mean_overlap_ms, round(gap_ms / nullif(gaps, 0), 3) AS mean_gap_ms FROM a""", "cues")  # fmt: skip
def continuity_stats(spark, sf_dir):
    c = X.cues(spark, sf_dir)
    return reports.continuity_stats(c, _limits(c))


@query(f"WITH {REASON_CTE} SELECT media_id, trim(string_agg(text, ' ' ORDER BY start_ms, seq)) AS text FROM reasons WHERE reason IS NULL GROUP BY media_id", "cues")
def transcript_text(spark, sf_dir):
    return reports.transcript_text(rules.with_drop_reason(X.cues(spark, sf_dir)).filter("reason IS NULL"))


@query(
    """SELECT run_id, event_id, stage, ts_ms - coalesce(lag(ts_ms) OVER w, ts_ms) AS stage_ms, ts_ms - min(ts_ms) OVER w AS total_ms, floor((ts_ms - min(ts_ms) OVER w) * 1000 / 3600000) / 1000 AS real_time_factor
    FROM stage_events WINDOW w AS (PARTITION BY run_id ORDER BY ts_ms, event_id)""", "stage_events")  # fmt: skip
def stage_durations(spark, sf_dir):
    return reports.stage_durations(X.stage_events(spark, sf_dir))
