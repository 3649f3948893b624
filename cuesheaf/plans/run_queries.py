"""Queries over chunks, runs and merged chunk results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheaf.functions import media as M
from cuesheaf.functions import text as T
from cuesheaf.operators import intervals as I
from cuesheaf.operators import reports, rules, runs, similar

from . import fixtures as X
from .base import query


@query("SELECT media_id, substring(md5(path || '_' || size_bytes || '_' || mtime), 1, 16) AS fingerprint, substring(md5(path), 1, 8) AS run_key FROM media", "media")
def media_fingerprint(spark, sf_dir):
    return X.media(spark, sf_dir).select("media_id", M.media_fingerprint(F.col("path"), F.col("size_bytes"), F.col("mtime")).alias("fingerprint"), M.run_key(F.col("path")).alias("run_key"))


@query("SELECT media_id, substring(regexp_replace(name || ' (a)_b-' || media_id, '[^A-Za-z0-9_-]', '_', 'g'), 1, 50) AS safe FROM media", "media")
def safe_media_name(spark, sf_dir):
    return X.media(spark, sf_dir).select("media_id", T.safe_media_name(F.concat("name", F.lit(" (a)_b-"), F.col("media_id").cast("string"))).alias("safe"))


@query(
    """WITH p AS (SELECT media_id, u.i AS chunk_idx, least((u.i + 1) * 60000, duration_ms) - u.i * 60000 AS planned_ms FROM media, unnest(range(0, ceil(duration_ms / 60000)::BIGINT)) AS u(i) WHERE duration_ms > 0)
    SELECT chunks.*, planned_ms FROM chunks JOIN p USING (media_id, chunk_idx) WHERE dur_ms > 100 AND size_bytes > 1000 AND planned_ms >= 1000""", "chunks", "media")  # fmt: skip
def valid_chunks(spark, sf_dir):
    planned = I.plan_fixed_chunks(X.media(spark, sf_dir)).select("media_id", "chunk_idx", (F.col("end_ms") - F.col("start_ms")).alias("planned_ms"))
    c = X.chunks(spark, sf_dir).join(planned, ["media_id", "chunk_idx"])
    return c.filter(rules.valid_chunk(F.col("dur_ms"), F.col("size_bytes"), planned_ms=F.col("planned_ms")))


@query(
    """WITH i AS (SELECT *, sum(CASE WHEN readable THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY chunk_idx) AS k FROM chunks)
    SELECT media_id, chunk_idx, CASE WHEN NOT readable THEN chunk_idx * 60000 ELSE coalesce(max(CASE WHEN NOT readable THEN (chunk_idx + 1) * 60000 END) OVER (PARTITION BY media_id, k), 0)
      + coalesce(sum(CASE WHEN readable THEN dur_ms END) OVER (PARTITION BY media_id, k ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS start_ms FROM i""", "chunks")  # fmt: skip
def chunk_offsets(spark, sf_dir):
    return I.chunk_offsets(X.chunks(spark, sf_dir)).select("media_id", "chunk_idx", "start_ms")


@query("SELECT media_id, chunk_idx FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY chunk_idx) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM chunks) WHERE r <= greatest(1, least(n, n * 30 // 100))", "chunks")
def head_fraction(spark, sf_dir):
    return I.head_fraction(X.chunks(spark, sf_dir), 30).select("media_id", "chunk_idx")


@query("SELECT media_id, chunk_idx, row_number() OVER (PARTITION BY media_id ORDER BY 'c' || lpad(chunk_idx::VARCHAR, 6, '0')) AS place FROM chunks", "chunks")
def ordered_file_list(spark, sf_dir):
    c = X.chunks(spark, sf_dir).withColumn("path", F.concat(F.lit("c"), F.lpad(F.col("chunk_idx").cast("string"), 6, "0")))
    w = I.Window.partitionBy("media_id").orderBy("path")
    return c.select("media_id", "chunk_idx", F.row_number().over(w).cast("long").alias("place")).orderBy("media_id", "place")


@query(
    """WITH p AS (SELECT media_id, duration_ms, greatest(1, ceil((duration_ms - 2000) / 178000)) AS n FROM media), c AS (SELECT media_id, duration_ms, u.i AS chunk_idx FROM p, unnest(range(0, n::BIGINT)) AS u(i))
    SELECT media_id, chunk_idx, chunk_idx * 178000 AS start_ms, least(chunk_idx * 178000 + 180000, duration_ms) AS end_ms FROM c WHERE least(chunk_idx * 178000 + 180000, duration_ms) - chunk_idx * 178000 >= 1000""", "media")  # fmt: skip
def plan_overlapping_chunks(spark, sf_dir):
    return I.plan_overlapping_chunks(X.media(spark, sf_dir))


@query("SELECT media_id, u.i AS chunk_idx, u.i * 60000 AS start_ms, least((u.i + 1) * 60000, duration_ms) AS end_ms FROM media, unnest(range(0, ceil(duration_ms / 60000)::BIGINT)) AS u(i) WHERE duration_ms > 0", "media")
def plan_fixed_chunks(spark, sf_dir):
    return I.plan_fixed_chunks(X.media(spark, sf_dir))


_STATE = """st AS (SELECT media_id, state_mtime, path AS video_path, CASE WHEN processed > 6 THEN 0 ELSE processed END AS p, CASE WHEN media_id % 9 > 6 THEN 0 ELSE media_id % 9 END AS c FROM run_states),
fd AS (SELECT media_id, count(*) FILTER (WHERE (media_id + j) % 9 <> 0) AS n FROM media, range(0, 6) AS r(j) GROUP BY media_id)"""


@query(
    f"""WITH {_STATE} SELECT st.media_id, state_mtime, video_path, CASE WHEN p > n THEN 0 ELSE p END AS processed_segments, n AS total_segments, CASE WHEN c > n THEN 0 ELSE c END AS current_segment, n AS files FROM st JOIN fd USING (media_id)""",
    "state_files", "stored_segments")
def read_run_state(spark, sf_dir):
    return runs.read_run_state(X.state_files(spark, sf_dir), X.stored_segments(spark, sf_dir))


@query(
    """SELECT media_id, state_mtime, form, CASE WHEN form <> 'none' THEN path END AS path, CASE WHEN form <> 'none' THEN 'base' END AS model, CASE WHEN form = 'results' THEN fingerprint ELSE '' END AS fingerprint,
    (CASE WHEN form = 'none' THEN 0 WHEN form = 'results' THEN count(*) FILTER (WHERE done) ELSE processed END)::BIGINT AS processed, CASE WHEN form = 'none' THEN 0 ELSE 6 END AS total FROM any_states GROUP BY media_id, state_mtime, form, path, fingerprint, processed""", "any_states")  # fmt: skip
def read_any_state(spark, sf_dir):
    return runs.any_state(runs.parsed_states(X.any_state_files(spark, sf_dir)))


@query(
    """SELECT media_id, state_mtime, form, j AS chunk_idx, CASE WHEN form = 'marks' THEN dir || '/' || j || '.wav' END AS path, CASE WHEN form = 'results' THEN j + media_id % 2 END AS segments, CASE WHEN form = 'results' THEN j END AS filtered
    FROM any_states WHERE done AND form <> 'none' AND NOT (form = 'results' AND j = 4)""", "any_states")  # fmt: skip
def state_chunks(spark, sf_dir):
    return runs.state_chunks(runs.parsed_states(X.any_state_files(spark, sf_dir)))


@query("SELECT media_id, chunk_idx FROM chunks ANTI JOIN (SELECT media_id, j AS chunk_idx FROM any_states WHERE state_mtime = 2 AND done AND form <> 'none' AND NOT (form = 'results' AND j = 4)) d USING (media_id, chunk_idx)", "chunks", "any_states")
def pending_of_states(spark, sf_dir):
    return runs.pending_of_states(X.chunks(spark, sf_dir), runs.parsed_states(X.any_state_files(spark, sf_dir))).select("media_id", "chunk_idx")


@query(
    """WITH s AS (SELECT media_id, form, fingerprint, CASE WHEN form = 'none' THEN 0 WHEN form = 'results' THEN count(*) FILTER (WHERE done) ELSE processed END AS p FROM any_states WHERE state_mtime = 2 GROUP BY media_id, form, fingerprint, processed),
    go AS (SELECT media_id FROM s WHERE form <> 'none' AND p < 6 AND (form = 'marks' OR fingerprint <> '')), d AS (SELECT media_id, j AS chunk_idx FROM any_states WHERE state_mtime = 2 AND done AND form <> 'none' AND NOT (form = 'results' AND j = 4)),
    c AS (SELECT media_id, chunk_idx FROM chunks SEMI JOIN go USING (media_id) ANTI JOIN d USING (media_id, chunk_idx)), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY chunk_idx) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM c)
    SELECT media_id, chunk_idx FROM r WHERE r <= greatest(1, least(n, n * 50 // 100))""", "media", "chunks", "any_states")  # fmt: skip
def resume_any_state(spark, sf_dir):
    """The first half of the pending chunks of media whose newest state, of either form, is unfinished; one with a fingerprint has to match the present file."""
    m, parsed = X.media(spark, sf_dir), runs.parsed_states(X.any_state_files(spark, sf_dir))
    states = runs.any_state(parsed)
    last = runs.latest_state(m, states, m.limit(0)).filter("class = 'continue'").select("media_id")
    newest = states.join(states.groupBy("media_id").agg(F.max("state_mtime").alias("state_mtime")), ["media_id", "state_mtime"], "left_semi")
    same = runs.resumable_runs(m, newest).select("media_id")
    go = last.join(same.unionByName(newest.filter("form = 'marks'").select("media_id")), "media_id", "left_semi")
    rest = runs.pending_of_states(X.chunks(spark, sf_dir).join(go, "media_id", "left_semi"), parsed)
    return I.head_fraction(rest, 50).select("media_id", "chunk_idx")


@query("SELECT media_id, chunk_idx FROM chunks WHERE chunk_idx % 3 = 0", "chunks")
def pending_chunks(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    return runs.pending_chunks(c, c.filter("chunk_idx % 3 <> 0")).select("media_id", "chunk_idx")


@query("SELECT media_id, chunk_idx FROM chunks WHERE chunk_idx >= media_id % 7", "chunks")
def pending_after_mark(spark, sf_dir):
    marks = X.media(spark, sf_dir).select("media_id", (F.col("media_id") % 7).alias("processed"))
    return runs.after_mark(X.chunks(spark, sf_dir), marks).select("media_id", "chunk_idx")


@query("SELECT media_id, state_mtime FROM run_states WHERE media_id % 5 <> 0", "media", "run_states")
def resumable_runs(spark, sf_dir):
    return runs.resumable_runs(X.media(spark, sf_dir), X.run_states(spark, sf_dir)).select("media_id", "state_mtime")


@query("SELECT media.media_id, d.dir FROM media JOIN (SELECT DISTINCT dir FROM run_states) d ON contains(d.dir, media.name) AND contains(d.dir, 'base')", "media", "run_states")
def match_run_dirs(spark, sf_dir):
    return runs.match_run_dirs(X.media(spark, sf_dir), X.run_states(spark, sf_dir))


@query("SELECT media.media_id, count(chunks.media_id) AS actual, ceil(duration_ms / 60000)::BIGINT AS expected, abs(count(chunks.media_id) - ceil(duration_ms / 60000)) <= 3 AS accepted FROM media LEFT JOIN chunks ON chunks.media_id = media.media_id GROUP BY media.media_id, duration_ms", "media", "chunks")
def chunk_count_check(spark, sf_dir):
    return runs.chunk_count_check(X.media(spark, sf_dir), X.chunks(spark, sf_dir))


_LATEST = "SELECT media_id, CASE WHEN processed < 6 THEN 'continue' WHEN media_id % 2 = 0 THEN 'completed' ELSE 'abnormal' END AS class, processed, total FROM run_states WHERE state_mtime = 2"


@query(_LATEST, "media", "run_states")
def latest_state(spark, sf_dir):
    m = X.media(spark, sf_dir)
    return runs.latest_state(m, X.run_states(spark, sf_dir), m.filter("media_id % 2 = 0"))


@query(
    f"""WITH l AS ({_LATEST}), ok AS (SELECT media_id FROM run_states WHERE state_mtime = 2 AND media_id % 5 <> 0), c AS (SELECT chunks.media_id, chunk_idx FROM chunks JOIN l USING (media_id) JOIN ok USING (media_id) WHERE class = 'continue' AND chunk_idx >= processed),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY chunk_idx) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM c) SELECT media_id, chunk_idx FROM r WHERE r <= greatest(1, least(n, n * 50 // 100))""", "media", "run_states", "chunks")  # fmt: skip
def resume_plan(spark, sf_dir):
    m, states = X.media(spark, sf_dir), X.run_states(spark, sf_dir)
    go = runs.latest_state(m, states, m.filter("media_id % 2 = 0")).filter("class = 'continue'").select("media_id", "processed")
    same = runs.resumable_runs(m, states).filter("state_mtime = 2").select("media_id")
    go = go.join(same, "media_id", "left_semi")
    rest = runs.after_mark(X.chunks(spark, sf_dir).join(go.select("media_id"), "media_id", "left_semi"), go)
    return I.head_fraction(rest, 50).select("media_id", "chunk_idx")


@query(
    """SELECT media_id, count(*) AS chunks, sum(CASE WHEN chunk_id % 2 = 0 THEN n ELSE 0 END)::BIGINT AS speech_segments, sum(n)::BIGINT AS transcribed_segments, sum(chunk_id)::BIGINT AS filtered, sum(w)::BIGINT AS weak
    FROM (SELECT media_id, seq // 8 AS chunk_id, count(*) AS n, count(*) FILTER (WHERE seq % 3 = 0) AS w FROM cues GROUP BY ALL) GROUP BY media_id""", "cues")  # fmt: skip
def chunk_report(spark, sf_dir):
    s = X.cues(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("seq") / 8))
    c = s.groupBy("media_id", "chunk_id").agg(F.collect_list(F.struct("seq", (F.col("seq") % 3 == 0).alias("is_weak"))).alias("segments"))
    c = c.withColumns({"speech_segments": F.when(F.col("chunk_id") % 2 == 0, F.size("segments")), "transcribed_segments": F.lit(None).cast("int"), "filtered": F.col("chunk_id")})
    return reports.chunk_report(c)


@query("SELECT media_id, seq // 8 AS chunk_id, start_ms, seq, end_ms, text, confidence FROM cues", "cues")
def union_chunk_segments(spark, sf_dir):
    return similar.union_chunk_segments(similar.chunk_results(X.cues(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("seq") / 8))))


def _heard(spark, sf_dir):
    c = X.cues(spark, sf_dir)
    return c.filter(~rules.is_hallucination(F.col("text"), F.col("end_ms") - F.col("start_ms"))).withColumn("chunk_id", F.floor(F.col("seq") / 8))


@query()
def text_similarity(spark, sf_dir):
    w = I.by_start()
    c = X.cues(spark, sf_dir).select("media_id", "seq", "text", F.lag("text").over(w).alias("before"))
    return c.select("media_id", "seq", F.round(similar.text_similarity(F.col("before"), F.col("text")), 6).alias("similarity"))


_SHARED = """WITH p AS (SELECT media_id, seq, translate(lag(text) OVER (PARTITION BY media_id ORDER BY start_ms, seq), '、。,!?', '') AS x, translate(text, '、。,!?', '') AS y FROM cues),
l AS (SELECT media_id, seq, c, count(*) AS n FROM (SELECT media_id, seq, unnest(string_split(x, '')) AS c FROM p) WHERE c <> '' GROUP BY ALL), r AS (SELECT media_id, seq, c, count(*) AS n FROM (SELECT media_id, seq, unnest(string_split(y, '')) AS c FROM p) WHERE c <> '' GROUP BY ALL),
s AS (SELECT media_id, seq, sum(least(l.n, r.n))::BIGINT AS shared FROM l JOIN r USING (media_id, seq, c) GROUP BY ALL)
SELECT media_id, seq, CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE round(2.0 * least(length(x), length(y)) / (length(x) + length(y)), 6) END::DOUBLE AS by_length,
  CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE round(2.0 * coalesce(shared, 0) / (length(x) + length(y)), 6) END::DOUBLE AS by_characters FROM p LEFT JOIN s USING (media_id, seq) WHERE x IS NOT NULL"""


@query(_SHARED, "cues")
def similarity_bounds(spark, sf_dir):
    c = X.cues(spark, sf_dir).select("media_id", "seq", "text", F.lag("text").over(I.by_start()).alias("before")).filter("before IS NOT NULL")
    by_length, by_characters = similar.similarity_bounds(F.col("before"), F.col("text"))
    return c.select("media_id", "seq", F.round(by_length, 6).alias("by_length"), F.round(by_characters, 6).alias("by_characters"))


@query()
def similarity_ways(spark, sf_dir):
    """How the pairs of neighbouring texts are decided, and how many of each way are similar."""
    c = X.cues(spark, sf_dir).select("text", F.lag("text").over(I.by_start()).alias("before")).filter("before IS NOT NULL")
    c = c.select(similar.is_similar(F.col("before"), F.col("text")).alias("s"))
    return c.groupBy(F.col("s.way").alias("way")).agg(F.count("*").alias("pairs"), F.count_if("s.similar").alias("similar"))


@query()
def merge_similar_segments(spark, sf_dir):
    return similar.merge_similar_segments(_heard(spark, sf_dir))


@query()
def merge_similar_chunks(spark, sf_dir):
    return similar.merge_similar_chunks(_heard(spark, sf_dir))


@query()
def merge_chunked_transcript(spark, sf_dir):
    per_chunk = similar.merge_similar_segments(_heard(spark, sf_dir))
    merged = similar.merge_similar_chunks(similar.union_chunk_segments(similar.chunk_results(per_chunk)))
    return reports.transcript_text(merged)


_CLIPS = """cl AS (SELECT media_id, frame_idx // 16 AS part, list(sample ORDER BY frame_idx) AS s FROM frames GROUP BY ALL),
m AS (SELECT *, len(s) AS n, list_sum(list_transform(s, lambda v: abs(v))) AS loud, round(list_sum(list_transform(range(2, len(s) + 1), lambda i: abs(sign(s[i]) - sign(s[i - 1])))) / len(s), 6) AS crossing_rate FROM cl),
noise AS (SELECT media_id, part, crossing_rate, (loud / n < 0.1 * (sum(loud) OVER (PARTITION BY media_id)) / (sum(n) OVER (PARTITION BY media_id)) AND loud / n < 0.001) OR crossing_rate > 0.4 AS is_noise FROM m)"""


def _clips(spark, sf_dir):
    part = F.floor(F.col("frame_idx") / 16)
    g = X.frames(spark, sf_dir).groupBy("media_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "sample"))).alias("x"))
    return g.select("media_id", "part", F.transform("x", lambda v: v["sample"]).alias("samples"))


@query(f"WITH {_CLIPS} SELECT media_id, part, crossing_rate, is_noise FROM noise", "frames")
def filter_noise_intervals(spark, sf_dir):
    return rules.noise_intervals(_clips(spark, sf_dir)).select("media_id", "part", "crossing_rate", "is_noise")


@query(
    f"""WITH {_CLIPS}, f AS (SELECT media_id, frame_idx, round(10 * log10(sample * sample + 1e-10), 9) AS db FROM frames), l AS (SELECT media_id, round(quantile_cont(db, 0.3), 9) AS lim, max(frame_idx) AS last FROM f GROUP BY media_id),
    a AS (SELECT f.media_id, frame_idx, last, frame_idx - row_number() OVER (PARTITION BY f.media_id ORDER BY frame_idx) AS k FROM f JOIN l USING (media_id) WHERE db > lim),
    b AS (SELECT media_id, min(frame_idx) * 10 AS start_ms, (max(frame_idx) + 1) * 10 AS end_ms FROM a GROUP BY media_id, k, last HAVING count(*) >= 5 OR max(frame_idx) = last UNION ALL SELECT media_id, part * 160, part * 160 + 160 FROM noise WHERE part % 2 = 0 AND NOT is_noise),
    e AS (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY media_id, k HAVING max(end_ms) - min(start_ms) >= 150""", "frames")  # fmt: skip
def speech_interval_plan(spark, sf_dir):
    given = rules.noise_intervals(_clips(spark, sf_dir)).filter("part % 2 = 0 AND NOT is_noise")
    given = given.select("media_id", (F.col("part") * 160).alias("start_ms"), (F.col("part") * 160 + 160).alias("end_ms"))
    return I.union_detectors(given, I.energy_intervals(X.frames(spark, sf_dir)))
