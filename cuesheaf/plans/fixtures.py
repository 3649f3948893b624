"""The operators' input tables, derived from the given tables: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    k = F.col("doc_id") + F.col("i")
    text = F.when((k % 17).isin(0, 1), "yes").when(k % 23 == 0, "Thanks for watching.").when(k % 29 == 0, "haaaaaaa").when(k % 37 == 0, "").otherwise(F.trim("line"))
    speed = (F.col("doc_id") * 7 + F.col("i") * 13) % 8
    factor = F.when(speed == 0, 30).when(speed == 1, 4000).when(speed == 2, 600).when(speed == 3, 10).otherwise(90)
    gap = F.element_at(F.array(*map(F.lit, (0, 250, -200, 2500, 6000))), (k % 5 + 1).cast("int")).cast("long")
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.select("doc_id", F.col("i").cast("long").alias("i"), text.alias("text"), factor.alias("factor"), gap.alias("gap"))
    out = out.withColumn("dur", dur_of("text")).withColumn("end_ms", F.sum(F.col("dur") + F.col("gap")).over(order))
    conf = -((F.col("doc_id") * 31 + F.col("i") * 17) % 120) / 100
    return out.select(F.col("doc_id").alias("media_id"), F.col("i").alias("seq"), (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms", "text", conf.cast("double").alias("confidence"))


def dur_of(text: str) -> F.Column:
    return F.when(F.col(text) == "yes", 200).when(F.col(text) == "haaaaaaa", 1000).otherwise(F.length(text) * F.col("factor")).cast("long")


SQL["cues"] = """
  SELECT doc_id AS media_id, i AS seq, end_ms - dur AS start_ms, end_ms, text, -((doc_id * 31 + i * 17) % 120) / 100.0::DOUBLE AS confidence FROM (
    SELECT *, (sum(dur + CASE (doc_id + i) % 5 WHEN 0 THEN 0 WHEN 1 THEN 250 WHEN 2 THEN -200 WHEN 3 THEN 2500 ELSE 6000 END) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS end_ms FROM (
      SELECT *, (CASE text WHEN 'yes' THEN 200 WHEN 'haaaaaaa' THEN 1000 ELSE length(text) * CASE (doc_id * 7 + i * 13) % 8 WHEN 0 THEN 30 WHEN 1 THEN 4000 WHEN 2 THEN 600 WHEN 3 THEN 10 ELSE 90 END END)::BIGINT AS dur FROM (
        SELECT doc_id, i, CASE WHEN (doc_id + i) % 17 IN (0, 1) THEN 'yes' WHEN (doc_id + i) % 23 = 0 THEN 'Thanks for watching.' WHEN (doc_id + i) % 29 = 0 THEN 'haaaaaaa' WHEN (doc_id + i) % 37 = 0 THEN '' ELSE trim(line) END AS text
        FROM (SELECT doc_id, u.line, (u.i - 1)::BIGINT AS i FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)))))
"""


def segments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("seq") / 8))
    c = c.withColumn("chunk_start_ms", F.min("start_ms").over(Window.partitionBy("media_id", "chunk_id")))
    return c.withColumns({
        "actual_ms": F.lit(60000).cast("long"), "processed_ms": (60000 + (F.col("media_id") % 3 - 1) * 1500).cast("long"),
        "rel_start_ms": F.col("start_ms") - F.col("chunk_start_ms"), "rel_end_ms": F.col("end_ms") - F.col("chunk_start_ms"),
    })


SQL["segments_raw"] = """
  SELECT *, start_ms - chunk_start_ms AS rel_start_ms, end_ms - chunk_start_ms AS rel_end_ms FROM (
    SELECT *, min(start_ms) OVER (PARTITION BY media_id, chunk_id) AS chunk_start_ms, 60000 AS actual_ms, 60000 + (media_id % 3 - 1) * 1500 AS processed_ms FROM (SELECT *, seq // 8 AS chunk_id FROM cues))
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("media_id"), "event_id", start.alias("start_ms"), (start + F.round(F.col("value") * 100).cast("long") * 600).alias("end_ms"), F.col("event_type").alias("src"))


SQL["intervals"] = "SELECT user_id AS media_id, event_id, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + round(value * 100)::BIGINT * 600 AS end_ms, event_type AS src FROM events"


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("stage"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


SQL["stage_events"] = "SELECT user_id AS run_id, event_id, event_type AS stage, (epoch_us(ts) // 1000) AS ts_ms FROM events"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), F.posexplode("embedding").alias("frame_idx", "sample"))
    return f.select("media_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("sample").cast("double").alias("sample"))


SQL["frames"] = "SELECT vec_id AS media_id, (u.i - 1)::BIGINT AS frame_idx, u.s::DOUBLE AS sample FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(s, i)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(
        F.col("o_custkey").alias("media_id"), idx.cast("long").alias("chunk_idx"), F.floor("o_totalprice").cast("long").alias("dur_ms"),
        (F.col("o_orderstatus") != "P").alias("readable"), (F.col("o_orderkey") % 3000).cast("long").alias("size_bytes"),
    )


SQL["chunks"] = "SELECT o_custkey AS media_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chunk_idx, floor(o_totalprice)::BIGINT AS dur_ms, o_orderstatus <> 'P' AS readable, o_orderkey % 3000 AS size_bytes FROM orders"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("media_id"), F.concat(F.lit("/media/"), "c_name", F.lit(".mp4")).alias("path"), F.col("c_name").alias("name"),
        (F.col("c_custkey") * 1000).alias("size_bytes"), F.col("c_nationkey").cast("long").alias("mtime"), F.floor(F.abs("c_acctbal") * 100).cast("long").alias("duration_ms"),
    )


SQL["media"] = "SELECT c_custkey AS media_id, '/media/' || c_name || '.mp4' AS path, c_name AS name, c_custkey * 1000 AS size_bytes, c_nationkey::BIGINT AS mtime, floor(abs(c_acctbal) * 100)::BIGINT AS duration_ms FROM customer"


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir).withColumn("state_mtime", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    own = F.substring(F.md5(F.concat_ws("_", "path", F.col("size_bytes").cast("string"), F.col("mtime").cast("string")).cast("binary")), 1, 16)
    return m.select(
        "media_id", "path", "state_mtime", F.lit("base").alias("model"),
        F.when(F.col("media_id") % 5 == 0, F.lit("")).otherwise(own).alias("fingerprint"),
        ((F.col("media_id") + F.col("state_mtime")) % 7).cast("long").alias("processed"), F.lit(6).cast("long").alias("total"),
        F.concat("name", F.lit("_"), F.substring(F.md5(F.col("path").cast("binary")), 1, 8), F.lit("_base")).alias("dir"),
    )


SQL["run_states"] = """
  SELECT media_id, path, s AS state_mtime, 'base' AS model, CASE WHEN media_id % 5 = 0 THEN '' ELSE substring(md5(path || '_' || size_bytes || '_' || mtime), 1, 16) END AS fingerprint,
    (media_id + s) % 7 AS processed, 6::BIGINT AS total, name || '_' || substring(md5(path), 1, 8) || '_base' AS dir FROM media, (VALUES (1::BIGINT), (2::BIGINT)) AS v(s)
"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cues(spark, sf_dir).select("text").filter((F.trim("text") != "") & (F.length("text") % 2 == 0)).distinct()
    return t.select(F.lit("en").alias("src"), F.lit("xx").alias("tgt"), "text", F.reverse("text").alias("translation"))


SQL["memory"] = "SELECT DISTINCT 'en' AS src, 'xx' AS tgt, text, reverse(text) AS translation FROM cues WHERE trim(text) <> '' AND length(text) % 2 = 0"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \n]+")).alias("word")).filter("word <> ''").distinct()
    return w.select("word", F.upper(F.replace(F.col("word"), F.lit("ß"), F.lit("ss"))).alias("gloss"))


SQL["lexicon"] = "SELECT DISTINCT word, upper(replace(word, 'ß', 'ss')) AS gloss FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM benchmark) WHERE word <> ''"


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    clock = "concat(lpad(cast({0} div 3600000 as string),2,'0'),':',lpad(cast(({0} div 60000)%60 as string),2,'0'),':',lpad(cast(({0} div 1000)%60 as string),2,'0'),',',lpad(cast({0}%1000 as string),3,'0'))"
    index = F.when((F.col("media_id") % 10 == 3) & (F.col("seq") == 1), F.lit("x")).otherwise((F.col("seq") + 1).cast("string"))
    block = F.concat(index, F.lit("\n"), F.expr(clock.format("abs(start_ms)")), F.lit(" --> "), F.expr(clock.format("abs(end_ms)")), F.when((F.col("media_id") % 10 == 3) & (F.col("seq") == 2), F.lit("")).otherwise(F.concat(F.lit("\n"), F.when(F.col("text") == "", F.lit("-")).otherwise(F.col("text")))))
    return c.select("media_id", "seq", block.alias("block")).groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), "\n\n").alias("content"))


def _clock(x: str) -> str:
    return f"lpad(({x} // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({x} // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad((({x} // 1000) % 60)::VARCHAR, 2, '0') || ',' || lpad(({x} % 1000)::VARCHAR, 3, '0')"


SQL["srt_files"] = f"""
  SELECT media_id, string_agg(CASE WHEN media_id % 10 = 3 AND seq = 1 THEN 'x' ELSE (seq + 1)::VARCHAR END || chr(10) || {_clock('abs(start_ms)')} || ' --> ' || {_clock('abs(end_ms)')}
    || CASE WHEN media_id % 10 = 3 AND seq = 2 THEN '' ELSE chr(10) || CASE WHEN text = '' THEN '-' ELSE text END END, chr(10) || chr(10) ORDER BY seq) AS content FROM cues GROUP BY media_id
"""


def txt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    clock = "concat(lpad(cast({0} div 3600000 as string),2,'0'),':',lpad(cast(({0} div 60000)%60 as string),2,'0'),':',lpad(cast(({0} div 1000)%60 as string),2,'0'),'.',lpad(cast({0}%1000 as string),3,'0'))"
    timed = F.concat(F.lit("["), F.expr(clock.format("abs(start_ms)")), F.lit(" - "), F.expr(clock.format("abs(end_ms)")), F.lit("] "), F.when(F.col("seq") % 4 == 0, F.lit("[弱] ")).otherwise(F.lit("")), F.col("text"))
    line = F.when(F.col("media_id") % 10 == 4, F.col("text")).otherwise(timed)
    lines = c.select("media_id", "seq", line.alias("line")).groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return lines.select("media_id", F.concat(F.lit("视频: x\n模型: base\n"), "body").alias("content"))


SQL["txt_files"] = f"""
  SELECT media_id, '视频: x' || chr(10) || '模型: base' || chr(10) || string_agg(CASE WHEN media_id % 10 = 4 THEN text ELSE '[' || replace({_clock('abs(start_ms)')}, ',', '.') || ' - ' || replace({_clock('abs(end_ms)')}, ',', '.') || '] ' || CASE WHEN seq % 4 = 0 THEN '[弱] ' ELSE '' END || text END, chr(10) ORDER BY seq) AS content FROM cues GROUP BY media_id
"""


def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run_states(spark, sf_dir)
    files = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.concat(F.lit('"'), F.col("dir"), F.lit("/"), j.cast("string"), F.lit('.wav"'))), ",")
    return r.select("media_id", "state_mtime", F.concat(
        F.lit('{"video_path":"'), "path", F.lit('","processed_segments":'), F.col("processed").cast("string"), F.lit(',"total_segments":6,"current_segment":'), (F.col("media_id") % 9).cast("string"), F.lit(',"segment_files":['), files, F.lit("]}"),
    ).alias("content"))


SQL["state_files"] = """
  SELECT media_id, state_mtime, '{"video_path":"' || path || '","processed_segments":' || processed || ',"total_segments":6,"current_segment":' || (media_id % 9) || ',"segment_files":[' || array_to_string(list_transform(range(0, 6), lambda j: '"' || dir || '/' || j || '.wav"'), ',') || ']}' AS content FROM run_states
"""


def any_state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State files with marks, with a map of results (every third media), and broken ones (every eleventh)."""
    r = run_states(spark, sf_dir)
    files = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.concat(F.lit('"'), F.col("dir"), F.lit("/"), j.cast("string"), F.lit('.wav"'))), ",")
    marks = F.concat(F.lit('{"video_path":"'), "path", F.lit('","model_size":"base","processed_segments":'), F.col("processed").cast("string"), F.lit(',"total_segments":6,"segment_files":['), files, F.lit("]}"))
    done = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda j: (F.col("media_id") + F.col("state_mtime") + j) % 2 == 0)
    ids = F.array_join(F.transform(done, lambda j: j.cast("string")), ",")
    result = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda j: j != 4), lambda j: F.concat(F.lit('"'), j.cast("string"), F.lit('":{"segments":['), F.array_join(F.array_repeat(F.lit('{"text":"t"}'), (j + F.col("media_id") % 2).cast("int")), ","), F.lit('],"filtered_hallucinations":'), j.cast("string"), F.lit("}")))
    results = F.concat(F.lit('{"audio_path":"'), "path", F.lit('","fingerprint":"'), "fingerprint", F.lit('","model":"base","total_chunks":6,"completed_chunks":['), ids, F.lit('],"results":{'), F.array_join(result, ","), F.lit("}}"))
    content = F.when(F.col("media_id") % 11 == 0, F.substring(marks, 1, 40)).when(F.col("media_id") % 3 == 0, results).otherwise(marks)
    return r.select("media_id", "state_mtime", content.alias("content"))


SQL["any_states"] = """
  SELECT media_id, state_mtime, dir, CASE WHEN media_id % 11 = 0 THEN 'none' WHEN media_id % 3 = 0 THEN 'results' ELSE 'marks' END AS form, path, fingerprint, processed, j,
    CASE WHEN media_id % 3 = 0 THEN (media_id + state_mtime + j) % 2 = 0 ELSE j < processed END AS done FROM run_states, range(0, 6) AS u(j)
"""


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark, sf_dir).select("media_id", F.concat("name", F.lit("_"), F.substring(F.md5(F.col("path").cast("binary")), 1, 8), F.lit("_base")).alias("dir"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    return m.filter((F.col("media_id") + F.col("j")) % 9 != 0).select(F.concat("dir", F.lit("/"), F.col("j").cast("string"), F.lit(".wav")).alias("path"))


SQL["stored_segments"] = "SELECT name || '_' || substring(md5(path), 1, 8) || '_base/' || j || '.wav' AS path FROM media, range(0, 6) AS r(j) WHERE (media_id + j) % 9 <> 0"


def page_edges(spark: SparkSession, sf_dir: str, loop: bool = False) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^:]+://[^/]+/([^/]+)", 1).alias("lang"))
    w = Window.partitionBy("lang").orderBy("page_id")
    nxt = F.lead("page_id").over(w)
    if loop:
        nxt = F.coalesce(nxt, F.min("page_id").over(Window.partitionBy("lang")))
    return p.select("lang", F.col("page_id").alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL")


SQL["page_edges"] = "SELECT lang, src, dst FROM (SELECT lang, page_id AS src, lead(page_id) OVER (PARTITION BY lang ORDER BY page_id) AS dst FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]+/([^/]+)', 1) AS lang FROM pages)) WHERE dst IS NOT NULL"


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    ext = F.element_at(F.array(*map(F.lit, ("png", "jpg", "jpeg", "gif", "webp"))), (F.col("page_id") % 5 + 1).cast("int"))
    lang = F.regexp_extract("url", r"^[^:]+://[^/]+/([^/]+)", 1)
    path = F.concat(F.lit("/media/["), lang, F.lit("]/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 7 == 0, "_skip").otherwise(""), F.lit("."), ext)
    length = (F.length("html") * 1000).cast("long")
    return p.select("page_id", path.alias("path"), length.alias("length"), F.expr("cast(length(html) as bigint) * 1000 * (70 + page_id % 60) div 100").alias("encoded_length"))


SQL["file_list"] = "SELECT page_id, '/media/[' || regexp_extract(url, '^[^:]+://[^/]+/([^/]+)', 1) || ']/' || page_id || CASE WHEN page_id % 7 = 0 THEN '_skip' ELSE '' END || '.' || (['png', 'jpg', 'jpeg', 'gif', 'webp'])[page_id % 5 + 1] AS path, length(html) * 1000 AS length, length(html) * 1000 * (70 + page_id % 60) // 100 AS encoded_length FROM pages"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("n", F.floor(F.col("frame_idx") / 3)).filter("n < 21")
    v = F.floor((F.col("sample") + 0.6) * 212).cast("int")

    def channel(k: int):
        return F.max(F.when(F.col("frame_idx") % 3 == k, v))

    g = f.groupBy(F.col("media_id").alias("image_id"), "n").agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
    return g.select("image_id", (F.col("n") % 7).alias("x"), F.floor(F.col("n") / 7).alias("y"), "r", "g", "b")


SQL["pixels"] = """
  SELECT image_id, n % 7 AS x, n // 7 AS y, r, g, b FROM (SELECT media_id AS image_id, frame_idx // 3 AS n, max(v) FILTER (WHERE frame_idx % 3 = 0) AS r, max(v) FILTER (WHERE frame_idx % 3 = 1) AS g, max(v) FILTER (WHERE frame_idx % 3 = 2) AS b
    FROM (SELECT *, floor((sample + 0.6) * 212)::INT AS v FROM frames WHERE frame_idx < 63) GROUP BY ALL)
"""


def pixel_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels as one image of 7 x 3 each, bytes in the order blue, green, red."""

    def byte(c: str):
        return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")), 2, "0")

    p = pixels(spark, sf_dir).select("image_id", F.struct("y", "x", F.concat(byte("b"), byte("g"), byte("r")).alias("h")).alias("p"))
    g = p.groupBy("image_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    return g.select("image_id", F.lit(7).alias("width"), F.lit(3).alias("height"), F.lit(3).alias("channels"), data.alias("data"))


def galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the classes that the class mode of the parsers looks for."""
    html = F.regexp_replace("html", '<li><a href="([^"]*)">([^<]*)</a></li>', '<li><a class="item-link" href="$1"><span class="item-link-text">$2</span></a></li>')
    html = F.replace(html, F.lit("<p>"), F.lit('<p><img class="lazy post-item-img" data-original="/i/p.jpg">'))
    html = F.replace(html, F.lit("<nav><ul>"), F.concat(F.lit('<nav><ul><li class="current">'), F.col("page_id").cast("string"), F.lit("</li>")))
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


SQL["links"] = """
  SELECT page_id, url, u.i AS index, replace(replace(replace(u.l[2], '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS name, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || u.l[1] AS target
  FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), lambda x: [regexp_extract(x, 'href="([^"]*)"', 1), regexp_extract(x, '">([^<]*)<', 1)]) AS ls FROM pages), unnest(ls) WITH ORDINALITY AS u(l, i)
"""


def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of file_list whose .webp exists."""
    return file_list(spark, sf_dir).filter(F.col("page_id") % 3 == 0).select(F.regexp_replace("path", r"\.[^./]*$", ".webp").alias("path"))


SQL["resized"] = "SELECT regexp_replace(path, '\\.[^./]*$', '.webp') AS path FROM file_list WHERE page_id % 3 = 0"

#: Tables that a fixture's SQL reads from.
NEEDS = {"segments_raw": ["cues"], "run_states": ["media"], "memory": ["cues"], "srt_files": ["cues"], "txt_files": ["cues"], "state_files": ["media", "run_states"], "any_states": ["media", "run_states"], "stored_segments": ["media"], "pixels": ["frames"], "resized": ["file_list"]}


def oracle(body: str, *names: str) -> str:
    """`body` (a SELECT, or CTEs and a SELECT after WITH) over the named fixtures."""
    wanted: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, []), name):
            if n not in wanted:
                wanted.append(n)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}" if ctes else body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body
