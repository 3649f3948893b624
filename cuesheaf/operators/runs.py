"""Resuming unfinished runs."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheaf.functions.media import media_fingerprint

STATE = "video_path string, processed_segments long, total_segments long, current_segment long, segment_files array<string>"


def read_run_state(files: DataFrame, stored: DataFrame) -> DataFrame:
    """State rows of files (media_id, state_mtime, content), repaired against the stored paths.

    Counters beyond the total become 0; segment files that do not exist are dropped and counted
    again. An unreadable file is the initial state.
    """
    s = files.select("media_id", "state_mtime", F.from_json("content", STATE).alias("s")).select("media_id", "state_mtime", "s.*")
    zero = F.lit(0).cast("long")
    for c in ("processed_segments", "total_segments", "current_segment"):
        s = s.withColumn(c, F.coalesce(c, zero))

    def within(c: str, total):
        return F.when(F.col(c) > total, zero).otherwise(F.col(c))

    total = F.col("total_segments")
    s = s.withColumns({"processed_segments": within("processed_segments", total), "current_segment": within("current_segment", total)})
    names = s.select("media_id", "state_mtime", F.explode("segment_files").alias("path")).join(stored.select("path").distinct(), "path", "left_semi")
    found = names.groupBy("media_id", "state_mtime").agg(F.count("*").alias("_found"))
    s = s.join(found, ["media_id", "state_mtime"], "left").withColumn("_found", F.coalesce("_found", zero))
    files_n = F.coalesce(F.size("segment_files"), F.lit(0))
    lost = (files_n > 0) & (total > 0) & (F.col("_found") != files_n)
    total = F.when(lost, F.col("_found")).otherwise(total)
    processed = F.when(lost & (F.col("processed_segments") > F.col("_found")), zero).otherwise(F.col("processed_segments"))
    current = F.when(lost & (F.col("current_segment") > F.col("_found")), zero).otherwise(F.col("current_segment"))
    return s.select("media_id", "state_mtime", "video_path", processed.alias("processed_segments"), total.alias("total_segments"), current.alias("current_segment"), F.when(lost, F.col("_found")).otherwise(files_n).cast("long").alias("files"))


def parsed_states(files: DataFrame) -> DataFrame:
    """files (media_id, state_mtime, content) with the content as a VARIANT `state` and its `form`: marks, results, or none for a file that is no state."""
    f = files.select("media_id", "state_mtime", F.try_parse_json("content").alias("state"))

    def has(path: str, kind: str) -> Column:
        return F.schema_of_variant(F.variant_get("state", path, "variant")).startswith(kind)

    form = F.when(has("$.results", "OBJECT") | has("$.completed_chunks", "ARRAY"), "results").when(has("$.segment_files", "ARRAY") | F.try_variant_get("state", "$.video_path", "string").isNotNull(), "marks")
    return f.withColumn("form", F.coalesce(form, F.lit("none")))


def _of(path: str, kind: str = "long") -> Column:
    return F.try_variant_get("state", path, kind)


def state_chunks(parsed: DataFrame) -> DataFrame:
    """(media_id, state_mtime, form, chunk_idx, path, segments, filtered) of the chunks that a state of either form counts as done.

    A state with marks has an array of files, of which those before the mark are done; one with results has a map of results
    by chunk, and done are those also listed as completed. One explode serves both; entries that are no chunk are dropped.
    """
    entries = F.when(F.col("form") == "marks", F.variant_get("state", "$.segment_files", "variant")).when(F.col("form") == "results", F.variant_get("state", "$.results", "variant"))
    p = parsed.select("media_id", "state_mtime", "form", "state", entries.alias("entries")).filter("entries IS NOT NULL")
    e = p.lateralJoin(p.sparkSession.tvf.variant_explode(F.col("entries").outer()))
    idx = F.when(F.col("form") == "marks", F.col("pos")).otherwise(F.col("key").try_cast("long")).cast("long")
    e = e.withColumn("chunk_idx", idx)
    done = F.when(F.col("form") == "marks", F.col("chunk_idx") < _of("$.processed_segments")).otherwise(F.array_contains(_of("$.completed_chunks", "array<bigint>"), F.col("chunk_idx")))
    size = F.coalesce(F.size(F.try_variant_get("value", "$.segments", "array<variant>")), F.lit(0))
    return e.filter(done).select(
        "media_id", "state_mtime", "form", "chunk_idx", F.when(F.col("form") == "marks", F.try_variant_get("value", "$", "string")).alias("path"),
        F.when(F.col("form") == "results", size).cast("long").alias("segments"), F.when(F.col("form") == "results", F.coalesce(F.try_variant_get("value", "$.filtered_hallucinations", "long"), F.lit(0))).alias("filtered"),
    )


def any_state(parsed: DataFrame) -> DataFrame:
    """(media_id, state_mtime, form, path, model, fingerprint, processed, total) of states of either form; a file that is no state is the initial one.

    processed is the mark, or the number of different completed chunks; one beyond the total counts as 0.
    """
    results = F.col("form") == "results"
    completed = F.size(F.filter(F.array_distinct(_of("$.completed_chunks", "array<bigint>")), lambda c: c.isNotNull()))
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.when(results, _of("$.total_chunks")).otherwise(_of("$.total_segments")), zero)
    done = F.coalesce(F.when(results, completed.cast("long")).otherwise(_of("$.processed_segments")), zero)
    return parsed.select(
        "media_id", "state_mtime", "form", F.when(results, _of("$.audio_path", "string")).otherwise(_of("$.video_path", "string")).alias("path"),
        F.when(results, _of("$.model", "string")).otherwise(_of("$.model_size", "string")).alias("model"), F.coalesce(_of("$.fingerprint", "string"), F.lit("")).alias("fingerprint"),
        F.when((done > total) | (done < 0), zero).otherwise(done).alias("processed"), total.alias("total"),
    )


def pending_of_states(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks (media_id, chunk_idx) that the newest state file of their media does not count as done; no file, or a newest one that is no state, leaves all."""
    newest = parsed.groupBy("media_id").agg(F.max("state_mtime").alias("state_mtime"))
    done = state_chunks(parsed.join(newest, ["media_id", "state_mtime"], "left_semi")).select("media_id", "chunk_idx")
    return pending_chunks(chunks, done)


def pending_chunks(chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """Chunks that are not completed (media_id, chunk_idx)."""
    return chunks.join(completed.select("media_id", "chunk_idx"), ["media_id", "chunk_idx"], "left_anti")


def after_mark(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    """Chunks from the media's high-water mark on: marks (media_id, processed); none counts as 0."""
    c = chunks.join(marks.select("media_id", "processed"), "media_id", "left")
    return c.filter(F.col("chunk_idx") >= F.coalesce("processed", F.lit(0))).drop("processed")


def resumable_runs(media: DataFrame, states: DataFrame, model: str = "base") -> DataFrame:
    """Saved states whose path, model and fingerprint are those of the present file; an empty fingerprint never matches."""
    now = media.select(F.col("path").alias("_path"), media_fingerprint(F.col("path"), F.col("size_bytes"), F.col("mtime")).alias("_print"))
    same = (F.col("path") == F.col("_path")) & (F.col("fingerprint") == F.col("_print")) & (F.col("fingerprint") != "") & (F.col("model") == model)
    return states.join(now, same).drop("_path", "_print")


def _contained(names: pa.Table, dirs: pa.Table) -> pa.Table:
    """(media_id, dir) of the names (media_id, name) that stand in directories (dir), by one automaton over the names."""
    ids, of = names.column("media_id").to_pylist(), {}
    for i, name in enumerate(names.column("name").to_pylist()):
        of.setdefault(name, []).append(i)
    found, at = [], []
    if of:
        automaton = ahocorasick.Automaton()
        for name, owners in of.items():
            automaton.add_word(name, owners)
        automaton.make_automaton()
        for k, d in enumerate(dirs.column("dir").to_pylist()):
            hits = {i for _, owners in automaton.iter(d) for i in owners}
            found += [ids[i] for i in hits]
            at += [k] * len(hits)
    return pa.table([pa.array(found, names.schema.field("media_id").type), dirs.column("dir").take(pa.array(at, pa.int64()))], names=["media_id", "dir"])


def match_run_dirs(media: DataFrame, dirs: DataFrame, model: str = "base", block_chars: int = 8_000_000, chunk_chars: int = 64_000_000) -> DataFrame:
    """(media_id, dir) where the directory's name contains the media's name and the model.

    An Aho-Corasick automaton over the names reads each directory once, whatever endings the names share. Names are dealt in
    blocks of about block_chars characters and directories in chunks of about chunk_chars; each block meets each chunk in a group of its own, so no
    group grows with the tables. An empty name matches nothing.
    """
    m = media.filter(F.length("name") > 0).select("media_id", "name")
    d = dirs.select("dir").distinct().filter(F.contains("dir", F.lit(model)))

    def parts(table: DataFrame, column: str, chars: int) -> int:
        return -(-max(1, table.agg(F.sum(F.length(column))).first()[0] or 0) // chars)

    blocks, chunks = parts(m, "name", block_chars), parts(d, "dir", chunk_chars)

    def dealt(table: DataFrame, column: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0)
        return table.select("*", F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(own), every.alias(other)).groupBy("block", "chunk")

    left, right = dealt(m, "name", "block", blocks, "chunk", chunks), dealt(d, "dir", "chunk", chunks, "block", blocks)
    return left.cogroup(right).applyInArrow(_contained, f"media_id {media.schema['media_id'].dataType.simpleString()}, dir string")


def chunk_count_check(media: DataFrame, chunks: DataFrame, segment_ms: int = 60_000, slack: int = 3) -> DataFrame:
    """Actual and expected chunks of each media, and whether they differ by at most `slack`."""
    n = chunks.groupBy("media_id").agg(F.count("*").alias("actual"))
    out = media.join(n, "media_id", "left").select("media_id", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"), F.ceil(F.col("duration_ms") / segment_ms).alias("expected"))
    return out.withColumn("accepted", F.abs(F.col("actual") - F.col("expected")) <= slack)


def latest_state(media: DataFrame, states: DataFrame, finished: DataFrame) -> DataFrame:
    """(media_id, class, processed, total) by the newest state: completed if all is processed and finished (media_id) has a transcript, else abnormal; continue; none without a state."""
    w = Window.partitionBy("media_id").orderBy(F.desc("state_mtime"), F.desc("processed"), F.desc("total"))
    last = states.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("media_id", "processed", "total")
    done = finished.select("media_id").distinct().withColumn("_done", F.lit(True))
    out = media.select("media_id").join(last, "media_id", "left").join(done, "media_id", "left")
    kind = F.when(F.col("processed").isNull(), "none").when(F.col("processed") < F.col("total"), "continue").when(F.col("_done"), "completed").otherwise("abnormal")
    return out.select("media_id", kind.alias("class"), "processed", "total")
