import random

import pytest
from pyspark.sql import functions as F

from cuesheaf.operators import intervals
from cuesheaf.streaming.cues import merged_stream
from cuesheaf.streaming.subtitles import translate_stream

CUE = "media_id long, seq long, start_ms long, end_ms long, text string, confidence double"
FIELDS = ("media_id", "seq", "start_ms", "end_ms", "text", "confidence", "merged")


def random_cues(seed, n=160):
    r = random.Random(seed)
    out, start = [], 0
    for k in range(n):
        start += r.choice([0, 200, 900, 3000, 7000])
        out.append((k % 2, k, start, start + r.randint(50, 4000), r.choice(["a", " a", "b", "", None]), r.choice([-0.5, None, 0.0])))
    return out


def streamed(spark, folder, files, delay):
    """The rows of the stream over the files, one a batch; a last row far ahead moves the watermark past all others."""
    for k, rows in enumerate([*files, [(99, 0, 10**9, 10**9 + 1, "end", 0.0)]]):
        spark.createDataFrame(rows, CUE).coalesce(1).write.mode("append").json(str(folder / f"in/{k:03d}"))
    source = spark.readStream.schema(CUE).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder / "in/*"))
    cues = source.withColumn("at", F.timestamp_millis(F.col("start_ms") + 1_000_000))
    q = merged_stream(cues, delay).writeStream.format("parquet").option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start(str(folder / "out"))
    q.awaitTermination(300)
    assert q.exception() is None
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.schema("number long, " + CUE + ", merged long").parquet(str(folder / "out")).filter("media_id <> 99"), dropped


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_over_shuffled_files_equals_the_batch(spark, tmp_path, seed):
    rows, r = random_cues(seed), random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + r.uniform(-12, 12))  # out of order by a dozen rows or two
    files = [[rows[k] for k in order[i : i + 32]] for i in range(0, len(rows), 32)]
    out, dropped = streamed(spark, tmp_path, files, "180 seconds")
    batch = intervals.merge_adjacent_duplicates(spark.createDataFrame(rows, CUE))
    want = sorted((tuple(x[f] for f in FIELDS) for x in batch.collect()), key=repr)
    assert dropped == 0 and sorted((tuple(x[f] for f in FIELDS) for x in out.collect()), key=repr) == want
    numbers = {(x["media_id"], x["seq"]): x["number"] for x in intervals.renumbered(batch).collect()}
    assert {(x["media_id"], x["seq"]): x["number"] for x in out.collect()} == numbers


def test_late_cues_are_dropped_and_counted(spark, tmp_path):
    def cue(seq, start, text):
        return (1, seq, start, start + 500, text, 0.0)

    files = [[cue(0, 0, "a"), cue(1, 60_000, "b")], [cue(2, 100_000, "c")], [cue(3, 1000, "late"), cue(4, 99_000, "d")]]
    out, dropped = streamed(spark, tmp_path, files, "10 seconds")
    assert [(x["number"], x["text"]) for x in out.orderBy("number").collect()] == [(1, "a"), (2, "b"), (3, "d"), (4, "c")] and dropped == 1


def test_new_files_are_translated_once(spark, tmp_path):
    memory = spark.createDataFrame([("en", "xx", "hi", "ih")], "src string, tgt string, text string, translation string")
    lexicon = spark.createDataFrame([("dog", "DOG")], "word string, gloss string")
    source = tmp_path / "in"
    source.mkdir()

    def run():
        q = translate_stream(spark, str(source), memory, lexicon, str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(120)
        return {r["media_id"].rpartition("/")[2]: r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    (source / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    assert "ih" in run()["a.srt"]
    (source / "b.srt").write_text("7\n00:00:01,000 --> 00:00:02,000\na dog\n")
    out = run()
    assert sorted(out) == ["a.srt", "b.srt"]
    assert "a DOG" in out["b.srt"] and out["b.srt"].startswith("1\n")
