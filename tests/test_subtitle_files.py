"""The subtitle data source: parsers against the DataFrame readers on odd contents, partitions, and what failed writes leave."""

import pytest
from pyspark.sql import functions as F

from cuesheaf.sources import subtitle_files as S
from cuesheaf.sources import transcripts

SRT = [
    "1\n00:00:01,000 --> 00:00:02,000\nhello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n\n3\n00:00:05,000 --> 00:00:06,000\n x \n",
    "\n\n \n x\nt\na\n\n 7 \nt\nb\n \n\t\n+8\nt\n　c　\n\n1_0\nt\nd\n\n99999999999\nt\ne",
    "",
    "5\nt\nonly",
]
TXT = [
    "视频: x\n=====\n[00:00:01.5 - 00:00:02] [弱] hello\n[00:00:03,25 - 00:00:04.12345]  there \n[00:00:05 - 00:00:06] \nnoise\n[a] b",
    "视频: x\n\nplain line\n[00:00:05 - 00:00:06]\n 去重后片段数: 3\nlast",
    "[x - y - z] [弱]   [弱] text",
    "",
]


def put(folder, contents, kind):
    for k, text in enumerate(contents):
        (folder / f"{k}.{kind}").write_bytes(text.encode())
    (folder / "other.bin").write_bytes(b"\xff")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("partition_bytes", [S.PARTITION_BYTES, 1])
def test_srt_equals_the_dataframe_reader(spark, tmp_path, partition_bytes):
    put(tmp_path, SRT, "srt")
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(SRT)], "media_id string, content string")
    columns = ("media_id", "at", "index", "timestamp", "text")
    read = S.read_subtitles(spark, str(tmp_path), "srt", partition_bytes)
    assert rows(read, *columns) == rows(transcripts.read_srt(files), *columns)
    assert read.rdd.getNumPartitions() == (4 if partition_bytes == 1 else 1)


def test_txt_equals_the_dataframe_reader(spark, tmp_path):
    put(tmp_path, TXT, "txt")
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(TXT)], "media_id string, content string")
    columns = ("media_id", "number", "start", "end", "text")
    assert rows(S.read_subtitles(spark, f"file://{tmp_path}", "txt"), *columns) == rows(transcripts.read_transcript_txt(files), *columns)


def test_written_srt_equals_the_dataframe_writer(spark, tmp_path):
    blocks = spark.createDataFrame([("a/b", 3, "t3", "three\nlines"), ("a/b", 1, "t1", "one"), ("c d", 1, "t", None)], "media_id string, at long, timestamp string, text string")
    S.write_subtitles(blocks, str(tmp_path), "srt")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a%2Fb.srt", "c%20d.srt"]
    made = {r["media_id"]: r["content"] for r in transcripts.write_srt(blocks).collect()}
    assert (tmp_path / "a%2Fb.srt").read_text() == made["a/b"] and (tmp_path / "c%20d.srt").read_text() == made["c d"]
    S.write_subtitles(blocks.filter("media_id = 'c d'"), str(tmp_path), "srt")
    assert [p.name for p in tmp_path.iterdir()] == ["c%20d.srt"]


def test_written_txt_and_json_come_back(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0, 1000, 2000, "a", -0.5, True), (1, 1, 3000, 4000, "é 漢", None, False), (2, 0, 0, 500, "", 0.0, False)], "media_id long, seq long, start_ms long, end_ms long, text string, confidence double, is_weak boolean")
    S.write_subtitles(cues, str(tmp_path), "json")
    columns = ("seq", "start_ms", "end_ms", "text", "confidence")
    assert rows(S.read_subtitles(spark, str(tmp_path), "json"), *columns) == rows(cues, *columns)
    counts = spark.createDataFrame([(1, 5, 4, 2), (2, 1, 1, 1)], "media_id long, original long, filtered long, deduplicated long")
    S.write_subtitles(cues.join(counts, "media_id"), str(tmp_path), "txt")
    made = {str(r["media_id"]): r["content"] for r in transcripts.write_transcript_txt(cues, counts).collect()}
    assert {p.name[:-4]: p.read_text() for p in tmp_path.glob("*.txt")} == made


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    S.write_subtitles(spark.createDataFrame([(1, 1, "t", "old")], "media_id long, at long, timestamp string, text string"), str(tmp_path), "srt")
    before = (tmp_path / "1.srt").read_text()
    bad = spark.range(40).select((F.col("id") % 8).alias("media_id"), F.col("id").alias("at"), F.lit("t").alias("timestamp"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        S.write_subtitles(bad, str(tmp_path), "srt")
    assert [p.name for p in tmp_path.iterdir()] == ["1.srt"] and (tmp_path / "1.srt").read_text() == before


def test_a_media_in_two_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(S.SubtitleFiles)
    two = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (1, "t", "c")], "media_id long, timestamp string, text string").coalesce(1)
    with pytest.raises(Exception, match="several tasks"):
        two.write.format("subtitles").option("kind", "srt").mode("overwrite").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_no_files_give_no_rows(spark, tmp_path):
    assert S.read_subtitles(spark, str(tmp_path / "none"), "srt").count() == 0
    (tmp_path / "broken.json").write_text("{")
    assert S.read_subtitles(spark, str(tmp_path), "json").count() == 0


def test_the_driver_keeps_little_of_a_file(tmp_path):
    """Messages, partitions and the commit's keys do not hold the paths of all files."""
    import pickle

    import pyarrow as pa

    n, tasks = 6000, 3
    schema = pa.schema([("media_id", pa.int64()), ("timestamp", pa.string()), ("text", pa.string())])
    (tmp_path / "old.srt").write_text("old")
    (tmp_path / "0.srt").write_text("old")
    (tmp_path / "other.txt").write_text("stays")
    writer = S.SubtitleWriter(str(tmp_path), "srt", True)
    messages = [writer.write(iter([pa.RecordBatch.from_pylist([{"media_id": i, "timestamp": "t", "text": str(i)} for i in range(t, n, tasks)], schema)])) for t in range(tasks)]
    assert len(pickle.dumps(messages)) < 1000
    writer.commit(messages)
    assert {p.name for p in tmp_path.iterdir()} == {f"{i}.srt" for i in range(n)} | {"other.txt"} and (tmp_path / "0.srt").read_text() == "1\nt\n0\n"
    parts = S.SubtitleReader(f"file://{tmp_path}", "srt", 10_000, None).partitions()
    assert len(parts) > 3 and sorted(x for p in parts for x in p.names()) == sorted(f"{i}.srt" for i in range(n))
    assert sum(len(pickle.dumps(p)) for p in parts) < 6 * n


def test_a_media_of_two_tasks_is_refused_at_the_commit(tmp_path):
    import pyarrow as pa

    (tmp_path / "1.srt").write_text("old")
    writer = S.SubtitleWriter(str(tmp_path), "srt", True)
    messages = [writer.write(iter([pa.RecordBatch.from_pylist([{"media_id": i, "timestamp": "t", "text": "x"} for i in ids])])) for ids in ((1, 2), (3, 1))]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([*messages, None])
    assert [p.name for p in tmp_path.iterdir()] == ["1.srt"] and (tmp_path / "1.srt").read_text() == "old"


def test_keys_of_names():
    keys = S.Keys(f"{i}.srt" for i in range(1000))
    assert not keys.repeated() and "7.srt" in keys and "1000.srt" not in keys
    assert S.Keys(["a", "b", "a"]).repeated() and not S.Keys([]).repeated() and "a" not in S.Keys([])
