"""Hand-made cases, one for each branch of a rule."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheaf.functions import text as T
from cuesheaf.functions import times, urls
from cuesheaf.operators import images, intervals, pages, rules, runs, similar, translate
from cuesheaf.plans import pipelines
from cuesheaf.sources import transcripts

CUE = "media_id long, seq long, start_ms long, end_ms long, text string, confidence double"


def cues(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], CUE)


def reasons(spark, *rows):
    return [r["reason"] for r in rules.with_drop_reason(cues(spark, *rows)).orderBy("seq").collect()]


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((0, 1000, " 　", 0.0), "blank"),
        ((0, 1000, "hello there", -1.01), "confidence"),
        ((0, 1000, "hello there", -1.0), None),
        ((0, 200, "yes", -9.0), None),
        ((0, 3000, "So, Thanks for watching!", 0.0), "pattern"),
        ((0, 1000, "haaaaaaa", 0.0), "run"),
        ((0, 1000, "aaaaa", 0.0), None),
        ((0, 3001, "", 0.0), "blank"),
        ((0, 10_000, "ab", 0.0), "slow"),
        ((0, 3000, "a", 0.0), None),
        ((0, 1000, "abcdefghijklmnopqrstu", 0.0), "fast"),
        ((0, 1000, "abcdefghijklmnopqrst", 0.0), None),
        ((0, 299, "ab", 0.0), "too_short"),
        ((0, 300, "ab", 0.0), None),
        ((0, 30_001, "abcdefghijklmnopqrstuvwxyz", 0.0), "too_long"),
        ((0, 30_001, "yes", 0.0), "too_long"),
        ((0, 1000, "hello there", None), None),
    ],
)
def test_drop_reason(spark, row, reason):
    assert reasons(spark, row) == [reason]


def test_repeats_look_ahead_but_for_the_last_five(spark):
    far = [(i * 10_000, i * 10_000 + 1000, f"text {i}", 0.0) for i in range(12)]
    far[2] = (*far[2][:2], "same", 0.0)
    far[5] = (*far[5][:2], "same", 0.0)
    assert [i for i, r in enumerate(reasons(spark, *far)) if r == "repeat"] == [2]
    far[11] = (*far[11][:2], "tail", 0.0)
    far[8] = (*far[8][:2], "tail", 0.0)
    assert [i for i, r in enumerate(reasons(spark, *far)) if r == "repeat"] == [2, 8, 11]


def test_identical_twin_is_no_repeat(spark):
    twin = (0, 1000, "same", 0.0)
    assert reasons(spark, twin, twin) == [None, None]
    assert reasons(spark, twin, (0, 1100, "same", 0.0)) == ["repeat", "repeat"]


@pytest.mark.parametrize(("gap", "rows"), [(4999, 1), (5000, 2)])
def test_merge_adjacent_duplicates_gap(spark, gap, rows):
    out = intervals.merge_adjacent_duplicates(cues(spark, (0, 9000, "a", 0.1), (9000 + gap, 9000 + gap + 1, " a", 0.2))).orderBy("seq").collect()
    assert len(out) == rows
    assert out[0]["end_ms"] == (9000 + gap + 1 if rows == 1 else 9000)


def test_merge_takes_the_last_end_even_if_earlier(spark):
    assert intervals.merge_adjacent_duplicates(cues(spark, (0, 9000, "a", 0.1), (10, 20, "a", 0.2))).first()["end_ms"] == 20


@pytest.mark.parametrize(("gap", "length", "n"), [(100, 150, 1), (101, 150, 2), (101, 149, 1)])
def test_merge_intervals_limits(spark, gap, length, n):
    rows = spark.createDataFrame([(1, 0, 1000), (1, 1000 + gap, 1000 + gap + length)], "media_id long, start_ms long, end_ms long")
    assert intervals.merge_intervals(rows).count() == n


def test_energy_run_open_at_the_end_stays(spark):
    samples = [0.001] * 10 + [1.0] * 5 + [0.001] * 10 + [1.0] * 2
    f = spark.createDataFrame([(1, i, s) for i, s in enumerate(samples)], "media_id long, frame_idx long, sample double")
    assert sorted((r["start_ms"], r["end_ms"]) for r in intervals.energy_intervals(f).collect()) == [(100, 150), (250, 270)]


def test_chunk_offsets_unreadable_and_missing(spark):
    rows = [(1, 0, 50, True), (1, 1, 0, False), (1, 2, 70, True), (1, 3, None, True), (1, 4, 10, True), (2, 0, 0, False), (2, 1, 5, True)]
    c = spark.createDataFrame(rows, "media_id long, chunk_idx long, dur_ms long, readable boolean")
    out = {(r["media_id"], r["chunk_idx"]): r["start_ms"] for r in intervals.chunk_offsets(c).collect()}
    assert out == {(1, 0): 0, (1, 1): 60_000, (1, 2): 120_000, (1, 3): 0, (1, 4): 120_070, (2, 0): 0, (2, 1): 60_000}


def test_plans_on_exact_multiples(spark):
    m = spark.createDataFrame([(1, 120_000), (2, 500)], "media_id long, duration_ms long")
    fixed = sorted(tuple(r) for r in intervals.plan_fixed_chunks(m).collect())
    assert fixed == [(1, 0, 0, 60_000), (1, 1, 60_000, 120_000), (2, 0, 0, 500)]
    m = spark.createDataFrame([(1, 180_000), (2, 180_001), (3, 358_000), (4, 900)], "media_id long, duration_ms long")
    over = sorted(tuple(r) for r in intervals.plan_overlapping_chunks(m).collect())
    assert over == [(1, 0, 0, 180_000), (2, 0, 0, 180_000), (2, 1, 178_000, 180_001), (3, 0, 0, 180_000), (3, 1, 178_000, 358_000)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "out"),
    [("/x/1", "http://h.example/x/1"), ("x", "http://h.example/x"), ("//o/x", "http://o/x"), ("?q", "http://h.example/?q"), ("#f", "http://h.example/#f"), ("https://z/1", "https://z/1")],
)
def test_resolve_url(spark, url, out):
    assert one(spark, urls.resolve_url(F.lit(url), F.lit("http://me@H.example:80/a/b?c"))) == out


def test_tag_urls(spark):
    assert one(spark, urls.tag_list_url(F.lit("a b(c)~*"), "http://s")) == "http://s/tag/a%20b(c)~*"
    assert one(spark, urls.tag_from_url(F.lit("http://s/tag/a+b%20c/12/"))) == "a+b c"
    assert one(spark, urls.tag_from_url(F.lit("http://s/12/"))) is None


def test_times(spark):
    assert one(spark, times.format_srt_time(F.lit(59_999))) == "00:00:59,999"
    assert one(spark, times.format_hms(F.lit(360_000_000))) == "100:00:00"
    assert [one(spark, times.srt_clock(F.lit(c))) for c in ("00:00:01,5", "00:00:01.5", "00:00:01.23456", "00:00:01")] == ["00:00:01,5", "00:00:01,500", "00:00:01,234", "00:00:01,000"]
    assert one(spark, times.clock_ms(F.lit("01:00:01,005"))) == 3_601_005


def test_text_functions(spark):
    assert one(spark, T.strip(F.lit("　 a \n"))) == "a"
    assert one(spark, T.wrap_text(F.lit("abcdefg"), 3)) == "abc\\ndef\\ng"
    assert one(spark, T.wrap_text(F.lit("abc"), 3)) == "abc"
    assert one(spark, T.clean_filename(F.lit('a<b>:"c  d'))) == "a_b___c_d"
    assert one(spark, T.format_bilingual(F.lit("x" * 30), F.lit(None).cast("string"))) == '<font size="16" color="white">' + "x" * 30 + "</font>"


def test_transcript_fallback_and_weak_mark(spark):
    files = spark.createDataFrame([(1, "视频: a\n\nfirst\n  second "), (2, "模型: b\n[00:00:01 - 00:00:02.5] [弱] hi\n[00:00:03 - 00:00:04] \n[00:00:05 - 00:00:06] yo\nloose")], "media_id long, content string")
    out = [tuple(r) for r in transcripts.read_transcript_txt(files).orderBy("media_id", "number").collect()]
    assert out == [
        (1, 3, "00:00:02,000", "00:00:03,000", "first"), (1, 4, "00:00:03,000", "00:00:04,000", "second"),
        (2, 1, "00:00:01,000", "00:00:02,500", "hi"), (2, 2, "00:00:05,000", "00:00:06,000", "yo"),
    ]


def test_srt_bad_blocks_and_round_trip(spark):
    content = "1\nt1\na\nb\n\n\nx\nt2\nc\n\n2\nt3\n\n 4 \nt4\nd"
    files = spark.createDataFrame([(1, content)], "media_id long, content string")
    read = transcripts.read_srt(files)
    assert [(r["index"], r["timestamp"], r["text"]) for r in read.orderBy("at").collect()] == [(1, "t1", "a\nb"), (4, "t4", "d")]
    written = transcripts.write_srt(read)
    again = transcripts.read_srt(written).orderBy("at").collect()
    assert [(r["index"], r["timestamp"], r["text"]) for r in again] == [(1, "t1", "a\nb"), (2, "t4", "d")]
    assert transcripts.write_srt(transcripts.read_srt(written)).first()["content"] == written.first()["content"]


def test_unreadable_memory_is_empty(spark):
    files = spark.createDataFrame([("en", "xx", '{"en_xx_hi":"ih","de_xx_a":"b"}'), ("en", "xx", "{broken")], "src string, tgt string, content string")
    assert [tuple(r) for r in transcripts.read_translation_memory(files).collect()] == [("en", "xx", "hi", "ih")]


def test_translation_order(spark):
    c = cues(spark, (0, 1, "<font>a\\nb</font>", 0.0), (1, 2, "<i>hi</i>", 0.0), (2, 3, "good dog!", 0.0), (3, 4, "none", 0.0), (4, 5, "<b></b>", 0.0))
    memory = spark.createDataFrame([("en", "xx", "hi", "ih"), ("en", "yy", "none", "no")], "src string, tgt string, text string, translation string")
    lexicon = spark.createDataFrame([("good", "GUT")], "word string, gloss string")
    out = [(r["status"], r["translation"]) for r in translate.translate_from_memory(c, memory, lexicon, "en", "xx").orderBy("seq").collect()]
    assert out == [("bilingual", None), ("memory", "ih"), ("lexicon", "GUT dog!"), ("failed", None), ("failed", None)]
    assert sorted(r["text"] for r in translate.missing_translations(c, memory, "en", "xx").collect()) == ["good dog!", "none"]


PAGE = '<ul><li><a href="/1">1</a></li><li class="x current"> 2 of 3</li><li><b><a href="/3">3</a></b></li></ul>'


@pytest.mark.parametrize(
    ("html", "out"),
    [
        (PAGE, [(2, "http://h/3")]),
        (PAGE.replace("current", "other"), []),
        ('<ul><li class="current">2</li></ul>', []),
        ('<ul><li class="current">2</li><p></p><li><a href="/3">3</a></li></ul>', []),
        ('<ul><li class="current">2</li><li>3</li></ul>', []),
        ('<ul><li class="current">2</li><li><a>3</a></li></ul>', []),
        ('<ul><li class="current">x<li><a href="y">3</a></ul>', [(1, "http://h/y")]),
        (None, []),
    ],
)
def test_next_page(spark, html, out):
    df = spark.createDataFrame([(1, "http://h/a/b", html)], "page_id long, url string, html string")
    assert [(r["page_number"], r["target"]) for r in pages.next_page_edges(df).collect()] == out


def test_item_and_image_links(spark):
    html = '<a class="item-link"></a><a class="item-link" href="/a"><span class="item-link-text"> A </span></a><a class="item-link" href="b"></a><img class="lazy" data-original="/n.jpg"><img class="lazy post-item-img" data-original="/p.jpg" title="T"><img class="post-item-img lazy">'
    df = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    assert [(r["index"], r["name"], r["target"]) for r in pages.item_links(df).collect()] == [(2, "A", "http://h/a"), (3, "项目_3", "http://h/b")]
    assert [(r["index"], r["name"], r["target"]) for r in pages.image_links(df).collect()] == [(1, "T", "http://h/p.jpg")]


def test_pagination_walk_ends_in_a_loop(spark):
    starts = spark.createDataFrame([(1, " 4 of 9 "), (9, None), (20, "next")], "start long, current string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (9, 10)], "src long, dst long")
    assert sorted(tuple(r) for r in pages.pagination_walk(starts, edges).collect()) == [(1, 1, 0, 4), (1, 2, 1, 5), (1, 3, 2, 6), (9, 8, 1, 2), (9, 9, 0, 1), (20, 20, 0, 1)]


def test_sources_and_sinks_on_files(spark, tmp_path):
    for name in ("a_skip.PNG", "a_SKIP_12.jpg", "b.png", "deep/c.JPEG", "d_skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = images.scan_media_files(images.list_files(spark, str(tmp_path)))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["b.png", "c.JPEG"]
    contents = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\nhello\n"), (2, "line one\nline two")], "media_id long, content string")
    transcripts.write_files(contents, str(tmp_path / "out"))
    for media, text in ((1, "hello"), (2, "line two")):
        (path,) = (tmp_path / "out" / f"media_id={media}").glob("*.txt")
        assert text in path.read_text()


def test_rules_at_their_edges(spark):
    t = spark.createDataFrame([("ab" + " " * 20, 1000), ("ab", 1000), ("a ", 4000), ("a", 4000)], "text string, d long")
    assert [r[0] for r in t.select(rules.is_hallucination(F.col("text"), F.col("d"))).collect()] == [True, False, False, True]
    c = spark.createDataFrame([(200, 2000, 999), (200, 2000, 1000), (100, 2000, 5000)], "d long, s long, p long")
    assert [r[0] for r in c.select(rules.valid_chunk(F.col("d"), F.col("s"), planned_ms=F.col("p"))).collect()] == [False, True, False]
    files = spark.createDataFrame([("/m/a.png",), ("/m/b.png",)], "path string")
    have = spark.createDataFrame([("/m/a.webp",), ("/m/b_skip.png",)], "path string")
    out = [tuple(r) for r in images.output_paths(files, have, "7").orderBy("path").select("output_path", "skip_path").collect()]
    assert out == [("/m/a_7.webp", "/m/a_skip.png"), ("/m/b.webp", "/m/b_skip_7.png")]


def test_similar_segments_take_the_more_confident_text(spark):
    c = cues(spark, (0, 1000, "hello there", 0.1), (1100, 2000, "hello there!", 0.5), (2299, 3000, "hello here!", 0.2), (9000, 9900, "hello there!", 0.9)).withColumn("chunk_id", F.lit(0).cast("long"))
    out = [(r["start_ms"], r["end_ms"], r["text"], r["confidence"]) for r in similar.merge_similar_segments(c).orderBy("seq").collect()]
    assert out == [(0, 3000, "hello there!", 0.5), (9000, 9900, "hello there!", 0.9)]
    merged = similar.merge_similar_chunks(c).collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in merged] == [(0, 9900, "hello there")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], CUE)
    assert pipelines.clean_transcript(none).count() == 0
    assert similar.merge_similar_chunks(none).count() == 0
    assert intervals.gaps_and_overlaps(none).count() == 0


def test_pages_are_parsed_once(spark):
    page = '<title>T</title><a class="item-link" href="/b"></a><img class="lazy post-item-img" data-original="/p.jpg"><img class="lazy post-item-img" data-original="/q.jpg">'
    df = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", None)], "page_id long, url string, html string")
    files = spark.createDataFrame([("1", "/g/1/image_2.png"), ("1", "/g/1/image_1.txt")], "folder string, path string")
    out = pages.gallery_inventory(df, df, files)
    assert sorted(map(tuple, out.collect())) == [(1, "T", 1, 1, 2, 1), (2, "untitled_page", None, None, 0, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PageRecord(") == 1 and "ArrowEvalPython" not in plan and "MapInArrow" not in plan


def test_states_of_both_forms_and_broken_files(spark):
    contents = ['{"video_path":"v","processed_segments":2,"total_segments":3,"segment_files":["a","b","c"]}', '{"audio_path":"x","model":"m","fingerprint":"f","total_chunks":3,"completed_chunks":[0,2,2,7],"results":{"0":{"segments":[{},{}],"filtered_hallucinations":4},"1":{},"2":{},"x":{}}}',
                '{"video_path":', "[]", "7", None, '{"completed_chunks":"no","results":[]}', '{"audio_path":"y","completed_chunks":[5]}', '{"video_path":"w","processed_segments":9,"total_segments":1,"segment_files":7}']
    parsed = runs.parsed_states(spark.createDataFrame([(k, 1, c) for k, c in enumerate(contents)], "media_id long, state_mtime long, content string"))
    assert [r["form"] for r in parsed.orderBy("media_id").collect()] == ["marks", "results", "none", "none", "none", "none", "none", "results", "marks"]
    assert sorted(map(tuple, runs.state_chunks(parsed).drop("state_mtime", "form").collect())) == [(0, 0, "a", None, None), (0, 1, "b", None, None), (1, 0, None, 2, 4), (1, 2, None, 0, 0)]
    out = [(r["processed"], r["total"], r["path"]) for r in runs.any_state(parsed).orderBy("media_id").collect()]
    assert out == [(2, 3, "v"), (3, 3, "x"), *([(0, 0, None)] * 5), (0, 0, "y"), (0, 1, "w")]


def png(path, width, rows, color=2):
    """A PNG of rows of bytes, color type 2 (three channels) or 6 (four)."""
    raw = b"".join(b"\0" + r for r in rows)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, color, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")]
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d)) for t, d in parts))


def test_image_bytes_are_blue_green_red(spark, tmp_path):
    png(tmp_path / "a.png", 2, [bytes([255, 0, 7, 200, 200, 201]), bytes([250, 251, 252, 10, 20, 30])])
    png(tmp_path / "b.png", 2, [bytes([250, 251, 252, 0, 250, 250, 250, 255])], 6)
    found = images.decoded_images(spark, str(tmp_path))
    assert [bytes(r["data"])[:6] for r in found.orderBy("image_id").collect()][0] == bytes([7, 0, 255, 201, 200, 200])
    whole = images.near_white_of_images(found, least=2).orderBy("image_id").collect()
    assert [(r["masked"], r["pixels"], r["share"], r["marked"]) for r in whole] == [(2, 4, 0.5, True), (2, 2, 1.0, True)]
    right = images.near_white_of_images(found, (F.col("width") - 1, F.lit(0), F.lit(99), F.lit(1))).orderBy("image_id").collect()
    assert [(r["masked"], r["pixels"]) for r in right] == [(1, 1), (1, 1)]


def test_image_bytes_equal_pixel_rows(spark):
    rng = np.random.default_rng(6)
    bytes_of = {k: rng.choice([0, 150, 161, 170, 185, 199, 255], (h, w, 3)).astype(np.uint8) for k, (h, w) in enumerate([(5, 7), (1, 1), (12, 9)])}
    df = spark.createDataFrame([(k, a.shape[1], a.shape[0], 3, a.tobytes()) for k, a in bytes_of.items()] + [(9, 3, 3, 3, None)], "image_id long, width int, height int, channels int, data binary")
    pixels = [(k, x, y, *(int(v) for v in a[y, x, ::-1])) for k, a in bytes_of.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    by_row = images.near_white_share(spark.createDataFrame(pixels, "image_id long, x int, y int, r int, g int, b int"), (F.col("x") >= 1) & (F.col("y") < 4), least=3)
    by_bytes = images.near_white_of_images(df, (F.lit(1), F.lit(0), F.col("width"), F.lit(4)), least=3)
    assert sorted(map(tuple, by_bytes.collect())) == sorted(map(tuple, by_row.collect()))


def test_memory_files_with_long_keys_and_odd_values(spark):
    import json

    long = "é漢x " * 20_000
    entries = {"en_xx_hi": "ih", f"en_xx_{long}": long[::-1], "en_xx_": "", "en_xx_n": None, "en_xx_o": {"a": [1, True]}, "en_xx_q\"\n": "\U0001f600", "de_xx_a": "b", "en_xx": "c"}
    files = [("en", "xx", json.dumps(entries, ensure_ascii=ascii)) for ascii in (True, False)]
    files += [("de", "xx", json.dumps(entries)), ("en", "xx", "[1]"), ("en", "xx", ""), ("en", "xx", None), (None, "xx", '{"None_xx_a":"b"}'), ("en", "xx", "[" * 100_000), ("en", "xx", '{"en_xx_half":"\\ud800"}')]
    out = [tuple(r) for r in transcripts.read_translation_memory(spark.createDataFrame(files, "src string, tgt string, content string")).collect()]
    good = [("en", "xx", "hi", "ih"), ("en", "xx", long, long[::-1]), ("en", "xx", "", ""), ("en", "xx", "n", None), ("en", "xx", "o", '{"a":[1,true]}'), ("en", "xx", 'q"\n', "\U0001f600")]
    assert sorted(out, key=repr) == sorted([*good, *good, ("de", "xx", "a", "b"), ("en", "xx", "half", "?")], key=repr)


def _blocks_and_tables(spark):
    texts = ["<font>a\\nb</font>", "<i>hi</i>", "good　dog! 。。good", "none", "<b></b>", "twice", "hi", "x good、 dog。", "odd word"]
    blocks = spark.createDataFrame([(m, k * 2 - m, f"t{k}", t) for m in (1, 2) for k, t in enumerate(texts)] + [(3, 0, "t", None)], "media_id long, at long, timestamp string, text string")
    memory = spark.createDataFrame([("en", "xx", "hi", "ih"), ("en", "xx", "twice", "b"), ("en", "xx", "twice", "c"), ("en", "yy", "none", "no"), ("en", "xx", "word", None)], "src string, tgt string, text string, translation string")
    lexicon = spark.createDataFrame([("good", "GUT"), ("dog", "HUND"), ("odd", None), (None, "x"), ("good", "BON")], "word string, gloss string")
    return blocks, memory, lexicon


@pytest.mark.parametrize("rows", [100_000, 2])
def test_media_are_translated_like_cues(spark, monkeypatch, rows):
    """Lexicons that go to all tasks and larger ones; a text that the memory has twice stays one block."""
    from cuesheaf.plans import pipelines

    monkeypatch.setattr(translate, "LEXICON_ROWS", rows)
    blocks, memory, lexicon = _blocks_and_tables(spark)
    single = memory.filter("coalesce(translation, '') <> 'b'")
    wanted = [("bilingual", None), ("memory", "ih"), ("lexicon", "BON GUT dog! BON GUT"), ("failed", None), ("failed", None), ("memory", "c"), ("memory", "ih"), ("lexicon", "x BON GUT HUND"), ("failed", None)]
    plain = translate.translate_from_memory(blocks.withColumn("seq", F.col("at")), single, lexicon, "en", "xx")
    for df in (plain, translate.translate_media(blocks, memory, lexicon, "en", "xx")):
        out = [tuple(r) for r in df.orderBy("media_id", "at").select("media_id", "at", "timestamp", "status", "translation").collect()]
        assert out == [(m, k * 2 - m, f"t{k}", *w) for m in (1, 2) for k, w in enumerate(wanted)] + [(3, 0, "t", "failed", None)]
    written = transcripts.write_srt(pipelines.bilingual_blocks(blocks, memory, lexicon)).orderBy("media_id").collect()
    assert [[b.split("\n")[:2] for b in r["content"].split("\n\n")] for r in written] == [[[str(k + 1), f"t{k}"] for k in range(len(wanted))]] * 2 + [[["1", "t"]]]


@pytest.mark.parametrize("name", ["bilingual_subtitles", "transcript_to_subtitles"])
def test_subtitle_jobs_move_texts_five_times_at_most(spark, name):
    """Cues by media (for the blocks, and for what asks the memory, which adaptive execution makes one), the memory's texts, the asked texts and the answers."""
    from cuesheaf.plans import registry

    from .conftest import SMALL

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count(" Exchange hashpartitioning") == 5
