"""The cue join against the literal merge, time arithmetic, subtitle files."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.errors import InvalidMedia
from framewright.functions import text as txt
from framewright.functions import timeline as tl
from framewright.operators import align, cues
from framewright.plans import commands as cmd
from framewright.sources import subtitles


def literal(spans, n):
    """The merge, step by step: frames are pulled one at a time; running out of them ends everything."""
    out, at = [], 0
    if n == 0:
        return out
    for k, (fs, fe) in enumerate(spans):
        while at not in (fs - 1, fs):
            at += 1
            if at >= n:
                return out
        while True:
            out.append((k, at))
            if at in (fe - 1, fe):
                break
            at += 1
            if at >= n:
                return out
        out.append((k, at))
    return out


def closed(spans, n):
    """What the closed form says, in Python."""
    out, end = [], 0
    for k, (fs, fe) in enumerate(spans):
        start = max(end, fs - 1)
        stop = max(start, fe - 1)
        if end > fs or start > n - 1:
            return out
        if start > fe or stop > n - 1:
            return out + [(k, f) for f in range(start, n)]
        out += [(k, f) for f in range(start, stop + 1)] + [(k, stop)]
        end = stop
    return out


def random_media(rng):
    spans, at = [], rng.randint(0, 4)
    for _ in range(rng.randint(1, 6)):
        length = rng.randint(0, 6)
        spans.append((at, at + length))
        at += length + rng.randint(-1, 4)
        at = max(at, 0)
    return spans, rng.randint(1, 40)


def test_closed_form_is_the_merge():
    rng = random.Random(5)
    for _ in range(4000):
        spans, n = random_media(rng)
        assert closed(spans, n) == literal(spans, n), (spans, n)


def test_cue_fingerprints(spark):
    rng = random.Random(6)
    media = {f"m{i}": random_media(rng) for i in range(60)}
    rows = [(m, k, str(k + 1), fs * 40, fe * 40, "t") for m, (spans, _) in media.items() for k, (fs, fe) in enumerate(spans)]
    table = spark.createDataFrame(rows, "media_id string, cue_pos int, cue_index string, start_ms bigint, end_ms bigint, text string")
    frames = spark.createDataFrame([(m, f, f * 3) for m, (_, n) in media.items() for f in range(n)], "media_id string, frame_id bigint, fp bigint")
    got = {}
    for r in cues.cue_fingerprints(table, frames).orderBy("media_id", "cue_pos", "emit_seq").collect():
        got.setdefault(r.media_id, []).append((r.cue_pos, r.frame_id))
        assert r.fp == r.frame_id * 3
    exact = {m: ([(int(fs * 40 / 1000.0 * 25), int(fe * 40 / 1000.0 * 25)) for fs, fe in spans], n) for m, (spans, n) in media.items()}
    assert got == {m: v for m, (spans, n) in exact.items() if (v := closed(spans, n))}


def test_golden_cues(spark):
    """Frames of eight cues at 25 a second, as derived for the sample subtitle."""
    want = [(0, 95, 0, 94, 96), (150, 225, 149, 224, 77), (272, 325, 271, 324, 55), (409, 473, 408, 472, 66), (573, 625, 572, 624, 54), (667, 750, 666, 749, 85), (750, 777, 749, 776, 29), (777, 812, 776, 811, 37)]
    table = spark.createDataFrame([("m", k, fs, fe) for k, (fs, fe, *_) in enumerate(want)], "media_id string, cue_pos int, fs bigint, fe bigint")
    lengths = spark.createDataFrame([("m", 900)], "media_id string, n bigint")
    got = [(r.fs, r.fe, r["first"], r["last"], r["last"] - r["first"] + 2) for r in cues.cue_spans(table, lengths).orderBy("cue_pos").collect()]
    assert got == want


def test_time_to_frame(spark):
    times = [0, 1160, 2320, 4520, 4600, 3_599_999, 3_600_000, 7_199_960]
    rows = spark.createDataFrame([(t,) for t in times], "ms bigint")
    got = {r.ms: r.f for r in rows.select("ms", tl.time_to_frame(F.col("ms")).alias("f")).collect()}
    for t in times:
        h, m, s, ms = t // 3_600_000, t // 60_000 % 60, t // 1000 % 60, t % 1000
        assert got[t] == int((h * 3600 + m * 60 + s + ms / 1000.0) * 25)
    assert (got[1160], got[2320], got[4520], got[4600]) == (28, 57, 112, 114)


def test_rescale(spark):
    row = spark.range(1).select(tl.rescale(F.lit(269_120), 25.0 / 23.9).alias("a"), tl.rescale(F.lit(1), 2.5).alias("b"), tl.shift(F.lit(10), 1, 2, 3).alias("c")).first()
    assert (row.a, row.b, row.c) == (281_506, 2, 62_013)


def test_select_expressions():
    assert tl.select_expression("BEGIN", "END") == r"gte(n\,0)"
    assert tl.select_expression("BEGIN", 500) == r"gte(n\,0)*lte(n\,500)"
    assert tl.select_expression(50, "500") == r"gte(n\,50)*lte(n\,500)"
    assert tl.select_expression(200, 50) == r"gte(n\,200)*lte(n\,50)"
    assert tl.time_expression() == r"gte(t\,0)"
    for bad in (-1, "abc", None):
        with pytest.raises(ValueError):
            tl.select_expression(bad)


def test_commands():
    spec = cmd.FilterSpec("scale", [("w", 2)]).with_option("h", 3)
    assert spec.build() == "scale=w=2:h=3" and spec.without_option("w").build() == "scale=h=3"
    with pytest.raises(ValueError):
        cmd.cut_command("a", "b", 5, 9)
    args = cmd.cut_command("a", "b", 5, 9, (25, 1), encoder="x").build()
    assert args[:3] == ["ffmpeg", "-y", "-hide_banner"] and args[-1] == "b" and args.index("-vf") < args.index("-af") < args.index("-vcodec")
    assert cmd.cat_command("l", "o").build() == ["ffmpeg", "-y", "-hide_banner", "-safe", "0", "-f", "concat", "-i", "l", "-vcodec", "copy", "-acodec", "copy", "o"]
    assert cmd.main(["--dry-run", "cat", "a", "b"]) == -1
    with pytest.raises(FileNotFoundError):
        cmd.main(["--dry-run", "cat", "/no/a", "/no/b", "c"])


def streams(codec="h264", sound="aac", width=1920, rate="24000/1001"):
    return {"streams": [{"codec_type": "audio", "codec_name": sound}, {"codec_type": "video", "codec_name": codec, "width": width, "height": 804, "r_frame_rate": rate}]}


def test_cut_takes_the_files_rate(capsys):
    assert cmd.main(["--dry-run", "cut", "--start", "100", "--stop", "2000", "a", "b"], probe=lambda p: streams()) == 0
    assert f"gte(t\\,{100 / (24000 / 1001)!r})*lte(t\\,{2000 / (24000 / 1001)!r})" in capsys.readouterr().out
    assert tl.time_expression(1_234_567, "END", (25, 1)) == r"gte(t\,49382.68)"
    for rate in ("25", "25/0", "0/1", None):
        with pytest.raises(InvalidMedia):
            cmd.frame_rate(rate)


def test_cat_wants_like_inputs(tmp_path, capsys):
    paths = [str(tmp_path / n) for n in "abc"]
    for p in paths:
        open(p, "w").close()
    run = lambda *probes: cmd.main(["--dry-run", "cat", *paths[: len(probes)], "out"], probe=dict(zip(paths, probes)).__getitem__)
    assert run(streams(), streams()) == 0 and "concat" in capsys.readouterr().out
    assert run(streams(), streams(), streams(codec="hevc")) == run(streams(), streams(sound="mp3")) == run(streams(width=4), streams()) == -1
    assert cmd.first_difference([streams(), streams(), streams(width=3)]) == "scale"


def test_scale(capsys):
    assert cmd.main(["--dry-run", "scale", "--height", "200", "a", "b"]) == 0
    assert "scale=height=200:width=0:force_original_aspect_ratio=disable" in capsys.readouterr().out
    assert "=increase" in cmd.scale_command("a", "b", 2, 4, aspect="increase").video_filters[0].build()
    with pytest.raises(ValueError):
        cmd.scale_command("a", "b", aspect="square")


def test_filter_columns(spark):
    spec = cmd.FilterSpec("scale", [("w", F.col("id") + 1), ("flags", "x")])
    assert spark.range(1).select(spec.as_column().alias("s"), cmd.FilterSpec("null").as_column().alias("n")).first() == ("scale=w=1:flags=x", "null")


def test_film_shorter_than_its_cues(spark):
    """The cue that passes the film's end gives what is left of it, and later ones nothing."""
    table = spark.createDataFrame([("m", k, str(k), 1000 * k, 1000 * k + 800, "t") for k in range(4)], "media_id string, cue_pos int, cue_index string, start_ms bigint, end_ms bigint, text string")
    frames = spark.range(60).select(F.lit("m").alias("media_id"), F.col("id").alias("frame_id"), F.col("id").alias("fp"))
    got = {}
    for r in cues.cue_fingerprints(table, frames).orderBy("cue_pos", "emit_seq").collect():
        got.setdefault(r.cue_pos, []).append(r.frame_id)
    assert got == {0: [*range(0, 20), 19], 1: [*range(24, 45), 44][: len(got[1])], 2: list(range(49, 60))}
    assert got[1][-2:] == [44, 44]


def joins(df):
    """The joins of a query's plan, by Spark's names and keys."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [line.strip(" :+-") for line in plan if "Join [" in line]


@pytest.mark.parametrize("mode", ["compatible", "clean"])
def test_frames_are_not_broadcast(spark, mode):
    """Frames made of a few lengths look small to Spark; they must not go through the driver."""
    table = spark.createDataFrame([("m", k, str(k), 1000 * k, 1000 * k + 800, "t") for k in range(4)], "media_id string, cue_pos int, cue_index string, start_ms bigint, end_ms bigint, text string")
    lengths = spark.range(1).select(F.lit("m").alias("media_id"), F.lit(80).cast("bigint").alias("n"))
    frames = lengths.select("media_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("frame_id")).withColumn("fp", F.col("frame_id"))
    found = cues.cue_fingerprints(table, frames, mode=mode, lengths=lengths)
    for df in (found, cues.rows_of(found), cues.first_frames(found)):
        assert not [j for j in joins(df) if j.startswith("Broadcast") and ("block" in j or "frame_id" in j)]
        assert [j for j in joins(df) if "Broadcast" not in j]


@pytest.mark.parametrize("mode", ["compatible", "clean"])
def test_long_cues_and_gaps(spark, mode):
    """Cues over many blocks of frames, some frames missing and some there twice, against the spans counted out."""
    rng = random.Random(16)
    spans, at = [], 0
    for length in (0, 255, 256, 257, 3, 1000, 1):
        spans.append((at, at + length))
        at += length + rng.randint(0, 2)
    ids = [f for f in range(-300, at + 50) if f % 7 != 3] + [f for f in range(at) if f % 11 == 0]
    table = spark.createDataFrame([("m", k, str(k), a * 40, b * 40, "t") for k, (a, b) in enumerate(spans)], "media_id string, cue_pos int, cue_index string, start_ms bigint, end_ms bigint, text string")
    frames = spark.createDataFrame([("m", f, f * 3) for f in ids], "media_id string, frame_id bigint, fp bigint")
    exact = [(int(a * 40 / 1000.0 * 25), int(b * 40 / 1000.0 * 25)) for a, b in spans]
    if mode == "clean":
        rows = [(k, f) for k, (a, b) in enumerate(exact) for f in range(a, b + 1)]
    else:
        rows = closed(exact, max(ids) + 1)
    number, want = {}, []
    for k, f in rows:
        number[k] = number.get(k, -1) + 1
        want += [(k, f, f * 3, number[k])] * ids.count(f)
    got = cues.cue_fingerprints(table, frames, mode=mode).select("cue_pos", "frame_id", "fp", "emit_seq").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000


def test_titles(spark):
    hits = spark.createDataFrame([(0, "Turtles"), (1, "Ninja Turtles"), (2, "Ninja Turtles"), (3, None)], "pos int, title string")
    assert align.best_title(hits, "Ninja Turtle").first().pos == 1
    assert align.best_title(hits, "the ninjas of Turtles", func=txt.partial_ratio).first().pos == 0
    assert txt.partial_ratio("abc", "xxabcxx") == 100 and txt.partial_ratio("", "abc") == 0 and txt.partial_ratio("abcd", "abxd") == 75


def test_subtitle_writer(spark, tmp_path):
    table = spark.createDataFrame([("m", k, str(k + 1), 1000 * k, 1000 * k + 500, f"t{k}") for k in range(3)], "media_id string, cue_pos int, cue_index string, start_ms bigint, end_ms bigint, text string")
    subtitles.write_subtitles(table, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert [(r.media_id, r.cue_pos, r.text) for r in subtitles.parse_subtitles(back).orderBy("cue_pos").collect()] == [("m", k, f"t{k}") for k in range(3)]


def test_subtitle_files(spark, tmp_path):
    text = "﻿1\r\n00:00:00,000 --> 00:00:03,800\r\nOne <i>two</i>\r\nthree\r\n\r\n2\r\n00:00:06,000 --> 00:00:09,000\r\nFour\r\n \r\n\r\n2\r\n01:02:03,004 --> 01:02:04,5\r\n\r\n\r\nno cue\r\n"
    (tmp_path / "a.srt").write_bytes(text.encode())
    got = [(r.cue_pos, r.cue_index, r.start_ms, r.end_ms, r.text) for r in subtitles.read_subtitles(spark, str(tmp_path / "a.srt")).orderBy("cue_pos").collect()]
    assert got == [(0, "1", 0, 3800, "One <i>two</i>\nthree"), (1, "2", 6000, 9000, "Four"), (2, "2", 3723004, 3724500, "")]
    table = subtitles.read_subtitles(spark, str(tmp_path / "a.srt")).withColumn("media_id", F.lit("m"))
    again = subtitles.parse_subtitles(subtitles.render_cues(cues.shift_cues(table, F.lit(1000))))
    assert [(r.cue_pos, r.start_ms) for r in again.orderBy("cue_pos").collect()] == [(0, 1000), (1, 7000), (2, 3724004)]


def test_sync_and_pairs(spark):
    schema = "media_id string, cue_pos int, cue_index string, start_ms bigint, end_ms bigint, text string"
    a = spark.createDataFrame([("m", k, str(k), 17_333 + 1000 * k, 17_900 + 1000 * k, "a") for k in range(5)], schema)
    b = spark.createDataFrame([("m", k, str(k), 35_493 + 900 * k, 36_000 + 900 * k, "b") for k in range(5)], schema)
    assert cues.shift_to_first_cue(a, b).orderBy("cue_pos").first().start_ms == 17_333 + 18_160
    assert cues.shift_to_first_cue(b, a).orderBy("cue_pos").first().start_ms == 17_333
    assert cues.shift_to_first_cue(b, a, signed=False).orderBy("cue_pos").first().start_ms == 35_493 + 18_160
    pairs = cues.pair_by_offset(a, b, 2, 100).orderBy("pos").collect()
    assert [(p.pos, p.left_ms, p.right_ms) for p in pairs] == [(k, 17_333 + 1000 * (k + 2), 35_493 + 900 * k) for k in range(3)]


def test_chunks(spark):
    rows = spark.createDataFrame([("m", k, c) for k, c in enumerate("ABCDEFG")], "media_id string, pos int, v string")
    padded = align.chunks(rows, "media_id", "pos", "v", 3, "x").orderBy("chunk").collect()
    assert ["".join(r["items"]) for r in padded] == ["ABC", "DEF", "Gxx"]
    plain = align.chunks(rows, "media_id", "pos", "v", 3).orderBy("chunk").collect()
    assert ["".join(r["items"]) for r in plain] == ["ABC", "DEF", "G"]


def test_translation(spark):
    rows = spark.createDataFrame([("m", k, t) for k, t in enumerate(["<i>the</i> end", "a &amp; b\nc", "boom"])], "media_id string, cue_pos int, text string")

    def service(text):
        if "boom" in text:
            raise OSError
        return text.replace("the", "le")

    got = [(r.source_text, r.target_text) for r in align.translated(rows, func=service).orderBy("cue_pos").collect()]
    assert got == [("the end", "le end"), ("a & b c", "a & b c"), ("boom", None)]
    got = align.translated_in_chunks(rows, 2, func=service).orderBy("cue_pos").collect()
    assert [(r.cue_pos, r.target_text) for r in got] == [(0, "le end"), (1, "a & b c")]
