"""Fingerprint files, probes, keyframe plans, concatenation, streams."""

import random

import numpy as np
import pytest
from tests.conftest import data_dir
from pyspark.sql import functions as F

from framewright.errors import BinaryCallFailed, BinaryNotFound, StreamLoadError
from framewright.operators import fingerprints, keyframes
from framewright.sources import fingerprints as store
from framewright.sources import media

SCHEMA = "media_id string, frame_id bigint, fp bigint"


def table(spark, seed=3, films=4, frames=60):
    rng = random.Random(seed)
    rows = [(f"m{m}", f, rng.choice([0, 1, rng.getrandbits(64) - 2**63])) for m in range(films) for f in range(frames)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), rows


def test_fingerprint_files(spark, tmp_path):
    df, rows = table(spark)
    assert sum(r.records for r in store.write_fingerprint_files(df, str(tmp_path / "ba")).collect()) == len(rows)
    (tmp_path / "ba" / "ragged.ba").write_bytes(b"\x00" * 8 + b"\xff" * 8 + b"abc")
    (tmp_path / "ba" / "empty.ba").write_bytes(b"")
    got = {(r.media_id, r.frame_id, r.fp) for r in store.read_fingerprints(spark, str(tmp_path / "ba")).collect()}
    assert got == set(rows) | {("ragged", 0, 0), ("ragged", 1, -1)}


def test_keyframes(spark):
    df, rows = table(spark)
    for distance, nonzero in ((8, 0), (20, 1), (0, 3)):
        want = set()
        for m in {r[0] for r in rows}:
            last = None
            for _, f, v in sorted(r for r in rows if r[0] == m):
                bits = bin(v & (2**64 - 1)).count("1")
                if bits >= nonzero and (last is None or bin((v ^ last) & (2**64 - 1)).count("1") >= distance):
                    want.add((m, f + 1, f, v))
                    last = v
        assert {tuple(r) for r in keyframes.keyframes(df, distance, nonzero).collect()} == want, distance


def test_keyframes_of_another_distance(spark):
    """The distance is a parameter: here how far two fingerprints are apart as numbers."""
    df = spark.createDataFrame([("m", k, v) for k, v in enumerate([5, 6, 9, 11, 30, 2])], SCHEMA)
    got = keyframes.keyframes(df, 4, 0, lambda fps, last: np.abs(fps - last)).orderBy("frame_id").collect()
    assert [r.fp for r in got] == [5, 9, 30, 2]


def test_images(spark, tmp_path):
    frames = spark.createDataFrame([("m", 3, bytearray(range(4)))], "media_id string, frame_id bigint, gray binary")
    assert [r.file for r in keyframes.write_images(frames, str(tmp_path / "i"), 2, 2).collect()] == ["m-3.pgm"]
    assert (tmp_path / "i" / "m-3.pgm").read_bytes() == b"P5 2 2 255\n" + bytes(range(4))


def test_fingerprint_table(spark, tmp_path):
    df, rows = table(spark)
    store.write_table(df, str(tmp_path / "t"))
    assert {(r.media_id, r.frame_id, r.fp) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "t")).collect()} == set(rows)


def test_search(spark, tmp_path):
    (tmp_path / "hits.json").write_text('{"imdbid":"1","sublanguageid":"fre","IDSubtitleFile":"a"}\n{"imdbid":"1","sublanguageid":"fre","IDSubtitleFile":"a"}\n{"imdbid":"1","sublanguageid":"eng","IDSubtitleFile":"b"}\n')
    hits = media.search(spark, str(tmp_path / "hits.json"), imdbid="1", sublanguageid="fre")
    files = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "IDSubtitleFile string, value string")
    assert hits.count() == 2 and [r.value for r in media.downloads(hits, files).collect()] == ["one"]


def test_probe_tool(tmp_path, monkeypatch):
    """The probe tool, a script here: what it says, that it fails, that it says no JSON, that there is none."""
    tool = tmp_path / "ffprobe"
    tool.write_text("#!/bin/sh\nfor x; do :; done\ncase $x in good) echo '{\"streams\":[{\"width\":4}]}';; bad) echo broken >&2; exit 1;; *) echo words;; esac\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert media.probe("good") == {"streams": [{"width": 4}]}
    with pytest.raises(BinaryCallFailed, match="broken"):
        media.probe("bad")
    with pytest.raises(StreamLoadError):
        media.probe("odd")
    monkeypatch.setenv("PATH", "/nowhere")
    with pytest.raises(BinaryNotFound):
        media.probe("good")


def test_frame_source(spark, tmp_path, monkeypatch):
    """Ranges of frames through a decoder that is a script here: it prints as many frames as the select filter asks for."""
    tool = tmp_path / "ffmpeg"
    tool.write_text("#!/bin/sh\nwhile [ $# -gt 1 ]; do case $1 in -ss) s=$2;; -vf) f=$2;; esac; shift; done\nn=$(echo \"$f\" | sed 's/.*lte(n.,\\([0-9]*\\)).*/\\1/')\ni=0; while [ $i -le $n ]; do printf '%04d' $(( $(printf '%.0f' \"${s:-0}\") + i )); i=$((i+1)); done; printf x\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    monkeypatch.setattr(media, "find_binary", lambda name: str(tmp_path / name))
    args = media.decode_command("a", 100, 120, 2, 2, "25/1")
    assert args[args.index("-ss") : args.index("-i")] == ["-ss", "3.98"] and any(r"lte(n\,20)" in x for x in args)
    reader = media.FrameSource({"path": "film", "start": "0", "stop": "9", "frames": "4", "width": "2", "height": "2", "rate": "1/1"}).reader(None)
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 3), (4, 7), (8, 9)]
    assert [(i, bytes(raw)) for p in parts for _, i, raw in reader.read(p)] == [(k, b"%04d" % k) for k in range(10)]
    assert media.frames(spark, "film", start=0, stop=9).columns == ["media_id", "frame_id", "gray"]


def test_near_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(40)]
    values = sorted({v ^ sum(1 << b for b in rng.sample(range(63), k)) for v in base for k in (0, 3, 7, 8)})
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    for most in (0, 2, 3, 5, 7, 8):
        want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= most}
        assert {(r.a, r.b) for r in fingerprints.near_pairs(df, most).collect()} == want


def test_near_pairs_keys_are_not_broadcast(spark):
    """A fingerprint has many keys, which Spark takes to be as few as the fingerprints; they must not go through the driver."""
    df = spark.range(50).select((F.col("id") * 7919).alias("fp"))
    for most in (3, 7, 8):
        assert "Broadcast" not in fingerprints.near_pairs(df, most)._jdf.queryExecution().executedPlan().toString()


def test_concat(spark):
    rows = [(p, f) for p, n in ((3, 4), (1, 2), (7, 3)) for f in range(n)]
    got = {(r.file_pos, r.frame_id): r.new_frame_id for r in fingerprints.concat_media(spark.createDataFrame(rows, "file_pos int, frame_id bigint")).collect()}
    assert [got[k] for k in sorted(rows)] == list(range(9))


def test_homogeneous(spark):
    def run(*rows):
        r = media.homogeneous(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "file_pos int, vcodec string, acodec string, scale string")).first()
        return r.enough, r.homogeneous, r.differs, r.file_pos

    assert run(("v", "a", "1x1"), ("v", "a", "1x1")) == (True, True, None, None)
    assert run(("v", "a", "1x1"), ("v", "b", "2x1"), ("w", "a", "1x1")) == (True, False, "acodec", 1)
    assert run(("v", "a", "1x1"))[0] is False


def test_probe(spark):
    raw = '{"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":804,"r_frame_rate":"24000/1001"}]}'
    df = spark.createDataFrame([(1, raw), (2, "nothing"), (3, None)], "i int, probe string")
    s = media.parse_entries(F.col("probe"))
    got = df.select("i", media.stream_entry(s, 0, "codec_name").alias("c"), media.stream_entry(s, 4, "codec_name").alias("n"), media.video_scale(media.parse_probe(F.col("probe"))).alias("w")).orderBy("i").collect()
    assert [(r.c, r.n, r.w) for r in got] == [("h264", None, "1920x804"), (None, None, None), (None, None, None)]
    assert [r.i for r in media.valid_media(df).collect()] == [1]
    with pytest.raises(Exception, match="InvalidMedia"):
        media.valid_media(df, strict=True).collect()
    with pytest.raises(Exception, match="StreamIndexOutOfBound"):
        df.where("i = 1").select(media.strict_stream_entry(s, 3, "x")).collect()


def test_raw_frames(spark):
    df = spark.createDataFrame([("a", bytearray(range(10))), ("b", bytearray(b"x"))], "media_id string, content binary")
    got = [(r.media_id, r.frame_id, bytes(r.gray)) for r in media.slice_frames(df, 2, 2).orderBy("frame_id").collect()]
    assert got == [("a", 0, bytes(range(4))), ("a", 1, bytes(range(4, 8)))]


def test_streaming_keyframes(spark, tmp_path):
    from framewright.streaming.keyframes import streaming_keyframes

    df, rows = table(spark, seed=8, films=2)
    for k in range(3):
        df.where(F.col("frame_id").between(20 * k, 20 * k + 19)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run = streaming_keyframes(stream, 16, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("media_id", "id_frame", "frame_id", "fp").collect()}
    assert got == {tuple(r) for r in keyframes.keyframes(df, 16, 1).collect()}


def test_streaming_cues(spark, tmp_path):
    from framewright.streaming.keyframes import frames_per_second, streaming_cue_fingerprints

    df, rows = table(spark, seed=2, films=1)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    shown = spark.createDataFrame([("m0", f, f // 10) for f in range(5, 25)], "media_id string, frame_id bigint, cue_pos int")
    out = streaming_cue_fingerprints(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), shown)
    run = out.writeStream.format("memory").queryName("shown").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.frame_id, r.cue_pos, r.fp) for r in spark.table("shown").collect()} == {(f, f // 10, fp) for _, f, fp in rows if 5 <= f < 25}
    assert frames_per_second(run) > 0


def test_pushdown(spark):
    from framewright.queries import QUERIES

    plan = QUERIES["fp_histogram"](spark, data_dir("sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "vec_id" not in plan.split("ReadSchema")[1].split("\n")[0] and "label" not in plan.split("ReadSchema")[1].split("\n")[0]
