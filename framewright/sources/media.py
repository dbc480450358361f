"""Media probes, stream entries, and an optional decoder."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BinaryCallFailed, BinaryNotFound, StreamEntryNotFound, StreamIndexOutOfBound, StreamLoadError
from ..plans.commands import FilterSpec, MediaCommand, frame_rate
from ..functions.timeline import BEGIN, END, select_expression
from ..schema import PROBE


def parse_probe(raw: Column) -> Column:
    """streams of a probe's JSON; null where it is not JSON."""
    return F.from_json(raw, PROBE)["streams"]


def parse_entries(raw: Column) -> Column:
    """The streams with all their entries, as texts."""
    return F.from_json(raw, "struct<streams array<map<string, string>>>")["streams"]


def stream_entry(streams: Column, index: int, entry: str) -> Column:
    """An entry of one stream (entries as maps); null if there is no such stream or entry."""
    return F.try_element_at(F.try_element_at(streams, F.lit(index + 1)), F.lit(entry))


def strict_stream_entry(streams: Column, index: int, entry: str) -> Column:
    """As stream_entry, but fails the query instead."""
    missing = F.raise_error(F.lit(f"{StreamIndexOutOfBound.__name__}: {index}"))
    no_entry = F.raise_error(F.lit(f"{StreamEntryNotFound.__name__}: {entry}"))
    return F.when(F.size(streams) <= index, missing.cast("string")).otherwise(F.coalesce(stream_entry(streams, index, entry), no_entry.cast("string")))


def codec(streams: Column, kind: str) -> Column:
    """Codec of the first stream of a kind (video or audio)."""
    return F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(1))["codec_name"]


def video_scale(streams: Column) -> Column:
    """Width x height of the first video stream."""
    first = F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(1))
    return F.when(first.isNotNull(), F.concat_ws("x", first["width"], first["height"]))


def valid_media(media: DataFrame, raw: str = "probe", strict: bool = False) -> DataFrame:
    """Rows whose probe can be read; strict: the query fails on others."""
    ok = parse_probe(F.col(raw)).isNotNull()
    if not strict:
        return media.where(ok)
    return media.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("InvalidMedia")).cast("boolean")))


def homogeneous(media: DataFrame) -> DataFrame:
    """One row: whether all inputs (file_pos, vcodec, acodec, scale) equal the first, and the first that differs and in what."""
    first = media.agg(F.min_by(F.struct("vcodec", "acodec", "scale"), "file_pos").alias("first")).first()["first"]
    found = F.lit(None).cast("string")
    for name in ("scale", "acodec", "vcodec"):
        found = F.when(~F.col(name).eqNullSafe(F.lit(first[name] if first else None)), F.lit(name)).otherwise(found)
    compared = media.withColumn("differs", found)
    return compared.agg(
        (F.count("*") >= 2).alias("enough"),
        (F.count("differs") == 0).alias("homogeneous"),
        F.min_by("differs", F.when(F.col("differs").isNotNull(), F.col("file_pos"))).alias("differs"),
        F.min(F.when(F.col("differs").isNotNull(), F.col("file_pos"))).alias("file_pos"),
    )


def find_binary(name: str) -> str:
    found = shutil.which(name)
    if not found:
        raise BinaryNotFound(name)
    return found


def probe(path: str, options: list[str] | None = None) -> dict:
    """What the probe tool says of one file."""
    done = subprocess.run([find_binary("ffprobe"), "-v", "error", "-of", "json", *(options or ["-show_streams"]), path], capture_output=True, check=False)
    if done.returncode:
        raise BinaryCallFailed(done.stderr.decode("utf-8", "replace"))
    try:
        return json.loads(done.stdout)
    except json.JSONDecodeError as e:
        raise StreamLoadError(path) from e


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int | str):
        self.path, self.start, self.stop = path, start, stop


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Frame ranges, if start, stop and frames (of a range) are given; else the whole file."""
        path, start, stop = self.options["path"], self.options.get("start", BEGIN), self.options.get("stop", END)
        size = int(self.options.get("frames", 0))
        if not size or stop == END:
            return [_Range(path, 0 if start == BEGIN else int(start), stop)]
        low, high = 0 if start == BEGIN else int(start), int(stop)
        return [_Range(path, a, min(a + size - 1, high)) for a in range(low, high + 1, size)]

    def read(self, part: _Range) -> Iterator[tuple]:
        width, height = int(self.options.get("width", 32)), int(self.options.get("height", 32))
        frames = decode(part.path, part.start, part.stop, width, height, self.options.get("rate"))
        yield from ((part.path, part.start + k, raw) for k, raw in enumerate(frames))


class FrameSource(DataSource):
    """format("frames"): grey frames of a media file, decoded by an external tool where there is one.

    Options: path, start, stop, frames (of a partition), width, height, and rate (num/den; the file
    is asked where it is not given), by which a later range seeks to its first frame."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "media_id string, frame_id bigint, gray binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(media_id, frame_id, gray) of a media file; options as FrameSource has them."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").options(**{k: str(v) for k, v in options.items()}).load(path)


def decode_command(path: str, start: int | str, stop: int | str, width: int, height: int, rate: str | None = None, binary: str = "ffmpeg") -> list[str]:
    """Arguments that decode the frames start..stop; with a rate, reading begins half a frame before the first."""
    command = MediaCommand(binary=binary).input(path).video_filter(FilterSpec("scale", [("w", width), ("h", height)]))
    if rate and start not in (BEGIN, 0):
        num, den = frame_rate(rate)
        command = command.seek((2 * int(start) - 1) * den / (2 * num))
        start, stop = 0, stop if stop == END else int(stop) - int(start)
    command = command.video_filter(FilterSpec("select", [("e", f"'{select_expression(start, stop)}'")])).video_filter(FilterSpec("setpts", [("expr", "PTS-STARTPTS")]))
    return command.pixel_format("gray").output_format("rawvideo").build()


def decode(path: str, start: int | str, stop: int | str, width: int, height: int, rate: str | None = None) -> Iterator[bytes]:
    """Grey frames of width x height bytes; a partial last one is dropped."""
    if rate is None and start not in (BEGIN, 0):
        rate = next((x.get("r_frame_rate") for x in probe(path).get("streams", []) if x.get("codec_type") == "video"), None)
    run = subprocess.Popen(decode_command(path, start, stop, width, height, rate, find_binary("ffmpeg")), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    try:
        while len(raw := run.stdout.read(width * height)) == width * height:
            yield raw
    finally:
        run.kill()
        run.wait()


def slice_frames(files: DataFrame, width: int = 32, height: int = 32) -> DataFrame:
    """Frames of raw grey video held whole in rows (media_id, content); a partial last frame is dropped."""
    size = width * height
    places = F.when(F.octet_length("content") >= size, F.sequence(F.lit(0), F.expr(f"int(octet_length(content) div {size}) - 1")))
    rows = files.select("media_id", "content", F.explode(places).alias("place"))
    return rows.select("media_id", F.col("place").cast("bigint").alias("frame_id"), F.substring("content", F.col("place") * size + 1, F.lit(size)).alias("gray"))


def search(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """Search hits kept as JSON lines under path, filtered on equal columns (such as imdbid, sublanguageid)."""
    hits = spark.read.json(path)
    for name, value in equal.items():
        hits = hits.where(F.col(name) == value)
    return hits


def downloads(hits: DataFrame, files: DataFrame, key: str = "IDSubtitleFile") -> DataFrame:
    """The files (key, value) of the hits, each once: what a download by the hits' ids gives."""
    return files.join(hits.select(key).distinct(), key, "left_semi")
