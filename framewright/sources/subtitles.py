"""SubRip files as cue tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"


def _milliseconds(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, _TIME, k).cast("bigint")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + F.rpad(F.regexp_extract(text, _TIME, 4), 3, "0").cast("bigint")


def parse_subtitles(files: DataFrame, content: str = "value", media_id: Column | None = None) -> DataFrame:
    """Cues of whole SubRip texts: byte-order mark and carriage returns go, blocks without two times are no cues."""
    files = files.select((media_id if media_id is not None else F.col("media_id")).alias("media_id"), F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r", "").alias("_body"))
    blocks = files.select("media_id", F.posexplode(F.split("_body", r"\n[ \t]*\n\s*")).alias("block_pos", "block"))
    block = F.regexp_replace("block", r"^\s+|\s+$", "")
    cues = blocks.select("media_id", "block_pos", block.alias("block")).withColumn("times", F.regexp_extract_all("block", F.lit(r"(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})"), F.lit(1)))
    cues = cues.where(F.size("times") >= 2).withColumn("head", F.regexp_extract("block", r"^([^\n]*)\n[^\n]*-->", 1))
    # the place among cues: blocks before it that are cues, counted in the file's own list
    order = F.row_number().over(_by_media("block_pos")) - 1
    return cues.select(
        "media_id",
        order.cast("int").alias("cue_pos"),
        F.trim("head").alias("cue_index"),
        _milliseconds(F.col("times")[0]).alias("start_ms"),
        _milliseconds(F.col("times")[1]).alias("end_ms"),
        F.regexp_replace("block", r"^(?:[^\n]*\n)?[^\n]*-->[^\n]*\n?", "").alias("text"),
    )


def _by_media(order: str):
    from pyspark.sql import Window

    return Window.partitionBy("media_id").orderBy(order)


def read_subtitles(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Cues of the SubRip files at path; media_id is the file's path."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", encoding)
    return parse_subtitles(raw.select(F.col("path").alias("media_id"), text.alias("value")))


def time_text(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def render_cues(cues: DataFrame) -> DataFrame:
    """media_id and the SubRip text of its cues in order."""
    block = F.concat(F.col("cue_index"), F.lit("\n"), time_text(F.col("start_ms")), F.lit(" --> "), time_text(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = cues.select("media_id", F.struct("cue_pos", block.alias("block")).alias("b"))
    listed = rows.groupBy("media_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return listed.select("media_id", F.array_join(F.transform("b", lambda b: b["block"]), "\n").alias("value"))


def write_subtitles(cues: DataFrame, path: str) -> None:
    """One folder per media under path, with its SubRip text."""
    render_cues(cues).write.mode("overwrite").partitionBy("media_id").text(path)
