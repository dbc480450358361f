"""Fingerprint files: headerless runs of 8-byte big-endian records, a frame's number being its place."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import from_bytes

RECORD = 8


def explode_records(files: DataFrame) -> DataFrame:
    """media_id, frame_id, fp of rows (media_id, content); a ragged tail is ignored, short files are empty."""
    places = F.when(F.octet_length("content") >= RECORD, F.sequence(F.lit(0), F.expr(f"int(octet_length(content) div {RECORD}) - 1")))
    rows = files.select("media_id", "content", F.explode(places).alias("place"))
    return rows.select("media_id", F.col("place").cast("bigint").alias("frame_id"), from_bytes(F.substring("content", F.col("place") * RECORD + 1, F.lit(RECORD))).alias("fp"))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return explode_records(files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("media_id"), "content"))


def pack_records(fingerprints: DataFrame) -> DataFrame:
    """media_id and content: the file's bytes, frames in order."""
    rows = fingerprints.select("media_id", F.struct("frame_id", F.lpad(F.hex("fp"), 16, "0").alias("raw")).alias("r"))
    packed = rows.groupBy("media_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return packed.select("media_id", F.unhex(F.array_join(F.col("r.raw"), "")).alias("content"))


def media_key(path: str | Column) -> Column:
    """The md5 of a media path names its fingerprint file."""
    return F.md5(F.lit(path) if isinstance(path, str) else path)


def write_fingerprint_files(fingerprints: DataFrame, folder: str) -> DataFrame:
    """Write <folder>/<media_id>.ba for every media (a folder that all executors share) when the result is read; its rows are what was written.

    Frames of a media are streamed in order to one file; nothing is gathered in memory. A task that
    is run again starts its files anew.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: dict[str, int] = {}
        os.makedirs(folder, exist_ok=True)
        for pdf in parts:
            for media, own in pdf.groupby("media_id", sort=False):
                with open(os.path.join(folder, f"{media}.ba"), "ab" if media in sizes else "wb") as f:
                    f.write(own["fp"].to_numpy().astype(">i8").tobytes())
                sizes[media] = sizes.get(media, 0) + len(own)
        yield pd.DataFrame({"media_id": list(sizes), "records": list(sizes.values())})

    ordered = fingerprints.select("media_id", "frame_id", "fp").repartition("media_id").sortWithinPartitions("media_id", "frame_id")
    return ordered.mapInPandas(run, "media_id string, records bigint")


def write_table(fingerprints: DataFrame, path: str) -> None:
    """The store at scale: Parquet by media."""
    fingerprints.write.mode("overwrite").partitionBy("media_id").parquet(path)


def instance_lines(fingerprints: DataFrame, first: int = 50) -> DataFrame:
    """value: an instance file of the distinct fingerprints among the first frames of each media: a header, then their bits unpadded."""
    some = fingerprints.where(F.col("frame_id") < first).select("media_id", "frame_id", "fp")
    once = some.groupBy("media_id", "fp").agg(F.min("frame_id").alias("at"))
    listed = once.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("at", F.bin("fp").alias("bits")))).alias("b"))
    head = F.concat(F.lit("2\n"), F.size("b").cast("string"), F.lit("\n64\n0\n1\n"))
    return listed.select("media_id", F.concat(head, F.array_join(F.transform("b", lambda b: b["bits"]), "\n")).alias("value"))
