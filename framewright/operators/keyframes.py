"""Keyframes: frames that differ enough from the last keyframe.

The choice is a fold: a frame is compared with the last one kept, not with its neighbour. Blank
frames can neither be kept nor change the state, so they are dropped before the fold, inside
Catalyst. The fold itself runs per media, over sorted Arrow batches with one fingerprint of state:
a media of any length streams through its task in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import entropy, popcount, to_hex

DISTANCE, NONZERO = 8, 0


#: Distances of fingerprints to one.
Distance = Callable[[np.ndarray, int], np.ndarray]


def hamming_to(fps: np.ndarray, last: int) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint64) ^ np.int64(last).view(np.uint64))


def fold(fps: np.ndarray, last: int | None, distance: float, func: Distance = hamming_to) -> tuple[np.ndarray, int | None]:
    """Which of the fingerprints are kept after last, and the new last."""
    kept = np.zeros(len(fps), bool)
    at = 0
    if last is None and len(fps):
        kept[0], last, at = True, int(fps[0]), 1
    while at < len(fps):
        # the next frame that is far enough: looked for in growing stretches, all at once
        size = 64
        while at < len(fps):
            near = func(fps[at : at + size], last) < distance
            if near.all():
                at += len(near)
                size *= 4
                continue
            at += int(near.argmin())
            kept[at], last = True, int(fps[at])
            at += 1
            break
    return kept, last


def keyframes(fingerprints: DataFrame, distance: float = DISTANCE, nonzero: int = NONZERO, func: Distance = hamming_to) -> DataFrame:
    """(media_id, id_frame, frame_id, fp): id_frame counts from 1, frame_id from 0. func: another distance than Hamming's."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        media, last = None, None
        for pdf in parts:
            names = pdf["media_id"].to_numpy(object)
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            kept = np.zeros(len(pdf), bool)
            fps = pdf["fp"].to_numpy(np.int64)
            for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
                if names[a] != media:
                    media, last = names[a], None
                kept[a:b], last = fold(fps[a:b], last, distance, func)
            yield pdf[kept]

    rows = fingerprints.where(popcount(F.col("fp")) >= nonzero).select("media_id", "frame_id", "fp").where("media_id is not null")
    rows = rows.repartition("media_id").sortWithinPartitions("media_id", "frame_id")
    kept = rows.mapInPandas(run, rows.schema)
    return kept.select("media_id", (F.col("frame_id") + 1).alias("id_frame"), "frame_id", "fp")


def described(kept: DataFrame) -> DataFrame:
    """Keyframes with the entropy of their hexadecimal digits."""
    return kept.withColumn("fp_hex", to_hex(F.col("fp"))).withColumn("entropy", entropy(F.col("fp_hex")))


def frames_of(kept: DataFrame, frames: DataFrame, id_column: str = "frame_id") -> DataFrame:
    """The frames that the keyframes point to."""
    ids = kept.select("media_id", F.col(id_column).alias("frame_id"), "fp")
    return frames.join(ids, ["media_id", "frame_id"])


def write_images(frames: DataFrame, folder: str, width: int = 32, height: int = 32) -> DataFrame:
    """Write grey frames as <folder>/<media_id>-<frame_id>.pgm (a folder that all executors share) when the result is read; its rows are what was written."""
    import os

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in parts:
            names = [f"{m}-{i}.pgm" for m, i in zip(pdf["media_id"], pdf["frame_id"], strict=True)]
            for name, raw in zip(names, pdf["gray"], strict=True):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(f"P5 {width} {height} 255\n".encode() + raw)
            yield pd.DataFrame({"file": names})

    return frames.select("media_id", "frame_id", "gray").mapInPandas(run, "file string")
