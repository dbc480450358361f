"""Streaming keyframes and statistics over fingerprint streams.

A media's frames must reach the stream in order; within a micro-batch they are sorted here. Across
batches a frame that is not after the last one seen is rejected (it is dropped).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fingerprint import popcount
from ..operators.keyframes import DISTANCE, NONZERO, fold

STATE = "seen bigint, last bigint, any boolean"
OUTPUT = "media_id string, id_frame bigint, frame_id bigint, fp bigint"


def streaming_keyframes(fingerprints: DataFrame, distance: int = DISTANCE, nonzero: int = NONZERO) -> DataFrame:
    """Keyframes of a stream (media_id, frame_id, fp); the state of a media is its last keyframe and frame."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, some = state.get if state.exists else (-1, 0, False)
        pdf = pd.concat(list(parts)).sort_values("frame_id", kind="stable")
        pdf = pdf[pdf["frame_id"] > seen]
        if len(pdf):
            kept, last = fold(pdf["fp"].to_numpy(np.int64), last if some else None, distance)
            state.update((int(pdf["frame_id"].iloc[-1]), int(last), True))
            out = pdf[kept]
            yield pd.DataFrame({"media_id": out["media_id"], "id_frame": out["frame_id"] + 1, "frame_id": out["frame_id"], "fp": out["fp"]})

    rows = fingerprints.where(popcount(F.col("fp")) >= nonzero).select("media_id", "frame_id", "fp")
    return rows.groupBy("media_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def streaming_histogram(fingerprints: DataFrame) -> DataFrame:
    """Occurrences so far; to be written in update or complete mode."""
    return fingerprints.groupBy("fp").agg(F.count("*").alias("n"))


def streaming_cue_fingerprints(fingerprints: DataFrame, cue_frames: DataFrame) -> DataFrame:
    """A stream of fingerprints against a static table of cue frames (media_id, frame_id, cue_pos)."""
    return fingerprints.join(cue_frames, ["media_id", "frame_id"])


def frames_per_second(query) -> float | None:
    """Mean throughput of a running query over its kept progress reports."""
    rates = [p["processedRowsPerSecond"] for p in query.recentProgress if p["numInputRows"]]
    return sum(rates) / len(rates) if rates else None
