"""Cues over frames: which frames a subtitle is shown on.

The compatible mode follows the order-sensitive merge of cues and frames exactly, in closed form: a
cue starts one frame early, but not before the frame the last cue ended on; its last frame comes
twice; a cue that overlaps the one before by more than a frame, or ends before it starts, ends the
media's join. The running end of the cues so far is a window maximum, and the fingerprints a join on
media and BLOCK of frames, so nothing is folded row by row, and a cue is as many rows as it touches blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeline import FPS, time_to_frame

#: Cues and fingerprints meet in blocks of so many frames, as a power of two.
BLOCK = 8


def with_frames(cues: DataFrame, fps: float = FPS) -> DataFrame:
    """Cues with fs and fe, the frames of their start and end."""
    return cues.withColumn("fs", time_to_frame(F.col("start_ms"), fps)).withColumn("fe", time_to_frame(F.col("end_ms"), fps))


def cue_spans(cues: DataFrame, lengths: DataFrame) -> DataFrame:
    """Of each cue that is emitted: first and last frame, and whether the last comes twice. cues: with fs, fe; lengths: media_id, n."""
    order = W.partitionBy("media_id").orderBy("cue_pos")
    reach = F.max(F.greatest(F.lit(0), F.col("fs") - 1, F.col("fe") - 1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    spans = cues.withColumn("last", reach).withColumn("before", F.coalesce(F.lag("last").over(order), F.lit(0)))
    spans = spans.withColumn("first", F.greatest(F.col("before"), F.col("fs") - 1)).join(lengths, "media_id")
    kind = F.when((F.col("before") > F.col("fs")) | (F.col("first") > F.col("n") - 1), "stop").when((F.col("first") > F.col("fe")) | (F.col("last") > F.col("n") - 1), "tail").otherwise("ok")
    spans = spans.withColumn("kind", kind)
    # the first cue that is not ok ends the media's join; a running minimum knows it by then
    cut = F.min(F.when(F.col("kind") != "ok", F.col("cue_pos"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    spans = spans.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("cue_pos") == F.col("cut")) & (F.col("kind") == "tail"))
    return spans.withColumn("last", F.when(F.col("kind") == "tail", F.col("n") - 1).otherwise(F.col("last"))).withColumn("twice", F.col("kind") == "ok").drop("before", "cut", "kind", "n")


def cue_fingerprints(cues: DataFrame, fingerprints: DataFrame, fps: float = FPS, mode: str = "compatible", lengths: DataFrame | None = None) -> DataFrame:
    """(media_id, cue_pos, cue_index, frame_id, fp, emit_seq) of every frame of every cue.

    mode 'clean' is the plain interval join: frames fs..fe once each, overlaps allowed.
    """
    cues = with_frames(cues, fps)
    if mode == "clean":
        spans = cues.select("media_id", "cue_pos", "cue_index", F.col("fs").alias("first"), F.col("fe").alias("last"), F.lit(False).alias("twice"))
    else:
        lengths = fingerprints.groupBy("media_id").agg((F.max("frame_id") + 1).alias("n")) if lengths is None else lengths
        spans = cue_spans(cues, lengths)
    def piece(low: str, high: str, turn: Column) -> Column:
        return F.struct(F.col(low).alias("low"), F.col(high).alias("high"), turn.alias("turn"))

    whole, again = piece("first", "last", F.col("first")), piece("last", "last", F.col("first") - 1)
    pieces = F.when(F.col("last") >= F.col("first"), F.when(F.col("twice"), F.array(whole, again)).otherwise(F.array(whole)))
    rows = spans.select("media_id", "cue_pos", "cue_index", F.explode(pieces).alias("p")).select("media_id", "cue_pos", "cue_index", "p.*")
    rows = rows.withColumn("block", F.explode(F.sequence(F.shiftright("low", BLOCK), F.shiftright("high", BLOCK))))
    frames = fingerprints.select("media_id", F.col("frame_id").cast("bigint").alias("frame_id"), "fp").withColumn("block", F.shiftright("frame_id", BLOCK))
    # Spark takes exploded rows to be few, and would send all frames to the driver to be broadcast; the pieces are the small side
    joined = frames.join(rows.hint("shuffle_hash"), ["media_id", "block"]).where(F.col("frame_id").between(F.col("low"), F.col("high")))
    return joined.select("media_id", "cue_pos", "cue_index", "frame_id", "fp", (F.col("frame_id") - F.col("turn")).cast("int").alias("emit_seq"))


def rows_of(cue_fp: DataFrame, size: int = 8) -> DataFrame:
    """A cue's fingerprints with their running number and the row of size that they print on."""
    order = W.partitionBy("media_id", "cue_pos").orderBy("emit_seq")
    return cue_fp.withColumn("rn", F.row_number().over(order)).withColumn("line", F.expr(f"cast((rn - 1) div {size} as bigint)"))


def first_frames(cue_fp: DataFrame) -> DataFrame:
    """Of each cue: its first frame and how many rows it has."""
    return cue_fp.groupBy("media_id", "cue_pos").agg(F.min_by("frame_id", "emit_seq").alias("first_frame"), F.count("*").alias("n_rows"))


def shift_cues(cues: DataFrame, delta: Column) -> DataFrame:
    return cues.withColumn("start_ms", F.col("start_ms") + delta).withColumn("end_ms", F.col("end_ms") + delta)


def shift_to_first_cue(cues: DataFrame, other: DataFrame, signed: bool = True) -> DataFrame:
    """cues moved so that their first starts when other's first does; unsigned: by the difference's size, hours left out."""
    mine, theirs = (t.groupBy("media_id").agg(F.min_by("start_ms", "cue_pos").alias(n)) for t, n in ((cues, "_a"), (other, "_b")))
    delta = F.col("_b") - F.col("_a")
    delta = delta if signed else F.abs(delta) % 3_600_000
    return shift_cues(cues.join(mine, "media_id").join(theirs, "media_id"), delta).select(cues.columns)


def pair_by_offset(left: DataFrame, right: DataFrame, offset: int = 2, first: int = 100) -> DataFrame:
    """Cue k of right with cue k + offset of left, for k below first, and how much later left starts."""
    a = left.select("media_id", (F.col("cue_pos") - offset).alias("pos"), F.col("start_ms").alias("left_ms"), F.col("text").alias("left_text"))
    b = right.where(F.col("cue_pos") < first).select("media_id", F.col("cue_pos").alias("pos"), F.col("start_ms").alias("right_ms"), F.col("text").alias("right_text"))
    return a.join(b, ["media_id", "pos"]).withColumn("difference_ms", F.col("left_ms") - F.col("right_ms"))
