"""Statistics and similarity of fingerprint tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fingerprint import hamming, to_short_hex


def histogram(fingerprints: DataFrame) -> DataFrame:
    """Every fingerprint and how often it occurs."""
    return fingerprints.groupBy("fp").agg(F.count("*").alias("n"))


def distinct_count(fingerprints: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("fp") if approximate else F.count_distinct("fp")
    return fingerprints.agg(count.alias("n_distinct"))


def head(fingerprints: DataFrame, first: int = 10) -> DataFrame:
    """The first frames of each media, as they are shown."""
    return fingerprints.where(F.col("frame_id") < first).select("media_id", "frame_id", to_short_hex(F.col("fp")).alias("fp_hex"))


def distance_to_previous(fingerprints: DataFrame) -> DataFrame:
    before = F.lag("fp").over(W.partitionBy("media_id").orderBy("frame_id"))
    return fingerprints.withColumn("previous", before).where("previous is not null").withColumn("distance", hamming(F.col("fp"), F.col("previous"))).drop("previous")


def flips(width: int, most: int) -> list[int]:
    """All masks of width bits with at most so many set."""
    return [sum(1 << k for k in places) for n in range(most + 1) for places in combinations(range(width), n)]


def near_pairs(fingerprints: DataFrame, most: int = 7) -> DataFrame:
    """Pairs of distinct fingerprints at most `most` bits apart (below 9), each once.

    Of b bands at least one differs in no more than most // b bits. Both sides are keyed by their
    bands with half of these bits turned in every way, so two such bands meet; bands of 21 bits or
    more keep the groups that meet small. What was turned on either side is where a band differs: of
    the ways in which two bands meet, the one that turns the lowest such bit on the second side
    counts, and of a pair's bands the first.
    """
    if not 0 <= most < 9:
        raise ValueError("most must be in 0..8")
    once = fingerprints.select("fp").where("fp is not null").distinct()
    bands = max(2, (most + 3) // 3)
    radius = most // bands
    cuts = [64 * k // bands for k in range(bands + 1)]

    def part(fp: Column, k: int) -> Column:
        return F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))

    def keys(k: int, name: str, turned: int) -> Column:
        masks = F.array(*map(F.lit, flips(cuts[k + 1] - cuts[k], turned)))
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("band"), part(F.col("fp"), k).bitwiseXOR(m.cast("bigint")).alias("key"), m.cast("bigint").alias(f"m_{name}")))

    def keyed(name: str, turned: int) -> DataFrame:
        every = F.concat(*(keys(k, name, turned) for k in range(bands)))
        return once.select(F.col("fp").alias(name), F.explode(every).alias("k")).select(name, "k.*")

    lower = radius // 2
    # Spark takes exploded rows to be as few as the fingerprints, and would broadcast the keys of one side through the driver
    met = keyed("a", radius - lower).join(keyed("b", lower).hint("merge"), ["band", "key"]).where("a < b").withColumn("distance", hamming(F.col("a"), F.col("b")))
    if lower:  # it is one bit, as radius is three at most
        differs = F.col("m_a").bitwiseXOR(F.col("m_b"))
        met = met.where(F.col("m_b") == differs.bitwiseAND(F.negative(differs)))
    earlier = [(F.col("band") <= k) | (F.bit_count(part(F.col("a").bitwiseXOR(F.col("b")), k)) > radius) for k in range(bands - 1)]
    return met.where((F.col("distance") <= most) & reduce(lambda x, y: x & y, earlier)).select("a", "b", "distance")


def concat_media(parts: DataFrame) -> DataFrame:
    """Frames of several files (file_pos, frame_id) as one: file after file, numbered anew.

    A frame's new number is its own plus the frames of the files before: a window over one row per
    file, not over the frames.
    """
    sizes = parts.groupBy("file_pos").agg(F.count("*").alias("rows"), F.min("frame_id").alias("low"))
    before = F.sum("rows").over(W.orderBy("file_pos").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")
    starts = sizes.select("file_pos", "low", before.alias("start"))
    return parts.join(starts, "file_pos").withColumn("new_frame_id", F.col("start") + F.col("frame_id") - F.col("low")).drop("start", "low")


def rebase(frames: DataFrame, time: str = "t", by: str = "media_id", *ties: str) -> DataFrame:
    """Times counted from the first of each media, and frames numbered from 0 (of equal times by ties)."""
    own = W.partitionBy(by)
    number = F.row_number().over(own.orderBy(time, *ties)) - 1
    return frames.withColumn(f"{time}_rebased", F.col(time) - F.min(time).over(own)).withColumn("n", number.cast("bigint"))


def group_entropy(rows: DataFrame, by: list[str], label: str, base: float | None = None) -> DataFrame:
    """Shannon entropy of a label within each group, in two pre-aggregated steps: counts, then c ln c."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").cast("double").alias("c"))
    out = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    value: Column = F.ln("n") - F.col("s") / F.col("n")
    value = value / F.ln(F.lit(float(base))) if base else value
    return out.select(*by, F.greatest(value, F.lit(0.0)).alias("entropy"))
