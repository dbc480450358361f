"""Training shards by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are ranked in a seeded shuffled order, all rows are sorted by their rank as a
fraction of their source's rows, and that order is cut into shards of equal length. Every shard so
holds each source in the proportion of the whole, to within a row or so per source.

No rank needs the rows of a source, or all rows, in one task: hashes (and then fractions) are first
put into buckets whose order is known, buckets are counted, and a row's rank is its bucket's offset
plus its rank inside the bucket. A source with a third of all rows is spread like any other.

Defined results: a null text has size 16 and the checksum of no bytes (0); a null source is a
source of its own; rows with equal ids, or none, are told apart by size and checksum, and wholly equal
rows are interchangeable (they share a bucket, and so a task); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket, at most about; and buckets, at least.
BUCKET_ROWS, BUCKETS = 65_536, 2_048
#: Hashes are 60-bit: the first 15 hexadecimal digits of an md5.
_RANGE = float(1 << 60)


def shuffle_hash(seed: int, key: Column) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard, fraction."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = docs.count()
    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("h", shuffle_hash(seed, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))).withColumn("bucket", F.floor(F.col("h") / F.lit(_RANGE) * buckets))
    tie = ["doc_id", "size", "text_crc32"]

    # rank within the source: offset of the bucket among the source's buckets, plus the rank inside
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("rows"))
    by_source = W.partitionBy("source")
    offsets = counts.select(
        F.col("source").alias("_s"),
        F.col("bucket").alias("_b"),
        (F.sum("rows").over(by_source.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).alias("before"),
        F.sum("rows").over(by_source).alias("of"),
    )
    inside = W.partitionBy("bucket", "source").orderBy("h", *tie)
    ranked = rows.repartition("bucket").withColumn("rn", F.row_number().over(inside))
    ranked = ranked.join(offsets, F.col("bucket").eqNullSafe(F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    placed = ranked.select(
        "doc_id", "source", "size", "text_crc32", "h",
        ((2 * (F.col("before") + F.col("rn")) - 1) / (2 * F.col("of")).cast("double")).alias("fraction"),
    ).withColumn("part", F.floor(F.col("fraction") * buckets))

    # place in the whole order, in the same manner; the table summed over has a row per bucket
    starts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    starts = starts.select(
        F.col("part").alias("_p"),
        (F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).alias("start"),
    )
    order = W.partitionBy("part").orderBy("fraction", F.col("source").asc_nulls_first(), "h", *tie)
    placed = placed.withColumn("rn", F.row_number().over(order)).join(starts, F.col("part") == F.col("_p"))
    at = F.col("start") + F.col("rn") - 1
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.withColumn("pos", at).withColumn("shard", F.expr(f"int((pos * {shards}L) div {max(n, 1)}L)")).select(
        "doc_id", "source", "size", "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("pos") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "fraction",
    )
