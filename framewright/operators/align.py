"""Chunks, pairs and best matches of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, one_line, pack, ratio, similarity, translate, unescape_html, unpack


def chunks(rows: DataFrame, by: str, pos: str, value: str, size: int, fill: str | None = None) -> DataFrame:
    """Runs of size values in order of pos (which counts from 0): (by, chunk, items). fill: pads the last; without it nulls are dropped."""
    kept = rows if fill is not None else rows.where(F.col(value).isNotNull())
    listed = kept.groupBy(by, F.expr(f"cast({pos} div {size} as bigint)").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("l"))
    items = F.transform("l", lambda x: x["v"])
    if fill is not None:
        items = F.concat(items, F.array_repeat(F.lit(fill), F.lit(size) - F.size(items)))
    return listed.select(by, "chunk", items.alias("items"))


def zip_shortest(a: Column, b: Column, left: str = "source", right: str = "target") -> Column:
    """Pairs of two arrays, as many as the shorter has."""
    size = F.least(F.size(a), F.size(b))
    named = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.struct(p["x"].alias(left), p["y"].alias(right)))
    return F.slice(named, F.lit(1), size)


def translated(cues: DataFrame, words: dict[str, str] | None = None, func: Callable[[str], str] | None = None) -> DataFrame:
    """media_id, cue_pos, the cleaned source text and its translation (null where that failed)."""
    clean = one_line(unescape_html(clean_html(F.col("text"))))
    return cues.select("media_id", "cue_pos", clean.alias("source_text")).withColumn("target_text", translate(F.col("source_text"), words, func))


def translated_in_chunks(cues: DataFrame, size: int = 15, mark: str = " ¶ ", words: dict[str, str] | None = None, func: Callable[[str], str] | None = None) -> DataFrame:
    """The same, size cues to a call: packed with a mark, translated, unpacked and paired; failed chunks are left out."""
    clean = cues.withColumn("line", one_line(clean_html(F.col("text"))))
    packed = chunks(clean, "media_id", "cue_pos", "line", size).withColumn("sent", pack(F.col("items"), mark))
    got = packed.withColumn("got", unescape_html(translate(F.col("sent"), words, func))).where("got is not null")
    pairs = got.withColumn("back", unpack(F.col("got"), mark)).select("media_id", "chunk", F.posexplode(zip_shortest(F.col("items"), F.col("back"))).alias("at", "p"))
    return pairs.select("media_id", (F.col("chunk") * size + F.col("at")).alias("cue_pos"), F.col("p.source").alias("source_text"), F.col("p.target").alias("target_text"))


def best_match(candidates: DataFrame, by: str, pos: str, score: Column, *keep: str) -> DataFrame:
    """The best candidate of each group; of equal scores the first by pos."""
    best = F.max_by(F.struct(pos, *keep), F.struct(score, -F.col(pos)))
    return candidates.groupBy(by).agg(best.alias("b"), F.max(score).alias("score")).select(by, f"b.{pos}", *(f"b.{k}" for k in keep), "score")


def best_title(hits: DataFrame, query: str, title: str = "title", pos: str = "pos", func: Callable[[str, str], int] = ratio) -> DataFrame:
    """The hit whose title is most like the query."""
    scored = hits.withColumn("score", similarity(F.col(title), F.lit(query), func)).withColumn("query", F.lit(query))
    return best_match(scored, "query", pos, F.col("score"), title)
