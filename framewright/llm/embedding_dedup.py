"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors of length one with cosine at least NEAR lie within sqrt(2 - 2 NEAR) of each other. Equal
vectors are one point with a number of copies. Points are dealt to cells round pivots (a farthest-
first net of a bounded sample, the top of the cover tree); cells of more than BLOCK points are dealt
again round points of their own, and what is then still large is cut, so no vector, however common,
fills a task by itself.

Each block becomes a cover tree: nested levels whose radii halve, every node with a centre and the
true covering radius of its points, points of a node side by side. Two blocks are compared unless
their covering radii keep them apart; a task walks both trees at once and drops every pair of nodes
whose centres are further apart than the threshold plus both covering radii. All distances are taken
in double precision, where rounding moves none by more than SLACK. What is left at the leaves is
compared by cosine in double precision. So the pairs are exact. A task returns, for each point, how
many vectors it links with and the smallest id its links reach, never the pairs.

Which blocks meet is found by tiles of their summaries, on the executors. Blocks are gathered in
squads, and a task holds two squads: a block travels once for each squad, not for each block.

How much the bounds prune depends on the vectors: clusters are cheap, but for vectors that are
spread evenly over many dimensions all blocks meet, and the work grows with the square. Where the
bounds part less than half of two nodes' children, these are compared at once instead of one by one.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link
with nothing and are kept; vectors of different lengths never link; equal rows link like equal
vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, spread_sample
from .components import components

NEAR = 0.9
#: Points of a block, about; vectors that pivots are chosen from, at most about; leaves' points.
BLOCK, SAMPLE, LEAF = 8_192, 4_096, 24
#: What rounding may do to a distance.
SLACK = 1e-7
#: Blocks of a squad, and squads at least if there are as many blocks; summaries of a tile.
SQUAD, SQUADS, SUMMARIES = 16, 8, 4_096


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors: good to SLACK, which is what the root makes of a product's rounding near zero."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(x: np.ndarray, radius: float, step: int = 512) -> np.ndarray:
    """Greedy cover: of each point, the place of a centre within radius of it; centres are their own."""
    owner = np.full(len(x), -1)
    centres = np.zeros(0, np.int64)
    for at in range(0, len(x), step):
        own = np.arange(at, min(at + step, len(x)))
        if len(centres):
            d = distance(x[own], x[centres])
            best = d.argmin(1)
            near = d[np.arange(len(own)), best] <= radius
            owner[own[near]] = centres[best[near]]
            own = own[~near]
        if len(own):
            near, fresh = distance(x[own], x[own]) <= radius, []
            for k in range(len(own)):
                if owner[own[k]] < 0:
                    fresh.append(own[k])
                    take = near[k] & (owner[own] < 0)
                    owner[own[take]] = own[k]
                    owner[own[k]] = own[k]
            centres = np.concatenate([centres, np.array(fresh, np.int64)])
    return owner


class CoverTree:
    """Points in tree order; of each node: its points' range, centre, covering radius and children's range."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        rows: list[list] = []  # start, end, centre (place in order), radius, first child, last child + 1
        pending = [(0, len(x), 2.0)]
        rows.append([0, len(x), 0, 0.0, 0, 0])
        at = 0
        while at < len(rows):
            start, end, level = pending[at]
            own = self.order[start:end]
            centre = x[own[:1]]
            rows[at][2] = start
            rows[at][3] = float(distance(x[own], centre).max(initial=0)) + SLACK if len(own) else 0.0
            if end - start > LEAF and rows[at][3] > 2 * SLACK:
                owner, radius = np.zeros(len(own), np.int64), min(level, rows[at][3])
                while len(own) and (owner == owner[0]).all() and radius > SLACK:
                    radius /= 2
                    owner = net(x[own], radius)
                if (owner != owner[0]).any():
                    by = np.argsort(owner, kind="stable")
                    # a centre comes first among its points
                    by = by[np.lexsort((by != owner[by], owner[by]))]
                    self.order[start:end] = own[by]
                    cuts = np.flatnonzero(np.append(True, owner[by][1:] != owner[by][:-1]))
                    rows[at][4] = len(rows)
                    for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
                        rows.append([start + a, start + b, start + a, 0.0, 0, 0])
                        pending.append((start + a, start + b, radius))
                    rows[at][5] = len(rows)
            at += 1
        self.start, self.end, self.centre, self.radius, self.low, self.high = (np.array(c) for c in zip(*rows, strict=True))
        self.x = x[self.order]
        self.centres = self.x[self.centre]

    def pack(self, vectors: np.ndarray) -> tuple:
        """What unpack needs: the vectors themselves, in tree order, are half as wide as the unit vectors."""
        return vectors[self.order], self.start, self.end, self.centre, self.radius, self.low, self.high

    @classmethod
    def unpack(cls, vectors: np.ndarray, *nodes: np.ndarray) -> CoverTree:
        tree = cls.__new__(cls)
        tree.start, tree.end, tree.centre, tree.radius, tree.low, tree.high = nodes
        tree.x = unit(vectors)
        tree.centres = tree.x[tree.centre]
        return tree


def dual(a: CoverTree, b: CoverTree, reach: float, step: int = 1024) -> Iterator[tuple[slice, slice]]:
    """Pairs of point ranges that may hold points within reach; what is not in any pair does not."""
    pending = [(0, 0)]
    while pending:
        m, n = pending.pop()
        if a.low[m] == a.high[m] and b.low[n] == b.high[n]:
            yield slice(a.start[m], a.end[m]), slice(b.start[n], b.end[n])
            continue
        left = np.arange(a.low[m], a.high[m]) if a.low[m] < a.high[m] else np.array([m])
        right = np.arange(b.low[n], b.high[n]) if b.low[n] < b.high[n] else np.array([n])
        for at in range(0, len(left), step):
            own = left[at : at + step]
            d = distance(a.centres[own], b.centres[right])
            near = d <= reach + SLACK + a.radius[own][:, None] + b.radius[right][None, :]
            if len(own) * len(right) > 64 and near.mean() > 0.5:  # bounds do not part these: compare their points
                yield slice(a.start[own[0]], a.end[own[-1]]), slice(b.start[right[0]], b.end[right[-1]])
                continue
            i, j = np.nonzero(near)
            pending.extend(zip(own[i].tolist(), right[j].tolist(), strict=True))


def compare(a: CoverTree, ids_a, copies_a, b: CoverTree, ids_b, copies_b, near: float, same: bool, step: int = 1024):
    """(links of a's points, of b's, smallest id reached by a's, by b's): over this pair of blocks alone."""
    reach = float(np.sqrt(2 - 2 * near))
    links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    root_a = ids_a.copy()
    root_b = root_a if same else ids_b.copy()
    found = []
    for rows, columns in dual(a, b, reach):
        for at in range(rows.start, rows.stop, step):
            own = slice(at, min(at + step, rows.stop))
            hit = a.x[own] @ b.x[columns].T >= near
            if same:
                i, j = np.arange(own.start, own.stop)[:, None], np.arange(columns.start, columns.stop)[None, :]
                hit &= i != j
            if hit.any():
                links_a[own] += hit @ copies_b[columns]
                if not same:
                    links_b[columns] += hit.T @ copies_a[own]
                found.append((own, columns, np.packbits(hit, axis=1), hit.shape[1]))
    changed = True
    while changed and found:
        changed = False
        for own, columns, packed, width in found:
            hit = np.unpackbits(packed, axis=1, count=width).astype(bool)
            top = np.iinfo(np.int64).max
            low = np.minimum(root_a[own], np.where(hit, root_b[columns][None, :], top).min(1))
            changed |= bool((low < root_a[own]).any())
            root_a[own] = low
            low = np.minimum(root_b[columns], np.where(hit, root_a[own][:, None], top).min(0))
            changed |= bool((low < root_b[columns]).any())
            root_b[columns] = low
    return links_a, links_b, root_a, root_b


def _prepare(kind: str):
    """One row per block: its tree, and the block's centre and covering radius."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        vectors = np.stack(pdf["v"].to_list()).astype(kind)
        tree = CoverTree(unit(vectors))
        payload = pickle.dumps((tree.pack(vectors), pdf["rep"].to_numpy()[tree.order], pdf["copies"].to_numpy()[tree.order]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "size": [tree.x.shape[1]], "centre": [tree.x[0]], "radius": [float(tree.radius[0])], "payload": [payload]})

    return run


def _neighbours(near: float):
    """Of a tile of summaries (those of part i, then of part j): the pairs of blocks that may hold links."""
    reach = float(np.sqrt(2 - 2 * near))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in pdf.groupby("size"):
            left, right = own[own["part"] == own["i"]], own[own["part"] == own["j"]]
            if len(left) and len(right):
                d = distance(np.stack(left["centre"].to_list()), np.stack(right["centre"].to_list()))
                x, y = np.nonzero(d <= reach + SLACK + left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None, :])
                found.append(pd.DataFrame({"a": left["block"].to_numpy()[x], "b": right["block"].to_numpy()[y], "squad_a": left["squad"].to_numpy()[x], "squad_b": right["squad"].to_numpy()[y]}))
        if not found:
            return pd.DataFrame({"a": pd.Series([], dtype=str), "b": pd.Series([], dtype=str), "squad_a": pd.Series([], dtype="int64"), "squad_b": pd.Series([], dtype="int64")})
        out = pd.concat(found, ignore_index=True)
        low = ((out["squad_a"] < out["squad_b"]) | (out["squad_a"] == out["squad_b"]) & (out["a"] <= out["b"])).to_numpy()
        first, second = out[["a", "squad_a"]].to_numpy(), out[["b", "squad_b"]].to_numpy()
        one, two = np.where(low[:, None], first, second), np.where(low[:, None], second, first)
        out = pd.DataFrame({"a": one[:, 0], "b": two[:, 0], "squad_a": one[:, 1], "squad_b": two[:, 1]}).drop_duplicates()
        return out.astype({"squad_a": "int64", "squad_b": "int64"})

    return run


def _meet(near: float):
    """Of two squads' blocks and the pairs of them that meet: links and roots of their points."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        found = []
        raw = dict(zip(blocks["block"].to_pylist(), blocks["payload"], strict=True))
        by: dict[str, list[str]] = {}
        for a, b in sorted(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)):
            by.setdefault(a, []).append(b)

        def load(block: str) -> tuple:
            packed, ids, copies = pickle.loads(raw[block].as_py())
            return CoverTree.unpack(*packed), ids, copies

        for first, others in by.items():
            a, ids_a, copies_a = load(first)
            for other in others:
                same = first == other
                b, ids_b, copies_b = (a, ids_a, copies_a) if same else load(other)
                links_a, links_b, root_a, root_b = compare(a, ids_a, copies_a, b, ids_b, copies_b, near, same)
                for ids, links, roots in ((ids_a, links_a, root_a),) if same else ((ids_a, links_a, root_a), (ids_b, links_b, root_b)):
                    some = links > 0
                    found.append(pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(roots[some])], schema=schema))
        return pa.Table.from_batches(found, schema=schema)

    return run


def pivots(points: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Of each vector length: farthest-first centres out of the sample."""
    drawn = points.where(spread_sample(points, F.col("rep"), SAMPLE, 29)).select("rep", "v").toArrow().sort_by("rep")
    by_size: dict[int, list] = {}
    for v in drawn["v"].to_pylist():
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, vectors in by_size.items():
        x = unit(np.array(vectors))
        chosen, far = [0], distance(x, x[:1])[:, 0]
        while len(chosen) < min(count, len(x)) and far.max() > SLACK:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distance(x, x[chosen[-1:]])[:, 0])
        out[size] = x[chosen]
    return out


def cells(points: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """(rep, block): points near one another, about block of them in each."""
    n = points.count()
    shared = points.sparkSession.sparkContext.broadcast(pivots(points, max(1, -(-n // block))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        starts = dict(zip(centres, np.cumsum([0, *map(len, centres.values())])[:-1], strict=True))
        spare = sum(map(len, centres.values()))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = part.column(1).to_pylist()
                sizes = np.array([len(v) for v in x])
                own = np.zeros(len(x), np.int64)
                for size in np.unique(sizes):
                    which = np.flatnonzero(sizes == size)
                    if int(size) in centres:
                        own[which] = starts[int(size)] + distance(unit(np.array([x[i] for i in which])), centres[int(size)]).argmin(1)
                    else:
                        own[which] = spare + int(size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own)], names=["rep", "cell"])

    placed = scratch.put(points.select("rep", "v").mapInArrow(lean(nearest), "rep long, cell long"), "cells")
    shared.destroy()
    large = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = scratch.put(large.select("cell", "n", F.ceil(F.col("n") / block).alias("parts")), "large")
    if large.isEmpty():
        return placed.select("rep", F.col("cell").cast("string").alias("block"))
    # about 2 * parts points of a large cell, drawn by hash, are centres of its own; as many as the cell has blocks, so few
    share = 2 * F.col("parts") / F.col("n") * F.lit(float(1 << 30))
    again = placed.join(large, "cell")
    drawn = again.where(F.pmod(F.xxhash64("rep", F.lit(31)), F.lit(1 << 30)) < share).select("rep", "cell").join(points.select("rep", "v"), "rep")
    centres = scratch.put(drawn.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("rep", "v"))).alias("centres")), "centres")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, own = np.asarray(batch.column(1)), np.zeros(len(batch), np.int64)
            for c in np.unique(cell):
                which = np.flatnonzero(cell == c)
                near = batch.column(3)[int(which[0])].as_py()
                if near:
                    x = unit(np.array(batch.column(2).take(pa.array(which)).to_pylist()))
                    own[which] = distance(x, unit(np.array([p["v"] for p in near]))).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["rep", "cell", "sub"])

    # vectors of one length share a cell, so they stack
    rows = again.select("rep", "cell").join(points.select("rep", "v"), "rep").join(centres.select("cell", F.col("centres").alias("c")), "cell", "left")
    fine = scratch.put(rows.select("rep", "cell", "v", "c").mapInArrow(lean(inner), "rep long, cell long, sub long"), "fine")
    sizes = scratch.put(fine.groupBy("cell", "sub").agg(F.ceil(F.count("*") / (2 * block)).alias("parts")), "fine-sizes")
    fine = fine.join(sizes, ["cell", "sub"]).select("rep", F.concat_ws("-", "cell", "sub", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))
    small = placed.join(large.select("cell"), "cell", "left_anti").select("rep", F.col("cell").cast("string").alias("block"))
    return small.unionByName(fine)


def near_duplicates(vectors: DataFrame, near: float = NEAR, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    scratch = Scratch(vectors.sparkSession)
    v = F.col("embedding")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(sound & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound & F.col("vec_id").isNotNull(), v).alias("v"))
    # equal vectors are known by 128 bits
    keys = ["h", "h2"]
    rows = rows.select("vec_id", "v", *(F.when(F.col("v").isNotNull(), F.xxhash64(x)).alias(k) for k, x in zip(keys, (F.col("v"), F.reverse("v")), strict=True)))
    points = rows.where("v is not null").groupBy(*keys).agg(F.min(F.struct("vec_id", "v")).alias("p"), F.count("*").alias("copies"))
    points = scratch.put(points.select(*keys, F.col("p.vec_id").alias("rep"), F.col("p.v").alias("v"), "copies"), "points")
    kind = "float32" if points.schema["v"].dataType.elementType.simpleString() == "float" else "float64"
    grouped = points.join(cells(points, block, scratch).hint("merge"), "rep").select("block", "rep", "copies", "v")
    blocks = grouped.groupBy("block").applyInPandas(_prepare(kind), "block string, size int, centre array<double>, radius double, payload binary")
    blocks = scratch.put(blocks, "blocks")
    n = blocks.count()
    if n:
        squads = min(n, max(SQUADS, -(-n // SQUAD)))
        squad = F.pmod(F.xxhash64("block"), F.lit(squads)).alias("squad")
        parts = max(1, -(-n // SUMMARIES))
        part = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(parts)).cast("int")
        summary = blocks.select("block", "size", "centre", "radius", squad, part.alias("part"))
        with_part = lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j"))
        tiles = summary.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), with_part))).select("block", "size", "centre", "radius", "squad", "part", "t.*")
        pairs = scratch.put(tiles.groupBy("i", "j").applyInPandas(_neighbours(near), "a string, b string, squad_a long, squad_b long"), "pairs")
        wanted = scratch.put(pairs.select("squad_a", "squad_b", F.explode(F.array("a", "b")).alias("block")).distinct(), "wanted")
        held = wanted.join(blocks.select("block", "payload"), "block")
        keyed = held.groupBy("squad_a", "squad_b").cogroup(pairs.groupBy("squad_a", "squad_b"))
        links = scratch.put(keyed.applyInArrow(_meet(near), "rep long, links long, root long"), "links")
    result = rows.join(points.select(*keys, "rep", "copies").hint("merge"), keys, "left")
    if n:
        roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        result = result.join(counts.hint("merge"), "rep", "left").join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    else:
        result = result.withColumn("links", F.lit(0)).withColumn("root", F.lit(None).cast("long"))
    result = result.select(
        "vec_id",
        F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("root", "rep", "vec_id").alias("component_id"),
    )
    return scratch.only(result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "classes")
