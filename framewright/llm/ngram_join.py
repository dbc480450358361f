"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, then exact sorted-array intersection.

A text's set is its distinct shingles of SHINGLE words (A-Z lower-cased; a shorter text is one
shingle, an empty one has none and links with nothing). Two sets link when their Jaccard similarity
is at least NEAR / 100. Texts with equal sets are one node from the start.

Candidates. Every set is ordered by one global order of shingles (commonest last, then by hash).
Two sets that link must share a shingle among the first s - ceil(NEAR s / 100) + 1 of each; these
are a node's signatures. The order decides only how many candidates there are, never which links are
found. One exchange brings equal signatures together, sorted; a pass over them drops those of a single
node, or of nodes whose sizes cannot link. Signatures of common shingles are known to be shared, so
theirs are salted, and no task has to take all nodes of one.

Tiles. The nodes of a signature are cut into bands of sizes with ratio 100 / NEAR; a link is either
inside a band or between neighbouring bands, so only those tiles are compared. The same pass names a
leader in every tile, the node with the largest share of common shingles (the middle of a group of
near copies has more of them than its copies, which differ from it in words of their own), and of
equal ones that of least hash; every node then meets one leader of its band and one of
the next, two at most, so a group of thousands of near copies costs two comparisons per member. What
links is one component, whose nodes need no further comparing. Then the signatures that still hold
several components are finished pair by pair: small ones as they pass by in order, crowded ones in
tiles of at most TILE nodes a side, where the bitmaps alone decide what may link.

Comparing. Hashed bitmaps, wider for larger sets, bound the overlap from above by bit counts: a set's
shingles whose bit the other lacks are not shared. Of pairs that pass, the sorted shingle arrays are
made again from the texts, which are a third of their size to move, and intersected exactly.

A node is known by a 64-bit hash of its set; nodes whose second such hash differs are found by a
count before anything else and go by that one, so that a chance of 2^-128 is left.

Defined results: a null text is an empty one; a row with a null id links with nothing; rows with one
id are rows of their own; equal rows are one node; an empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, among, gathered, grams, lean, mix, shielded, word_chunks
from .components import components

SHINGLE, NEAR = 5, 80
BITS, BITS_PER = 256, 8
#: Nodes still apart from which a signature is crowded; nodes of a block of a tile.
CROWD, TILE = 32, 1024
#: A shingle is common when this share of documents has it; COMMONEST of them, at most, are told apart.
COMMON, COMMONEST = 1 / 100_000, 1 << 21
#: Shingles that are counted together, and then forgotten if they came but once.
TOGETHER = 1 << 22
#: Rows of a part of a common signature, about, of which there are PARTS at most; rows of one signature that are held together, at most.
PART, PARTS, HELD = 1 << 13, 1 << 16, 1 << 16
#: One signature in so many names leaders.
LEADING = 4


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    first, texts = words.first, len(words.first) - 1
    n = np.diff(first)
    g = grams(words.hashes, size)
    owner = np.repeat(np.arange(texts), n)
    inside = np.flatnonzero(owner[: len(g)] == owner[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    extra = [grams(words.hashes[first[k] : first[k + 1]], int(n[k]), seed=1)[0] for k in short]
    keys = np.concatenate([g[inside], np.array(extra, np.uint64)])
    owner = np.concatenate([owner[inside], short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)]
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(texts + 1))


def node_keys(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's set, whatever its order."""
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(mix(keys + np.uint64(salt)), out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return mix(out[0]).view(np.int64), mix(out[1] + np.uint64(1)).view(np.int64)


def least_overlap(a: int, b: int, near: int) -> int:
    """Smallest overlap with which sets of sizes a and b link."""
    return -(-near * (a + b) // (100 + near))


def bitmap(keys: np.ndarray) -> bytes:
    """Which hash bits the set has; as many bits as the power of two above BITS_PER shingles, BITS at least."""
    width = max(BITS, 1 << (BITS_PER * len(keys)).bit_length())
    bits = np.zeros(width, bool)
    bits[(keys >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """Most shingles that two sets can share: those of one whose bit the other lacks are not shared."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):  # the wider one is folded
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def band(column: str) -> Column:
    """Size band of a set; sizes that can link are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(column).cast("double")) / F.log(F.lit(100.0 / NEAR)) + 1e-9).cast("int")


# ---- passes over the texts ---------------------------------------------------------------


def _nodes(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(2), lower=True):
                keys, first = shingle_sets(words, size)
                bits = [bitmap(keys[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                node, check = node_keys(keys, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first)), pa.array(node), pa.array(check), pa.array(bits, pa.binary())], schema=schema)

    return lean(run)


def _common(size: int):
    """Shingles that this task's texts have often, and in how many of them.

    What TOGETHER shingles have once is not counted, so the counts of rarer ones are low; they only order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in chain(batches, [None]):
            for _, _, words in word_chunks(batch.column(1), lower=True) if batch is not None else ():
                held.append(shingle_sets(words, size)[0])
                waiting += len(held[-1])
                if waiting >= TOGETHER:
                    keys, n, held, waiting = *_counted(keys, n, held), [], 0
        keys, n = _counted(keys, n, held)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["shingle", "texts"])

    return lean(run)


def _counted(keys: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts so far and those of what is held more than once."""
    own, times = np.unique(np.concatenate([keys[:0], *held]), return_counts=True)
    keys, n = np.concatenate([keys, own[times >= 2]]), np.concatenate([n, times[times >= 2]])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], (np.add.reduceat(n, at) if len(at) else n).astype(np.int64)


def prefixes(keys: np.ndarray, first: np.ndarray, common: np.ndarray, level: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, its level): each set's leading shingles in the global order; and how many in 255 of its shingles are common."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(keys), np.int64)
    if len(common) and len(keys):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        rank = np.where(common[at] == keys, level[at], 0)
    order = np.lexsort((keys, rank, owner))
    keep = n - (-(-near * n // 100)) + 1
    place = np.arange(len(keys)) - first[:-1][owner]
    take = place < keep[owner]
    share = 255 * np.bincount(owner, rank > 0, len(n)) // np.maximum(n, 1)
    return owner[take], keys[order][take], rank[order][take], share.astype(np.int64)


def _signatures(size: int, near: int, shared):
    schema = pa.schema([("sig", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level, doubtful = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, words in word_chunks(batch.column(1), lower=True):
                keys, first = shingle_sets(words, size)
                nodes, check = node_keys(keys, first)
                nodes = np.where(np.isin(nodes, doubtful), check, nodes)
                seen = seen if len(seen) < 100_000 else set()
                fresh = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)  # most copies in a task count once
                owner, sig, rank, share = prefixes(keys, first, common, level, near)
                keep = fresh[owner]
                owner, sig, rank = owner[keep], sig[keep], rank[keep]
                # 0: rare; 1: common, in one part; from 2 on: a part of a commoner one (its level is one more than a logarithm)
                parts = np.minimum((np.uint64(1) << np.minimum(rank, 40).astype(np.uint64)) // np.uint64(2 * PART), np.uint64(PARTS))
                part = mix(nodes.view(np.uint64)[owner] ^ sig) % np.maximum(parts, np.uint64(1))
                salt = np.where(rank == 0, 0, np.where(parts <= 1, 1, 2 + part.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(salt, pa.int32()), pa.array(nodes[owner]), pa.array((np.diff(first) << 8 | share)[owner], pa.int64())], schema=schema)

    return lean(run)


def size_bands(n: np.ndarray) -> np.ndarray:
    """As band."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100.0 / NEAR) + 1e-9).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The columns of sorted rows, cut between keys (the first columns): (columns, whether the first key goes on from the last
    piece). Only a key of more than `most` rows is cut inside."""
    held: list[np.ndarray] | None = None
    goes_on, last = False, None
    for some in gathered(batches, min(most, 1 << 15)):
        now = [np.concatenate(c) for c in zip(*([np.asarray(c) for c in batch.columns] for batch in some), strict=True)]
        held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
        other = np.zeros(len(held[0]), bool)
        for c in held[:keys]:
            other |= c != c[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if len(held[0]) - cut > most:
            cut = len(held[0])
        if cut:
            piece = [c[:cut] for c in held]
            key = tuple(c[0] for c in piece[:keys])
            yield piece, goes_on and key == last
            last, goes_on = tuple(c[-1] for c in piece[:keys]), cut == len(held[0])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held, goes_on and tuple(c[0] for c in held[:keys]) == last


def _shared(near: int):
    """Of rows sorted by (sig, salt): those that may link with another, and in some of them the node's leaders: of its band, and of the next."""
    long = pa.int64()
    schema = pa.schema([("sig", long), ("salt", pa.int32()), ("node", long), ("n", pa.int32()), ("share", pa.int32()), ("lead", long), ("lead_share", pa.int32()), ("up", long), ("up_share", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, salt, node, packed), goes_on in runs(batches, 2, HELD):
            n, share = packed >> 8, packed & 255
            new = np.append(True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]))
            group = np.cumsum(new) - 1
            rows = np.bincount(group)[group]
            sure = (salt > 0) | (group == 0) & goes_on
            some = np.flatnonzero((rows > 1) | sure)
            if not len(some):
                continue
            sig, salt, node, n, share, group, sure = (x[some] for x in (sig, salt, node, n, share, group, sure))
            band = size_bands(n)
            order = np.lexsort((mix(node.view(np.uint64)), -share, band, group))
            sig, salt, node, n, share, group, sure, band = (x[order] for x in (sig, salt, node, n, share, group, sure, band))
            first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (band[1:] != band[:-1])))  # of each band of a group
            size = np.diff(np.append(first, len(group)))
            follows = np.append((group[first[1:]] == group[first[:-1]]) & (band[first[1:]] == band[first[:-1]] + 1), False)
            beside = follows | np.append(False, follows[:-1])
            tile = np.repeat(np.arange(len(first)), size)
            keep = sure | ((size > 1) | beside)[tile]
            own = first[tile]
            above = first[np.minimum(tile + 1, len(first) - 1)]

            def fits(at: np.ndarray, n=n) -> np.ndarray:
                return near * np.maximum(n, n[at]) <= 100 * np.minimum(n, n[at])

            naming = (mix(sig.view(np.uint64)) % np.uint64(LEADING) == 0) & (salt < 2)
            has_lead = naming & (node[own] != node) & fits(own)
            has_up = naming & follows[tile] & fits(above)
            leaders = (pa.array(x[at], kind, mask=~has) for at, has in ((own, has_lead), (above, has_up)) for x, kind in ((node, long), (share, pa.int32())))
            columns = [pa.array(sig), pa.array(salt), pa.array(node), pa.array(n, pa.int32()), pa.array(share, pa.int32()), *leaders]
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(keep))

    return lean(run)


def _finish(near: int):
    """Of rows (sig, node, n, root) sorted by sig, of signatures that hold several roots: kind 0, the pairs of small ones that sizes
    allow; kind 1, the rows of crowded ones."""
    long = pa.int64()
    schema = pa.schema([("kind", pa.int32()), ("sig", long), ("a", long), ("b", long), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, node, n, root), goes_on in runs(batches, 1, HELD):
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(first, len(sig)))
            crowded = size >= CROWD
            apart = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
            crowded[0], apart[0] = crowded[0] or goes_on, apart[0] or goes_on
            crowded, apart = (np.repeat(x, size) for x in (crowded | (size >= HELD), apart | (size >= HELD)))
            at = np.flatnonzero(apart & crowded)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(sig[at]), pa.array(node[at]), pa.array(root[at]), pa.array(n[at])], schema=schema)
            at = np.flatnonzero(apart & ~crowded)
            sig, node, n, root = sig[at], node[at], n[at].astype(np.int64), root[at]
            found = []
            for d in range(1, min(CROWD, len(at))):
                same = sig[d:] == sig[:-d]
                if not same.any():
                    break
                i = np.flatnonzero(same & (root[d:] != root[:-d]) & (near * np.maximum(n[d:], n[:-d]) <= 100 * np.minimum(n[d:], n[:-d])))
                found.append(np.stack([np.maximum(node[i], node[i + d]), np.minimum(node[i], node[i + d])], 1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                zero = np.zeros(len(pairs), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(zero), pa.nulls(len(pairs), long), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(zero)], schema=schema)

    return lean(run)


def _bound(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)
            keep = pa.array([bound(p.as_buffer(), q.as_buffer(), x, y) >= least_overlap(x, y, near) for x, y, p, q in sizes], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return lean(run)


def fold_to(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of words, all folded to width bytes."""
    out = np.empty((len(bits), width // 8), np.uint64)
    for k, b in enumerate(bits):
        x = np.frombuffer(b, np.uint64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        out[k] = x
    return out


def _tile(near: int):
    """Pairs of a tile whose bitmaps leave room for a link: of blocks i and j of one band (kind 0), or of block i of a band
    and j of the next (kind 1), or of all bands of a signature that is one tile (kind 2)."""

    def met(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[np.ndarray]:
        if not len(left) or not len(right):
            return
        width = min(min(map(len, p["bits"])) for p in (left, right))
        x, y = (fold_to(list(p["bits"]), width) for p in (left, right))
        m, roots, nodes = (right[c].to_numpy() for c in ("n", "root", "node"))
        for k, (root, node, size) in enumerate(zip(left["root"], left["node"], left["n"], strict=True)):
            fits = (roots != root) & (near * np.maximum(m, size) <= 100 * np.minimum(m, size))
            if same:
                fits &= nodes > node
            at = np.flatnonzero(fits)
            if len(at):
                most = np.minimum(size - np.bitwise_count(x[k] & ~y[at]).sum(1, dtype=np.int64), m[at] - np.bitwise_count(y[at] & ~x[k]).sum(1, dtype=np.int64))
                at = at[most >= -(-near * (size + m[at]) // (100 + near))]
                yield np.stack([np.maximum(nodes[at], node), np.minimum(nodes[at], node)], 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, low, i, j = (pdf[c].iloc[0] for c in ("kind", "low", "i", "j"))
        if kind == 2:
            bands = {k: part for k, part in pdf.groupby("band")}
            found = [p for k, part in bands.items() for other in (k, k + 1) if other in bands for p in met(part, bands[other], other == k)]
        else:
            second = (pdf["block"].to_numpy() != i) if kind == 0 else (pdf["band"].to_numpy() != low)
            same = kind == 0 and i == j
            found = list(met(pdf[~second], pdf if same else pdf[second], same))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _exact(size: int, near: int):
    """Pairs whose texts' sorted shingle arrays overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                sets = [[keys[first[k] : first[k + 1]] for _, _, words in word_chunks(part.column(c), lower=True) for keys, first in [shingle_sets(words, size)] for k in range(len(first) - 1)] for c in (2, 3)]
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = overlap(x, y)
                    keep.append(100 * both >= near * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return lean(run)


# ---- the join ----------------------------------------------------------------------------


class Join:
    """The tables of one join, in scratch space."""

    def __init__(self, docs: DataFrame, size: int, near: int):
        self.scratch, self.size, self.near = Scratch(docs.sparkSession), size, near
        self.sc = docs.sparkSession.sparkContext
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        self.rows = rows.where("doc_id is not null")
        made = self.scratch.put(rows.mapInArrow(_nodes(size), "doc_id long, h long, n long, node long, check long, bits binary"), "members")
        # two sets with one hash: so few, by chance, that the driver can name them (rows squared over 2^65)
        twice = made.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
        self.doubtful = np.array(sorted(r.node for r in twice.select("node").collect()), np.int64)
        self.members = made.withColumn("node", F.when(F.col("node").isin(self.doubtful.tolist()), F.col("check")).otherwise(F.col("node"))) if len(self.doubtful) else made

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The common shingles and the logarithm of how many documents have each."""
        least = max(2, int(self.members.count() * COMMON))
        often = self.rows.select("doc_id", "text").mapInArrow(_common(self.size), "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least)
        table = often.orderBy(F.desc("texts"), "shingle").limit(COMMONEST).toArrow()
        keys, n = np.asarray(table["shingle"]).view(np.uint64).copy(), np.asarray(table["texts"], dtype=np.float64)
        order = np.argsort(keys)
        return keys[order], (1 + np.log2(n[order])).astype(np.int8)

    def signatures(self) -> DataFrame:
        """(sig, salt, node, n, and its leaders) of signatures that several nodes of sizes that can link have."""
        shared = self.sc.broadcast((*self.common(), self.doubtful))
        raw = self.rows.select("doc_id", "text").mapInArrow(_signatures(self.size, self.near, shared), "sig long, salt int, node long, n long")
        met = raw.repartition("sig", "salt").sortWithinPartitions("sig", "salt")
        both = self.scratch.put(met.mapInArrow(_shared(self.near), "sig long, salt int, node long, n int, share int, lead long, lead_share int, up long, up_share int"), "signatures")
        shared.destroy()
        self.scratch.tidy()
        return both

    def described(self, wanted: DataFrame, name: str) -> DataFrame:
        """Of each wanted node: size, bitmap, and a row that has its text."""
        rows = among(self.members.where("doc_id is not null"), wanted, key="node").join(wanted, "node")
        first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("m"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        return self.scratch.put(first.select("node", "m.doc_id", "m.h", "n", "bits"), name)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct pairs (a, b) that link: bitmaps first, then the texts' shingles."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        nodes = self.described(ends, f"{name}-nodes")
        for side in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits_{side}")), side)
        left = pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_bound(self.near), "a long, b long")
        left = self.scratch.put(left, f"{name}-left")
        ends = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
        wanted = nodes.select("node", "doc_id", "h").join(ends, "node")
        texts = among(self.rows, wanted).join(wanted.hint("merge"), ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"])
        texts = self.scratch.put(texts, f"{name}-texts")
        met = left
        for side in ("a", "b"):
            met = met.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")).hint("merge"), side)
        links = met.select("a", "b", "text_a", "text_b").mapInArrow(_exact(self.size, self.near), "a long, b long")
        links = self.scratch.put(links, f"{name}-links")
        self.scratch.drop(f"{name}-left", f"{name}-texts", f"{name}-nodes")
        self.scratch.tidy()
        return links

    def run(self) -> DataFrame:
        """doc_id, h, n, root, component_id."""
        signatures = self.signatures()
        pairs = self.scratch.put(self.with_leaders(signatures), "leaders")
        links = self.verified(pairs, "first") if not pairs.isEmpty() else None
        roots = components(links, self.scratch, "cc-first-") if links is not None else None
        rest = self.scratch.put(self.with_all(signatures, roots).join(pairs, ["a", "b"], "left_anti"), "rest")
        self.scratch.drop("signatures", "crowded", "finish")
        if not rest.isEmpty():
            new = self.verified(rest, "second")
            links = new if links is None else links.unionByName(new)
            roots = components(links, self.scratch, "cc-second-")
        return self.scratch.only(self.classes(roots), "classes")

    def with_leaders(self, signatures: DataFrame) -> DataFrame:
        """Every node with one leader of its band and one of the next, of all that its signatures name: again those with most common shingles."""
        columns = ["node", "lead", "lead_share", "up", "up_share"]
        named = signatures.where("lead is not null or up is not null").select(columns)
        # signatures in several parts: their leaders by a pre-aggregated minimum, and a join that Spark can split
        split = signatures.where("salt > 1").select("sig", "node", "n", "share", band("n").alias("band"))
        lead = split.groupBy("sig", "band").agg(F.min(F.struct(F.negative("share"), F.xxhash64("node"), "node", "n", "share")).alias("l"))
        lead = self.scratch.put(lead.select("sig", "band", "l.node", "l.n", "l.share"), "lead")
        if not lead.isEmpty():
            fits = F.expr(f"{self.near} * greatest(n, n2) <= 100 * least(n, n2)") & (F.col("node") != F.col("node2"))
            other = lambda k: lead.select("sig", (F.col("band") - k).alias("band"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("share").alias("share2"))
            for k, (c, none) in enumerate((("lead", "up"), ("up", "lead"))):
                met = split.join(other(k), ["sig", "band"]).where(fits)
                met = met.select("node", F.col("node2").alias(c), F.col("share2").alias(f"{c}_share"), F.lit(None).cast("long").alias(none), F.lit(None).cast("int").alias(f"{none}_share"))
                named = named.unionByName(met)
        best = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.negative(f"{c}_share").alias("s"), F.xxhash64(c).alias("r"), F.col(c).alias("x")))).alias(c) for c in ("lead", "up")]
        met = named.groupBy("node").agg(*best).select("node", F.explode(F.array("lead.x", "up.x")).alias("other")).where("other is not null")
        return met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()

    def with_roots(self, signatures: DataFrame, roots: DataFrame | None) -> DataFrame:
        """signatures with their nodes' components; only rows of nodes that may have links are shuffled."""
        rows = signatures.select("sig", "salt", "node", "n")
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        some = among(rows, roots, key="node").join(roots.hint("merge"), "node", "left").select("sig", "salt", "node", "n", F.coalesce("root", "node").alias("root"))
        return some.unionByName(among(rows, roots, "left_anti", key="node").withColumn("root", F.col("node")))

    def with_all(self, signatures: DataFrame, roots: DataFrame | None) -> DataFrame:
        """All pairs that are still apart: those of small signatures one by one, those of crowded ones by tiles."""
        now = self.with_roots(signatures, roots)
        rare = now.where("salt < 2").select("sig", "node", "n", "root").repartition("sig").sortWithinPartitions("sig")
        finish = self.scratch.put(rare.mapInArrow(_finish(self.near), "kind int, sig long, a long, b long, n int"), "finish")
        # signatures in several parts: their roots first, then the rows of those that hold several components
        common = now.where("salt > 1")
        apart = common.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
        apart = self.scratch.put(apart, "apart")
        many = finish.where("kind = 1").select("sig", F.col("a").alias("node"), "n", F.col("b").alias("root"))
        many = self.scratch.put(many.unionByName(common.join(apart, "sig").select("sig", "node", "n", "root")), "crowded")
        pairs = finish.where("kind = 0").select("a", "b")
        return pairs.unionByName(self.tiled(many)).distinct() if not many.isEmpty() else pairs.distinct()

    def tiled(self, many: DataFrame) -> DataFrame:
        """Pairs of a crowded signature whose bitmaps leave room for a link.

        A signature's bands are cut into blocks of about TILE nodes; two blocks of one band, or of
        neighbouring bands, are a tile, and a task holds the bitmaps of one tile at a time. A
        signature of no more nodes than that is one tile.
        """
        bits = self.described(many.select("node").distinct(), "crowd-nodes").select("node", "bits")
        open_ = self.scratch.put(many.groupBy("sig").agg(F.count("*").alias("open")).where(F.col("open") > TILE), "open")
        many = many.withColumn("band", band("n"))
        sizes = self.scratch.put(many.join(open_, "sig").groupBy("sig", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), "blocks")
        above = sizes.select("sig", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
        below = sizes.select("sig", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
        counts = self.scratch.put(sizes.join(above, ["sig", "band"], "left").join(below, ["sig", "band"], "left"), "counts")
        own = many.join(counts, ["sig", "band"], "left")
        own = own.withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))

        def tiles(count: str, low: Column, kind: int, i, j) -> Column:
            places = F.transform(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1), lambda x: F.struct(low.cast("int").alias("low"), F.lit(kind).alias("kind"), i(x).alias("i"), j(x).alias("j")))
            return F.when(F.col(count).isNotNull(), places).otherwise(F.slice(places, 1, 0))

        mine = F.col("block")
        alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(2).alias("kind"), mine.alias("i"), mine.alias("j")))
        every = F.concat(
            tiles("blocks", F.col("band"), 0, lambda x: F.least(mine, x), lambda x: F.greatest(mine, x)),
            tiles("above", F.col("band"), 1, lambda x: mine, lambda x: x),
            tiles("below", F.col("band") - 1, 1, lambda x: x, lambda x: mine),
        )
        dealt = own.withColumn("t", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(every))).select("sig", "node", "n", "root", "band", "block", "t.*")
        return dealt.join(bits, "node").groupBy("sig", "low", "kind", "i", "j").applyInPandas(_tile(self.near), "a long, b long")

    def classes(self, roots: DataFrame | None) -> DataFrame:
        members, root = self.members.drop("bits", "check"), F.col("node")
        if roots is not None:
            members, root = members.join(roots.hint("merge"), "node", "left"), F.coalesce("root", "node")
        rooted = members.select("doc_id", "h", "n", root.alias("root"))
        least = self.scratch.put(rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
        joined = rooted.join(least.hint("merge"), "root", "left")
        component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
        return joined.select("doc_id", "h", "n", "root", component.alias("component_id"))


def join_documents(docs: DataFrame, size: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach from each document."""
    return Join(docs, size, near).run().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_representatives(docs: DataFrame, size: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """One document of each group: the one with the smallest id (of its texts, if it has several in one group, one; of equal
    rows one). Rows without an id, and texts without words, stay."""
    scratch = Scratch(docs.sparkSession)
    inner, restored = shielded(docs)
    found = Join(docs, size, near).run().where("n > 0 and doc_id is not null")
    best = scratch.put(found.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("best")), "best")
    marked = found.join(best.hint("merge"), "root").select("doc_id", "h", (F.struct("doc_id", "h") == F.col("best")).alias("stays"))
    # of each (id, text): whether it stays, and whether several rows are alike
    verdict = marked.groupBy("doc_id", "h").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")
    verdict = scratch.put(verdict.select("doc_id", F.col("h").alias("_h"), F.col("doc_id").alias("_id"), "stays"), "verdict")
    some = among(inner, verdict)
    keys = (some["doc_id"].cast("long") == verdict["_id"]) & (F.xxhash64(some["text"]) == verdict["_h"])
    held = some.join(verdict.drop("doc_id").hint("merge"), keys, "left")
    alike = held.where("stays").dropDuplicates(["_id", "_h"])
    return restored(held.where("stays is null").unionByName(alike).select(inner.columns).unionByName(among(inner, verdict, "left_anti")))
