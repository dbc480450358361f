"""Benchmark decontamination: every passage of every document queries a BM25 index of test items.

The inverted index holds the items' terms. An impact is a term's BM25 weight in an item over the
item's score against itself, so that one threshold serves all items: a passage retrieves every item
of whose self-score it reaches THRESHOLD. Postings are cut into blocks that know their largest
impact, and retrieval is block-max WAND: cursors sorted by item, a pivot where the terms' largest
impacts reach the threshold, block maxima to skip, full scores only for what is left.

A text's passages are windows of twice the longest item, half overlapping, so that an item that
stands whole in a text stands whole in a passage. Before WAND a passage is held against the sum of
its terms' largest impacts in each group of items of like length, for all passages at once; below
the threshold it cannot retrieve anything of that group, so nothing is lost. What is retrieved is verified: the item's question (all but its last
sentence) and answer (the last) must each share at least OVERLAP of their word trigrams with the
passage (short parts: their words in sequence).

The index goes to every executor only in blocks of about BLOCK_ITEMS items and BLOCK_WORDS words at
most; more items make more blocks, dealt by hash, each of which all documents are held against. Their number, mean and
largest length and their terms' frequencies are taken over all items first, so that scores and
passages do not depend on the blocks.

Defined results: null and empty texts hold nothing; items that are null or have no words cannot
leak; repeated items are each reported; equal rows give equal results; an empty table of documents
or items gives an empty result; other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grams, lean, modest, shielded, without, word_chunks, word_hash

THRESHOLD, OVERLAP = 0.7, 0.6
K1, B = 1.2, 0.75
#: Groups of items of like length; each has bounds and postings of its own.
GROUPS = 32
#: Leading bits of the table that a word's hash is looked up in first.
BITS = 18
POSTINGS_BLOCK, BLOCK_ITEMS, BLOCK_WORDS = 32, 20_000, 500_000


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()]


def parts_of(text: str) -> list[list[str]]:
    """Words of the question and of the answer: all sentences but the last, and the last."""
    sentences = [w for s in re.split(r"(?<=[.?!])\s+", text) if (w := words_of(s))]
    if len(sentences) < 2:
        return [w for w in sentences]
    return [[w for s in sentences[:-1] for w in s], sentences[-1]]


def hashed(words: list[str]) -> np.ndarray:
    return np.array([word_hash(w) for w in words], np.uint64)


def part_grams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(grams(hashes, min(3, max(1, len(hashes)))))


@dataclass
class Statistics:
    """Of all items that have words."""

    n: int
    mean: float
    longest: int
    #: of each term: in how many items
    df: dict[int, int]

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        return cls(len(docs), sum(map(len, docs)) / len(docs), max(map(len, docs)), Counter(int(h) for d in docs for h in np.unique(d)))


@dataclass
class Index:
    items: list[int] = field(default_factory=list)
    #: of each item: (trigram size, hashes) of its parts
    parts: list[list[tuple[int, np.ndarray]]] = field(default_factory=list)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: of each group of items, of each of its terms: items and impacts, and blocks' last items and largest impacts
    postings: list[dict[int, tuple[list[int], list[float], list[int], list[float]]]] = field(default_factory=list)
    #: of each term and group
    largest: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    longest: int = 1
    #: whether any term's hash begins with these bits
    hint: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, bool))

    @classmethod
    def build(cls, rows: list[tuple[int, str]], whole: Statistics | None = None) -> Index:
        """whole: statistics of all items, where rows are a block of them."""
        rows = [(i, t) for i, t in rows if words_of(t)]
        index = cls(items=[i for i, _ in rows])
        docs = [hashed(words_of(t)) for _, t in rows]
        if not docs:
            return index
        whole = whole or Statistics.of(docs)
        mean, index.longest = whole.mean, whole.longest
        index.terms = np.unique(np.concatenate(docs))
        idf = {h: float(np.log(1 + (whole.n - whole.df[h] + 0.5) / (whole.df[h] + 0.5))) for h in index.terms.tolist()}
        index.hint[(index.terms >> np.uint64(64 - BITS)).astype(np.int64)] = True
        number = {int(h): k for k, h in enumerate(index.terms)}
        groups = min(GROUPS, len(docs))
        index.largest = np.zeros((len(index.terms), groups), np.float32)
        lists: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(groups)]
        group = [0] * len(docs)
        for place, k in enumerate(sorted(range(len(docs)), key=lambda k: len(docs[k]))):
            group[k] = place * groups // len(docs)
        for k, d in enumerate(docs):
            tf = Counter(map(int, d))
            weight = {h: idf[h] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(d) / mean)) for h, n in tf.items()}
            self_score = sum(weight.values())
            for h, w in weight.items():
                t = number[h]
                lists[group[k]][t].append((k, w / self_score))
                index.largest[t, group[k]] = max(index.largest[t, group[k]], w / self_score)
            index.parts.append([(min(3, len(p)), part_grams(hashed(p))) for p in parts_of(rows[k][1])])
        for own in lists:
            index.postings.append({})
            for t, entries in own.items():
                of, impact = map(list, zip(*entries, strict=True))
                cuts = range(0, len(of), POSTINGS_BLOCK)
                index.postings[-1][t] = (of, impact, [of[min(c + POSTINGS_BLOCK, len(of)) - 1] for c in cuts], [max(impact[c : c + POSTINGS_BLOCK]) for c in cuts])
        return index

    def retrieve(self, terms: list[int], group: int, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of the group's items whose impacts over the distinct terms reach the threshold."""
        postings = self.postings[group]
        most_of = {t: max(postings[t][3]) for t in terms if t in postings}
        cursors = [[postings[t][0][0], 0, t] for t in most_of]
        floor, found = threshold - 1e-9, []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += most_of[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, until = 0.0, None
            for _, _, t in cursors[: pivot + 1]:
                lasts, most = postings[t][2:]
                b = bisect.bisect_left(lasts, item)
                if b < len(lasts):
                    block += most[b]
                    until = lasts[b] if until is None else min(until, lasts[b])
            if block < floor:  # no item up to the end of these blocks can reach the threshold
                goal = (until if until is not None else item) + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                move = range(pivot + 1)
                goal = max(goal, item + 1)
            elif cursors[0][0] == item:
                move = range(pivot + 1)
                score = sum(postings[cursors[k][2]][1][cursors[k][1]] for k in move)
                if score >= floor:
                    found.append((item, score))
                goal = item + 1
            else:
                move, goal = (k for k in range(pivot + 1) if cursors[k][0] < item), item
            for k in list(move):
                of = postings[cursors[k][2]][0]
                at = bisect.bisect_left(of, goal, cursors[k][1])
                cursors[k] = [of[at], at, cursors[k][2]] if at < len(of) else None
            cursors = [c for c in cursors if c]
        return found

    def verify(self, passage: np.ndarray, item: int) -> list[float]:
        """Share of the question's and of the answer's word grams that the passage has."""
        cache = {size: grams(passage, size) for size in {s for s, _ in self.parts[item]}}
        return [float(np.isin(g, cache[size]).mean()) for size, g in self.parts[item]]

    def leaks(self, hashes: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question's overlap, answer's overlap), the best passage of each."""
        if not len(self.terms) or not len(hashes):
            return
        step = self.longest
        spans = np.diff(first)
        counts = np.maximum(1, -(-spans // step))  # of each text's blocks of step words; a passage is a block and the next
        text = np.repeat(np.arange(len(first) - 1), counts)
        begin = np.cumsum(counts) - counts
        start = first[:-1][text] + step * (np.arange(len(text)) - begin[text])
        table = np.uint64(64 - BITS)
        at = np.flatnonzero(self.hint[(hashes >> table).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        known = self.terms[place] == hashes[at]
        at, place = at[known], place[known]
        if not len(at):
            return
        owner = np.searchsorted(first, at, "right") - 1
        block = begin[owner] + (at - first[owner]) // step
        pairs = np.unique(block * len(self.terms) + place)  # a term counts once in a block
        block, place = pairs // len(self.terms), pairs % len(self.terms)
        cut = np.searchsorted(block, np.arange(len(text) + 1))
        total = np.zeros((len(place) + 1, self.largest.shape[1]), np.float32)
        np.cumsum(self.largest[place], axis=0, out=total[1:])
        last = np.append(text[1:] != text[:-1], True)
        to = np.where(last, np.arange(len(text)) + 1, np.minimum(np.arange(len(text)) + 2, len(text)))
        end = np.minimum(start + 2 * step, first[1:][text])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        slack = 1e-6 * len(place) + 1e-4  # of the sums' rounding
        for k, group in np.argwhere(total[cut[to]] - total[cut[:-1]] >= threshold - slack).tolist():
            terms = np.unique(place[cut[k] : cut[to[k]]])
            if self.largest[terms, group].sum() < threshold - 1e-4:
                continue
            for item, score in self.retrieve(terms.tolist(), group, threshold):
                shares = self.verify(hashes[start[k] : end[k]], item)
                if min(shares) >= overlap:
                    pair = (int(text[k]), self.items[item])
                    best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (score, shares[0], shares[-1]))
        for (t, item), found in best.items():
            yield t, item, *found


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item with words: its block, words and distinct terms."""
    for batch in batches:
        docs = [(k, hashed(words_of(t))) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        docs = [(k, len(d), np.unique(d).view(np.int64)) for k, d in docs if len(d)]
        yield pa.RecordBatch.from_pydict({"block": [k for k, _, _ in docs], "size": [n for _, n, _ in docs], "terms": [d for _, _, d in docs]}, schema=pa.schema([("block", pa.int32()), ("size", pa.int64()), ("terms", pa.list_(pa.int64()))]))


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """The items, in blocks that are small enough to send to every executor, each with the statistics of all for its terms."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, length = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-length // (4 * BLOCK_WORDS)))
    if blocks == 1:
        yield sorted(map(tuple, items.collect())), None
        return
    scratch = Scratch(benchmark.sparkSession)
    part = scratch.put(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "items")
    terms = scratch.put(part.select("block", "text").mapInArrow(_terms, "block int, size long, terms array<long>"), "terms")
    whole = terms.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    each = terms.select("block", F.explode("terms").alias("term")).groupBy("block", "term").agg(F.count("*").alias("n"))
    total = each.groupBy("term").agg(F.sum("n").alias("df"))
    df = scratch.put(each.select("block", "term").join(total, "term"), "frequencies")
    for k in range(blocks):
        own = df.where(F.col("block") == k).select("term", "df").toArrow()
        of = dict(zip(np.asarray(own["term"]).view(np.uint64).tolist(), own["df"].to_pylist(), strict=True))
        rows = sorted((r.item_id, r.text) for r in part.where(F.col("block") == k).collect())
        if not rows:
            continue
        yield rows, Statistics(whole[0], (whole[1] or 0) / max(1, whole[0]), whole[2] or 1, of)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    modest(docs.sparkSession)
    sc, found = docs.sparkSession.sparkContext, None
    for rows, whole in item_blocks(benchmark):
        shared = sc.broadcast(Index.build(rows, whole))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for i, _, words in word_chunks(batch.column(1), lower=True):
                    rows = [(batch.column(0)[i + t].as_py(), *rest) for t, *rest in index.leaks(words.hashes, words.first, threshold, overlap)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LEAKS, strict=True)], schema=_LEAKS)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), LEAKS)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    inner, restored = shielded(docs)
    gone = find_leaks(docs, benchmark).select("doc_id").distinct()
    return restored(without(inner, Scratch(docs.sparkSession).put(gone, "leaking")))
