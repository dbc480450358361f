"""Removal of repeated passages: windows of WINDOW words that also start in a document with a smaller id.

1. Confirm. Each text's word grams (GRAM words) are winnowed: of any REACH consecutive grams the one
   with the least hash is an anchor, so that every window of WINDOW words holds an anchor, and equal
   windows hold the same one. An anchor that occurs in two texts or more is a recurring phrase; its
   words are read from one of these texts into a table of phrases.
2. Locate. Documents are dealt to shards of about SHARD texts. Each shard's phrases - those that any
   of its documents' anchors name - are compiled from the table into an Aho-Corasick automaton
   (pyahocorasick, over 31-bit word symbols), and every document of the shard is streamed through it.
   Where the automaton finds a phrase, and there alone, a phrase occurs; a document none of whose
   anchors recurs could not meet a phrase at an anchor, and is not sent. So the automata grow with
   the number of shards, each bounded by its documents, and not with documents times phrases.
3. Judge. The windows of one anchor's occurrence are an extent. An extent (its words, as two
   independent 64-bit hashes) that also occurs in a document with a smaller id is owned as a whole.
   Where an anchor has extents that differ - at the edges of a passage, or round a changed word -
   the windows of each extent's first occurrence are compared one by one in the same way. A window
   whose owner is smaller than its document covers its words.

Equal texts are handled as one for all this: the copy with the smallest id represents them, and every
window of another copy is owned by it. Owners are found by a pre-aggregating minimum, so a passage
that a third of all documents share is combined before it is shuffled; the join back to such a
passage is one that Spark can split.

Defined results: a null text has no words, nothing removed, and an empty rest; of rows with one id
each is judged on its own, and a window owned by the same id is not removed (dedup_documents leaves
such rows too, each reduced in the same way); an empty table gives an empty result; other columns are ignored (or kept, in dedup_documents). Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, _power_tables, among, grams, lean, mix, shielded, text_chunks, trim, word_chunks

WINDOW = 50
GRAM = 17
#: Grams in a window; winnowing takes one of any so many.
REACH = WINDOW - GRAM + 1
#: Texts of a shard, about.
SHARD = 1_500


def winnow(hashes: np.ndarray, first: np.ndarray, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes; the places of windows (reach grams) that lie inside one text; each one's anchor's place."""
    g = grams(hashes, gram)
    n = len(g) - reach + 1
    if n <= 0:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, reach):  # the first of equal minima
        less = g[k : k + n] < best
        np.copyto(best, g[k : k + n], where=less)
        np.copyto(at, k, where=less)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    place = np.flatnonzero(ends - np.arange(n) >= gram + reach - 1)
    return g, place, place + at[place]


def emit_anchors(window: int, gram: int):
    """(anchor, h, place) of every text; of equal texts near one another, of one."""
    schema = pa.schema([("anchor", pa.int64()), ("h", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            seen = seen if len(seen) < 100_000 else set()
            batch = batch.filter(pa.array([not (h in seen or seen.add(h)) for h in batch.column(0).to_pylist()], pa.bool_()))
            for i, _, words in word_chunks(batch.column(1), lower=False):
                g, _, anchor = winnow(words.hashes, words.first, gram, window - gram + 1)
                chosen = np.unique(anchor)
                if len(chosen):
                    text = np.searchsorted(words.first, chosen, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(g[chosen].view(np.int64)), batch.column(0).take(pa.array(i + text)), pa.array((chosen - words.first[text]).astype(np.int32))], schema=schema)

    return lean(run)


def symbols(words: Words) -> np.ndarray:
    """The automata's letters: 31 bits of each word's hash."""
    return (words.hashes >> np.uint64(33)).astype(np.int32)


def emit_phrases(gram: int):
    """(anchor, phrase) of the anchors that a text is to give: their words as symbols."""
    schema = pa.schema([("anchor", pa.int64()), ("phrase", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(0), lower=False):
                letters, anchors, phrases = symbols(words), [], []
                for k in range(i, j):
                    own = batch.column(1)[k].values
                    at = np.asarray(own.field("place")) + words.first[k - i]
                    anchors.append(np.asarray(own.field("anchor")))
                    phrases.append(letters[at[:, None] + np.arange(gram)])
                flat = np.concatenate(phrases)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * gram), pa.array(flat.ravel()))], schema=schema)

    return lean(run)


def automaton(phrases: np.ndarray) -> ahocorasick.Automaton:
    """Of phrases as rows of symbols."""
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases.tolist():
        found.add_word(tuple(phrase))
    found.make_automaton()
    return found


def locate(words: Words, machine: ahocorasick.Automaton, gram: int) -> np.ndarray:
    """Whether a phrase of the automaton begins at each word."""
    hit, letters = np.zeros(len(words.hashes), bool), symbols(words)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= gram:
            ends = np.fromiter((end for end, _ in machine.iter(tuple(letters[a:b].tolist()))), np.int64)
            hit[a + ends - gram + 1] = True
    return hit


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run hashes[start:end], by prefix sums."""
    power, inverse = _power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * power[: len(hashes)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


EXTENTS = "g long, e1 long, e2 long, doc_id long, h long, start int, windows int, k1 array<long>, k2 array<long>"


def emit_extents(window: int, gram: int):
    """Of a shard's documents and phrases: the extents of every phrase found at an anchor."""
    long = pa.int64()
    schema = pa.schema([("g", long), ("e1", long), ("e2", long), ("doc_id", long), ("h", long), ("start", pa.int32()), ("windows", pa.int32()), ("k1", pa.list_(long)), ("k2", pa.list_(long))])

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        found = []
        if len(docs) and len(phrases):
            machine = automaton(np.asarray(phrases["phrase"].combine_chunks().flatten()).reshape(-1, gram))
            ids, keys = (docs[c].combine_chunks() for c in ("doc_id", "h"))
            for i, _, words in word_chunks(docs["text"].combine_chunks(), lower=False):
                g, place, anchor = winnow(words.hashes, words.first, gram, window - gram + 1)
                keep = locate(words, machine, gram)[anchor]
                place, anchor = place[keep], anchor[keep]
                if not len(place):
                    continue
                owner = np.searchsorted(words.first, place, "right") - 1
                cut = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(place) != 1)))
                bounds = np.append(cut, len(place))
                start, count = place[cut], np.diff(bounds)
                text = pa.array(i + owner[cut])
                extent = (span_hashes(words.hashes, start, start + count - 1 + window, seed).view(np.int64) for seed in (3, 4))
                one, two = (pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(span_hashes(words.hashes, place, place + window, seed).view(np.int64))) for seed in (1, 2))
                found.append(pa.RecordBatch.from_arrays([pa.array(g[anchor[cut]].view(np.int64)), *map(pa.array, extent), ids.take(text), keys.take(text), pa.array((start - words.first[owner[cut]]).astype(np.int32)), pa.array(count.astype(np.int32)), one, two], schema=schema))
            del machine
            trim()
        return pa.Table.from_batches(found, schema=schema)

    return run


def second_hash(text: Column) -> Column:
    """A second hash, so that texts are taken for equal by 128 bits."""
    return F.shiftleft(F.hash(text).cast("long"), 32).bitwiseXOR(F.octet_length(text).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text; rows with one id and one key are alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def verdicts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, h, whole (every word goes, if there are window words) and starts (of owned windows), where anything goes."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keys = ["h", "h2"]
    twin = rows.select("doc_id", "h", second_hash(F.col("text")).alias("h2"))
    groups = scratch.put(twin.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "groups")
    copies = twin.join(groups.where("rep < last"), keys).where("doc_id > rep").select("doc_id", "h")
    copies = scratch.put(copies.distinct(), "copies")

    # confirm: anchors of several texts, and the words of each
    marks = scratch.put(rows.select("h", "text").mapInArrow(emit_anchors(window, gram), "anchor long, h long, place int"), "marks")
    recurring = marks.groupBy("anchor").agg(F.min(F.struct("h", "place")).alias("a"), F.max("h").alias("b")).where("a.h <> b")
    recurring = scratch.put(recurring.select("anchor", "a.h", "a.place"), "recurring")
    shards = F.lit(max(1, -(-groups.count() // SHARD)))
    own = scratch.put(marks.select("anchor", "h").join(recurring.select("anchor"), "anchor").distinct(), "own")
    scratch.drop("marks")
    reps = groups.select("h", F.col("rep").alias("doc_id"))
    givers = recurring.groupBy("h").agg(F.collect_list(F.struct("anchor", "place")).alias("own")).join(reps, "h")
    givers = scratch.put(givers, "givers")
    given = among(rows, givers).join(givers.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    phrases = scratch.put(given.select("text", "own").mapInArrow(emit_phrases(gram), "anchor long, phrase array<int>"), "phrases")

    # locate: each shard's documents through the automaton of its phrases
    shard = F.pmod(F.xxhash64("h"), shards).alias("shard")
    named = own.select(shard, "anchor").distinct().join(phrases, "anchor").select("shard", "phrase")
    holders = scratch.put(own.select("h").distinct().join(reps, "h"), "holders")
    met = among(rows, holders).join(holders.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select(shard, "doc_id", "h", "text")
    extents = met.groupBy("shard").cogroup(named.groupBy("shard")).applyInArrow(emit_extents(window, gram), EXTENTS)
    extents = scratch.put(extents, "extents")
    scratch.drop("own", "givers", "phrases", "holders", "recurring", "groups")

    # whole extents: all windows of an anchor's occurrence at once; equal extents are one row here
    extent = ["e1", "e2"]
    firsts = extents.groupBy(*extent).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min("g").alias("g"))
    firsts = scratch.put(firsts, "firsts")
    repeated = scratch.put(firsts.where("owner < last").select(*extent, "owner"), "repeated")
    again = extents.select(*extent, "doc_id", "h", "start", "windows").join(repeated, extent).where("owner < doc_id")
    # single windows: only of anchors with more than one extent, and of each extent only where it comes first
    mixed = firsts.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g")
    chosen = scratch.put(firsts.join(mixed, "g").select(*extent, "owner"), "chosen")
    single = extents.join(chosen, extent).where("owner = doc_id")
    single = single.select("doc_id", "h", "start", F.posexplode(F.arrays_zip("k1", "k2")).alias("at", "k"))
    single = scratch.put(single.select("doc_id", "h", (F.col("start") + F.col("at")).alias("start"), "k.k1", "k.k2"), "windows")
    owners = single.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    owned = single.join(owners, ["k1", "k2"]).where("owner < doc_id").select("doc_id", "h", "start", F.lit(1).alias("windows"))

    runs = again.select("doc_id", "h", "start", "windows").unionByName(owned)
    found = runs.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "windows"))).alias("runs"))
    found = found.select("doc_id", "h", F.lit(False).alias("whole"), F.col("runs.start").alias("starts"), F.col("runs.windows").alias("windows"))
    none = F.array().cast("array<int>")
    found = found.unionByName(copies.select("doc_id", "h", F.lit(True).alias("whole"), none.alias("starts"), none.alias("windows")))
    return scratch.only(found, "verdicts")


def with_verdicts(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those docs that may have a verdict, with _id, _whole, _starts, _windows; and the others, which are not shuffled."""
    side = found.withColumnsRenamed({"doc_id": "_id", "h": "_h", "whole": "_whole", "starts": "_starts", "windows": "_windows"})
    some = among(docs, found)
    some = some.join(side.hint("merge"), (some["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(some["text"]) == F.col("_h")), "left").drop("_h")
    return some, among(docs, found, "left_anti")


def kept_words(text: bytes, whole: bool | None, starts: np.ndarray | None, windows: np.ndarray | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that stay: those outside the given runs of windows."""
    words = text.split()
    if whole and len(words) >= window:
        return len(words), []
    if starts is None or not len(starts):
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + windows - 1 + window, -1)
    stay = np.cumsum(gone[:-1]) == 0
    return len(words), [w for w, s in zip(words, stay, strict=True) if s]


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what stays of every text."""
    found = verdicts(docs, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, whole, starts, windows = batch.columns
            for i, j, data, offsets in text_chunks(texts):
                n, left, sha = [], [], []
                for k in range(j - i):
                    of, sizes = starts[i + k], windows[i + k]
                    count, stay = kept_words(data[offsets[k] : offsets[k + 1]].tobytes(), whole[i + k].as_py(), *((np.asarray(x.values) if x.is_valid else None) for x in (of, sizes)), window)
                    n.append(count)
                    left.append(count - len(stay))
                    sha.append(hashlib.sha256(b" ".join(stay)).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    some, others = with_verdicts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), found)
    rows = some.unionByName(others, allowMissingColumns=True)
    return rows.select("doc_id", "text", "_whole", "_starts", "_windows").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text reduced to the words that stay; documents that lose all their words go."""
    found = verdicts(docs, window)
    inner, restored = shielded(docs)

    @F.pandas_udf("string")
    @lean
    def rest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text, all_gone, at, size in zip(*batch, strict=True):
                if text is None or (not all_gone and at is None):
                    out.append(text)
                else:
                    out.append(b" ".join(kept_words(text.encode(), bool(all_gone), at, size, window)[1]).decode())
            yield pd.Series(out, dtype=object)

    some, others = with_verdicts(inner, found)
    # told to be nondeterministic, else Spark evaluates it once for the filter and once for the text, in two workers side by side
    some = some.withColumn("_rest", rest.asNondeterministic()("text", F.coalesce("_whole", F.lit(False)), "_starts", "_windows"))
    lost = F.col("_id").isNotNull() & (F.col("_rest") == "")
    some = some.where(~F.coalesce(lost, F.lit(False))).withColumn("text", F.col("_rest"))
    return restored(some.select(inner.columns).unionByName(others))
