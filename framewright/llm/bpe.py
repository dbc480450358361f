"""Byte-level BPE: encoding by a heap of merge ranks over a doubly linked symbol list, and decoding.

A word's symbols stand in a doubly linked list. A heap holds (rank, position) of every mergeable
neighbour pair; the best is taken, entries whose pair has changed since are skipped, and each merge
puts its two new neighbour pairs on the heap. A word of n bytes so costs O(n log n), however long.
Decoding concatenates the vocabulary strings of the ids.

Vocabulary and merges are read from a public tokenizer's JSON file, whose path is a parameter; every
worker reads it once. A file that asks for anything else than is built here is refused. Words met
before come from a cache of bounded size, which changes no result and is emptied when a task ends.

Defined results: a null text is encoded as the empty text (no ids, empty decoding); equal rows give
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, modest

#: The byte-level pre-tokenisation pattern, and Unicode's White_Space characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r \x85\xa0  -     　"
#: Entries of each half of a worker's cache, of 64 letters at most: a full half takes the place of the older one.
CACHE = 250_000
#: What a file may say of its steps; other keys are free.
PLAIN = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"}}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PLAIN_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def require(spec: dict) -> None:
    """Raise if the file asks for a step that is not built here."""

    def agree(have: dict | None, want: dict, where: str) -> None:
        for key, value in want.items():
            own = (have or {}).get(key)
            if isinstance(value, dict):
                agree(own, value, key)
            elif (own or None) != (value or None):
                raise ValueError(f"{where}: {key} = {own!r} is not implemented")

    agree(spec, PLAIN, "tokenizer")
    agree(spec["model"], PLAIN_MODEL, "model")
    for token in spec["added_tokens"]:
        agree(token, PLAIN_ADDED, "added token")


class ByteBPE:
    def __init__(self, spec: dict):
        require(spec)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.raw: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        #: Of bytes: their ids, where those are bytes too.
        self.translated = bytes(self.byte_id) if max(self.byte_id) < 256 else None
        #: Of a pair of ids, as one number: the rank of its merge; and by rank: the merged id.
        self.bits = max(vocab.values()).bit_length()
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << self.bits | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw |= {i: s.encode() for s, i in added.items()}
        self.added = added
        self.decimal = {i: str(i) for i in self.raw}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN.replace(r"\s", f"[{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]")).findall
        #: Coarser cuts at the same places: a run of non-space with the space before it, or white space.
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self._known: dict[str, tuple[str, int, bytes]] = {}
        self._older: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-tokenised piece. Heap entries are rank and position as one number; pair has the rank of each symbol's
        pair with the next one (-1: none), so an entry whose rank is no longer that of its position is stale."""
        rank, bits, merged = self.rank.get, self.bits, self.merged
        ids = list(piece.translate(self.translated)) if self.translated else [self.byte_id[b] for b in piece]
        n = len(ids)
        shift = n.bit_length()
        pair = [rank(a << bits | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        pair.append(-1)
        heap = [r << shift | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return ids
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        low = (1 << shift) - 1
        while heap:
            top = heappop(heap)
            i, r = top & low, top >> shift
            if pair[i] != r:
                continue
            j = after[i]
            new = ids[i] = merged[r]
            ids[j] = pair[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pair[i] = rank(new << bits | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                r = pair[p] = rank(ids[p] << bits | new, -1)
                if r >= 0:
                    heappush(heap, r << shift | p)
        return [x for x in ids if x >= 0]

    def _encode_chunk(self, chunk: str) -> tuple[str, int, bytes]:
        known = self._older.get(chunk)
        if known is None:
            # letters alone are one piece
            pieces = [chunk] if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha() else self.pieces(chunk)
            if len(pieces) == 1:
                ids = self.merge(chunk.encode())
                known = (",".join([self.decimal[i] for i in ids]), len(ids), self.decode_bytes(ids))
            else:
                ids, n, raw = zip(*[self._known.get(p) or self._encode_chunk(p) for p in pieces], strict=True)
                known = (",".join(ids), sum(n), b"".join(raw))
        if len(chunk) <= 64:
            if len(self._known) >= CACHE:
                self._older = dict(self._known)
                self._known.clear()
            self._known[chunk] = known
        return known

    def encoded(self, text: str) -> Iterator[tuple[str, int, bytes]]:
        """(decimal ids joined by commas, their number, bytes of their vocabulary strings) of the text's parts in order."""
        get, slow = self._known.get, self._encode_chunk
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                i = self.added[part]
                yield str(i), 1, self.raw[i]
            elif part:
                for chunk in self.chunks(part):
                    yield get(chunk) or slow(chunk)

    def forget(self) -> None:
        """Empty the cache."""
        self._known.clear()
        self._older = {}

    def encode(self, text: str) -> np.ndarray:
        decimal = ",".join([ids for ids, _, _ in self.encoded(text)])
        return np.fromstring(decimal, np.int32, sep=",") if decimal else np.zeros(0, np.int32)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    with open(path, encoding="utf-8") as f:
        return ByteBPE(json.load(f))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids, and round_trip (whether decoding gives the text back) of every text."""
    modest(docs.sparkSession)
    if clash := {*keep} & {"n_tokens", "ids", "round_trip"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                same = [bpe.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *made], names=[*keep, "n_tokens", "ids", "round_trip"])
        bpe.forget()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(lean(run), f"{kinds}n_tokens long, ids array<int>, round_trip boolean")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    modest(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                some = texts.slice(at, 256)
                count, of_ids, of_text = [], [], []
                for text in some.to_pylist():
                    ids, n, raw = zip(*bpe.encoded(text), strict=True) if text else ((), (), ())
                    count.append(sum(n))
                    of_ids.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                    of_text.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)], schema=DIGESTS)
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
