"""Quality by a generalised additive model with pairwise interactions.

FEATURES are measured on every whole text in numpy, from bytes and word hashes. Each is cut into
bins at quantiles. Cyclic boosting goes round the features, fitting to the logistic loss at each
turn one shallow tree (two levels) over that feature's bins alone, and adds a share of it to the
feature's lookup table; the pairs of features whose coarse grid explains most of what remains are
then boosted in the same way. A score is a sum of table entries, looked up for all texts at once.

The model is fitted to a bounded sample (SAMPLE) of the labelled rows; it is sent out as tables
whose size does not depend on the data.

Defined results: a null text is scored as the empty one, whose features are zeros; labels that are
null are not learned from, and of several labels of one id the largest counts; without labels every
score is 0.5; equal rows give equal results; long texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, lean, modest, spread_sample, text_chunks

#: Labelled rows that the model is fitted to, at most about.
SAMPLE = 12_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 120, 60, 6, 0.15
FEATURES = ["log_words", "word_length", "upper_share", "symbol_share", "bar_share", "digit_share", "exclaim_share", "equal_neighbours", "distinct_share", "top_word_share", "stops_per_word", "lines_per_word", "repeated_trigrams", "symbol_ends"]


def _class(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


_UPPER, _LOWER, _DIGIT = _class(*range(65, 91)), _class(*range(97, 123)), _class(*range(48, 58))
_SYMBOL = _class(*b'"#$%&*+/<=>@[\\]^_`{|}~')
_STOP, _LINE, _EXCLAIM, _BAR = _class(*b".,;:?"), _class(10), _class(33), _class(124)


def _runs(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many distinct keys, and how often the commonest occurs."""
    distinct, most = np.zeros(texts), np.zeros(texts)
    if len(keys):
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))
        at = np.flatnonzero(new)
        np.add.at(distinct, o[at], 1)
        np.maximum.at(most, o[at], np.diff(np.append(at, len(k))))
    return distinct, most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text."""
    words, texts = Words(data, offsets, lower=False), len(offsets) - 1

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    n = np.diff(words.first).astype(float)
    safe, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(texts), np.diff(words.first))
    upper, lower = count(_UPPER), count(_LOWER)
    same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    equal = np.bincount(owner[1:][same], minlength=texts) if len(same) else np.zeros(texts)
    distinct, most = _runs(words.hashes, owner, texts)
    triples = grams(words.hashes, 3)
    inside = owner[: len(triples)] == owner[2:] if len(triples) else np.zeros(0, bool)
    distinct3, _ = _runs(triples[inside], owner[: len(triples)][inside], texts)
    n3 = np.maximum(n - 2, 0)
    ends = np.bincount(owner, weights=_SYMBOL[data[words.ends - 1]].astype(float), minlength=texts) if len(owner) else np.zeros(texts)
    length = np.bincount(owner, weights=(words.ends - words.starts).astype(float), minlength=texts) if len(owner) else np.zeros(texts)
    return np.stack([
        np.log1p(n), length / safe, upper / np.maximum(upper + lower, 1), count(_SYMBOL) / size, count(_BAR) / size,
        count(_DIGIT) / size, count(_EXCLAIM) / size, equal / np.maximum(n - 1, 1), distinct / safe, most / safe,
        count(_STOP) / safe, count(_LINE) / safe, 1 - distinct3 / np.maximum(n3, 1) * (n3 > 0) - (n3 == 0), ends / safe,
    ], axis=1)


def _split(grad: np.ndarray, hess: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best cut of bins low..high by gain; 0 if none helps."""
    g, h = grad[low:high].cumsum(), hess[low:high].cumsum()
    if high - low < 2:
        return 0.0, 0
    left_g, left_h = g[:-1], h[:-1]
    gain = left_g**2 / (left_h + 1) + (g[-1] - left_g) ** 2 / (h[-1] - left_h + 1) - g[-1] ** 2 / (h[-1] + 1)
    gain[(left_h < 0.5) | (h[-1] - left_h < 0.5)] = 0
    k = int(gain.argmax())
    return float(gain[k]), low + k + 1


def tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Step of each bin by a tree of two levels."""
    step, n = np.zeros(len(grad)), len(grad)
    _, cut = _split(grad, hess, 0, n)
    for low, high in ((0, cut), (cut, n)) if cut else ((0, n),):
        _, at = _split(grad, hess, low, high)
        for a, b in ((low, at), (at, high)) if at else ((low, high),):
            step[a:b] = -grad[a:b].sum() / (hess[a:b].sum() + 1)
    return step


def pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """As tree, over a grid: one cut of the first feature and one of the second on either side."""
    best, step = 0.0, np.zeros_like(grad)
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    for cut in range(1, grad.shape[0]):
        gain, leaves = -whole, []
        for rows in (slice(0, cut), slice(cut, None)):
            g, h = grad[rows].sum(0), hess[rows].sum(0)
            _, at = _split(g, h, 0, len(g))
            for columns in (slice(0, at), slice(at, None)) if at else (slice(None),):
                gain += g[columns].sum() ** 2 / (h[columns].sum() + 1)
                leaves.append((rows, columns))
        if gain > best:
            best, step = gain, np.zeros_like(grad)
            for rows, columns in leaves:
                step[rows, columns] = -grad[rows, columns].sum() / (hess[rows, columns].sum() + 1)
    return step, best


@dataclass
class Additive:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # bin to coarse bin
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[b[j]]
            for i, j, t in self.pairs:
                total += t[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    if not len(y):
        return Additive(0.0, [], [], [], [])
    rate = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model = Additive(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], [np.arange(len(e) + 1) * COARSE // (len(e) + 1) for e in edges], [])
    if y.min() == y.max():
        return model
    bins, margin = model.bins(x), np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            grad, hess = slopes()
            step = RATE * tree(np.bincount(bins[j], grad, len(table)), np.bincount(bins[j], hess, len(table)))
            table += step
            margin += step[bins[j]]
    cells = [model.coarse[j][b] for j, b in enumerate(bins)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = slopes()
        at = cells[i] * COARSE + cells[j]
        return tuple(np.bincount(at, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (grad, hess))

    gains = sorted(((pair_tree(*grid(i, j))[1], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * pair_tree(*grid(i, j))[0]
            table += step
            margin += step[cells[i], cells[j]]
    return model


def measured(docs: DataFrame, keep: tuple[str, ...], columns: str, finish) -> DataFrame:
    """The kept columns and what finish makes of each run of texts' (bytes, offsets)."""
    modest(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                own = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                made = finish(data, offsets)
                yield pa.RecordBatch.from_arrays([*own, *made.values()], names=[*(f"_k{k}" for k in range(len(keep))), *made])

    kinds = ", ".join(f"_k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = docs.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)), F.col("text").alias("_text")).mapInArrow(lean(run), f"{kinds}, {columns}")
    return out.toDF(*keep, *out.columns[len(keep) :])


def sample_labels(labels: DataFrame, target: str, sample: int, seed: int) -> DataFrame:
    """(doc_id, target) of about sample labelled ids: few enough to broadcast."""
    labels = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max(target).cast("int").alias(target))
    return labels.where(spread_sample(labels, F.col("doc_id"), sample, seed))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, seed: int = 11) -> Additive:
    chosen = sample_labels(labels, target, sample, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def finish(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        x = features(data, offsets)
        return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}

    table = measured(rows, ("doc_id", target), "x array<double>", finish).toArrow().sort_by("doc_id")
    x = np.array(table["x"].to_pylist(), float).reshape(len(table), len(FEATURES))
    return fit_additive(x, np.array(table[target], float))


def score(docs: DataFrame, model: Additive, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    if "score" in keep:
        raise ValueError("columns of the result: ['score']")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return measured(docs, keep, "score double", lambda data, offsets: {"score": pa.array(shared.value.score(features(data, offsets)))})
