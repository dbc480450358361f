"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the 2-, 3- and 4-byte windows of its case-folded letters, every other byte
standing for a gap. Each hashes to a row of an embedding table; the rows are averaged and a softmax
layer reads the average. Both are trained by stochastic gradient descent in numpy, on cuts of CUTS
subwords of a bounded sample (SAMPLE) of the labelled rows, spread evenly over the languages. Because
the model is linear after the average, it is sent out as one small table of subword logits, whose
size does not depend on the data. At most LANGUAGES languages, the commonest, are told apart.

Rejection is calibrated on a part of the sample kept out of training. A temperature is fitted to its
log-likelihood. How strange a text is, is the mean log share of its subwords in the training texts, all
languages alike (so that a text in two of them is no stranger than in one), as a number of deviations
from the kept-out texts, whose spread shrinks with length. The bound lies between what all but REJECT
of the kept-out texts reach and what texts of each language reach when that language is left out of
training: nearer to the former, so that known languages stay. A text beyond it is rejected, and one
whose probability is no better than a guess among the languages.

Defined results: a null text, an empty one or one without letters is 'und' with score 0, and
rejected; without labelled rows every text is 'und'; equal rows give equal results; long texts are
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GAP, fold_case, lean, modest, shielded, text_chunks, trim

#: Labelled rows that the model is fitted to, at most about; languages, at most.
SAMPLE, LANGUAGES = 4_000, 400
BUCKET_BITS, WIDTH, RATE = 17, 16, 8.0
#: Passes over the sample: about STEPS rows in all, EPOCHS passes at least and LONGEST at most.
EPOCHS, LONGEST, STEPS = 8, 80, 60_000
#: Sizes of the cuts that are learned from, in subwords.
CUTS = (15, 400)
#: Share of the calibration texts that may fall short of a threshold; how far the bound lies towards strange texts; how much
#: better than a guess a probability must be.
REJECT, TOWARDS, GUESS = 0.001, 0.4, 0.1
#: Weight of subwords never seen, spread over all buckets; bytes that are scored at a time.
PRIOR, CHUNK = 1.0, 1 << 18
UNKNOWN = "und"


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords in order of position, and where each text's begin."""
    letters = np.where(_GAP[data] | ((data >= 48) & (data < 58)), np.uint8(32), fold_case(data) if len(data) else data).astype(np.uint64)
    n, found, at = len(letters), [], []
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for size in range(1, 5):
        if n < size:
            break
        key[: n - size + 1] = key[: n - size + 1] * np.uint64(257) + letters[size - 1 :] + np.uint64(1)
        if size == 1:
            continue
        here = np.flatnonzero((left >= size) & (letters != 32) | (left >= size) & (np.append(letters[1:], 32) != 32))
        found.append(((key[here] + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS))
        at.append(here)
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at, found = np.concatenate(at), np.concatenate(found).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return found[order], np.searchsorted(at[order], offsets)


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's entries."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = text_sums(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128), offsets) > 0
    for i in np.flatnonzero(~plain & (np.diff(offsets) > 0)):
        plain[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return plain


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket: its logits, divided by the temperature, then its log share in all languages
    bias: np.ndarray
    #: mean log share of texts, and its variance as a + b / subwords
    mean: float
    spread: tuple[float, float]
    least_score: float
    least_likeness: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language (-1: none), its probability, and whether it is rejected."""
        n, known = len(offsets) - 1, len(self.languages)
        if not known:
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        found, first = subwords(data, offsets)
        count = np.diff(first)
        means = text_sums(self.table[found], first) / np.maximum(count, 1)[:, None]
        scores = softmax(means[:, :known] + self.bias)
        none = ~has_letter(data, offsets)
        best = scores.argmax(1)
        score = np.where(none, 0.0, scores[np.arange(n), best])
        return np.where(none, -1, best), score, none | (score < self.least_score) | (self.likeness(means[:, known], count) < self.least_likeness)

    def likeness(self, share: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Deviations from the mean of texts of this size."""
        return (share - self.mean) / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(count, 1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and the buckets of two cuts of each text."""
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(2), CHUNK):
            found, first = subwords(data, offsets)
            out = {"key": [], "lang": [], "bucket": []}
            for k in range(j - i):
                own = found[first[k] : first[k + 1]]
                key = batch.column(0)[i + k].as_py()
                rng = np.random.default_rng((key or 0) % (1 << 32))
                for _ in range(2):
                    size = int(rng.integers(*CUTS))
                    at = int(rng.integers(0, max(1, len(own) - size)))
                    out["key"].append(key)
                    out["lang"].append(batch.column(1)[i + k].as_py())
                    out["bucket"].append(own[at : at + size].astype(np.int32))
            yield pa.RecordBatch.from_pydict(out, schema=_SAMPLED)


_SAMPLED = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("bucket", pa.list_(pa.int32()))])


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """Model of labelled's text and lang columns; doc_id only chooses the sample."""
    modest(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    sizes = {r["lang"]: r["count"] for r in sorted(common, key=lambda r: r["lang"])}
    if not sizes:
        return Model([], np.zeros((1, 0)), np.zeros(0), 0.0, (1.0, 0.0), 1.0, 0.0)
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample / len(sizes) / n) * (1 << 30)))))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))
    rows = labelled.where(chosen).select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(lean(_sampled), "key long, lang string, bucket array<int>")
    table = rows.toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in table["lang"].to_pylist()], int)
    bucket = table["bucket"].combine_chunks()
    first = np.asarray(bucket.offsets).astype(np.int64)
    model = train(languages, np.asarray(bucket.values)[first[0] :].copy(), first - first[0], y, seed)
    del table, bucket
    trim()
    return model


def train(languages: list[str], flat: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int) -> Model:
    """Model of cuts (two of a text side by side): flat[first[k]:first[k + 1]] of language y[k]."""
    rng = np.random.default_rng(seed)
    buckets, n_lang, size = 1 << BUCKET_BITS, len(languages), np.diff(first)
    embed = rng.normal(0, 0.1, (buckets, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (WIDTH, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32)
    keep_out = (np.arange(len(y)) // 2) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    learned = np.flatnonzero(~keep_out & (size > 0))
    epochs = max(EPOCHS, min(LONGEST, STEPS // max(1, len(learned))))
    steps, done = epochs * max(1, -(-len(learned) // 64)), 0
    for _ in range(epochs):
        rng.shuffle(learned)
        for at in range(0, len(learned), 64):
            which = learned[at : at + 64]
            rate = RATE * max(0.05, 1 - done / steps)
            done += 1
            own = np.concatenate([flat[first[k] : first[k + 1]] for k in which])
            n = size[which]
            starts, owner = np.cumsum(n) - n, np.repeat(np.arange(len(which)), n)
            mean = np.add.reduceat(embed[own], starts) / n[:, None]
            g = softmax(mean @ out + bias)
            g[np.arange(len(which)), y[which]] -= 1
            g /= len(which)
            back = (g @ out.T / n[:, None]).astype(np.float32)
            out -= (0.1 * rate * (mean.T @ g)).astype(np.float32)
            bias -= (0.01 * rate * g.sum(0)).astype(np.float32)
            order = np.argsort(own, kind="stable")
            used, cut = np.unique(own[order], return_index=True)
            embed[used] -= rate * WIDTH * np.add.reduceat(back[owner[order]], cut)
    logits = (embed @ out).astype(np.float64)

    held = np.flatnonzero((keep_out if keep_out.any() else ~keep_out) & (size > 0))
    counts = np.zeros((buckets, n_lang))
    for lang in range(n_lang):
        own = [flat[first[k] : first[k + 1]] for k in learned[y[learned] == lang]]
        counts[:, lang] = np.bincount(np.concatenate(own), minlength=buckets) if own else 0
    shares = (counts + PRIOR / buckets) / (counts.sum(0) + PRIOR)
    seen = np.log(shares.mean(1))
    model = Model(languages, np.column_stack([logits, seen]).astype(np.float32), bias, 0.0, (1.0, 1.0), 0.0, -np.inf)
    if not len(held):
        return model
    mean_of = lambda values, which: np.stack([values[flat[first[k] : first[k + 1]]].mean(0) for k in which])
    scores, like, truth, n = mean_of(logits, held) + bias, mean_of(seen, held), y[held], size[held]
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    model.table[:, :n_lang] /= temperature
    model.bias = bias / temperature
    model.mean = float(np.median(like))
    # the variance of short and of long cuts gives both parts of the spread
    off, short = (like - model.mean) ** 2, n <= np.median(n)
    a, b = (1 / max(1.0, n[x].mean()) if x.any() else 0.0 for x in (~short, short))
    high, low = (float(off[x].mean()) if x.any() else float(off.mean()) for x in (short, ~short))
    slope = max((high - low) / max(b - a, 1e-6), 0.1)
    model.spread = max(low - slope * a, 0.05), slope
    model.least_score = min(0.8 * float(np.quantile(softmax(scores / temperature).max(1), REJECT)), (1 + GUESS) / n_lang)
    floor = float(np.quantile(model.likeness(like, n), REJECT))
    # each language left out in turn: how its texts look to the shares of the others
    strange = []
    for lang in range(n_lang) if n_lang > 1 else ():
        own = held[truth == lang]
        if len(own):
            strange.append(model.likeness(mean_of(np.log(np.delete(shares, lang, 1).mean(1)), own), size[own]))
    top = float(np.quantile(np.concatenate(strange), 0.9)) if strange else floor
    model.least_likeness = floor - max(TOWARDS * (floor - top), 1.0)
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, lang_score and rejected of every text."""
    modest(docs.sparkSession)
    if clash := {*keep} & {"lang_pred", "lang_score", "rejected"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for i, j, data, offsets in text_chunks(column, CHUNK):
                best, score, rejected = model.predict(data, offsets)
                own = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*(f"_k{k}" for k in range(len(keep))), "_lang", "_score", "_rejected"])

    kinds = ", ".join(f"_k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = docs.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)), F.col("text").alias("_text")).mapInArrow(lean(run), f"{kinds}, _lang string, _score double, _rejected boolean")
    return out.toDF(*keep, "lang_pred", "lang_score", "rejected")


def language_filter(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is not rejected, with their columns."""
    inner, restored = shielded(docs)
    return restored(predict(inner, model, tuple(inner.columns)).where(~F.col("rejected")))
