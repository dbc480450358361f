"""Language-model scores: a gated recurrent network with a class-factored softmax over exact counts.

Tokens are words (A-Z lower-cased), then one end for each text. Their counts are taken over every
training text, by a pre-aggregated sum whose result stays in a table that grows with the corpus;
log10((c + 1) / (N + V + 1)) of each token gives the base score. Words are known by 64-bit hashes.

The network (gated recurrent units) predicts the next token out of the commonest ones - one in EACH
of the V counted words, CLASSES x MEMBERS at least - and 'another word'. Its softmax is factored: the
class first, then the word within the class, so a token costs twice the root of that number. Classes are runs of equal size in the order of counts;
'another word' is a class by itself, and such a word's share of it is (c + 1) over the like sum of
all words outside, so the model gives every word a probability, seen or not, that sum to one.

It is trained in numpy by truncated backpropagation through windows of WINDOW tokens, with Adam and
the state carried from window to window, once on every training text: a hash deals the texts to shards
of about SHARD tokens (PER_WORD for each word of the output, if that is more), each shard is a pass
of its own from the same weights, in as many parallel streams (STREAMS at most) as leave it STEPS steps,
and the weights are merged, a shard counting by its tokens. The shards grow in number with the corpus,
and the weights are merged by the executors in parts of PART numbers. Biases start from the corpus counts. Scoring carries the state from a text's first token
to its end: texts of one batch are sorted by length and advance together, and each is scored whole.

A word's count is needed wherever it occurs. The FREQUENT commonest are sent to the executors (a
bounded table, or the output's words if they are more); the scored texts are written with the others that
occur in each, and these are joined to the table of counts by word, one row per word and text. What comes
of equal texts is added up and shared out among them.

Defined results: a null text is empty and has the end alone; rows with a null id are never held out;
equal rows get equal scores; without training texts every count is 0 and the network untrained; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered, lean, trim, word_chunks, word_hash

#: Classes and words of each, at least; counted words to one word of the output.
CLASSES, MEMBERS = 32, 32
EACH = 4_096
#: Tokens of a shard: so many, or so many for each word of the output. Weights merged by one task.
SHARD, PER_WORD, PART = 1 << 22, 512, 1 << 16
EMBED, HIDDEN, WINDOW, STREAMS, STEPS, RATE = 16, 24, 16, 512, 256, 4e-3
FREQUENT = 150_000
#: Steps from where a hash's leading bits point, before it is sought by halves.
NEAR = 3
#: Tokens that are counted together.
COUNTED = 1 << 21
#: Texts that advance together; texts that are sorted by length for it.
TOGETHER, SORTED = 2_048, 8_192
#: Tokens of these texts, as many steps as they make, whose words are looked up and whose probabilities are taken at once.
BLOCK = 16_384
END = np.uint64(word_hash("\x00 end of text"))
UNKNOWN = CLASSES * MEMBERS


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def output_size(words: int) -> int:
    """Words of the output for so many: a square, CLASSES x MEMBERS at least."""
    return max(UNKNOWN, (math.isqrt(max(words, 1) - 1) + 1) ** 2)


def log_total(x: np.ndarray) -> np.ndarray:
    """Log of each column's sum of exponentials; x is used up."""
    top = x.max(0)
    x -= top
    np.exp(x, out=x)
    return np.log(x.sum(0)) + top


def probabilities(x: np.ndarray) -> np.ndarray:
    """Softmax of each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def in_order(x: np.ndarray, most: int) -> np.ndarray:
    """Stable order of x, whole numbers up to most: by radix where they are short."""
    return np.argsort(x.astype(np.min_scalar_type(most)), kind="stable")


@dataclass
class Network:
    p: dict[str, np.ndarray]
    seen: int = 0  # tokens of one round of training

    @classmethod
    def new(cls, counts: np.ndarray, other: float, seed: int = 3) -> Network:
        """counts: of the words of the output, in order (0 beyond their number); other: of all other words."""
        rng = np.random.default_rng(seed)
        size, members = output_size(len(counts)), max(MEMBERS, math.isqrt(output_size(len(counts))))
        full = np.zeros(size)
        full[: len(counts)] = counts
        full += 0.5
        by_class = full.reshape(-1, members)
        classes = len(by_class)
        shares = np.append(by_class.sum(1), other + 0.5)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        return cls({
            "embed": rng.normal(0, 0.5, (size + 1, EMBED)).astype(np.float32),
            "inward": draw(EMBED, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32), "around": draw(HIDDEN, 3 * HIDDEN),
            "classes": 0.1 * draw(HIDDEN, classes + 1), "class_bias": np.log(shares / shares.sum()).astype(np.float32),
            "words": 0.1 * draw(classes, HIDDEN, members), "word_bias": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        })

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows for each word, and the weights that make drives of them; the last of both is for the bias."""
        p = self.p
        return np.append(p["embed"], np.ones((len(p["embed"]), 1), p["embed"].dtype), 1), np.vstack((p["inward"], p["bias"]))

    def step(self, drive: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state from the input's drive: update and reset gates, candidate, and state; one row for each stream."""
        return tuple(x.T for x in self.advance(drive.T, h.T, np.empty(h.T.shape, h.dtype)))

    def advance(self, drive: np.ndarray, h: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
        """step with one row for each unit, so that numpy runs along the streams; the next state goes to new."""
        around = self.p["around"].T @ h
        gates, a = around[: 2 * HIDDEN], around[2 * HIDDEN :]
        gates += drive[: 2 * HIDDEN]
        sigmoid(gates)
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        n = r * a
        n += drive[2 * HIDDEN :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= z
        new += n
        return z, r, n, a, new

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each target; their order by class, another word last; and where each class begins in it."""
        classes, members = self.p["word_bias"].shape
        group = np.minimum(target // members, classes)
        cut = np.append(0, np.cumsum(np.bincount(group, minlength=classes + 1)[:classes]))
        return group, in_order(group, classes), cut

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability given its state."""
        p, members = self.p, self.p["word_bias"].shape[1]
        group, order, cut = self.by_class(target)
        inside = order[: cut[-1]]
        out = p["classes"].T @ h.T
        out += p["class_bias"][:, None]
        log_p = out[group, np.arange(len(target))]
        log_p -= log_total(out)
        state = h.T.take(inside, 1)
        inner = np.empty((members, len(inside)), state.dtype)
        for k in np.flatnonzero(np.diff(cut)):
            own = inner[:, cut[k] : cut[k + 1]]
            np.matmul(p["words"][k].T, state[:, cut[k] : cut[k + 1]], out=own)
            own += p["word_bias"][k][:, None]
        log_p[inside] += inner[target[inside] % members, np.arange(len(inside))] - log_total(inner)
        return log_p

    def gradients(self, x: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean loss over one window (inputs and targets: steps x streams), the last state, and the loss."""
        p, steps, streams = self.p, *x.shape
        words, goal = x.ravel(), target.ravel()
        size, members = p["word_bias"].size, p["word_bias"].shape[1]
        table, weights = self.inputs()
        rows = table[words]
        drive = weights.T @ rows.reshape(steps, streams, -1).transpose(0, 2, 1)
        # one row for each unit and a last one of ones, for the biases; the states before and after each step
        states = np.ones((HIDDEN + 1, steps + 1, streams), h.dtype)
        states[:HIDDEN, 0] = h.T
        trace = [self.advance(drive[t], states[:HIDDEN, t], states[:HIDDEN, t + 1]) for t in range(steps)]
        before = states[:HIDDEN, :-1].reshape(HIDDEN, -1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        group, order, cut = self.by_class(goal)
        group, goal = group[order], goal[order]
        flat = states[:, 1:].reshape(HIDDEN + 1, -1).take(order, 1)
        d = probabilities(np.vstack((p["classes"], p["class_bias"])).T @ flat)
        at = group, np.arange(len(goal))
        loss = -np.log(d[at]).sum()
        d[at] -= 1
        both = flat @ d.T
        g["classes"], g["class_bias"] = both[:HIDDEN], both[HIDDEN]
        back = p["classes"] @ d
        inner = np.concatenate((p["words"], p["word_bias"][:, None]), 1)
        d = np.empty((members, cut[-1]), h.dtype)
        parts = [(k, slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut))]
        for k, own in parts:
            np.matmul(inner[k].T, flat[:, own], out=d[:, own])
        probabilities(d)
        at = goal[: cut[-1]] % members, np.arange(cut[-1])
        loss -= np.log(d[at]).sum()
        d[at] -= 1
        for k, own in parts:
            both = flat[:, own] @ d[:, own].T
            g["words"][k], g["word_bias"][k] = both[:HIDDEN], both[HIDDEN]
            back[:, own] += p["words"][k] @ d[:, own]
        turn = np.empty_like(order)
        turn[order] = np.arange(len(order))
        back = back.take(turn, 1).reshape(HIDDEN, steps, streams)
        dh = np.zeros((HIDDEN, streams), h.dtype)
        # by rows: candidate, both gates, and the candidate's part that came around; the drive has the first three, the weights around the last three
        deltas = np.empty((4 * HIDDEN, steps, streams), h.dtype)
        turned = lambda x, by: np.roll(x, by * HIDDEN, -1)
        for t in range(steps - 1, -1, -1):
            z, r, n, a, _ = trace[t]
            dn, dz, dr, reset = deltas[:, t].reshape(4, HIDDEN, streams)
            dh += back[:, t]
            kept = dh * z
            dh -= kept
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh
            np.multiply(dn, r, out=reset)
            np.subtract(states[:HIDDEN, t], n, out=dz)
            dz *= kept
            np.subtract(1, z, out=z)
            dz *= z
            np.subtract(1, r, out=r)
            np.multiply(reset, a, out=dr)
            dr *= r
            dh = p["around"] @ deltas[HIDDEN:, t]
            dh += kept
        deltas = deltas.reshape(4 * HIDDEN, -1)
        d_drive = deltas[: 3 * HIDDEN]
        g["around"] = (deltas[HIDDEN:] @ before.T).T
        both = turned((d_drive @ rows).T, -1)
        g["inward"], g["bias"] = both[:-1], both[-1]
        order = in_order(words, size)
        count = np.bincount(words, minlength=size + 1)
        seen = np.flatnonzero(count)
        g["embed"][seen] = np.add.reduceat((d_drive.T @ turned(p["inward"], 1).T)[order], (np.cumsum(count) - count)[seen])
        for v in g.values():
            v /= len(goal)
        return g, states[:HIDDEN, -1].T, float(loss / len(goal))

    def train(self, texts: list[np.ndarray], passes: int = 1, seed: int = 7) -> list[float]:
        """Truncated backpropagation over the texts, laid end to end in parallel streams; the losses."""
        if not texts:
            return []
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        for _ in range(passes):
            order = rng.permutation(len(texts))
            line = np.concatenate([texts[i] for i in order])
            streams = max(1, min(STREAMS, len(line) // (STEPS * WINDOW)))
            length = (len(line) - 1) // streams
            windows = -(-length // WINDOW)
            x = line[: streams * length].reshape(streams, length).T
            y = line[1 : streams * length + 1].reshape(streams, length).T
            h = np.zeros((streams, HIDDEN), np.float32)
            for w in range(windows):
                at = slice(w * WINDOW, min((w + 1) * WINDOW, length))
                g, h, loss = self.gradients(x[at], y[at], h)
                losses.append(loss)
                step += 1
                norm = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
                rate = RATE * (1 - 0.9 * step / (passes * windows + 1)) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in g.items():
                    v *= min(1.0, 1.0 / max(norm, 1e-9))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        return losses

    def score(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihood (natural) of each text's tokens flat[first[k]:first[k+1]], each from a fresh state."""
        size, total = np.diff(first), np.zeros(len(first) - 1)
        table, weights = self.inputs()
        by_length = np.argsort(-size, kind="stable")
        for at in range(0, len(by_length), TOGETHER):
            own = by_length[at : at + TOGETHER]
            start, length = first[:-1][own], size[own]
            h = np.zeros((HIDDEN, len(own)), np.float32)
            active = len(own) - np.searchsorted(length[::-1], np.arange(length[0]), "right")  # at each step: those not yet ended
            w = 0
            while w < len(active):
                n = active[w : w + max(1, BLOCK // int(active[w]))]
                cut = np.append(0, np.cumsum(n)).tolist()
                text = np.arange(cut[-1]) - np.repeat(cut[:-1], n)
                place = start[text] + np.repeat(np.arange(w, w + len(n)), n)
                before = flat[place - 1]
                if w == 0:
                    before[: n[0]] = self.end_id
                drive = weights.T @ table[before].T
                states = np.empty((HIDDEN, cut[-1]), h.dtype)
                for a, b in pairwise(cut):
                    h = self.advance(drive[:, a:b], h[:, : b - a], states[:, a:b])[-1]
                total += np.bincount(own[text], self.log_probability(states.T, flat[place]), len(total))
                w += len(n)
        return total

    @property
    def end_id(self) -> int:
        return int(self.p["end"][0]) if "end" in self.p else self.p["word_bias"].size


@dataclass
class Vocabulary:
    """Counts of the frequent words, and the output's words among them."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    ids: np.ndarray  # of the output; its size for others
    total: int  # N
    distinct: int  # V
    outside: float  # sum of c + 1 over words outside the output, and one more
    end: int
    unknown: int  # size of the output

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("begin", "logs")}

    @cached_property
    def logs(self) -> np.ndarray:
        return np.log10(self.counts + 1.0)

    @cached_property
    def begin(self) -> np.ndarray:
        """Where the hashes of each leading run of bits begin: they spread evenly, so few share a run."""
        bits = len(self.hashes).bit_length() + 2
        runs = (self.hashes >> np.uint64(64 - bits)).astype(np.int64)
        return np.append(0, np.cumsum(np.bincount(runs, minlength=1 << bits))).astype(np.int32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """np.searchsorted(self.hashes, hashes), but the last for hashes beyond all."""
        last = len(self.hashes) - 1
        at = np.minimum(self.begin[hashes >> np.uint64(65 - len(self.begin).bit_length())], last)
        late = np.flatnonzero(self.hashes[at] < hashes)
        for _ in range(NEAR):
            at[late] = np.minimum(at[late] + 1, last)
            late = late[(self.hashes[at[late]] < hashes[late]) & (at[late] < last)]
        at[late] = np.minimum(np.searchsorted(self.hashes, hashes[late]), last)
        return at

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is among the frequent; its output id, and log10 of its count and one (0 if it is not)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.full(len(hashes), self.unknown), np.zeros(len(hashes))
        at = self.place(hashes)
        known = self.hashes[at] == hashes
        ids, logs = self.ids[at], self.logs[at]
        other = np.flatnonzero(~known)
        ids[other], logs[other] = self.unknown, 0
        return known, ids, logs


def tokens(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end, and where each text's begin."""
    first = words.first + np.arange(len(words.first))
    word = np.ones(first[-1], bool)
    word[first[1:] - 1] = False
    hashes = np.full(first[-1], END)
    hashes[word] = words.hashes
    return hashes, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held += [tokens(words)[0] for _, _, words in word_chunks(batch.column(0), lower=True)]
            size = sum(map(len, held))
        if held and (batch is None or size >= COUNTED):
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "c"])
            held = []


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) of all training texts."""
    return training.select("text").mapInArrow(lean(_count), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    unknown = output_size(distinct // EACH)
    top = counts.orderBy(F.desc("c"), "word").limit(max(FREQUENT, unknown)).toArrow()
    words, c = np.asarray(top["word"]).view(np.uint64).copy(), np.asarray(top["c"]).astype(np.int64)
    rank = np.lexsort((words, -c))
    words, c = words[rank], c[rank]
    ids = np.minimum(np.arange(len(words)), unknown)
    inside = ids < unknown
    outside = float(total - c[inside].sum() + distinct - inside.sum() + 1)
    at_end = np.flatnonzero(words == END)
    order = np.argsort(words)
    return Vocabulary(words[order], c[order], ids[order], int(total), int(distinct), outside, int(ids[at_end[0]]) if len(at_end) else unknown, unknown)


def sharded(training: DataFrame, vocab: Vocabulary, tokens_each: int, seed: int = 13) -> DataFrame:
    """(shard, doc_id, h, ids): the output ids of every training text, dealt to shards of about so many tokens."""
    shared = training.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(3), lower=True):
                hashes, first = tokens(words)
                ids = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(shared.value.find(hashes)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), ids], names=["shard", "doc_id", "h", "ids"])

    h = F.xxhash64(F.coalesce("text", F.lit("")))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", h), F.lit(max(1, -(-vocab.total // tokens_each))))
    rows = training.select(shard.alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), "text")
    return rows.mapInArrow(lean(run), "shard long, doc_id long, h long, ids array<int>")


def merged(shards: DataFrame, network: Network, seed: int) -> Network:
    """The network after one pass over each shard, all from the same weights: their mean, by tokens."""
    shared = shards.sparkSession.sparkContext.broadcast(network)

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        own = Network({k: v.copy() for k, v in shared.value.p.items()})
        texts = [np.asarray(x.values) for x in rows.sort_by([("doc_id", "ascending"), ("h", "ascending")])["ids"]]
        own.train(texts, seed=seed)
        flat = np.concatenate([v.ravel() for v in own.p.values()])
        parts = [flat[at : at + PART] for at in range(0, len(flat), PART)]
        size = sum(map(len, texts))
        del own, texts
        trim()
        return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "shard": pa.array([key[0].as_py()] * len(parts), pa.int64()), "tokens": pa.array([size] * len(parts), pa.int64()), "x": pa.array(parts, pa.list_(pa.float32()))})

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        total, size = 0.0, 0
        rows = rows.sort_by("shard")
        for x, n in zip(rows["x"], rows["tokens"].to_pylist(), strict=True):
            total, size = total + np.asarray(x.values).astype(np.float64) * n, size + n
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "tokens": pa.array([size], pa.int64()), "x": pa.array([(total / size).astype(np.float32)], pa.list_(pa.float32()))})

    each = shards.groupBy("shard").applyInArrow(learn, "part int, shard long, tokens long, x array<float>")
    found = each.groupBy("part").applyInArrow(mean, "part int, tokens long, x array<float>").toArrow().sort_by("part")
    if not len(found):
        return network
    flat, at, p = np.concatenate([np.asarray(x.values) for x in found["x"]]), 0, {}
    for k, v in network.p.items():
        p[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return Network(p, found["tokens"][0].as_py())


def fit(training: DataFrame, vocab: Vocabulary, _: Scratch, tokens_each: int | None = None) -> Network:
    """The trained network. The shards are read once, so they go to their tasks by the shuffle alone."""
    inside = vocab.ids < vocab.unknown
    in_order = np.zeros(vocab.unknown)
    in_order[vocab.ids[inside]] = vocab.counts[inside]
    network = Network.new(in_order, vocab.total - in_order.sum())
    network = merged(sharded(training, vocab, tokens_each or max(SHARD, PER_WORD * vocab.unknown)), network, 7)
    network.p["end"] = np.array([vocab.end])
    return network


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int32())])))])
_SCORED_DDL = "doc_id long, held_out boolean, h long, n_tokens long, known long, base double, model double, rare array<struct<word: long, times: int>>"


def _rare(hashes: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens at these places: each text's distinct words, how often each comes, and how many each text has."""
    texts = len(first) - 1
    w, owner = hashes[at], np.searchsorted(first, at, "right") - 1
    order = np.argsort(w)
    order = order[in_order(owner[order], texts)]
    w, owner = w[order], owner[order]
    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (owner[1:] != owner[:-1]))[: len(w)])
    return w[new].view(np.int64), np.diff(np.append(new, len(w))).astype(np.int32), np.bincount(owner[new], minlength=texts)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, vocab = shared.value
        floor, floor_other = np.log10(vocab.total + vocab.distinct + 1), np.log10(vocab.outside)
        for some in gathered(batches, SORTED):
            held, sizes = [], [np.zeros(1, np.int64)]
            known, base, inner, rare = [], [], [], []
            for words in (words for batch in some for _, _, words in word_chunks(batch.column(3), lower=True)):
                hashes, first = tokens(words)
                seen, ids, logs = vocab.find(hashes)
                known.append(np.add.reduceat(seen, first[:-1], dtype=np.int64))  # no text is without tokens
                base.append(np.add.reduceat(logs, first[:-1]))
                inner.append(np.add.reduceat(np.where(ids == vocab.unknown, logs - floor_other, 0.0), first[:-1]))
                rare.append(_rare(hashes, np.flatnonzero(~seen), first))
                held.append(ids.astype(np.int32))
                sizes.append(np.diff(first))
            size = np.concatenate(sizes)
            flat, first = np.concatenate(held), np.cumsum(size)
            scores = network.score(flat, first) / np.log(10) + np.concatenate(inner)
            own = pa.Table.from_batches(some).select([0, 1, 2])
            made = [size[1:], np.concatenate(known), np.concatenate(base) - size[1:] * floor, scores]
            words, times, each = map(np.concatenate, zip(*rare, strict=True))
            pairs = pa.StructArray.from_arrays([words, times], fields=list(_SCORED.field("rare").type.value_type))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(each)).astype(np.int32), pairs)
            yield from pa.table([*own.columns, *map(pa.array, made), lists], schema=_SCORED).combine_chunks().to_batches()

    return run


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; learns where held_out is not true."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    training = rows.where(~F.col("held_out"))
    counts = scratch.put(count_words(training), "counts")
    vocab = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((fit(training, vocab, scratch), vocab))
    scored = scratch.put(rows.mapInArrow(lean(_score(shared)), _SCORED_DDL), "scored")
    rare = scored.select("h", F.posexplode("rare").alias("k", "own")).select("h", (F.col("k") == 0).cast("int").alias("texts"), F.col("own.word").alias("word"), F.col("own.times").alias("times"))
    # texts: how many equal texts a row of sums is of, as each begins once; what is theirs together is shared out
    sums = rare.join(counts, "word", "left").groupBy("h").agg(
        (F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))) / F.sum("texts")).alias("rare_log"),
        (F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)) / F.sum("texts")).alias("rare_known"),
    )
    extra, none = F.coalesce("rare_log", F.lit(0.0)), F.lit(0)
    return scored.join(sums, "h", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", none)).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"),
    )
