"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexicon maps terms (case folded; letters, digits and apostrophes) to classes: insult, kin, threat,
target, negation, reported speech. Function words are fixed lists for four languages. Insults are
learned: terms and term beginnings that occur in toxic labelled texts and hardly ever in others, in
many different contexts (so that a copied text counts once), taken greedily until the toxic texts are
covered. Kin are terms that share a beginning which toxic texts have STRANGE deviations too often, and
that the labelled texts without toxicity do not hold themselves.

The grammar is a cascade of transducers, each given as data: weighted arcs from class to class.
Read from the clause's end, one marks insults, kin and threats that have a target among the next REACH
terms. Read from its beginning, a negation transducer marks those that a negation reaches, a target
transducer those with a target before them, a reported-speech transducer those that somebody is said
to have said, and the insult and threat transducers turn what is left into outcomes. The latter are
composed into one machine by the usual product, which adds weights along a path. A clause's score is
the weight of its path, so a word weighs by what stands round it; words outside a match weigh nothing.
A text's score is the logistic function of the sum of its clauses' scores, of which each outcome
counts MOST times. The weights are learned from the same labels and then stand on the arcs.

Lexicon and weights are learned from a bounded sample (SAMPLE) of labelled rows, evenly drawn from
toxic and other texts; the lexicon has at most LEXICON entries. Every whole text is scored.

Defined results: null and empty texts match nothing and get the score of a text without a match;
null labels are not learned from; without toxic labels no insult is known; equal rows give equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, lean, text_chunks, word_hash
from .quality import measured

#: Labelled rows learned from, at most about; entries of the lexicon, at most.
SAMPLE, LEXICON = 8_000, 2_000
#: Sizes in bytes of the term beginnings that may be learned; terms that negation and targets reach.
BEGINNINGS, REACH = (4, 5, 6, 7), 3
#: Deviations from chance that make a beginning one of kin; entries of known words with such a beginning, at most.
STRANGE, KNOWN = 6.0, 50_000
#: Times that an outcome counts in one text.
MOST = 4

#: Function words of English, German, French and Spanish.
NEGATION = "not no never neither without don't isn't aren't wasn't nicht kein keine nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTED = "said says say told quoted quote claimed called wrote sagte sagt schrieb nannte zitierte dit disait écrit appelé cité dijo dice escribió llamó citó".split()
TARGET = "you your you're u they them their he she his her du dich dein deine ihr euch sie tu te toi ton vous votre ils elles tú ti usted ustedes vosotros él ella ellos ellas".split()
THREAT = "kill hurt destroy burn beat shoot stab töten umbringen verletzen zerstören schlagen tuer frapper détruire brûler matar herir destruir golpear quemar".split()

#: Classes of terms, and what the cascade makes of an insult, of kin or of a threat on the way.
OTHER, INSULT, KIN, MENACE, AIM, NOT, SAYS, END = CLASSES = "other insult kin menace aim not says end".split()
HITS = (INSULT, KIN, MENACE)
CONTEXTS = ("aimed", "negated", "quoted")
#: Outcomes: a hit and its context ("" for none).
OUTCOMES = [f"{hit} {context}".strip() for hit in HITS for context in ("", *CONTEXTS)]


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) to (state, symbol, weight); a symbol without an arc passes unchanged and moves as `rest` says."""

    start: object
    arcs: dict
    rest: dict  # state to the state after any other symbol

    def step(self, state, symbol: str) -> tuple[object, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest[state], symbol, 0.0)

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        """What it makes of the symbols, and the path's weight."""
        state, out, total = self.start, [], 0.0
        for s in symbols:
            state, symbol, weight = self.step(state, s)
            out.append(symbol)
            total += weight
        return out, total


def marked(hit: str, context: str) -> str:
    return f"{hit} {context}"


def within_reach(opener: str, context: str) -> Transducer:
    """Hits among the REACH terms after an opener get a context, if they have none."""
    arcs: dict = {}
    for left in range(REACH + 1):
        arcs[left, opener] = (REACH, opener, 0.0)
        arcs[left, END] = (0, END, 0.0)
        for hit in HITS if left else ():
            arcs[left, hit] = (left - 1, marked(hit, context), 0.0)
    return Transducer(0, arcs, {left: max(0, left - 1) for left in range(REACH + 1)})


def overruling(opener: str, context: str) -> Transducer:
    """Every hit after an opener, up to the end, gets a context in place of any other."""
    arcs: dict = {(0, opener): (1, opener, 0.0), (1, opener): (1, opener, 0.0), (1, END): (0, END, 0.0), (0, END): (0, END, 0.0)}
    for hit in HITS:
        for have in (hit, *(marked(hit, c) for c in CONTEXTS)):
            arcs[1, have] = (1, marked(hit, context), 0.0)
    return Transducer(0, arcs, {0: 0, 1: 1})


def weighing(hits: tuple[str, ...], weights: dict[str, float]) -> Transducer:
    """Puts the weights of the hits' outcomes on the path."""
    return Transducer(0, {(0, o): (0, o, w) for o, w in weights.items() if o.split()[0] in hits}, {0: 0})


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that does as second does with what first makes of its symbols: states are pairs, weights add up."""
    start = (first.start, second.start)
    arcs, rest, pending = {}, {}, [start]
    while pending:
        state = pending.pop()
        if state in rest:
            continue
        for s in symbols:
            a, between, v = first.step(state[0], s)
            b, out, w = second.step(state[1], between)
            arcs[state, s] = ((a, b), out, v + w)
            pending.append((a, b))
        rest[state] = (first.rest[state[0]], second.rest[state[1]])
        pending.append(rest[state])
    return Transducer(start, arcs, rest)


#: What the left-to-right cascade may read: classes, and hits that have a target ahead.
READ = [*CLASSES, *(marked(hit, "aimed") for hit in HITS)]


def negating() -> Transducer:
    """As within_reach, and a hit with a target ahead is negated all the same."""
    base = within_reach(NOT, "negated")
    extra = {(left, marked(hit, "aimed")): (left - 1, marked(hit, "negated"), 0.0) for left in range(1, REACH + 1) for hit in HITS}
    return Transducer(0, base.arcs | extra, base.rest)


def cascade(weights: dict[str, float]) -> Transducer:
    """Negation, targets before a hit, reported speech, then insults and threats: composed into one."""
    machine = negating()
    for part in (within_reach(AIM, "aimed"), overruling(SAYS, "quoted"), weighing((INSULT, KIN), weights), weighing((MENACE,), weights)):
        machine = compose(machine, part, READ)
    return machine


#: Read from right to left: hits with a target among the next REACH terms.
AHEAD = within_reach(AIM, "aimed")


def read_clause(machine: Transducer, terms: list[str]) -> tuple[list[str], float]:
    """The outcomes of a clause's hits, and the weight of its path."""
    ahead, _ = AHEAD.run(terms[::-1])
    out, weight = machine.run([*ahead[::-1], END])
    return [o for o in out if o.split()[0] in HITS], weight


_BREAK = np.zeros(256, np.int64)
_BREAK[list(b".!?;\n")] = 1


@dataclass
class Grammar:
    terms: np.ndarray  # hashes, sorted
    term_class: np.ndarray  # numbers of classes
    beginnings: dict[int, np.ndarray]  # of each size: hashes, sorted
    stems: dict[int, np.ndarray]  # likewise, of kin
    known: np.ndarray  # hashes, sorted, of words with such a beginning that are no kin
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.machine = cascade(self.weights)

    def classes(self, words: Words) -> np.ndarray:
        kinds = np.zeros(len(words.hashes), np.int64)
        for size, hashes in self.stems.items():
            kinds[_member(words.prefix_hashes(size), hashes) >= 0] = CLASSES.index(KIN)
        kinds[_member(words.hashes, self.known) >= 0] = 0
        for size, hashes in self.beginnings.items():
            kinds[_member(words.prefix_hashes(size), hashes) >= 0] = CLASSES.index(INSULT)
        at = _member(words.hashes, self.terms)
        return np.where(at >= 0, self.term_class[np.maximum(at, 0)], kinds)

    def clauses(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """(text, terms) of the clauses with a hit. Runs of terms that are nothing are cut to what negation and targets reach."""
        words, texts = Words(data, offsets, lower=True, terms=True), len(offsets) - 1
        if not len(words.hashes):
            return
        kinds = self.classes(words)
        owner = np.repeat(np.arange(texts), np.diff(words.first))
        clause = np.cumsum(_BREAK[data])[words.starts] + owner  # grows at every break and every text
        hits = np.flatnonzero(np.isin(kinds, [CLASSES.index(h) for h in HITS]))
        marks = np.flatnonzero(kinds)
        for c in np.unique(clause[hits]):
            a, b = np.searchsorted(clause[marks], [c, c + 1])
            terms: list[str] = []
            before = None
            for p in marks[a:b]:
                terms += [OTHER] * (0 if before is None else min(int(p) - before - 1, REACH))
                terms.append(CLASSES[kinds[p]])
                before = int(p)
            yield int(owner[marks[a]]), terms

    def outcomes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: how many hits had each outcome."""
        counts = np.zeros((len(offsets) - 1, len(OUTCOMES)))
        for text, terms in self.clauses(data, offsets):
            for o in read_clause(self.machine, terms)[0]:
                counts[text, OUTCOMES.index(o)] += 1
        return counts

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts, total = np.zeros((len(offsets) - 1, len(OUTCOMES))), np.full(len(offsets) - 1, self.bias)
        for text, terms in self.clauses(data, offsets):
            out, weight = read_clause(self.machine, terms)
            total[text] += weight
            for o in out:
                counts[text, OUTCOMES.index(o)] += 1
        # an outcome counts MOST times
        total -= np.maximum(counts - MOST, 0) @ np.array([self.weights.get(o, 0.0) for o in OUTCOMES])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted array known, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def grammar(insults: list[str], beginnings: list[bytes], weights: dict[str, float], bias: float, stems: tuple[bytes, ...] = (), known: tuple[str, ...] = ()) -> Grammar:
    lists = ((AIM, TARGET), (NOT, NEGATION), (SAYS, REPORTED), (MENACE, THREAT), (INSULT, insults))
    classes = {word_hash(w): CLASSES.index(kind) for kind, words in lists for w in words}
    terms = np.array(sorted(classes), np.uint64)

    def sized(forms) -> dict[int, np.ndarray]:
        by: dict[int, list[int]] = defaultdict(list)
        for f in forms:
            by[len(f)].append(_bytes_hash(f))
        return {n: np.array(sorted(h), np.uint64) for n, h in by.items()}

    return Grammar(terms, np.array([classes[int(h)] for h in terms], int), sized(beginnings), sized(stems), np.array(sorted(map(word_hash, known)), np.uint64), weights, bias)


def _bytes_hash(b: bytes) -> int:
    return int(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), lower=False, terms=True).hashes[0])


def _keys(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[bytes, bytes, bytes]]]:
    """(term, term before, term after) of each text's terms."""
    words = Words(data, offsets, lower=True, terms=True)
    raw = words.data.tobytes()
    for k in range(len(offsets) - 1):
        own = [raw[a:b] for a, b in zip(words.starts[words.first[k] : words.first[k + 1]], words.ends[words.first[k] : words.first[k + 1]], strict=True)]
        yield list(zip(own, [b"", *own[:-1]], [*own[1:], b""], strict=True))


def _forms(term: bytes) -> Iterator[bytes]:
    """The term itself (marked by a gap at its end) and its beginnings."""
    yield term + b" "
    for n in BEGINNINGS:
        if len(term) > n:
            yield term[:n]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each form: in how many toxic texts of the task, and in how many others."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for i, _, data, offsets in text_chunks(batch.column(1)):
            for k, keys in enumerate(_keys(data, offsets)):
                (toxic if labels[i + k] else other).update({f for t in {t for t, _, _ in keys} for f in _forms(t)})
    forms = [f for f in {*toxic, *other}]
    for at in range(0, len(forms), 50_000):
        part = forms[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"form": part, "toxic": [toxic[f] for f in part], "other": [other[f] for f in part]}, schema=pa.schema([("form", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64())]))


def choose(found: list[tuple[int, list[tuple[bytes, int]]]], cost: dict[bytes, float], most: int = LEXICON) -> list[bytes]:
    """Forms that cover the toxic texts, greedily. found: of each toxic text, its candidate forms with a hash of their context.

    cost: what a form's occurrences in other texts take from its gain. A text counts in full until it is covered and a tenth after; contexts count once, so that the
    words of a much copied text do not. Of forms that do as well, the longest is taken."""
    contexts: dict[bytes, dict[int, int]] = defaultdict(dict)
    for text, forms in found:
        for form, context in forms:
            contexts[form].setdefault(context, text)
    covered: set[int] = set()
    chosen: list[bytes] = []
    left = {f: c for f, c in contexts.items() if len(c) >= 2}
    while left and len(chosen) < most:
        gain = {f: sum(0.1 if t in covered else 1.0 for t in c.values()) - cost.get(f, 0.0) for f, c in left.items()}
        top = max(gain.values())
        if top < max(1.15, 0.002 * len(found)):
            break
        form = max((f for f, g in gain.items() if g >= 0.98 * top), key=lambda f: (f.endswith(b" "), len(f), f))
        chosen.append(form)
        covered |= set(contexts[form].values())
        inside = (lambda f, form=form: f.startswith(form) or form.startswith(f)) if not form.endswith(b" ") else (lambda f, form=form: form.startswith(f))
        left = {f: c for f, c in left.items() if f != form and not inside(f)}
    return chosen


def kin_stems(counts: dict[bytes, tuple[int, int]], toxic: float, other: float, chosen: list[bytes]) -> tuple[bytes, ...]:
    """Beginnings that toxic texts (in different contexts) have far too often for chance; none inside another or inside an insult."""
    strange = {}
    for form, (n, m) in counts.items():
        chance = (m + 1) * toxic / max(other, 1)
        if not form.endswith(b" ") and n >= 4 and (n - chance) / chance**0.5 >= STRANGE:
            strange[form] = (n - chance) / chance**0.5
    found: list[bytes] = []
    for form in sorted(strange, key=lambda f: (-strange[f], f)):
        if not any(form.startswith(f) or f.startswith(form) for f in found) and not any(form.startswith(c) for c in chosen):
            found.append(form)
    return tuple(found)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 23) -> Grammar:
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not sizes.get(True):
        return grammar([], [], {}, -4.0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for toxic, n in sizes.items():
        chosen = chosen | (F.col("toxic") == toxic) & (draw < int(min(1.0, sample / 2 / n) * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(labels.where(chosen)), "doc_id").select("toxic", "text")
    of = {t: min(n, sample / 2) for t, n in sizes.items()}
    scratch = Scratch(docs.sparkSession)
    counts = rows.mapInArrow(lean(_counted), "form binary, toxic long, other long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = scratch.put(counts, "counts")
    share = of[True] / max(of.get(False, 1), 1)
    rare = F.col("other") * share <= 0.02 * F.col("toxic")
    chance = (F.col("other") + 1) * share
    strange = (F.col("toxic") >= 4) & ((F.col("toxic") - chance) / F.sqrt(chance) >= STRANGE)
    found = counts.where((F.col("toxic") >= 2) & (rare | strange)).withColumn("rare", rare)
    candidates = found.orderBy(F.desc("toxic"), "form").limit(10 * LEXICON).collect()
    insults = {bytes(r["form"]): (r["toxic"], r["other"]) for r in candidates if r["rare"]}
    every = {bytes(r["form"]): (r["toxic"], r["other"]) for r in candidates}
    shared = docs.sparkSession.sparkContext.broadcast(set(every))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                forms, context = [], []
                for keys in _keys(data, offsets):
                    own = [(f, word_hash((b + b" " + a).decode("utf-8", "replace")) >> 1) for t, b, a in keys for f in _forms(t) if f in known]
                    forms.append([f for f, _ in own])
                    context.append([c for _, c in own])
                yield pa.RecordBatch.from_arrays([pa.array(forms, pa.list_(pa.binary())), pa.array(context, pa.list_(pa.int64()))], names=["forms", "contexts"])

    found = rows.where("toxic").mapInArrow(lean(contexts), "forms array<binary>, contexts array<long>").toArrow()
    shared.destroy()
    texts = sorted(zip(map(tuple, found["forms"].to_pylist()), map(tuple, found["contexts"].to_pylist()), strict=True))
    ratio = max(1.0, share)
    own = [(k, [(f, c) for f, c in zip(fs, cs, strict=True) if f in insults]) for k, (fs, cs) in enumerate(texts)]
    forms = choose(own, {f: 5 * other * ratio for f, (_, other) in insults.items()})
    # texts of a form with different contexts: as many as either allows
    places: dict[bytes, dict[int, int]] = defaultdict(dict)
    for k, (fs, cs) in enumerate(texts):
        for f, c in zip(fs, cs, strict=True):
            places[f].setdefault(c, k)
    stems = kin_stems({f: (len(set(c.values())), every[f][1]) for f, c in places.items()}, of[True], of.get(False, 1), forms)[: LEXICON]
    within = F.lit(False)
    for n in sorted({len(x) for x in stems}):
        within = within | F.substring("form", 1, n).isin([bytearray(x) for x in stems if len(x) == n])
    plain = counts.where(within & (F.substring("form", -1, 1) == F.lit(bytearray(b" "))) & (F.col("other") > 0)).orderBy(F.desc("other"), "form").limit(KNOWN).collect() if stems else []
    scratch.drop("")
    words, beginnings = [f[:-1].decode("utf-8", "replace") for f in forms if f.endswith(b" ")], [f for f in forms if not f.endswith(b" ")]
    # a text learned from does not tell of itself: words that it alone of the other texts holds are kin in it
    named = {n: tuple(bytes(r["form"])[:-1].decode("utf-8", "replace") for r in plain if r["other"] >= n) for n in (1, 2)}
    blank = grammar(words, beginnings, {}, 0.0, stems, named[2])
    outcomes = measured(rows, ("toxic",), "x array<double>", lambda data, offsets: {"x": pa.array(list(blank.outcomes(data, offsets)), pa.list_(pa.float64()))}).toArrow()
    x, y = np.minimum(np.array(outcomes["x"].to_pylist(), float).reshape(-1, len(OUTCOMES)), MOST), np.array(outcomes["toxic"], float)
    weights, bias = weigh(x, y)
    return grammar(words, beginnings, dict(zip(OUTCOMES, weights.tolist(), strict=True)), bias, stems, named[1])


#: What an outcome weighs before any text is seen: an insult tells most, kin and bare threats less; negated or reported little.
PRIOR = {INSULT: (7.0, 8.0, 2.0, 2.0), KIN: (3.0, 4.0, 1.0, 1.0), MENACE: (0.5, 7.0, 0.2, 0.2)}


def weigh(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of the outcomes, drawn to a prior."""
    prior = np.array([w for hit in HITS for w in PRIOR[hit]])
    z = np.column_stack([x, np.ones(len(x))])
    centre, pull = np.append(prior, -2.0), np.append(np.ones(len(prior)), 0.01)

    def loss(v: np.ndarray) -> float:
        margin = z @ v
        return float((np.logaddexp(0, margin) - y * margin).sum() + 0.5 * (pull * (v - centre) ** 2).sum())

    v = centre.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        grad = z.T @ (p - y) + pull * (v - centre)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), grad)
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v) - 1e-4 * size * float(grad @ step):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return v[:-1], float(v[-1])


def score(docs: DataFrame, model: Grammar, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    if "score" in keep:
        raise ValueError("columns of the result: ['score']")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return measured(docs, keep, "score double", lambda data, offsets: {"score": pa.array(shared.value.score(data, offsets))})
