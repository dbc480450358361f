"""The operators against brute force, on small tables with every awkward row."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import (
    bpe,
    decontaminate,
    embedding_dedup,
    language_id,
    language_model,
    ngram_join,
    quality,
    sharding,
    substring_dedup,
    toxicity,
)
from framewright.llm.common import Scratch, Words, lean, text_chunks, word_hash

#: Columns besides the usual ones, with names that operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, node string, h string, score string, rejected string, _id string, _leaking int, root int, word string"
LANG = {"en": "the of and to in that house water light river stone".split(), "de": "der die das und nicht haus wasser licht fluss stein über".split(), "fr": "le la les et dans maison eau lumière rivière pierre où".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(LANG[lang]) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None,) * (4 - len(r)), 1, "x", "y", "z", "w", "v", 2, 3, "u") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages, and awkward rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(max(1, len(w) // 60)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            text = "\n".join(w) if rng.random() < 0.5 else " ".join(w)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 30, 90, 200]))]
            if rng.random() < 0.5:
                at = rng.randint(0, len(w))
                w = w[:at] + passage[: rng.randint(45, 70)] + w[at:]
            text = " ".join(w)
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, None), (1004, "Ünï " * 300), (1005, "ünï " * 300), (1006, rows[5][1]), (1006, rows[5][1]), (None, rows[4][1]), (1010, " ".join(rng.choice(words) for _ in range(20_000)))]
    rng.shuffle(rows)
    return rows


def empty(spark):
    return table(spark, [(1, "x")]).where("false")


# ---- word hashes -------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="aB é\n\t\x1cÉ.7'", max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    for _, _, data, offsets in text_chunks(pa.array(texts), most=20):
        words = Words(data, offsets, lower=True)
        raw = data.tobytes()
        for k in range(len(offsets) - 1):
            want = raw[offsets[k] : offsets[k + 1]].lower().split()
            got = words.hashes[words.first[k] : words.first[k + 1]]
            assert [int(x) for x in got] == [word_hash(w.decode()) for w in want]


# ---- 1 -----------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = [r for r in corpus(seed) if r[0] is not None]
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(pairs, ids)
    got = ngram_join.join_documents(table(spark, [*rows, (None, rows[0][1])])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r.doc_id
    assert len(set(want.values())) < len(ids)


def test_ngram_join_group_of_near_copies(spark):
    """A chain: neighbours link, ends do not; and many copies of one text round it."""
    rng = random.Random(4)
    w = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = w.copy()
        w[rng.randrange(len(w))] = f"n{k}"
        rows.append((k, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(pairs, sets)
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(table(spark, rows + [(500 + i, rows[7][1]) for i in range(50)])).collect()}
    assert {i: got[i] for i in sets} == want and all(got[500 + i] == want[7] for i in range(50))


@pytest.mark.parametrize(("crowd", "tile", "leading", "held", "part"), [(2, 3, 10**6, 1, 1), (2, 1024, 1, 1 << 16, 1 << 13), (5, 7, 4, 3, 2), (32, 1024, 10**6, 1 << 16, 1 << 13)])
def test_ngram_join_tiles(spark, monkeypatch, crowd, tile, leading, held, part):
    """Texts round one common passage: signatures crowded or not, tiles and held runs cut small, few or no leaders before."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "LEADING", leading)
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "PART", part)
    rng = random.Random(crowd + tile)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = passage + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"c{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    want = classes([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert {r.doc_id: r.component_id for r in ngram_join.join_documents(table(spark, rows)).collect()} == want
    assert len(set(want.values())) > 3


def test_ngram_join_hash_collisions(spark, monkeypatch):
    """Different sets with one first hash are told apart by the second."""
    real = ngram_join.node_keys
    monkeypatch.setattr(ngram_join, "node_keys", lambda keys, first: (real(keys, first)[0] % 5, real(keys, first)[1]))
    rows = [(i, t) for i, t in corpus(4, 60) if i is not None]
    sets = {i: shingles(t) for i, t in rows}
    want = classes([(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    join = ngram_join.Join(table(spark, rows), 5, 80)
    assert len(join.doubtful) > 1
    assert {r.doc_id: r.component_id for r in join.run().collect()} == want


def test_bitmap_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 700).astype(np.uint64)
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 600), replace=False)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert ngram_join.overlap(a, b) == both <= ngram_join.bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b))


def test_ngram_join_empty_and_filter(spark):
    assert ngram_join.join_documents(empty(spark)).collect() == []
    rows = [(5, "a b c d e f"), (3, "A b  c d e f"), (9, "x"), (4, None), (2, None)]
    got = ngram_join.keep_representatives(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 4, 9]
    text = "a b c d e f g"
    rows = [(1, text), (1, text), (2, text), (3, text), (7, "p q r s t u"), (7, "p q r s t u"), (7, "P q r s t u"), (7, "other words are here now ok"), (8, ""), (8, ""), (None, text)]
    got = sorted(((r.doc_id or 0, r.text) for r in ngram_join.keep_representatives(table(spark, rows)).collect()), key=str)
    assert [i for i, _ in got] == [0, 1, 7, 7, 8, 8] and {t.lower() for i, t in got if i == 7} == {"p q r s t u", "other words are here now ok"}


# ---- 2 -----------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.choice([2, 8, 40, 200])), lang, "s") for i, lang in enumerate(rng.choices(list(LANG), k=400))]
    docs = table(spark, [*rows, (900, None, "en", "s"), (901, "", "de", "s"), (902, "12 !! 34", "fr", "s"), (903, "the of", None, "s"), (904, "the of and " * 9000, None, "s")])
    model = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in held]) > 0.97
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].lang_score, got[i].rejected) == ("und", 0.0, True)
    assert got[903].lang_pred == got[904].lang_pred == "en"
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    kept = language_id.language_filter(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900, 901, 902} and len(ids) > 0.98 * len(rows)


def test_language_id_by_hand(spark):
    """The query's predictions against subwords counted one by one in Python."""
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, rng.choice([1, 3, 40])), lang, "s") for i, lang in enumerate(rng.choices(list(LANG), k=200))]
    model = language_id.fit(table(spark, rows))
    rows += [(300, "ÀÉ x9y--zß 漢字", None, None), (301, "a", None, None)]
    mask, known = (1 << 64) - 1, len(model.languages)

    def by_hand(text):
        raw = [0x20 if not (b >= 128 or chr(b).isalpha() or b == 39) else b for b in bytes(language_id.fold_case(np.frombuffer(text.encode(), np.uint8)))]
        total, n = np.zeros(known + 1), 0
        for i in range(len(raw)):
            key = 0
            for size in range(1, 5):
                if i + size > len(raw):
                    break
                key = (key * 257 + raw[i + size - 1] + 1) & mask
                if size > 1 and (raw[i] != 32 or raw[i + 1] != 32):
                    bucket = ((key + (size << 40)) * 0x9E3779B97F4A7C15 & mask) >> (64 - language_id.BUCKET_BITS)
                    total, n = total + model.table[bucket], n + 1
        mean = total / max(n, 1)
        e = np.exp(mean[:known] + model.bias)
        best = int(e.argmax())
        like = (mean[known] - model.mean) / math.sqrt(model.spread[0] + model.spread[1] / max(n, 1))
        return model.languages[best], round(float(e[best] / e.sum()), 6), bool(e[best] / e.sum() < model.least_score or like < model.least_likeness)

    got = {r.doc_id: (r.lang_pred, round(r.lang_score, 6), r.rejected) for r in language_id.predict(table(spark, rows), model).collect()}
    assert got == {r[0]: by_hand(r[1]) for r in rows}


def test_language_left_out(spark):
    """Texts of a language that training has not seen are rejected; those of the languages it has seen stay."""
    rng = random.Random(4)
    syllables = {"aa": "ka to mi ru se no ha".split(), "bb": "lich heit der ung sch ein auf".split(), "cc": "eau tion que les mont oir ai".split(), "new": "przy szcz owa ński dzi wy łem".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang: " ".join(word(lang) for _ in range(rng.choice([12, 40, 150])))
    known = [(i, text(lang), lang, "s") for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=600))]
    model = language_id.fit(table(spark, known))
    more = [(1000 + i, text(lang), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    more += [(1500 + i, f"{text('aa')} {text('bb')}", "aa", "s") for i in range(40)]
    kept = {r.doc_id for r in language_id.language_filter(table(spark, more + [(2000 + i, text("new"), "new", "s") for i in range(100)]), model).collect()}
    assert kept == {r[0] for r in more}


def test_clashing_names(spark):
    docs = table(spark, [(1, "the of")])
    for run in (lambda: bpe.encode_documents(docs.withColumn("ids", F.lit(1)), PATH, ("doc_id", "ids")), lambda: language_id.predict(docs, language_id.fit(docs), ("doc_id", "rejected")), lambda: quality.score(docs, None, ("score",)), lambda: toxicity.score(docs, None, ("score",))):
        with pytest.raises(ValueError, match="columns of the result"):
            run()


def test_language_id_without_rows(spark):
    model = language_id.fit(empty(spark))
    assert [r.lang_pred for r in language_id.predict(table(spark, [(1, "the")]), model).collect()] == ["und"]
    assert language_id.predict(empty(spark), model).collect() == []


# ---- 3 -----------------------------------------------------------------------------------


def test_sharding(spark):
    rng = random.Random(5)
    rows = [(i % 900, "é" * (i % 7) if i % 11 else None, "en", rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(1003)]
    got = sharding.assign_shards(table(spark, rows), 7, 3).collect()
    assert sharding.assign_shards(table(spark, rows[::-1]), 7, 3).drop("fraction").exceptAll(sharding.assign_shards(table(spark, rows), 7, 3).drop("fraction")).count() == 0
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1003 and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source, n in Counter(r[3] for r in rows).items():
        for s in range(7):
            assert abs(sum(r.shard == s and r.source == source for r in got) - n / 7) <= 2
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    # the same order, ranked in one piece
    size = lambda r: len((r[1] or "").encode()) + 16
    key = lambda r: hashlib.md5(f"3:{'' if r[0] is None else r[0]}:{size(r)}:{zlib.crc32((r[1] or '').encode())}".encode()).hexdigest()[:15]
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((key(r), r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())))
    line = sorted((((2 * k + 1) / (2 * len(v)), s is not None, s or "", x) for s, v in by.items() for k, x in enumerate(sorted(v))), key=lambda t: t[:3])
    at = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r["size"]) for r in at] == [(x[1], x[2]) for *_, x in line]
    assert sharding.assign_shards(empty(spark), 7).collect() == []


# ---- 4 -----------------------------------------------------------------------------------


def removed(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = Counter(tuple(r) for r in substring_dedup.digests(table(spark, rows)).collect())
    want = removed(rows, 50)
    assert got == want
    assert sum(k[2] for k in want) > 1000


def test_substring_dedup_takes_places_from_automata(spark, monkeypatch):
    """Without the phrases in the automata nothing is found but whole copies; small shards change nothing."""
    rows = corpus(5, 60)
    monkeypatch.setattr(substring_dedup, "SHARD", 7)
    assert Counter(tuple(r) for r in substring_dedup.digests(table(spark, rows)).collect()) == removed(rows, 50)
    monkeypatch.setattr(substring_dedup, "automaton", lambda phrases: substring_dedup.ahocorasick.Automaton(substring_dedup.ahocorasick.STORE_LENGTH, substring_dedup.ahocorasick.KEY_SEQUENCE))
    monkeypatch.setattr(substring_dedup, "locate", lambda words, machine, gram: np.zeros(len(words.hashes), bool) if not len(machine) else None)
    found = {r.doc_id: r for r in substring_dedup.digests(table(spark, rows)).collect()}
    want = {k[0]: k for k in removed(rows, 50)}
    assert sum(r.n_removed for r in found.values()) < sum(k[2] for k in want.values())
    assert all(r.n_removed in (0, r.n_words) for r in found.values())


def test_substring_dedup_edges(spark):
    """Runs that repeat in themselves, passages of just 50 and 49 words, overlaps of two owners."""
    w = [f"a{i}" for i in range(200)]
    rows = [(9, "x " * 300), (2, "x " * 120), (3, " ".join(w[:60])), (4, "q " + " ".join(w[10:60])), (5, "q " + " ".join(w[11:60])), (6, " ".join(w[30:130])), (7, " ".join(w)), (8, " ".join(w)), (8, " ".join(w)), (1, " ".join(w[100:150]) + " x" * 49)]
    assert Counter(tuple(r) for r in substring_dedup.digests(table(spark, rows)).collect()) == removed(rows, 50)
    assert substring_dedup.digests(empty(spark)).collect() == []
    kept = substring_dedup.dedup_documents(table(spark, [*rows, (20, None), (21, "")]))
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == table(spark, rows).columns
    assert 8 not in texts and texts[20] is None and texts[21] == "" and texts[4] == "q" and texts[5] == rows[4][1]


def test_substring_dedup_reduces_texts_once(spark):
    """A task of the last pass has one Python worker, not one for the filter and one for the text."""
    rows = corpus(1, 60)
    kept = substring_dedup.dedup_documents(table(spark, rows))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    want = Counter((k[0], k[1] - k[2], k[3]) for k in removed(rows, 50).elements() if k[1] > k[2])
    got = Counter((r.doc_id, len(w := (r.text or "").encode().split()), hashlib.sha256(b" ".join(w)).hexdigest()) for r in kept.collect() if (r.text or "").split())
    assert got == want


# ---- 5 -----------------------------------------------------------------------------------


def test_language_model(spark):
    rows = corpus(7, 80)
    out = language_model.score_documents(table(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    split = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in split if not held(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 5)) for i, w in split)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)
    assert got == want
    assert all(r.score < 0 for r in out)


def test_language_model_by_hand(spark, monkeypatch):
    """The query's scores against the network stepped token by token, with another word's share by its exact count."""
    made = []
    real = language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: made.append((real(*a), a[1])) or made[0][0])
    monkeypatch.setattr(language_model, "CLASSES", 4)
    monkeypatch.setattr(language_model, "MEMBERS", 4)
    monkeypatch.setattr(language_model, "UNKNOWN", 16)
    monkeypatch.setattr(language_model, "FREQUENT", 40)
    rows = [(i, " ".join(random.Random(i).choice("a b c d e f g h".split() + [f"w{k}" for k in range(200)]) for _ in range(random.Random(-i).randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, "never Seen a B")]
    out = {r.doc_id: r.score for r in language_model.score_documents(table(spark, rows), F.col("doc_id") % 7 == 2).collect()}
    (net, vocab), = made
    c = Counter(w for i, t in rows if i % 7 != 2 for w in [*(t or "").lower().split(), None])
    top = dict(zip(vocab.hashes.tolist(), vocab.ids.tolist(), strict=True))
    drive = net.p["embed"] @ net.p["inward"] + net.p["bias"]
    assert vocab.unknown == 16 and len(vocab.hashes) == 40
    for i, t in rows:
        words = [*(t or "").lower().split(), None]
        ids = [top.get(word_hash(w) if w is not None else int(language_model.END), 16) for w in words]
        h, total = np.zeros((1, language_model.HIDDEN)), 0.0
        for before, now, w in zip([net.end_id, *ids], ids, words, strict=False):
            h = net.step(drive[[before]], h)[-1]
            total += net.log_probability(h, np.array([now]))[0] / math.log(10)
            total += math.log10((c[w] + 1) / vocab.outside) if now == 16 else 0.0
        assert out[i] == pytest.approx(total, rel=1e-4), i


def test_language_model_reads_texts_thrice(spark, monkeypatch):
    """Texts are counted, trained on and scored, one pass each; equal texts share what their rarer words add up to."""
    passes = []
    monkeypatch.setattr(language_model, "lean", lambda run: passes.append(run) or lean(run))
    monkeypatch.setattr(language_model, "FREQUENT", 20)
    monkeypatch.setattr(language_model, "UNKNOWN", 16)
    monkeypatch.setattr(language_model, "CLASSES", 4)
    monkeypatch.setattr(language_model, "MEMBERS", 4)
    rng = random.Random(6)
    texts = [" ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.randint(0, 40))) for _ in range(30)]
    texts += ["new Words w59 new w58", "w59 w59 w57 W59", None, " ", *texts[:4]]
    rows = list(enumerate(3 * texts))
    out = language_model.score_documents(table(spark, rows), F.col("doc_id") % 7 == 2)
    assert len(passes) == 3 and "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    split = {i: [*(t or "").lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in split.items() if i % 7 != 2 for w in ws)
    floor = math.log10(sum(c.values()) + len(c) + 1)
    got, scores = out.collect(), {}
    assert len(got) == len(rows) and len(c) > 20
    for r in got:
        assert r.n_known == sum(c[w] > 0 for w in split[r.doc_id]), r.doc_id
        assert r.base_score == pytest.approx(sum(math.log10(c[w] + 1) - floor for w in split[r.doc_id])), r.doc_id
        scores.setdefault(rows[r.doc_id][1], set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def test_language_model_places():
    """Words are found where a search by halves finds them, evenly spread or not."""
    rng = np.random.default_rng(5)
    even = rng.integers(0, 2**64, 3_000, dtype=np.uint64)
    for hashes in (even, even[:1], np.arange(900, dtype=np.uint64), np.append(even, np.uint64(2**63) + np.arange(500, dtype=np.uint64))):
        hashes = np.unique(hashes)
        n = len(hashes)
        vocab = language_model.Vocabulary(hashes, np.arange(n) + 1, np.minimum(np.arange(n), 700), n, n, 1.0, 0, 700)
        sought = np.concatenate([hashes, hashes + np.uint64(1), hashes - np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (vocab.place(sought) == np.minimum(np.searchsorted(hashes, sought), n - 1)).all()
        known, ids, logs = vocab.find(sought)
        assert (known == np.isin(sought, hashes)).all() and (ids[:n] == vocab.ids).all() and (ids[~known] == 700).all()
        assert np.allclose(logs[:n], np.log10(vocab.counts + 1)) and (logs[~known] == 0).all()


def test_language_model_gradients():
    """Backpropagation against finite differences; scoring in windows against one pass; probabilities sum to one."""
    rng = np.random.default_rng(2)
    net = language_model.Network.new(rng.integers(1, 50, 900).astype(float), 200.0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, language_model.UNKNOWN + 1, (2, 5, 3))
    h = np.zeros((3, language_model.HIDDEN))
    g, _, _ = net.gradients(x, y, h)
    for name in ("around", "inward", "bias", "classes", "class_bias"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        keep, e = net.p[name][at], 1e-5
        losses = []
        for d in (e, -e):
            net.p[name][at] = keep + d
            losses.append(net.gradients(x, y, h)[2])
        net.p[name][at] = keep
        assert abs((losses[0] - losses[1]) / (2 * e) - g[name][at]) < 1e-5, name
    h = rng.normal(0, 1, (1, language_model.HIDDEN))
    every = np.arange(language_model.UNKNOWN + 1)
    assert abs(np.exp(net.log_probability(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-9
    net.p["end"] = np.array([4])
    texts = [rng.integers(0, 1024, n) for n in (1, 70, 33, 2000, 5)]
    flat, first = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    for k, t in enumerate(texts):
        state, drive, total = np.zeros((1, language_model.HIDDEN)), net.p["embed"] @ net.p["inward"] + net.p["bias"], 0.0
        for before, word in zip([4, *t[:-1]], t, strict=True):
            state = net.step(drive[[before]], state)[-1]
            total += net.log_probability(state, np.array([word]))[0]
        assert abs(net.score(flat, first)[k] - total) < 1e-3 * abs(total)


def test_language_model_learns():
    rng = np.random.default_rng(3)
    texts = [np.array([5, 9, 700, 4] * 40) + (0 if rng.random() < 0.5 else 1) for _ in range(60)]
    net = language_model.Network.new(np.ones(1024), 1.0)
    losses = net.train(texts, passes=25)
    assert np.mean(losses[-5:]) < 0.5 * losses[0]


def test_language_model_trains_on_all(spark):
    """Every training text reaches the network, in shards whose weights are merged; the merged network has learned."""
    rng = random.Random(4)
    rows = table(spark, [(i, " ".join(["p q r s", "t u v w"][rng.random() < 0.5] for _ in range(3))) for i in range(6_000)])
    vocab = language_model.vocabulary(language_model.count_words(rows))
    shards = language_model.sharded(rows, vocab, 20_000).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("t")).collect()
    assert len(shards) == 4 and sum(r.n for r in shards) == 6_000 and sum(r.t for r in shards) == vocab.total == 78_000
    net = language_model.fit(rows, vocab, Scratch(spark), 20_000)
    assert net.seen == vocab.total
    ids = [int(vocab.find(np.array([word_hash(w)], np.uint64))[1][0]) for w in "pqrstuvw"]
    score = lambda t: net.score(np.array(t), np.array([0, len(t)]))[0]
    assert score(ids[:4]) > score([ids[0], ids[5], ids[2], ids[7]]) + 1


def test_language_model_output_grows(spark, monkeypatch):
    monkeypatch.setattr(language_model, "EACH", 256)
    small, large = (language_model.vocabulary(spark.range(n).select(F.col("id").alias("word"), F.lit(2).alias("c"))) for n in (5_000, 600_000))
    assert small.unknown == language_model.UNKNOWN < large.unknown == 49**2
    net = language_model.Network.new(np.ones(large.unknown), 5.0)
    every = np.arange(large.unknown + 1)
    assert abs(np.exp(net.log_probability(np.zeros((len(every), language_model.HIDDEN)), every)).sum() - 1) < 1e-4


# ---- 6 -----------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@given(st.text(max_size=60) | st.text(alphabet="ab'st \n\t\x1c\x85  <|endoftext|>é", max_size=80))
@settings(max_examples=400, deadline=None)
def test_bpe_text(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    model = bpe.load(PATH)
    assert model.encode(text).tolist() == ids
    assert model.decode(model.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_other_files():
    import copy
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    bpe.require(spec)
    for change in (lambda d: d["pre_tokenizer"].update(add_prefix_space=True), lambda d: d.update(normalizer={"type": "NFC"}), lambda d: d["model"].update(byte_fallback=True), lambda d: d["added_tokens"][0].update(lstrip=True)):
        other = copy.deepcopy({**spec, "model": {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}})
        change(other)
        with pytest.raises(ValueError, match="not implemented"):
            bpe.require(other)


def test_bpe_table(spark, library):
    rows = [*corpus(3, 30), (1, "<|endoftext|> it's  <|endoftext|>"), (2, "x" * 50_000)]
    got = Counter(tuple(r) for r in bpe.encode_digests(table(spark, rows), PATH).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[i, len(ids), *sha] += 1
    assert got == want
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in bpe.encode_documents(table(spark, rows), PATH).collect())
    assert bpe.encode_digests(empty(spark), PATH).collect() == []


# ---- 7 and 9 -----------------------------------------------------------------------------


def labelled(seed=5, n=600):
    rng = random.Random(seed)
    insults = ["nitwit", "blurgs", "snarfe", "snarfo", "snarfix", "dolt"]
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, rng.choice(list(LANG)), rng.choice([20, 60, 150])).split()
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            w = rng.choice([[x.upper() + "!!" for x in w], [x + "###" for x in w], [x for x in w for _ in range(9)]])
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "the of " * 20_000, None, None), (None, "the of", None, None)]
    labels += [(3, None, None), (None, 1, 1), (5000, 1, 1)]
    return rows, labels


@pytest.mark.parametrize(("target", "column", "fit", "score"), [("quality", 1, quality.fit, quality.score), ("toxic", 2, toxicity.fit, toxicity.score)])
def test_classifiers(spark, target, column, fit, score):
    rows, labels = labelled()
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = fit(docs, marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    got = score(docs, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [x for x in labels if x[0] in by and x[0] is not None and x[column] is not None and zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([(by[x[0]] >= 0.7) == bool(x[column]) for x in held]) > 0.95
    if target == "toxic":
        assert max(by[900], by[901], by[902]) < 0.7
    for nothing in (marks.where("false"), marks.where("quality is null")):
        assert len(score(docs, fit(docs, nothing)).collect()) == len(rows)
    assert score(empty(spark), model).collect() == []


def by_rules(terms):
    """What the grammar says of each hit of a clause, rule by rule: reported, else negated, else aimed at somebody."""
    out, near = [], toxicity.REACH
    for i, t in enumerate(terms):
        if t in toxicity.HITS:
            if "says" in terms[:i]:
                out.append(f"{t} quoted")
            elif "not" in terms[max(0, i - near) : i]:
                out.append(f"{t} negated")
            elif "aim" in terms[max(0, i - near) : i] or "aim" in terms[i + 1 : i + 1 + near]:
                out.append(f"{t} aimed")
            else:
                out.append(t)
    return out


@given(st.lists(st.sampled_from([*toxicity.CLASSES[:-1], "other", "other", "insult", "aim"]), max_size=14))
@settings(max_examples=600, deadline=None)
def test_composed_grammar(terms):
    """The composed machine against the rules, and its path's weight against the outcomes' weights."""
    weights = {o: 2.0**k for k, o in enumerate(toxicity.OUTCOMES)}
    found, weight = toxicity.read_clause(toxicity.cascade(weights), terms)
    assert found == by_rules(terms) and weight == sum(weights[o] for o in found)


def test_composition():
    """A composed transducer does as the two do one after the other, and so does every part of the cascade."""
    rng = random.Random(2)
    parts = [toxicity.negating(), toxicity.within_reach("aim", "aimed"), toxicity.overruling("says", "quoted")]
    one = toxicity.compose(toxicity.compose(*parts[:2], toxicity.READ), parts[2], toxicity.READ)
    for _ in range(300):
        terms = rng.choices(toxicity.READ, k=rng.randint(0, 12))
        want = terms
        for part in parts:
            want = part.run(want)[0]
        assert one.run(terms)[0] == want


def test_grammar():
    g = toxicity.grammar(["dolt"], [b"snarf"], dict.fromkeys(toxicity.OUTCOMES, 1.0), -1.0, (b"blurg",), ("blurgish",))

    def read(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return {o: int(n) for o, n in zip(toxicity.OUTCOMES, g.outcomes(data, np.array([0, len(data)]))[0], strict=True) if n}

    assert read("a Dolt, here") == {"insult": 1}
    assert read("you are a dolt") == read("dolt you are") == {"insult aimed": 1}
    assert read("he is not a dolt") == {"insult negated": 1}
    assert read("she said. dolt") == {"insult": 1}
    assert read("she said what a big fat dolt") == {"insult quoted": 1}
    assert read("snarf snarfest kill you kill") == {"insult aimed": 1, "menace aimed": 2}
    assert read("kill the time") == {"menace": 1} and read("blurgs blurgish Blurgo") == {"kin": 2}
    assert read("nothing at all") == {}
    # an outcome counts MOST times in a text
    few, many = (np.frombuffer(("dolt. " * n).encode(), np.uint8) for n in (toxicity.MOST, 50))
    assert g.score(few, np.array([0, len(few)]))[0] == pytest.approx(g.score(many, np.array([0, len(many)]))[0])


def plain_features(text):
    """quality's features of one text, one after the other."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, lower = share(range(65, 91)), share(range(97, 123))
    runs = Counter(words)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    symbols = b'"#$%&*+/<=>@[\\]^_`{|}~'
    return [
        math.log1p(n), sum(map(len, words)) / max(n, 1), upper / max(upper + lower, 1), share(symbols) / size, share(b"|") / size,
        share(range(48, 58)) / size, share(b"!") / size, sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(n - 1, 1), len(runs) / max(n, 1), max(runs.values(), default=0) / max(n, 1),
        share(b".,;:?") / max(n, 1), share(b"\n") / max(n, 1), 1 - len(set(triples)) / len(triples) if triples else 0.0, sum(w[-1] in symbols for w in words) / max(n, 1),
    ]


def test_quality_by_hand(spark):
    """The query's scores against sums of table entries, looked up feature by feature."""
    rows, labels = labelled(6, 300)
    rows += [(910, "a | b | c | 1 2 !!\n\n x", None, None), (911, "Ünï " * 40, None, None)]
    model = quality.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert model.pairs
    want = []
    for i, t, *_ in rows:
        x = plain_features(t or "")
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x, strict=True)]
        total = model.bias + sum(own[k] for own, k in zip(model.tables, bins, strict=True))
        total += sum(own[model.coarse[p][bins[p]], model.coarse[q][bins[q]]] for p, q, own in model.pairs)
        want.append((i, round(1 / (1 + math.exp(-total)), 9)))
    got = [(r.doc_id, round(r.score, 9)) for r in quality.score(table(spark, rows), model).collect()]
    assert Counter(got) == Counter(want)


# ---- 8 -----------------------------------------------------------------------------------


#: With the tiles of summaries cut small as well.
@pytest.mark.parametrize(("n", "block"), [(400, 8192), (700, 64), (700, 12)])
def test_embeddings(spark, monkeypatch, n, block):
    monkeypatch.setattr(embedding_dedup, "SUMMARIES", max(2, block // 8))
    rng = np.random.default_rng(n)
    base = rng.normal(0, 1, (40, 16))
    x = [(base[rng.integers(0, 40)] * rng.uniform(0.5, 3) + rng.normal(0, rng.choice([0, 0.1, 0.3, 0.5]), 16)).astype(np.float32) for _ in range(n)]
    rows = [(i * 2, v.tolist(), "l") for i, v in enumerate(x)]
    rows += [(9001, None, "l"), (9003, [0.0] * 16, "l"), (9005, [float("nan")] * 16, "l"), (9007, [None] * 16, "l"), (9009, [], "l"), (9011, [float("inf")] + [1.0] * 15, "l"), (9013, rows[3][1], "l"), (9013, rows[3][1], "l"), (9015, [1.0, 2.0], "l"), (9017, [2.0, 4.0], "l")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, h string")
    unit = {}
    for k, (_, v, _) in enumerate(rows):
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            a = np.array(v, float)
            unit[k] = a / np.sqrt((a * a).sum())
    links, pairs = Counter(), []
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                pairs.append((rows[a][0], rows[b][0]))
    root = classes(pairs, {r[0] for r in rows})
    want = Counter((r[0], links[k], root[r[0]], r[0] == root[r[0]]) for k, r in enumerate(rows))
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(df, block=block).collect())
    assert got == want
    assert embedding_dedup.near_duplicates(df.where("false")).collect() == []


def test_tight_clusters():
    """Two clusters far tighter than single precision can tell, astride the threshold: no pair is lost to a bound."""
    lost = links = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        a, b = np.linalg.qr(rng.normal(0, 1, (32, 2)))[0].T
        centres = [a, 0.9 * a + math.sqrt(1 - 0.81) * b]
        x = embedding_dedup.unit(np.concatenate([c + rng.normal(0, 10 ** rng.uniform(-6, -3.5), (41, 32)) for c in centres]))
        tree = embedding_dedup.CoverTree(x)
        near = tree.x @ tree.x.T >= 0.9
        seen = np.zeros_like(near)
        for i, j in embedding_dedup.dual(tree, tree, math.sqrt(0.2)):
            seen[i, j] = True
        lost += int((near & ~seen).sum())
        links += int(near[tree.order < 41][:, tree.order >= 41].sum())
    assert lost == 0 and links > 1000


def test_cover_tree():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(np.concatenate([rng.normal(0, 1, (300, 8)), np.repeat(rng.normal(0, 1, (5, 8)), 60, 0) + rng.normal(0, 0.05, (300, 8))]))
    tree = embedding_dedup.CoverTree(x)
    assert sorted(tree.order) == list(range(600))
    for k in range(len(tree.start)):
        own = tree.x[tree.start[k] : tree.end[k]]
        assert np.sqrt(((own - tree.x[tree.centre[k]]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-9
        kids = range(tree.low[k], tree.high[k])
        if kids:
            assert [tree.start[c] for c in kids] + [tree.end[k]] == [tree.start[k]] + [tree.end[c] for c in kids]
    near = {(i, j) for i in range(600) for j in range(600) if tree.x[i] @ tree.x[j] >= 0.9}
    found = {(i, j) for a, b in embedding_dedup.dual(tree, tree, math.sqrt(0.2)) for i in range(a.start, a.stop) for j in range(b.start, b.stop)}
    assert near <= found


# ---- 10 ----------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40))) + ". " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + ".") for k in range(60)]
    rows, want = [], set()
    for i in range(150):
        w = [rng.choice(words) for _ in range(rng.choice([0, 10, 100, 400]))]
        for k in rng.sample(range(60), rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(w))
            w = w[:at] + items[k][1].split() + w[at:]
            want.add((i, k))
        rows.append((i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    rows += [(900, None), (901, ""), (902, "w1 " * 30_000), (903, items[5][1]), (903, items[5][1])]
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (72, items[5][1]), (None, items[6][1])], "item_id bigint, text string")
    low = [(k, b" " + b" ".join(t.encode().lower().split()) + b" ") for k, t in items]
    whole = {(i, k) for i, t in rows for k, x in low if x in b" " + b" ".join((t or "").encode().lower().split()) + b" "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, rows), bench).collect()}
    assert whole <= got and (903, 72) in got
    assert all(p in want or p[0] == 903 or p[1] == 72 for p in got)
    kept = decontaminate.decontaminate(table(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert kept.columns == table(spark, rows).columns
    assert decontaminate.find_leaks(empty(spark), bench).collect() == []
    assert decontaminate.find_leaks(table(spark, rows), bench.where("false")).collect() == []


def test_decontamination_by_hand(spark):
    """Whole and partial passages: every window of every text scored against every item, without an index."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    sentence = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high))) + "."
    items = [(k, f"{sentence(8, 25)} {sentence(2, 6)}") for k in range(25)]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        own = items[i % 25][1].split()
        for at in rng.sample(range(len(own)), rng.randint(0, len(own) // 3)):
            own[at] = rng.choice(words)
        rows.append((i, " ".join([*w, *own[rng.choice([0, 0, 2, 6]) :], *rng.choices(words, k=rng.randint(0, 90))])))
    docs = {k: t.split() for k, t in items}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in df}
    weight = {k: {w: idf[w] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, f in Counter(d).items()} for k, d in docs.items()}
    step = max(map(len, docs.values()))
    grams = lambda w, size: {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
    want, sure, total = {}, set(), len(rows)
    for i, t in rows:
        w = t.split()
        for at in range(0, len(w), step):
            passage = w[at : at + 2 * step]
            for k, d in docs.items():
                score = sum(v for x, v in weight[k].items() if x in set(passage)) / sum(weight[k].values())
                cut = max(j for j, x in enumerate(d[:-1]) if x.endswith(".")) + 1
                shares = []
                for part in (d[:cut], d[cut:]):
                    size = min(3, len(part))
                    shares.append(len(grams(part, size) & grams(passage, size)) / len(grams(part, size)))
                if score >= 0.7 and min(shares) >= 0.6:
                    want[i, k] = max(want.get((i, k), (0.0, 0.0, 0.0)), (score, *shares))
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontaminate.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) == set(want) and 30 < len(want) < total
    assert all(got[p] == pytest.approx(want[p], abs=1e-6) for p in want)


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_wand_is_exhaustive(seed):
    rng = random.Random(seed)
    index = decontaminate.Index.build([(k, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.randint(1, 25)))) for k in range(rng.randint(1, 150))])
    terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, len(index.terms))))
    limit = rng.choice([0.05, 0.3, 0.6])
    for group, postings in enumerate(index.postings):
        total = Counter()
        for t in terms:
            if t in postings:
                for item, impact in zip(*postings[t][:2], strict=True):
                    total[item] += impact
        assert {i for i, s in total.items() if s >= limit} == {i for i, _ in index.retrieve(terms, group, limit)}


def test_decontamination_blocks_agree(spark, monkeypatch):
    """Items dealt to blocks get the scores that one index gives them, edited copies near the threshold too."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    items = [(k, " ".join(rng.choice(words[: 20 + 3 * k]) for _ in range(rng.randint(12, 40))) + ". " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + ".") for k in range(30)]
    rows = []
    for i in range(200):
        w = items[i % 30][1].split()
        for at in rng.sample(range(len(w)), rng.randint(0, len(w) // 4)):
            w[at] = rng.choice(words)
        rows.append((i, " ".join([*rng.choices(words, k=50), *w, *rng.choices(words, k=70)])))
    bench = spark.createDataFrame([*items, (70, None), (71, "")], "item_id bigint, text string")
    found = lambda: {(r.doc_id, r.item_id): round(r.score, 4) for r in decontaminate.find_leaks(table(spark, rows), bench, overlap=0.2).collect()}
    one = found()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert len(one) > 100 and min(one.values()) < 0.95 and found() == one
