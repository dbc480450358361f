"""The pipeline on a small corpus: what each stage keeps, against brute force."""

import random

import duckdb
import pytest
from tests.conftest import data_dir
from tests.llm.test_llm_operators import LANG, classes, prose, removed, shingles

import corpus_pipeline
from framewright.llm.queries import oracle_sql, queries, tokenizer_path


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    items = [(k, prose(rng, "en", 25) + f" q{k} r{k} s{k}. the answer is u{k} v{k}.") for k in range(5)]
    rows = [(i, " ".join(f"{w}{rng.randrange(60)}" if rng.random() < 0.3 else w for w in prose(rng, lang, 130).split()), lang, "s", 5) for i, lang in enumerate(rng.choices(list(LANG), k=90))]
    passage = " ".join(f"{w}{100 + k}" for k, w in enumerate(prose(rng, "en", 60).split()))
    rows += [(200, rows[3][1], "en", "s", 5), (201, rows[3][1].replace(".", "", 1), "en", "s", 5), (202, "1234 !!", "en", "s", 5), (203, None, "en", "s", 5)]
    rows += [(210 + k, prose(rng, "en", 100) + " " + passage, "en", "s", 5) for k in range(3)]
    rows += [(220, prose(rng, "en", 60) + " " + items[2][1], "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, now, after = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after[name] = now.collect()
        assert name == "bpe" or now.columns == names

    first = {r.doc_id: r.text for r in after["language_id"]}
    assert not {202, 203} & set(first) and len(first) >= len(rows) - 4
    sets = {i: shingles(t) for i, t in first.items()}
    want = classes([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    second = {r.doc_id: r.text for r in after["ngram_join"]}
    assert second == {i: first[i] for i in first if want[i] == i} and not {200, 201} & set(second)
    third = {r.doc_id: r.text for r in after["substring_dedup"]}
    gone = {k[0]: k[2] for k in removed(list(second.items()), 50)}
    assert {i: len(second[i].split()) - len(third[i].split()) for i in third} == {i: gone[i] for i in third}
    assert gone[211] >= 60 and gone[210] == 0
    fourth = {r.doc_id: r.text for r in after["decontamination"]}
    assert set(third) - set(fourth) == {220}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: list(r.ids) for r in after["bpe"]} == {i: library.encode(t, add_special_tokens=False).ids for i, t in fourth.items()}
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, tuple(r.ids)) for r in after["bpe"]}


def test_stages_let_heaps_shrink(spark):
    """What earlier stages left in an executor's heap is collected before the next one starts."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "Mark" in b.getName())
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[-1:]:
        before = full()
        stage(spark, docs, "")
        assert full() > before, name


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    """The queries that SQL can express against DuckDB, on the smallest tables."""
    con, at = duckdb.connect(), data_dir("sf0.001")
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    found = queries()[name](spark, at)
    columns = sorted(found.columns)
    want = con.sql(oracle_sql()[name])
    places = [want.columns.index(c) for c in columns]
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    assert got and got == sorted(map(repr, (tuple(r[i] for i in places) for r in want.fetchall())))


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 11))
