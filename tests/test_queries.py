"""Every registered query of the timeline engine against its SQL in DuckDB."""

import os

import duckdb
import pytest
from tests.conftest import data_dir

from framewright.functions.text import ratio
from framewright.queries import ORACLES, QUERIES

TABLES = "embeddings conversations pages events documents benchmark supplier part".split()


@pytest.fixture(scope="module")
def duck():
    con, at = duckdb.connect(), data_dir("sf0.001")
    for t in TABLES:
        path = f"{at}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, data_dir("sf0.001"))
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    if name not in ORACLES:
        assert got
        return
    result = duck.sql(ORACLES[name])
    at = [result.columns.index(c) for c in columns]
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in result.fetchall())))


def test_fuzzy_match_is_whole(spark, tmp_path):
    """Whole texts against every supplier: the like name stands beyond 24 letters, and under any key."""
    names = [(k, f"Supplier#{k * 7919 % 100_003:09d}") for k in range(600)]
    texts = [(i, "é " * 20 + names[(i * 37 + 11) % 600][1] + " of the house\nby the river") for i in range(12)]
    spark.createDataFrame(names, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.pos, r.title, r.score) for r in QUERIES["title_fuzzy_match"](spark, str(tmp_path)).collect()}
    best = {i: max((ratio(t, n), -k) for k, n in names) for i, t in texts}
    assert got == {i: (-k, names[-k][1], s) for i, (s, k) in best.items()}
