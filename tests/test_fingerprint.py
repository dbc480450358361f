"""Fingerprint algebra on the known vectors, and round trips."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import fingerprint as fp
from framewright.functions.phash import hash_frames, phash


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_known_vectors(spark):
    matrix = [1, 1, 0, 1, 0, 1, 0, 1] + [0] * 56
    other = matrix.copy()
    other[18] = 1
    a, b = (fp.from_matrix(F.array(*(F.lit(bool(x)) for x in m))) for m in (matrix, other))
    row = one(spark, bits=fp.to_bits(a), hex=fp.to_hex(a), n=fp.popcount(a), d=fp.hamming(a, b), short=fp.to_short_hex(a))
    assert row.bits == "11010101" + "0" * 56
    assert (row.hex, row.n, row.d, row.short) == ("d500000000000000", 5, 1, "0xd500000000000000")


def test_hex_to_binary_text(spark):
    row = one(spark, a=fp.hex_to_binary_text(F.lit("c165924de35876d9")), b=fp.hex_to_binary_text(F.lit("0f")), c=fp.hex_to_binary_text(F.lit("0xff")), d=fp.hex_to_binary_text(F.lit("0")))
    assert row.a == "1100000101100101100100100100110111100011010110000111011011011001"
    assert (row.b, row.c, row.d) == ("1111", "11111111", "0")


def test_round_trips(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 255, -256]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = rows.select("v", fp.from_hex(fp.to_hex(F.col("v"))).alias("a"), fp.from_bytes(fp.to_bytes(F.col("v"))).alias("b"), fp.from_hex(fp.to_short_hex(F.col("v"))).alias("c"), fp.popcount(F.col("v")).alias("n"))
    for r in got.collect():
        assert r.a == r.b == r.c == r.v
        assert r.n == bin(r.v & (2**64 - 1)).count("1")


def test_entropy(spark):
    for text in ("0000", "0123456789abcdef", "aab", "f"):
        n = len(text)
        want = -sum(c / n * math.log(c / n) for c in Counter(text).values())
        row = one(spark, e=fp.entropy(F.lit(text)), two=fp.entropy(F.lit(text), base=2))
        assert math.isclose(row.e, want, abs_tol=1e-12)
        assert math.isclose(row.two, want / math.log(2), abs_tol=1e-12)


def test_phash(spark):
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, (20, 32, 32)).astype(np.uint8)
    hashes = hash_frames(frames)
    assert all(bin(int(h) & (2**64 - 1)).count("1") == 32 for h in hashes)
    flat = hash_frames(np.stack([np.full((32, 32), v, np.uint8) for v in (0, 77, 255)]))
    assert all(bin(int(h) & (2**64 - 1)).count("1") <= 1 for h in flat)
    rows = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(frames)] + [(99, bytearray(b"short")), (100, None)], "i int, g binary")
    got = {r.i: r.h for r in rows.select("i", phash(F.col("g")).alias("h")).collect()}
    assert [got[i] for i in range(20)] == hashes.tolist()
    assert got[99] is None and got[100] is None
    # brightness and contrast leave all but the first coefficient's place in the order as it is
    soft = hash_frames((frames // 2).astype(np.uint8))
    assert np.mean([bin(int(a ^ b) & (2**64 - 1)).count("1") for a, b in zip(hashes, soft, strict=True)]) < 4


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=40), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_fold_matches_loop(values, distance):
    from framewright.operators.keyframes import fold

    kept, last = [], None
    for v in values:
        if last is None or bin((v ^ last) & (2**64 - 1)).count("1") >= distance:
            last = v
            kept.append(True)
        else:
            kept.append(False)
    got, end = fold(np.array(values, np.int64), None, distance)
    assert got.tolist() == kept and end == last
