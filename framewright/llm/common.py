"""What the operators of this subpackage share: tables, scratch space, word hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy steps work on at a time; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20


#: Rows of an Arrow batch that go to a Python worker and come back. Spark's own default is this times five.
ARROW_ROWS = 2_000


def modest(spark: SparkSession) -> None:
    """Let texts travel in batches of ARROW_ROWS rows, unless the session has a limit of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shielded(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with neutral names for all columns but the needed ones, so that none can clash; and what gives the names back."""
    modest(docs.sparkSession)
    inner = {c: c if c in needed else f"_col{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*inner.values()), lambda df: df.select(*(F.col(i).alias(c) for c, i in inner.items()))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; in local mode the warehouse will do."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return at


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give memory that is free inside this process back to the system, tables for a very long text among it."""
    if len(_powers[0]) > 1 << 20:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Let every executor's JVM collect its garbage: a heap that has grown to its limit then shrinks, and the Python workers have room beside it."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker (which Spark keeps for later tasks) gives its memory back."""

    @functools.wraps(run)
    def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return with_end


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches, so many that they have about that many rows."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            some.append(batch)
        if sum(map(len, some)) >= rows:
            yield some
            some = []
    if some:
        yield some


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        modest(spark)
        self.spark, self.root = spark, f"{scratch_dir(spark)}/framewright-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """df as the one table that stays of this scratch space."""
        kept = Scratch(self.spark)
        out = kept.put(df, name)
        self.drop("")
        return out

    def tidy(self) -> None:
        """Let Spark remove the shuffle files of plans that are done with: it does when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids hash to so many buckets; a table of buckets has no more rows than that, whatever the corpus.
BUCKETS = 1 << 18


def bucket(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def among(rows: DataFrame, wanted: DataFrame, how: str = "left_semi", key: str = "doc_id") -> DataFrame:
    """rows whose key may be wanted (left_semi), or is not (left_anti): by the bounded table of wanted buckets, without a shuffle of rows."""
    own = F.broadcast(wanted.select(bucket(F.col(key)).alias("_bucket")).distinct())
    return rows.join(own, bucket(rows[key].cast("long")) == own["_bucket"], how)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows whose id is not in gone (a written table of doc_id); only rows that may be in it are shuffled."""
    some = among(rows, gone)
    left = some.join(gone.select(F.col("doc_id").alias("gone")).hint("merge"), some["doc_id"].cast("long") == F.col("gone"), "left_anti")
    return left.unionByName(among(rows, gone, "left_anti"))


def spread_sample(df: DataFrame, key: Column, limit: int, seed: int) -> Column:
    """A condition that holds for about limit of df's rows, chosen by a seeded hash of key; all rows if there are fewer."""
    rows = df.count()
    share = 1.0 if rows <= limit else limit / rows
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30))


# ---- word hashes over Arrow text ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters of any script, by byte: everything else parts terms.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data], to read only, for a table of 256 bytes or booleans."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals of Latin-1, in UTF-8."""
    out = _LOWER[data]
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1
    second = out[lead]
    out[lead] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second | 0x20, second)
    return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, n.bit_length())
        for k, base in enumerate((int(_MULT), pow(int(_MULT), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a run of texts: hashes, byte spans, and where each text's words begin.

    terms: case is folded beyond A-Z, and words are runs of letters, digits and apostrophes.
    """

    __slots__ = ("_total", "data", "ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, terms: bool = False):
        n = len(data)
        if lower:
            data = fold_case(data) if terms and n else mapped(data, _LOWER)
        self.data = data
        if n == 0:
            self._total = np.zeros(1, np.uint64)
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
            return
        solid = mapped(data, ~(_GAP if terms else _SPACE))
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        cuts = offsets[:-1][offsets[:-1] < n]
        begin[cuts] = solid[cuts]
        end = solid.copy()
        end[:-1] &= ~solid[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        end[last] = solid[last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        self.first = np.searchsorted(self.starts, offsets)
        self._total = total

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Hash of each word's first size bytes; 0 for words of no more bytes."""
        starts = np.where(self.ends - self.starts > size, self.starts, 0)
        _, inverse = _power_tables(len(self._total))
        hashes = mix((self._total[np.minimum(starts + size, len(self.data))] - self._total[starts]) * inverse[starts])
        return np.where(self.ends - self.starts > size, hashes, np.uint64(0))


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive hashes; the result has k - 1 fewer entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed * 2 + 1))
    for j in range(k):
        out = out * _MULT + hashes[j : j + n]
    return mix(out)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; nulls are empty texts. Texts are never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_chunks(column: pa.Array, lower: bool, most: int = CHUNK_BYTES, terms: bool = False) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, offsets in text_chunks(column, most):
        yield i, j, Words(data, offsets, lower, terms)


def word_hash(word: str) -> int:
    """The hash that Words gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(mix((_BYTE[data] * _power_tables(len(data) + 1)[0][: len(data)]).sum(keepdims=True))[0])
