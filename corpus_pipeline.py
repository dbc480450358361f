"""A training corpus out of documents: five stages, each one operator of framewright.llm.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet and read again before the next. What goes and what stays:

1. language_id: documents whose language the classifier rejects go.
2. ngram_join: of each group of near copies the document with the smallest id stays; of equal rows one.
3. substring_dedup: words of passages that start in a document with a smaller id go; documents that
   so lose all their words go.
4. decontamination: documents that hold a benchmark item go.
5. bpe: the rest is encoded, and decoded again; this last stage returns doc_id, lang, source,
   n_tokens, ids, and whether decoding gives the text back.

Null and empty texts have no language and go in the first stage; an empty table stays empty; extra
columns are carried through the filtering stages.

The stages run in the same executors, whose heaps grow with each: every stage first lets them shrink.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontaminate, language_id, ngram_join, substring_dedup
from framewright.llm.common import Scratch, fold, read, settle
from framewright.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def settled(stage: Stage) -> Stage:
    """stage, before which executors give back what earlier ones left in their heaps."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


@settled
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.language_filter(docs, language_id.fit(docs.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(True)))))


@settled
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_representatives(docs)


@settled
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_documents(docs)


@settled
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


@settled
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path(), ("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", by_language),
    ("ngram_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: A trained classifier and tokenisation are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
