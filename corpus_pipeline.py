"""Cleaning a corpus of documents: the stages in order, each on what its predecessor kept.

language  documents whose language is not identified go
near_dup  one document of each group of near-duplicates stays (the one with the smallest id)
pii       personal data and the terms that give it away are replaced in the texts
mix       every source is taken towards its target weight; a document appears as often as it is taken
bpe       token ids and the decoded text of every document that is left
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelquilt.llm import bpe, langid, mixing, ngram_join, pii
from pixelquilt.session import configure, stash

STAGES = [
    ("language", lambda spark, docs, sf_dir: langid.keep_identified(docs)),
    ("near_dup", lambda spark, docs, sf_dir: ngram_join.keep_one(docs)),
    ("pii", lambda spark, docs, sf_dir: pii.sanitise(docs)),
    ("mix", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("bpe", lambda spark, docs, sf_dir: bpe.encode(docs)),
]

# language ID, the sanitiser and the encoder cannot be written as SQL; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
