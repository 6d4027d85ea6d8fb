"""The corpus pipeline: raw documents to token ids, in five stages.

toxicity            documents that the classifier rejects go
simhash_near_dedup  of each group of near copies (five-word shingles, similarity from 0.8 on; the
                    tries of SimHash fingerprints and bands of minima find them) the document with the smallest doc_id stays
substring_dedup     passages that an earlier document holds are taken out of later ones
decontamination     documents that hold a benchmark item go
sentencepiece       the rest is encoded and decoded: doc_id, ids, and whether the text came back

A stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
documents. Stages are meant to be written out in between, as `run` does with checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meandra.llm import decontamination, nearcopies, pieces, queries, substrings, toxicity
from meandra.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicate(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trips(docs, pieces.read_model(queries.PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", remove_passages),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenise),
]

#: Hashes, compression and tokenisation are beyond SQL: each stage is tested against a brute-force version of it, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
