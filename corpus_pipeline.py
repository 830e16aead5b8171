"""Corpus pipeline: quality rules, exact and near duplicates, source mixing, packing.

``run`` applies the stages to ``documents``; each stage's rows are written to the shared folder and read again, so a
stage never depends on the plan before it. Write a stage's rows before the next stage begins: its scratch tables, and
no others, are then deleted. All but the last return the columns of ``documents``.

Defined cases of every stage: null text counts as empty, and an empty text fails the quality rules; null doc_ids and rows
that repeat are rows of their own until a duplicate stage keeps one of them; a text is read whole, however long; an
empty table gives no rows; extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens.llm import exact, mixing, packing, quality, runs, simhash
from brewlens.llm.common import Scratch, shared

_scopes: list[Scratch] = []


def _scope(spark: SparkSession) -> Scratch:
    """A scope for a stage that begins; what the stage before it left is deleted."""
    while _scopes:
        _scopes.pop().release()
    _scopes.append(Scratch(spark))
    return _scopes[-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio (its model is counted over all of ``docs``)."""
    with _scope(spark):
        labels = runs.table(spark, sf_dir, "labels")
        return quality.passing(docs, quality.fit(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with _scope(spark):
        return exact.deduplicated(docs, exact.DigestIndex(spark))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: fingerprints within four bits, as ``op7_simhash`` links them.

    That is closer than a five-word similarity of 0.8, at which fingerprints differ by about ten bits of 64.
    """
    with _scope(spark):
        return simhash.deduplicated(docs)


#: A mixture of unlike parts would throw away most of a corpus if each document could be used once and the weights
#: held to the last; nine tenths of the words are spent, each at most once, and what a leaf lacks goes to others.
MIX_EPOCHS = 1


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the hierarchical budgets take."""
    with _scope(spark):
        return mixing.mixed(docs, F.expr(runs.DOMAIN), F.expr(runs.BUDGET), runs.WEIGHTS, MIX_EPOCHS, runs.MIX_SEED)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, one a sequence."""
    with _scope(spark):
        return runs.piece_digests(packing.pack(docs, public_tokenizers.path(runs.VOCABULARY)))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, hashed likelihoods and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
