"""A corpus pipeline of five stages over ``documents``: each filters or cuts what its predecessor kept, and the last packs it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rulequarry.llm import exact, near_texts, packing, suffix, toxicity
from rulequarry.session import Scratch, ship


_left: dict[str, list[Scratch]] = {}


def _space(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str) -> Scratch:
    """Scratch space of a stage. What earlier stages of the same corpus left goes, unless ``docs`` reads it: a stage starts when the output of the one
    before is written. Stages of other folders are let be."""
    own = _left.setdefault(sf_dir, [])
    read = {part for f in docs.inputFiles() for part in f.split("/")[:-1]}
    for old in [x for x in own if os.path.basename(x.root) not in read]:
        own.remove(old)
        if old.spark.sparkContext._jsc is not None:  # a session that has ended takes its folder along
            old.clear()
    own.append(Scratch(spark, name))
    return own[-1]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labels of ``sf_dir``."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    ship(spark)
    return exact.drop_exact_copies(docs, _space(spark, docs, sf_dir, "exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of texts whose shingles of five words have a Jaccard similarity of 0.8 or more the smallest doc_id stays."""
    ship(spark)
    return near_texts.drop_near_copies(docs, _space(spark, docs, sf_dir, "near"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occurred before are cut from the texts; the first occurrence stays."""
    ship(spark)
    return suffix.drop_later_copies(docs, _space(spark, docs, sf_dir, "suffix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    ship(spark)
    return packing.pack_documents(docs, added=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("packing", pack)]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again for the next."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
