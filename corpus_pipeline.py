"""A corpus pipeline of five stages over ``documents``; each stage is one operator on all of its input.

Toxic documents go, one document of each near-duplicate class stays, repeated passages are cut,
sources are mixed to target weights, and what is left is packed into bins.

Stages take nulls in any column, empty and repeated rows and extra columns of any name. Rows that
share an id are judged by their own texts, but stay or go together in the near-dedup stage, and so do
rows with null ids; rows with null ids lose no passages. Empty tables pass through every stage: without
labels nothing is toxic, and the last stage returns its columns without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from svspark.llm import minhash, mixing, packing, substrings, toxicity
from svspark.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the chain, fitted on the labelled ones of the corpus, finds clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels, ["quality", "toxic"])
    return toxicity.keep_clean(docs, chain, "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class at five words and a similarity of 0.8."""
    return minhash.keep_one(docs, percent=80, width=5, bands=40)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that an earlier document has; documents left empty go.

    A document that loses words keeps the others joined by single spaces, and n_chars follows.
    """
    return substrings.without_repeats(docs, window=50, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix to the sources' target weights takes it, in the order of its schedule."""
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; a bin has no two documents of a source and no document twice."""
    return packing.pack(docs, capacity=2048, cluster="doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can't express the fitted chain; the stages are tested against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
