"""The corpus pipeline: cleaning stages over documents, and packing of what they keep."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from costweave.llm import decontamination, minhash, packing, pseudonyms, simhash, toxicity
from costweave.llm.queries import BYTE_BPE, KEY_SETTING, SAMPLE_KEY
from costweave.llm.shared import read, shipped, small_batches, written


@shipped
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels of ``sf_dir``, does not reject."""
    with small_batches(spark):
        model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


@shipped
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest doc_id. Documents are linked by op10's
    fingerprints (4-word shingles, 4 bits), and where at least four fifths of their five-word shingles are shared,
    which a radius of 4 does not reach."""
    def similar(texts: DataFrame) -> DataFrame:
        return minhash.near_duplicates(texts, least=0.8, width=5, empty_alike=True)

    return simhash.one_of_each(docs, lambda texts: simhash.alike_by_any(texts, simhash.near_duplicates, similar))


@shipped
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item of the benchmark occurs."""
    return decontamination.without_items(docs, read(spark, sf_dir, "benchmark"))


@shipped
def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values in their texts replaced."""
    return pseudonyms.pseudonymised(docs, spark.conf.get(KEY_SETTING, SAMPLE_KEY))


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    with small_batches(spark):
        return written(packing.pack(docs, public_tokenizers.path(BYTE_BPE), end_id=1), "pieces")


STAGES = [("toxicity", without_toxic), ("near-dedup", without_copies),
          ("decontamination", without_benchmark), ("pseudonyms", pseudonymised), ("packing", packed)]
#: Learned scores, hashed fingerprints, keyed permutations and tokenizers are not expressed in SQL;
#: the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
