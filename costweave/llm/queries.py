"""The registered query of each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from costweave.llm import (decontamination, id_store, language, minhash, nearest, packing, periodic, pitman_yor,
                           prefix_counts, pseudonyms, repair, simhash, toxicity)
from costweave.llm.shared import read, remainder_of_crc, shipped
from costweave.registry.entries import Entries
from costweave.sources.scratch import scratch_path

BYTE_BPE = "byte_bpe_50k.json"
#: A sample key; whoever runs this on data of their own sets one that only they know.
KEY_SETTING, SAMPLE_KEY = "costweave.pseudonym.key", "sample key"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_counts.prefix_counts(read(spark, sf_dir, "documents"),
                                         public_tokenizers.path(BYTE_BPE), budget=512)
    return counts.withColumn("over_limit", F.col("fits_bytes") < F.col("n_bytes"))


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "ids")
    id_store.write_ids(read(spark, sf_dir, "documents"), root,
                       public_tokenizers.path(BYTE_BPE), end_id=2)
    return id_store.read_ids(spark, root).drop("file")


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", (remainder_of_crc(F.col("doc_id"), 7) != 2).alias("train"))
    return pitman_yor.score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
                                         "n_known", "train_tokens", "base_score", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), k=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "score").select(
        "doc_id", (remainder_of_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                    spark.conf.get(KEY_SETTING, SAMPLE_KEY), "n_replaced")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.learn(docs)).withColumn(
        "held_out", remainder_of_crc(F.col("doc_id"), 4) == 2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_periodic_tails(read(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumns({"longest": longest, "lines": lines}).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), least=0.8, width=2).withColumn(
        "kept", F.col("doc_id") == F.col("component_id"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = repair.repairs(repair.damaged(rows)).withColumnRenamed("conv_id", "own_id")
    every = rows.select(F.col("conv_id").cast(found.schema["own_id"].dataType)).distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_prefix_counts, op3_id_store, op4_pitman_yor, op5_nearest, op6_toxicity, op7_pseudonyms,
    op8_language, op9_packing, op10_simhash, op11_periodic_runs, op12_minhash,
    op13_conversation_repair)}


def register(entries: Entries) -> None:
    for name, query in QUERIES.items():
        entries.add(name, shipped(query))
