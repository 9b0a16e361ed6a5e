"""Working columns stay out of the way of the tables' own, whatever those are called."""

import corpus_pipeline
import pytest
from costweave.llm import pseudonyms, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
OWN = ["__pairs", "pairs", "__row", "row", "Toxicity", "Score", "a.b", "own", "Count", "tick`"]


@pytest.fixture(scope="module")
def crowded(spark, docs):
    out = docs.limit(60).withColumn("text", F.concat("text", F.lit(" write to ada.l@example.org")))
    for i, name in enumerate(OWN):
        out = out.withColumn(name, F.concat(F.lit(f"{i} of "), F.col("doc_id").cast("string")))
    return out.cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, crowded, name):
    after = dict(corpus_pipeline.STAGES)[name](spark, crowded, SF)
    assert after.columns == crowded.columns
    rows = after.collect()
    assert rows
    for r in rows:
        assert [r[n] for n in OWN] == [f"{i} of {r.doc_id}" for i in range(len(OWN))]


def test_packing_of_crowded_documents(spark, crowded):
    pieces = corpus_pipeline.packed(spark, crowded, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in crowded.collect()}


def test_a_named_column_replaces_its_like(spark, crowded):
    out = pseudonyms.pseudonymised(crowded, "key", "count")
    assert [c.lower() for c in out.columns] == [c.lower() for c in crowded.columns]
    assert all(r["count"] >= 1 and "ada.l@" not in r.text for r in out.collect())
    model = toxicity.learn(crowded, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.scored(crowded, model, "score")
    assert "Score" not in scored.columns and all(0 <= r.score <= 1 for r in scored.collect())
