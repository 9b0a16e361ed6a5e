"""The pipeline's stages one by one: decisions take effect, clean documents stay, rows are whole."""

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "pseudonyms", "packing"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        ids, kept = [r.doc_id for r in before.collect()], [r.doc_id for r in after.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= set(ids)
        assert len(kept) > 0.5 * len(ids), name
        if name == "pseudonyms":
            assert sorted(kept) == sorted(ids)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}


def test_every_operator_is_registered(spark):
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert names["pipeline"](spark, SF).count() > 0


def test_empty_documents(spark, no_docs):
    rows = no_docs
    for _, stage in corpus_pipeline.STAGES[1:]:
        rows = stage(spark, rows, SF)
    assert rows.count() == 0


def test_a_worker_remembers_one_kind_of_work(tokenizer_path):
    from costweave.llm.shared import forget_others
    from costweave.llm.tokens import encoder

    first = encoder(tokenizer_path)
    assert encoder(tokenizer_path) is first
    forget_others()
    assert encoder(tokenizer_path) is not first


def test_texts_do_not_come_back_from_python(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang")
    weights, letters = {"fox!": 6.0, "fox": 6.0}, corpus_pipeline.toxicity.Letters.of({"fox": 1.0}, 4)
    model = corpus_pipeline.toxicity.Model(weights, letters, [-4.0, 2.0, 0.0, 0.0], corpus_pipeline.toxicity.Toxicity())
    kept = corpus_pipeline.toxicity.without_toxic(docs, model)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    rows = sorted(map(str, docs.collect()))
    assert sorted(map(str, kept.collect())) == [r for r in rows if "fox" not in r]


def test_only_given_keys_go(spark):
    from costweave.llm.shared import without_keys

    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (None, "c", "x"), (2, "d", None), (3, "e", "y")],
                                 "k long, `te.xt` string, maybe string")
    gone = spark.createDataFrame([(1,), (3,), (9,)], "k long")
    left = without_keys(rows, "k", gone)
    assert left.columns == ["te.xt", "maybe"]
    assert sorted(r["te.xt"] for r in left.collect()) == ["c", "d"]
    assert without_keys(rows, "k", gone.limit(0)).count() == 5


def test_pseudonyms_stage_takes_odd_values(spark):
    """A secret of one digit ended the stage by a failed cast, a long list of numbers by a full stack."""
    texts = ["password=1...", "password=(((9", "1 " * 5_000 + "bob.17@a.example.com", "no value"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    stage = dict(corpus_pipeline.STAGES)["pseudonyms"]
    after = [r.text for r in stage(spark, docs, SF).orderBy("doc_id").collect()]
    assert list(map(len, after)) == list(map(len, texts)) and after[3] == texts[3]
    assert after[0].startswith("password=") and after[0].endswith("...") and after[1].startswith("password=(((")
    assert after[2].startswith(texts[2][:10_000]) and after[2].endswith("@a.example.com") and after[2] != texts[2]
