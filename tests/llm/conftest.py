import os

import pytest

#: As in tests/conftest.py, in whose place this module is found when both folders are collected.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns of clashing names."""
    texts = [None, "", " ", "\n\n", "a", "a a a a", "one two three four", "one  two\t three four ",
             "The Quick. Brown fox! jumps" * 3, "word " * 20_000, "x" * 5_000, "日本語 テキスト", "　é　",
             "<|endoftext|> special", "one two three four"]
    rows = [(i if i != 6 else None, t, None if i % 3 else "en", i / 2, "kept") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, fp string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
