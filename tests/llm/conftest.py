"""Inputs shared by the tests of the training-data operators."""

from __future__ import annotations

import pytest

from release_guard.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """All rows of the smallest documents table as (doc_id, text)."""
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


ODD_TEXTS = [
    None, "", " ", "   \n\t ", "a", "a b", "a  b   c    ", "\n\n  x\n y   z  w", "don't  I'll\nwe've. End.\nNext, one!",
    "<|endoftext|> and<|startoftext|>x <|endoftext|>, <|endo ftext|>", "ÀÉÎ straße Ünïcödé. ẞ ΣΣ ΟΔΟΣ é ́x",
    "漢字かな交じり文 한국어 русский عربي ไทย", "x" * 3000, "ab " * 2000, "1234567890 " * 50, "🙂🙃 \U0001f468‍\U0001f469", "A\x1cB \x85 C\x1f D",
    "tab\tseparated\r\nlines \r\n", "end. \nNext. \n\n  Third", "trailing \n",
]


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, odd and long texts; a repeated row, a repeated id, rows without an id."""
    rows = [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    return [*rows, (1005, "a b"), (1005, "another text of the same id"), (None, "no id"), (None, None), (None, "no id")]


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text), with columns whose names clash with those of the operators."""

    def make(pairs):
        rows = [(d, t, "en", "s", 0, 1, 2, 3, 4, 5, 6) for d, t in pairs]
        extra = ", key long, text_key long, n_tokens long, doc long, place long, block long"
        return spark.createDataFrame(rows, DOCS + extra).repartition(3)

    return make
