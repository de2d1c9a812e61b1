from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Null, empty, blank, one letter, repeated rows, ties, a very long text, characters of many kinds.
TEXTS = [
    None,
    "",
    "  \n\t ",
    "a",
    "The cat sat on the mat and then the cat sat on the mat again while it rained all day long here",
    "The cat sat on the mat and then the cat sat on the mat again while it rained all day long here",
    "der Hund lief über die Straße und bellte laut\nder Hund lief über die Straße und bellte laut",
    "naïve Café 日本語 😀 <|endoftext|> x\x85y  z \n b ",
    "word " * 30_000,
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.5, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, Kept string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
