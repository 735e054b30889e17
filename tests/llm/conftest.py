"""Small documents with every odd case that the operators define."""

from __future__ import annotations

import pytest
from helpers import SF_DIR

ODD = [
    (9001, None), (9002, ""), (9003, " \t\n "), (9004, "one"), (9005, "one two"), (9006, "don't  won't\n\n  stop   \r\n"),
    (9007, "日本語のテキスト     mixed"), (9008, "x" * 60_000), (9009, "a b c " * 9000), (9010, "it's'it 's ''ll 12'3² ١"),
    (9010, "same id, other text"), (9011, "repeat\nme now\n" * 300), (9011, "repeat\nme now\n" * 300), (None, "no id\nat all"), (None, None),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns that operators might use themselves."""
    rows = [(i, t, None if k % 3 else "en", None, None, k, "mine") for k, (i, t) in enumerate(ODD)]
    names = "doc_id long, text string, lang string, source string, n_chars long, _key int, _text string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
