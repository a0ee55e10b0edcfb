from __future__ import annotations

import pandas as pd
import pytest

#: Rows every operator must survive: nulls, blanks, ties, repeated rows, a very long text.
ODD_TEXTS = [
    None,
    "",
    "   \t\n",
    "one",
    "One two",
    "one two",
    "A b\x0bc\x0cd\re f",
    "A b c d e f",
    "naïve Straße \U0001f600 Kİ x́",
    "x" * 5000,
    "a  a" * 3000,
    "under the mit license. Apache License, Version 2.0; CC BY-NC under The MIT: license",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, each once or twice, with null and repeated ids and columns whose names clash."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS[::2])]
    rows += [(3, "one", "en", "s", 0), (None, "one", "en", "s", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, run string, words int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def frame():
    def collect(df) -> pd.DataFrame:
        return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)

    return collect
