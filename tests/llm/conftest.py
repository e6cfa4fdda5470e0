from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names clash with the operators' own."""

    def build(rows, lang=None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, "s", len(r[1]) if r[1] else 0) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("key", "score", "text_key", "copies", "n", "part", "ids_", "w", "size", "slot", "input"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Null columns, empty and blank texts, repeated rows, a long text."""
    long = " ".join(f"word{i % 97} más {i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \n "), (4, "one two three four five six seven eight nine ten eleven"), (4, "one two three four five six seven eight nine ten eleven"),
            (None, "no id here at all"), (6, long), (7, "ÉCOLE İstanbul ß 漢字 🎉 x"), (8, "!!! ???"), (9, "one two three four five six seven eight nine ten eleven")]
