from __future__ import annotations

import pytest

#: Names that operators use inside or return.
CLASHING = ("score", "n_tokens", "words", "key", "found", "label", "print", "row", "kept", "a.b")


def edge_rows() -> list[tuple]:
    prose = "The cat of the house sat on the mat and it was that by this, as for in is with are to. " * 8
    return [
        (1, prose),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, prose),
        (5, prose),
        (None, "Nobody knows who wrote this of the."),
        (6, "x" * 200_000),
        (7, "word " * 60_000),
        (8, 'token = "5fa2b6cdb08be96a4a469e2a9805c979fc0ae438" mail me.now@mail.example.com or +1 (643) 555-5742'),
        (9, "Zeile eins\nZeile eins\n\nÄé 漢字 🙂 released under the MIT License"),
    ]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) rows, with columns whose names clash with those of operators."""

    def make(rows):
        more = ", ".join(f"`{c}` string" for c in CLASHING)
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {more}"
        full = [(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in rows]
        return spark.createDataFrame(full, schema)

    from tallyveer.llm.common import prepare

    prepare(spark)
    return make


@pytest.fixture(scope="session")
def edges(make_docs):
    return make_docs(edge_rows()).cache()


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def sample(spark, data):
    """Whole documents table of the smallest scale."""
    return spark.read.parquet(f"{data}/documents.parquet").cache()
