import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, columns=("lang", "source")):
        full = [(i, t, *("x" for _ in columns), 0, "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + ", ".join(f"{c} string" for c in columns) + ", n_chars long, length string")

    return make
