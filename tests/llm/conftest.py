import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns whose names clash with what operators use."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("score", "predicted", "fp", "row", "k", "size", "target", "copies", "v", "words", "line", "host", "path", "key", "first", "t", "h", "d"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
