import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from texts or (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, extra=True):
        rows = [(i, r) if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        full = [(i, t, None if i is None or i % 5 == 4 else "en", None if i is None or i % 7 == 6 else f"s{(i or 0) % 3}", None) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for c in ("row", "n", "h", "name", "score", "shard", "copy", "component", "size", "stays"):
                df = df.selectExpr("*", f"'clash' as {c}")
        return df

    return make
