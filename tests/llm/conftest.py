import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows and ids, and columns whose names clash with results."""
    texts = [(0, "Alpha beta gamma delta epsilon zeta eta theta."), (1, "ALPHA beta gamma delta epsilon zeta eta theta."), (2, None), (3, ""),
             (4, "   \n\t "), (5, LONG), (5, LONG), (6, "Één TWEE drie vier vijf zes"), (7, "één twee drie vier vijf zes"), (8, "!!! 123 ???"),
             (9, "Line one of five words here\nline one of five words here\nshort\n\nanother line with more words in it"),
             (9, "same id, other text"), (None, "no id"), (None, None), (12, "a"), (13, "a b"), (14, "a b"), (14, "a b")]
    rows = [(i, t, "en" if (i or 0) % 3 else None, None if i == 4 else "src0", 7) for i, t in texts]
    clash = spark.createDataFrame(rows, DOCS)
    for name in ("shard", "slot", "position", "kept", "keep_id", "score", "lang_pred", "weight", "probability", "offset", "component_id", "row_id", "fp"):
        clash = clash.selectExpr("*", f"'mine' AS {name}")
    return clash


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
