import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _row string, node string, label string, n_words string, size int, hits string, score string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    long_text = " ".join(f"word{i % 977} longish text, with {i} numbers" for i in range(6000))
    line = "This line stands on very many sites of the web."
    texts = [None, "", " ", "\n\n", "a", "Hello World", "hello world", long_text, long_text, "ünï çödé ÀÉ", "x\n" + line, line + "\ny", "�\x00 tab\tend", "5 4 3 2 1"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if i % 2 else 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id", None, None, None), (None, "null id", None, None, None), (99, None, None, None, None)]
    return spark.createDataFrame([(*r, "k", None, "n", "l", "w", 1, None, "s") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
