import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, row string, bucket int, fp string, taken string, spans string, src string, h string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    more = (5, "en", 0.5, "r", 1, "f", "t", "s", "c", "q")
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (None, "no id here at all"), (None, None), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long), (7, "é ß 漢字 \u0000 \x0b z"), (8, "one")]
    rows = [(i, t, "en" if k % 2 else None, "s1" if k % 3 else None, None if t is None else len(t), *map(str, more[:1]), 0.5, "r", 1, "f", "t", "s", "c", "q") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame([*rows, (9, "x y z", None, None, None, None, None, None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
