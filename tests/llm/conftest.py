import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string, cell int, shard int, slot int, row int, fp long, doc int, label int, score double, ids int, __stay int"
EXTRA = ("x", "y", 1, 2, 3, 4, 5, 6, 7, 0.5, 8, 9)


def frame(spark, rows):
    """Documents (id, text) with columns whose names operators use themselves."""
    full = [(i, t, None if i is None else ("en" if i % 2 else "de"), "src" if i else None, None, *EXTRA) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ODD = [(1, "the same text here"), (2, "the same text here"), (2, "the same text here"), (3, None), (4, ""), (5, " \n\t "), (None, "no id at all"), (None, None), (6, LONG), (7, "ÄÖÜ straße 中文 😀 é"), (8, "x"), (9, "the same text here "), (10, "12 34 !!")]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).limit(0)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
