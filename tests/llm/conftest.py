import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, marked int, node string, w int, g int, h int, rest int, size int, `_r` int, cluster string, level int, key int, gone int, n_rows int, span int, salt int, asked int, n int, copies int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use for themselves."""

    def make(rows):
        full = [(*(list(r) + ["en", "s", None][len(r) - 2 :]), "x", 1, "y", 2, 3, 4, 5, 6, 7, "z", 8, *range(9, 17)) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
