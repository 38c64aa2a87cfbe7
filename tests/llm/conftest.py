import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table with extra columns whose names clash with those that operators use."""

    def make(rows):
        data = [(i, t, lang, "src", None if t is None else len(t), 1, "x", 2) for i, t, lang in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, name long, row string, ids int"
        return spark.createDataFrame(data, kinds)

    return make


AWKWARD = [
    (1, "", "en"),
    (2, None, "en"),
    (3, " \n\t ", None),
    (4, "one", "en"),
    (5, "one", "en"),
    (5, "one", "en"),
    (None, "a null id with five words or more in it", "en"),
    (None, None, None),
    (7, "word " * 30_000, "de"),
    (8, "x" * 40_000, "fr"),
    (9, "日本語 🙂 é ▁ <|im_end|> \x00 �", "en"),
]


@pytest.fixture()
def awkward():
    return list(AWKWARD)
