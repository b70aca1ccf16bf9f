import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from texts: ids count up from 0, further columns have names that operators use themselves."""

    def make(texts, ids=None):
        rows = [(k if ids is None else ids[k], t, "en", "s", 1, "x", "y") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, bits string")

    return make


ODD = [None, "", " \n\t ", "a", "a b", "ab cd ef", "é 漢字 x\x00y", "A B C d", "x " * 5000, "Aa\rbB\x0bcc\x0cdd", "ab cd ef", "  \x1c q"]


@pytest.fixture
def odd():
    return list(ODD)
