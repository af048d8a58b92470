import pytest

from strandline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.driver.memory": "4g"})


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, extra=""):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r + ("en", "a"))[:4] + (len(r[1] or ""),) if len(r) == 2 else r + (len(r[1] or ""),) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
