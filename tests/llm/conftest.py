import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures_llm import CLASHING, ROWS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above as documents, with extra columns named like what operators use inside."""
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", None if t is None else len(t),
             *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(ROWS)]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
