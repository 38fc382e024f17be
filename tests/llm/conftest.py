from __future__ import annotations

import pytest

from shoptrace.llm.shared import ship

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, or from (doc_id, text[, lang[, source]]) rows."""
    ship(spark)

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, *rest = r if isinstance(r, tuple) else (i, r)
            lang, source = (rest + ["en", "a"][len(rest) :])[:2]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENTS)

    return build
