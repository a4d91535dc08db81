import importlib
import sys

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("missing", ["corpus_pipeline", "pagewarden.llm", "xxhash", "public_tokenizers"])
@pytest.mark.filterwarnings("ignore:the corpus operators are left out")
def test_other_queries_work_without_the_corpus_operators(monkeypatch, missing):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("pagewarden.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        left = importlib.reload(entry)
        assert left.corpus_pipeline is None and not [q for q in left.queries() if q.startswith("op") or q == "pipeline"]
        assert "evidence_summary" in left.queries() and set(left.oracle_sql()) <= set(left.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
