import subprocess
import sys

from tests.conftest import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "score"]


def test_without_corpus_operators():
    """The entry module works where they are deleted."""
    code = "import sys; sys.modules['diffusio.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pagerank_k' in q and not any(x.startswith('op') and x[2].isdigit() for x in q), list(q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
