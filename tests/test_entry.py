import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "title", "published_date", "graph_score", "keyword_score", "score"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_llm_package():
    code = "import sys, corvana.plans.queries, corvana.sources.feeds, corvana.streaming.refresh; assert not [m for m in sys.modules if m.startswith('corvana.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
