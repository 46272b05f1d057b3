"""Every core query against its SQL on the smallest tables."""

import pytest

from loamgraph.plans import catalogue
from oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, name):
    same(spark, FOLDER, catalogue.QUERIES, catalogue.SQL, name)


def test_all_columns_named_once(spark):
    for name in ("churn_topk", "p7_profile", "reconcile_peers"):
        cols = catalogue.QUERIES[name](spark, FOLDER).columns
        assert len(cols) == len(set(cols)) and "author" not in cols


def test_core_does_not_need_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    for p in (root / "loamgraph").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "loamgraph.llm" not in p.read_text()
    code = "import sys; sys.modules['loamgraph.llm'] = None; import loamgraph.plans.catalogue as c; print(len(c.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True).stdout) > 40
