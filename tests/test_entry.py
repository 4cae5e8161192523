"""Driver contract: entry, query registry, oracle pairing, plan shape."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from vigil.plans.catalog import QUERIES

PYTHON_ALLOWED = {"map_responder", "respond_flow", "classifier_injected", "bootstrap_ci", "bootstrap_median", "yesno_summary",
                  "yesno_summary_median", "axis_limits", "error_bars", "responder_ledger"}
# queries of optional packages have tests of their own
CORE = sorted(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:5] == ["closeness_level", "closeness_level_name", "severity_level", "model", "perspective"]


def test_oracles_pair_with_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(CORE) <= set(q)
    assert set(CORE) <= set(o)
    assert len(CORE) >= 72


@pytest.mark.parametrize("key", CORE)
def test_every_query_runs_small(spark, key):
    df = E.queries()[key](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if key not in PYTHON_ALLOWED:
        assert not any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow")), key
    assert df.limit(5).count() >= 0


@pytest.mark.parametrize("key", ["extract_json", "lexicon_counts", "tokenize", "is_report", "coerce_numeric"])
def test_row_wise_queries_do_not_shuffle(spark, key):
    plan = E.queries()[key](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    if key == "is_report":  # the fixture view joins lineitem to orders; the operator adds nothing
        assert plan.count("Exchange") <= 2
    else:
        assert "Exchange" not in plan


def test_scan_prunes_columns(spark):
    plan = E.queries()["lexicon_counts"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_optional_package(tmp_path, also):
    """A copy of the tree without the optional folders still names every other query."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__", *also)])
    code = "import __spark_entry__ as E; print(sorted(E.queries())); print(sorted(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.splitlines()
    assert out[-2] == str(CORE) == out[-1]
