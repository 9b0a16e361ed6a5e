"""The billing queries stay when the training-data package cannot be imported."""

import subprocess
import sys

import pytest
from conftest import ROOT


@pytest.mark.parametrize("hidden", ["xxhash", "costweave.llm", "corpus_pipeline"])
def test_queries_without_a_library(hidden):
    code = f"""import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert "cost_by_service" in names and names == set(e.oracle_sql()), names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "left out" in done.stderr
