"""The entry keeps the analysis queries whatever of the optional parts can be
imported."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from kartlens.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["xxhash", "public_tokenizers", "kartlens.llm", "corpus_pipeline"])
def test_queries_without_an_optional_import(hidden):
    code = (
        "import sys\n"
        f"sys.modules[{hidden!r}] = None\n"  # importing it raises ImportError
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(registry.queries()) and int(out[1]) >= len(registry.queries())
    assert out[2] == "False"
