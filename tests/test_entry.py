"""The entry point without the training-data group or a library of it."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("hidden", ["tiktoken", "xxhash", "corpus_pipeline"])
def test_other_queries_load_without_an_optional_module(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), any(n.startswith('op') and '_' in n and n[2:n.index('_')].isdigit() for n in e.queries()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    n, numbered = told.stdout.split()
    assert int(n) >= 220 and numbered == "False"
    assert "left out" in told.stderr
