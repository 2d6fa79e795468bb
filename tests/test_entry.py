"""The entry points where the training-data operators, or a package that they need, can't be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

HIDE = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry

found = entry.queries()
assert "call_score" in found and "pipeline" not in found and not any(k.startswith("op1_") for k in found), sorted(found)
assert set(entry.oracle_sql()) <= set(found)
"""


@pytest.mark.parametrize("hidden", [("zstandard",), ("siltstone.llm", "corpus_pipeline"), ("public_tokenizers",)])
def test_entry_without(hidden):
    subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden, root=str(ROOT))], check=True)
