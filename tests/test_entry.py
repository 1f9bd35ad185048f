"""The driver's contract holds with and without the llm package."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lodestone.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"], e.queries().keys()
assert "lexical_topk" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""


def test_import_without_llm():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
