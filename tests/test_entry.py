"""The rest works without the training-data operators."""

import subprocess
import sys

from conftest import ROOT

CODE = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("galewatch.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 30 and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_llm():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (ROOT / "galewatch").rglob("*.py"):
        if "llm" not in path.parts:
            assert "galewatch.llm" not in path.read_text(), path
