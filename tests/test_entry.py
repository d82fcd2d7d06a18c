import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from relforge import queries

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    assert set(queries.oracles()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators():
    """The entry imports, and offers the relational queries, where the optional subpackage is gone."""
    script = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("relforge.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "top_orders" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "relforge").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
