"""The entry file without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage():
    code = (
        "import sys; sys.modules['quarry.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries()); assert len(names) > 30 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names)\n"
        "assert set(e.oracle_sql()) <= names")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for f in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "quarry").parts:
            assert "quarry.llm" not in f.read_text() and "from ..llm" not in f.read_text(), f
