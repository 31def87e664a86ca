"""The driver's contract, and that the library stands without the corpus operators."""

import subprocess
import sys

from conftest import DATA, ROOT


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert DATA


def test_library_does_not_import_corpus_operators():
    code = "import sys, tessella.registry as r; r.queries(); assert not [m for m in sys.modules if m.startswith('tessella.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
