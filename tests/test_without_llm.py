"""The rest of the library without the training-data operators."""

import shutil
import subprocess
import sys

from conftest import ROOT

CODE = """
import __spark_entry__ as entry
names = entry.queries()
assert names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(entry.oracle_sql()) <= set(names)
"""


def test_entry_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for there in (True, False):  # with corpus_pipeline.py, and without
        subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, check=True)
        if there:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
