"""The entry module works with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from helpers import ROOT

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_works_without_llm(tmp_path, pipeline_stays):
    """The tree without the two llm folders, with and without the pipeline module, answers and runs a query."""
    left_out = lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__") or (n == "corpus_pipeline.py" and not pipeline_stays)]
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=left_out)
    code = (
        "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and 'dedup_best' in q and 'pipeline' not in q;"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in q)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "lawmill")):
        if os.sep + "llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert "lawmill.llm" not in text and "from llm" not in text, name
