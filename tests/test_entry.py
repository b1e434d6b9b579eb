from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 40
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
