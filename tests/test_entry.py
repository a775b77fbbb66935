"""The driver contract, with and without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op3_minhash_near_dedup' not in q and len(q) > 150; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)
    assert "fine" in done.stdout, done.stderr
