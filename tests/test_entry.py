"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    code = "import sys\nsys.modules['pagelight.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\nassert len(e.queries()) > 50 and len(e.oracle_sql()) > 50\n"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
