"""The driver's contract is read before any session exists."""

from __future__ import annotations

import os
import subprocess
import sys


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    queries, sql = map(int, done.stdout.split())
    assert queries > sql > 0
