"""The entry can be imported, and lists its queries, without a Spark session."""

from __future__ import annotations

import os
import subprocess
import sys


def test_the_entry_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}, timeout=120).returncode == 0
