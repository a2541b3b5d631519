"""The entry module stands without the optional operators."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_a_library_of_the_optional_operators():
    code = (
        "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; names = set(e.queries());"
        "assert 'health_snapshot' in names and 'pipeline' not in names and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in names);"
        "assert set(e.oracle_sql()) <= names"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
