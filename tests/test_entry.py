"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry_and_twins(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, twins = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) >= 80 and all(callable(q) for q in queries.values())


def test_core_without_the_libraries_of_the_subpackage():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'cte' in q and 'op4_substring_dedup' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1], timeout=120)
