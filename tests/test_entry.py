"""The driver's contract."""

import subprocess
import sys

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_training_data_half():
    code = "import sys; sys.modules['reelgrid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_errors_inside_the_training_data_half_are_seen():
    code = "import sys, types; sys.modules['pyarrow.compute'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert out.returncode and "Error" in out.stderr
