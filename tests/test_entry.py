"""The driver contract: registered names, SQL for known queries only, a stable flagship."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_flagship_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert {"datetime", "factor_name", "label_name", "ic", "spread"} <= set(df.columns) and df.count() > 0


def test_queries_load_without_a_session():
    code = "import __spark_entry__ as e; e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=120)


def test_a_missing_optional_package_costs_only_the_text_operators():
    code = ("import sys; sys.modules['xxhash'] = None\nimport warnings; warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), len(e.oracle_sql()) > 200)")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    number, has_text, sql = out.stdout.split()
    assert int(number) > 240 and has_text == "False" and sql == "True", out.stderr
