"""The driver contract on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("part", "supplier", "events", "documents", "lineitem", "orders")
# One query of each family; the driver compares them all.
FAMILIES = (
    "prune_dirs_detector", "detect_languages", "tokens", "brackets", "rule_go_defer_in_loop",
    "ingest_osv_python", "build_summary", "group_issues", "pr_changed_lines", "resolve_thresholds",
    "debounce_saves", "latest_findings",
)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    shown = ", ".join(f'"{c}"' for c in columns)
    want = Counter(con.execute(f"SELECT {shown} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry_has_a_row_per_repository(spark):
    assert entry.entry(spark).count() == 20
