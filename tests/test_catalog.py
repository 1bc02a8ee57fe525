"""Every query against its SQL in DuckDB on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rounded(rows):
    def plain(v):
        return float(f"{v:.6g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rounded(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == rounded(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['orthoplan.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
