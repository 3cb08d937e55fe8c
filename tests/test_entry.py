import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = [q for q in entry.queries() if not (q[0] == "p" and q[1].isdigit())]


def same(v):
    return round(v, 6) if isinstance(v, float) else v


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_core_stands_without_the_llm_subpackage():
    """Nothing but the entry imports the subpackage, and the entry does without it."""
    code = "import sys; sys.modules['litloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q[0] == 'p' and q[1].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
