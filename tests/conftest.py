import math
import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from larder.session import get_session

    folder = tempfile.mkdtemp(prefix="larder-tests-")
    session = get_session("local[4]", spark__checkpoint__dir=f"file://{folder}", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    if x is None:
        return "null"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Run a query and its SQL twin on the smallest tables; assert equal rows."""

    def check(query, sql):
        df = query(spark, DATA)
        names = sorted(df.columns)
        cur = duck.execute(sql)
        theirs = [c[0] for c in cur.description]
        assert sorted(theirs) == names
        expected = sorted(tuple(plain(r[theirs.index(n)]) for n in names) for r in cur.fetchall())
        assert sorted(tuple(plain(x) for x in r) for r in df.select(*names).collect()) == expected

    return check
