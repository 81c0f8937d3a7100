import re

import __spark_entry__ as entry
from sieveframe.plans import adapters


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    assert all(re.match(r"\s*(with|select)\b", sql) for sql in oracles.values())


def test_entry(spark):
    got = {r.severity: r.n for r in entry.entry(spark).collect()}
    assert got[None] == sum(n for s, n in got.items() if s) > 0


def test_adapters_nest():
    sql = adapters.with_adapters("select * from files")
    assert sql.index("nodes as") < sql.index("files as")
