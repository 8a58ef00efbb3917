"""Every registered query against its SQL, on the same tables."""

import math
import re

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([cell(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = plain(df.collect(), df.columns)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    kind = lambda t: "int" if re.search("INT|LONG|int|long", t) else "real" if re.search("DOUBLE|double|FLOAT|DECIMAL\\(|decimal", t) and not re.search("DECIMAL|decimal", t) else t.lower()
    theirs = {c[0]: kind(str(c[1])) for c in found.description}
    ours = {n: kind(t.replace("string", "varchar")) for n, t in df.dtypes}
    assert ours == {n: t.replace("bool", "boolean").replace("booleanean", "boolean") for n, t in theirs.items()}
    assert sorted(names) == sorted(df.columns)
    expected = plain(found.fetchall(), names)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b
