"""Every query with SQL is held against DuckDB on the same tables: names, kinds and rows."""

import datetime
import math

import pytest

from tidemill import catalogue

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.4f}".replace("-0.0000", "0.0000")
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(name, spark, small, oracle):
    got = catalogue.QUERIES[name](spark, small)
    want = oracle.execute(catalogue.ORACLE_SQL[name])
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    names = sorted(kinds)
    order = [c[0] for c in want.description]
    left = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    right = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in want.fetchall())
    assert left == right
    assert left, "an empty result shows nothing"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, small):
    assert catalogue.QUERIES[name](spark, small).count() > 0
