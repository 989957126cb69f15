"""Every query of the library against its DuckDB SQL on the smallest tables."""

import numpy as np
import pytest

from tidemark.plans import registry

from .conftest import SMALL


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) == "<NA>":
        return None
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else v


def rows(frame):
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_what_its_sql_says(name, spark, duck):
    found, wanted = registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
