"""Every registered query of this package against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quillflow.plans import registry
from tests.conftest import normal

SQL = registry.oracle_sql()

CHOSEN = sorted(SQL)

@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    found = normal(df.collect(), df.columns)
    cursor = duck.execute(SQL[name])
    assert found == normal(cursor.fetchall(), [c[0] for c in cursor.description])

@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n not in SQL and not n.startswith(("ml", "ev20", "cp12"))))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0

def test_flagship(spark, sf_dir):
    df = registry.flagship(spark, sf_dir)
    assert df.count() == 6000
    assert "own_decay_count_12h" in df.columns
