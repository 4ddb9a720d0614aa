"""Every query of the terrain, access, path and graph operators beside its SQL."""

from __future__ import annotations

import pytest

from compare import difference
from ridgeline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
