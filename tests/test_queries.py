"""Every registered query with SQL equals it on the smallest tables; those without give rows."""

from __future__ import annotations

import pytest
from compare import connect, difference

from cairn.plans import catalog

#: Thresholds of these are set for sf0.01; smaller tables may leave them without rows.
MAY_BE_EMPTY = {"f4_cell_calling", "f6_low_support", "q3_effect_overlap"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        found = difference(df, con, catalog.ORACLE_SQL[name])
        assert found in (("", "both are empty") if name in MAY_BE_EMPTY else ("",)), found
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_fan_out_of_odd_parts(spark, tmp_path):
    """Parts without a key or size, parts that stand twice, nations with one supplier or none."""
    import os

    import duckdb

    os.symlink("/root/testdata/sf0.001/nation.parquet", tmp_path / "nation.parquet")
    parts = [(1, 1), (2, 2), (2, 27), (3, 3), (4, 3), (4, 28), (None, 1), (None, 4), (5, None), (6, 29), (7, 24)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    suppliers = [(10, 1), (11, 1), (12, 2), (13, 3), (14, 4), (15, None)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for name in ("nation", "part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'' if name == 'nation' else '/*.parquet'}'")
    assert difference(catalog.QUERIES["j6_fan_out"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["j6_fan_out"]) == ""
