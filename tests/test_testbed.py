from __future__ import annotations

import pytest

from listenlake.sources.testbed import Testbed


@pytest.fixture
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("part", [(1, "blue sky", "Brand#1"), (2, "red sea", "Brand#2")], "p_partkey bigint, p_name string, p_brand string")
    put("orders", [(10, 7, "1999-01-01")], "o_orderkey bigint, o_custkey bigint, o_orderdate string")
    lines = [(10, 1, 5, 1, 1.0, "R", "O"), (10, 2, 5, 2, 1.0, "N", "F"), (10, 3, 5, 3, 1.0, "N", "F")]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    put("lineitem", lines, schema)
    put("supplier", [(5, "Supplier 5")], "s_suppkey bigint, s_name string")
    return Testbed(spark, str(tmp_path))


def test_names_of_parts_are_never_broadcast(tables):
    """Their size is a multiple of what Spark expects from the file of parts."""
    for made in (tables.build_plays(), tables.history_pages(), tables.link_search()):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join Inner" in line and "l_linenumber" in line]
        assert len(joins) == 1
        assert "strategy=merge" in joins[0]


def test_plays_have_the_names_of_their_line(tables):
    found = sorted(tuple(r) for r in tables.build_plays().select("username", "track_name", "track_id").collect())
    assert found == [("7", "blue sky", "blue sky|brand1"), ("7", "red sea - Remastered 2012", "red sea|brand2")]
