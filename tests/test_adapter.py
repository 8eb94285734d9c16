"""Datasets that share one join of lineitem and orders."""

from datetime import datetime

import pytest

from catalogue.adapter import RIDES, ROUTE_KEYS, VA_RIDES, Star
from catalogue.queries import callables, measured, measuring

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with keys that are null, missing elsewhere or repeated."""
    path = str(tmp_path_factory.mktemp("star"))
    day = datetime(1997, 1, 5)
    lines = [
        (i % 40 if i % 17 else None, i % 11 if i % 13 else None, i % 7, i % 7 + 1, float(i % 50), 10.0 * i, 0.01 * (i % 10), 0.01 * (i % 8), "ARN"[i % 3], "OF"[i % 2], day)
        for i in range(300)
    ]
    tables = {
        "lineitem": (lines, LINES),
        "orders": ([(i % 30, i % 5, "O", 1.0, datetime(1997, i % 12 + 1, 3) if i % 9 else None, "1") for i in range(36)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(i, f"c{i}", i, 1.0, "x") for i in range(4)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(i, f"p{i}", "b", f"t{i % 3}", i, 1.0) for i in range(9)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"s{i}", i, 1.0) for i in range(6)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    }
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{path}/{name}.parquet")
    return path


def listed(df):
    return sorted(map(repr, df.collect()))


def test_shared_datasets_have_the_same_rows(spark, folder):
    own, shared = Star(spark, folder), measuring(Star(spark, folder))
    for one, other in zip(measured(own).values(), measured(shared).values(), strict=True):
        assert listed(one) == listed(other) and listed(one)
    every = Star(spark, folder).sharing([*RIDES.values(), *VA_RIDES.values(), "l_shipdate"])
    assert listed(own.run_list()) == listed(shared.run_list()) == listed(every.run_list())
    for name in ("ritten_detail", "va_ritten_detail", "routes_detail", "kentallen_route"):
        assert listed(getattr(own, name)()) == listed(getattr(every, name)())
    assert listed(shared.ritten_detail(["reiziger_naam"])) == listed(own.ritten_detail(["reiziger_naam"]))  # not among the shared columns
    assert shared.routes_detail([*ROUTE_KEYS, "resultaat_5"]).columns == [*ROUTE_KEYS, "resultaat_5"]


@pytest.mark.parametrize("name", ["control_breakdown", "export_summary", "control_trend", "trend_previous_point", "control_checked_count", "control_deviation_count", "dashboard_metrics_long"])
def test_lines_are_shuffled_once(spark, folder, name):
    held = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = callables()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert len(lines) > 1 and len([line for line in lines if "ReusedExchange" not in line]) == 1
