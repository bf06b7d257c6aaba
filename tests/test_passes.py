"""How often queries read the usage rows, and that tables read once give what tables read apart gave."""

import os

from pyspark.sql import functions as F

from quillspan.operators import behavior, catalog, economics, usage as usage_ops
from quillspan.plans import catalogue, views
from quillspan.plans.base import Inputs
from tests.conftest import DATA
from tests.oracle import assert_same


def reads(df, table: str = "lineitem") -> int:
    """Scans of a table in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(f"/{table}.parquet" in line for line in plan.split("\n") if "FileScan" in line)


def test_f13_f14_f18_read_usage_no_more_than_they_need(spark):
    assert reads(catalogue.QUERIES["downgrade_candidates"](spark, DATA)) == 2
    assert reads(catalogue.QUERIES["behavior_roles"](spark, DATA)) == 1
    assert reads(catalogue.QUERIES["model_breakdown"](spark, DATA)) == 1


def test_f13_f14_names_by_column_are_those_of_the_table(spark):
    x = Inputs(spark, views.load(spark, DATA))
    of = lambda names: economics.agent_facts(x.named_usage, x.events, names, x.tables.sessions).withColumn("cost", F.round("cost", 6)).toPandas()
    assert_same(of(views.agent_name()), of(x.names))
    roles = lambda usage, names: behavior.behavior_roles(x.tables.sessions, x.events, usage, x.priced, names, x.tables.sources, "alpha").toPandas()
    assert_same(roles(x.priced, views.agent_name()), roles(x.usage, x.names))


def test_f17_totals_by_projection_leave_superseded_rows_out(spark):
    x = Inputs(spark, views.load(spark, DATA))
    apart = catalog.catalog(x.tables.sessions, x.tables.metadata, usage_ops.session_totals(x.priced))
    of = lambda cat: cat.withColumn("cost_estimate", F.round("cost_estimate", 6)).select("id", "tokens_in", "tokens_out", "observations", "cost_estimate", "pricing_known").toPandas()
    assert_same(of(x.catalog), of(apart))


def test_f15_f17_lists_and_agents_are_worked_out_once(spark, tmp_path):
    assert reads(catalogue.QUERIES["hoarding"](spark, DATA)) == 0
    assert reads(catalogue.QUERIES["machines_second_page"](spark, DATA)) == 0
    path = str(tmp_path / "rows")
    spark.range(9).write.parquet(path)
    first, after = catalog.page_of(spark.read.parquet(path), ["id"], 4)
    for f in os.listdir(path):
        os.remove(f"{path}/{f}")
    assert [r.id for r in first.collect()] == [0, 1, 2, 3]
