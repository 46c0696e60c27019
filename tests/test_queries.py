"""Every registered query against its SQL, and the plans the operators promise."""

import pytest
from compare import database, difference

from __spark_entry__ import entry, oracle_sql, queries
from stormframe.operators.blocks import plan_blocks
from stormframe.operators.conditioning import model_columns, within_limits
from stormframe.operators.ordered import fill_missing, with_position
from stormframe.plans.oracle import ORACLE
from stormframe.plans.prepare import condition, split_table
from stormframe.plans.workflows import QUERIES
from stormframe.sources.events import solar_wind

WITHOUT_SQL = {"random_forest_metrics"}


@pytest.fixture(scope="module")
def tables(testdata):
    return database(testdata)


def test_registry():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, testdata, tables, name):
    actual = QUERIES[name](spark, testdata).toPandas()
    assert len(actual)
    if name in ORACLE:
        assert difference(actual, tables.sql(ORACLE[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def executed(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("+- == Initial Plan ==")[0]


def test_conditioning_shuffles_rows_once(spark, testdata):
    plan = executed(split_table(condition(solar_wind(spark, testdata), block_rows=100)))
    shuffles = [x for x in plan.splitlines() if "+- Exchange hashpartitioning" in x]
    # one of the rows, one of the per-block summaries; the count per block reuses the first
    assert len(shuffles) <= 2, plan
    assert "ReusedExchange" in plan


def test_only_summaries_meet_in_one_partition(spark, testdata):
    table = model_columns(solar_wind(spark, testdata), ["event_id"])
    layout = plan_blocks(table, block_rows=100)
    frame = with_position(fill_missing(layout.assign(table), layout, ["bt"]), layout)
    lines = executed(frame).splitlines()
    single = [i for i, text in enumerate(lines) if "Exchange SinglePartition" in text]
    assert single
    for i in single:  # what is gathered has been aggregated per block right before
        below = next(text for text in lines[i + 1 :] if "Aggregate" in text or "Scan" in text)
        assert "Aggregate(key" in below, below


def test_filters_and_columns_reach_the_scan(spark, testdata):
    events = spark.read.parquet(f"{testdata}/events.parquet").withColumnRenamed("value", "bt")
    plan = executed(within_limits(events).select("bt"))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,0.0), LessThanOrEqual(value,5.0)]" in plan
    assert "ReadSchema: struct<value:double>" in plan
