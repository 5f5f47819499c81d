"""Physical plans: no pair-producing joins, no Python where expressions do, filters at the scan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlytics.operators import relational as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "portfolio_base", "suspensions", "scoring_fact", "complete_dates", "effective_start", "series_state", "credit_quota",
    "review_rules", "mean_weights", "mean_forecast", "consumption_fact", "describe_series",
])
def test_no_pair_producing_join_and_no_python(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "EvalPython" not in text and "InPandas" not in text and "InArrow" not in text


def test_best_row_per_key_is_limited_before_the_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = plan(R.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc()]))
    assert text.count("WindowGroupLimit") == 2


def test_date_bounds_reach_the_scan(spark, sf_dir, tmp_path):
    closes = spark.sql("select explode(sequence(date'2020-01-31', date'2024-01-31', interval 1 month)) as close_date, 1 as x")
    closes.write.parquet(str(tmp_path / "closes"))
    text = plan(R.trailing_months(spark.read.parquet(str(tmp_path / "closes")), "close_date", 12, "2023-06-10"))
    assert "GreaterThanOrEqual(close_date,2022-05-31)" in text and "LessThanOrEqual(close_date,202" in text


def test_completed_series_is_shuffled_once_by_station(spark, sf_dir):
    text = plan(entry.queries()["effective_start"](spark, sf_dir))
    assert text.count("hashpartitioning(station") == 2  # the daily sums, then the station
