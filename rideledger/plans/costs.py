"""Control 20: cost per ride, weighted by the number of rides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideledger.fixed_values import COST_MONTHS
from rideledger.functions.numeric import exact_sum, number, share, weighted_mean
from rideledger.operators.count import PER_RUN
from rideledger.operators.detail import Detail
from rideledger.registry import RUN


def _cost() -> Column:
    return number(F.col("kosten_rit"))


def _rides() -> Column:
    return F.coalesce(number(F.col("n_ritten")), F.lit(0.0))


def report_20_summary(key_figures: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Rows, rows with a cost, their share, mean cost per ride and rides."""
    with_cost = F.count(_cost())
    return key_figures.groupBy(*by).agg(
        F.count("*").alias("total_checked"),
        with_cost.alias("days_with_cost"),
        share(with_cost, F.count("*"), 2).alias("coverage_percentage"),
        weighted_mean(_cost(), _rides()).alias("average_cost"),
        F.coalesce(F.sum(_rides()).cast("bigint"), F.lit(0)).alias("total_rides"),
    )


def report_20_daily_table(key_figures: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    """Rides and mean cost per day; rows without a date share one line."""
    rows = key_figures.groupBy(*by, F.to_date("datum").alias("datum")).agg(
        F.sum(_rides()).cast("bigint").alias("n_ritten"), weighted_mean(_cost(), _rides()).alias("kosten_rit")
    )
    return Detail(rows, ["datum"])


def report_20_daily_chart(key_figures: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    """The dated lines of the table."""
    table = report_20_daily_table(key_figures, by).rows
    return Detail(table.where(F.col("datum").isNotNull()).select(*by, "datum", "kosten_rit"), ["datum"])


def report_20_monthly(key_figures: DataFrame, months: int = COST_MONTHS) -> Detail:
    """Mean cost per month over the year up to the last month of each run, from the rows of all runs.

    Rows are reduced once, to sums per run and month. Windows over this small table (a few rows per run)
    give the mean of every month over all runs and the list of months, one entry each, of which
    a run then takes the twelve up to its own last month, or the newest if it has no dates.
    """
    counts = _cost().isNotNull()
    parts = key_figures.groupBy(RUN, F.trunc(F.to_date("datum"), "MM").alias("month_start")).agg(
        exact_sum(F.when(counts, _cost() * _rides())).alias("cost"), exact_sum(F.when(counts, _rides())).alias("rides")
    )
    unbounded = Window.unboundedPreceding, Window.unboundedFollowing
    month = Window.partitionBy("month_start").orderBy(RUN).rowsBetween(*unbounded)
    mean = F.sum("cost").over(month) / F.nullif(F.sum("rides").over(month), F.lit(0.0))
    everything = Window.partitionBy(F.lit(0))
    known = F.when(F.col("month_start").isNotNull(), F.struct("month_start", "kosten_rit"))
    listed = parts.withColumn("kosten_rit", mean).withColumns(
        {"listed": F.collect_set(known).over(everything), "newest": F.max("month_start").over(everything)}
    )
    per_run = listed.groupBy(RUN).agg(
        F.coalesce(F.max("month_start"), F.max("newest")).alias("last_month"), F.first("listed").alias("listed")
    )
    rows = per_run.select(RUN, "last_month", F.inline("listed")).where(
        F.col("month_start").between(F.add_months("last_month", 1 - months), F.col("last_month"))
    )
    return Detail(rows.select(RUN, F.date_format("month_start", "yyyy-MM").alias("month"), "kosten_rit"), ["month"])
