"""Linear cost forecasts by built-in regression aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions.numbers import percent_or_zero, rounded

PERIOD = "billing_period_start"


def _fit() -> dict[str, Column]:
    x, y = F.col("x").cast("double"), F.col("cost").cast("double")
    return {
        "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x),
        "mean": F.avg(y), "spread": F.var_pop(y), "n": F.count(F.lit(1)),
    }


def _ordinal(monthly: DataFrame, group: list[str]) -> DataFrame:
    """0-based position of each observed month; a group holds one row per month."""
    own = Window.partitionBy(*(group or [F.lit(1)])).orderBy(PERIOD)
    return monthly.withColumn("x", F.row_number().over(own) - 1)


def forecast_total(invoices: DataFrame, months_ahead: int = 1) -> DataFrame:
    """One row: value on the regression line ``months_ahead`` after the last month, and how far to trust it."""
    monthly = invoices.groupBy(PERIOD).agg(F.coalesce(F.sum("total_billed_cost"), F.lit(0)).alias("cost"))
    fit = _ordinal(monthly, []).agg(*[c.alias(k) for k, c in _fit().items()])
    enough = F.col("n") >= 2
    r2 = F.when(F.col("spread") > 0, F.col("r2")).otherwise(F.lit(0.0))
    trust = (
        F.when(~enough, "insufficient_data")
        .when((F.col("n") >= 6) & (F.col("r_squared_raw") > 0.7), "high")
        .when((F.col("n") >= 3) & (F.col("r_squared_raw") > 0.4), "medium")
        .otherwise("low")
    )
    ahead = F.col("slope") * (F.col("n") - 1 + months_ahead) + F.col("intercept")
    return fit.withColumn("r_squared_raw", r2).select(
        F.when(enough, rounded(ahead)).alias("forecast"),
        trust.alias("confidence"),
        F.when(enough, rounded(F.col("r_squared_raw"), 3)).alias("r_squared"),
        F.when(enough, rounded(percent_or_zero(F.col("slope"), F.col("mean")), 1)).alias("trend_pct"),
        F.col("n").alias("periods_used"),
    )


def forecast_by_service(resources: DataFrame, months_ahead: int = 1) -> DataFrame:
    """Forecast of each service with at least two observed months, never below zero."""
    service = F.coalesce("service_name", F.lit("Unknown")).alias("service")
    monthly = resources.groupBy(service, PERIOD).agg(F.sum("total_cost").alias("cost"))
    last = F.max_by("cost", PERIOD).alias("current")
    fit = _ordinal(monthly, ["service"]).groupBy("service").agg(*[c.alias(k) for k, c in _fit().items()], last)
    ahead = F.col("slope") * (F.col("n") - 1 + months_ahead) + F.col("intercept")
    return fit.where("n >= 2").select(
        "service", rounded(F.greatest(ahead, F.lit(0.0))).alias("forecast"), "current",
        rounded(percent_or_zero(F.col("slope"), F.col("mean")), 1).alias("trend_pct"),
        F.col("n").alias("periods_used"),
    )
