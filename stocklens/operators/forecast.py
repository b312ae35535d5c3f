"""Daily demand, two demand forecasts, and forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stocklens.functions.expr import (
    DateLike,
    days_between,
    label_up_to,
    not_cancelled,
    pct,
    ratio,
    round_half_even_int,
    round_to,
)
from stocklens.operators.sales import live_lines, sales_anchor, from_first_key
from stocklens.sources.tables import Tables

# Accuracy grades by mean absolute percentage error.
ACCURACY_STEPS = [(10, "Excellent"), (20, "Good"), (30, "Fair")]


def daily_demand(t: Tables, product_id: int | None = None, warehouse_id: int | None = None) -> DataFrame:
    """Live units ordered per day and product; a filter applies whenever it is given, 0 included."""
    orders = ["order_date"] if warehouse_id is None else ["order_date", "warehouse_id"]
    lines = live_lines(t, orders, ["product_id", "quantity_ordered"])
    if product_id is not None:
        lines = lines.filter(F.col("product_id") == product_id)
    if warehouse_id is not None:
        lines = lines.filter(F.col("warehouse_id") == warehouse_id)
    return lines.groupBy("order_date", "product_id").agg(F.sum("quantity_ordered").alias("quantity_ordered"))


def _with_span(daily: DataFrame) -> DataFrame:
    """Add each product's first and last sale date; a partition is at most one row per day."""
    series = W.partitionBy("product_id")
    return daily.select(
        "*",
        F.min("order_date").over(series).alias("first_day"),
        F.max("order_date").over(series).alias("last_day"),
    )


def _ahead(level: DataFrame, days: int, method: str) -> DataFrame:
    """Repeat each product's level over the days after its last sale."""
    future = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", days))
    return level.select(
        "product_id",
        F.explode(future).alias("date"),
        round_half_even_int("level").alias("forecasted_quantity"),
        F.lit(method).alias("method"),
    )


def moving_average_forecast(
    t: Tables, window: int = 7, forecast_days: int = 30, product_id: int | None = None
) -> DataFrame:
    """Mean demand of the last ``window`` days, gap days counting as zero, for all products.

    Only the mean at the last day is needed, so the gaps are never filled with rows.
    """
    age = days_between("last_day", "order_date")
    days = F.least(F.lit(window), days_between("last_day", "first_day") + 1)
    recent = F.sum(F.when(age < window, F.col("quantity_ordered")).otherwise(0))
    level = (
        _with_span(daily_demand(t, product_id))
        .groupBy("product_id", "first_day", "last_day")
        .agg(recent.alias("units"))
        .withColumn("level", ratio("units", days))
    )
    return _ahead(level, forecast_days, "Moving Average")


def exponential_smoothing_forecast(
    t: Tables, alpha: float = 0.3, forecast_days: int = 30, product_id: int | None = None
) -> DataFrame:
    """Simple exponential smoothing over the gap-filled daily series, for all products.

    The recursion ``s = a*x + (1-a)*s`` unrolls to weights ``a*(1-a)^age`` (the first day
    keeps weight 1), and a gap day adds nothing: one aggregation, no row per gap.
    """
    age = days_between("last_day", "order_date")
    weight = F.when(F.col("order_date") == F.col("first_day"), 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), age)
    level = (
        _with_span(daily_demand(t, product_id))
        .groupBy("product_id", "first_day", "last_day")
        .agg(F.sum(F.col("quantity_ordered") * weight).alias("level"))
    )
    return _ahead(level, forecast_days, "Exponential Smoothing")


def forecast_accuracy(t: Tables, as_of: DateLike = None, days: int = 90) -> DataFrame:
    """Error and bias of daily forecasts against live demand, zero where nothing sold."""
    today = sales_anchor(t, as_of)

    def in_window(day: Column) -> Column:
        return day.between(F.date_sub(today, days), today)

    forecasts = t(
        "demand_forecasts", "product_id", "warehouse_id", "forecast_date", "forecast_period",
        "forecasted_quantity", "model_used",
    ).filter(in_window(F.col("forecast_date")) & (F.col("forecast_period") == "Daily"))
    # Demand is summed to the forecast's grain before the join, so an order's other lines
    # never multiply a forecast row.
    orders = t("sales_orders", "so_id", "warehouse_id", "order_date", "status").filter(
        not_cancelled() & in_window(F.col("order_date"))
    )
    actuals = (
        from_first_key(t("sales_order_items", "so_id", "product_id", "quantity_ordered"), orders, "so_id")
        .join(orders.select("so_id", "warehouse_id", F.col("order_date").alias("forecast_date")), "so_id")
        .groupBy("product_id", "warehouse_id", "forecast_date")
        .agg(F.sum("quantity_ordered").alias("sold"))
    )
    actual, forecast = F.col("actual"), F.col("forecasted_quantity")
    stats = (
        forecasts.join(actuals, ["product_id", "warehouse_id", "forecast_date"], "left")
        .withColumn("actual", F.coalesce("sold", F.lit(0)))
        .groupBy("product_id", "warehouse_id", "model_used")
        .agg(
            F.count("*").alias("forecast_periods"),
            F.avg(F.when(actual > 0, pct(F.abs(forecast - actual), actual))).alias("error"),
            F.avg(F.abs(forecast - actual)).alias("mean_miss"),
            F.avg(forecast - actual).alias("bias"),
        )
    )
    return (
        stats.join(t("products", "product_id", "sku", "product_name"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .select(
            "sku",
            "product_name",
            "warehouse_code",
            "model_used",
            "forecast_periods",
            round_to("error", 2).alias("mape"),
            round_to("mean_miss", 2).alias("mae"),
            round_to("bias", 2).alias("forecast_bias"),
            label_up_to("error", ACCURACY_STEPS, "Poor").alias("accuracy_grade"),
        )
    )
