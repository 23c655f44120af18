"""Inference cost per call and per condition.

Money is carried as integer pico- or nano-USD wherever it is computed here, so sums are exact
and independent of summation order; dollars are one division at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.operators.cells import drop_null_keys

COST_SUMMARY_SCHEMA = ("model_name string, prompt_id string, n_calls bigint, "
                       "total_input_tokens bigint, total_output_tokens bigint, "
                       "total_cost_usd double, avg_cost_per_sample_usd double")

def paid_rows(results: DataFrame, cost_col: str = "cost_usd") -> DataFrame:
    """Rows of paid calls, ``cost > 0`` (null is not paid)."""
    return results.filter(F.coalesce(F.col(cost_col) > 0, F.lit(False)))


def per_call_cost(results: DataFrame, models: DataFrame, key: str = "model_id") -> DataFrame:
    """P17 + J8: add ``cost_pico``, ``cost_nano`` and ``cost_usd`` from token counts and the
    model's per-1K-token prices (``cost_per_1k_input_tokens`` / ``cost_per_1k_output_tokens``).

    Prices become integer pico-USD per token (price per 1K x 1e9, rounded), so every product
    and sum of ``cost_pico`` is exact; ``cost_nano`` is its thousandth, rounded.  A model listed
    twice is an error (it would double its calls)."""
    def pico(c: str) -> F.Column:
        return F.round(F.col(c) * F.lit(1e9)).cast("long")
    prices = models.groupBy(key).agg(
        F.count(F.lit(1)).alias("_times"), F.max(pico("cost_per_1k_input_tokens")).alias("_pin"),
        F.max(pico("cost_per_1k_output_tokens")).alias("_pout"))
    prices = prices.withColumn("_pin", F.when(F.col("_times") > 1, F.raise_error(F.concat(
        F.lit("model listed twice: "), F.col(key).cast("string")))).otherwise(F.col("_pin"))).drop("_times")
    j = results.join(prices, key, "left")
    cost = (F.coalesce(F.col("input_tokens"), F.lit(0)) * F.coalesce(F.col("_pin"), F.lit(0))
            + F.coalesce(F.col("output_tokens"), F.lit(0)) * F.coalesce(F.col("_pout"), F.lit(0)))
    return (j.withColumn("cost_pico", cost)
             .withColumn("cost_nano", F.round(F.col("cost_pico") / F.lit(1000.0)).cast("long"))
             .withColumn("cost_usd", F.col("cost_pico") / F.lit(1e12))
             .drop("_pin", "_pout"))


def cost_summary(results: DataFrame, group_cols: Sequence[str] = ("model_name", "prompt_id"),
                 cost_col: str = "cost_usd", nano_col: str | None = None,
                 round_digits: bool = False) -> DataFrame:
    """Per condition over paid rows: calls, token sums (null tokens count 0),
    total cost, average cost per call (from the unrounded total).

    With ``nano_col`` the sums run on integer nano-USD.  ``round_digits`` rounds the
    total to 4 and the average to 6 decimals, as in published report tables.  Missing
    columns give an empty table with the right schema."""
    spark = results.sparkSession
    needed = {*group_cols, "input_tokens", "output_tokens", nano_col or cost_col}
    if not needed.issubset(results.columns):
        return spark.createDataFrame([], COST_SUMMARY_SCHEMA)
    if nano_col:
        paid = drop_null_keys(results, group_cols).filter(
            F.coalesce(F.col(nano_col) > 0, F.lit(False)))
        total = F.sum(nano_col) / F.lit(1e9)
        calls = F.count(nano_col)
    else:
        paid = paid_rows(drop_null_keys(results, group_cols), cost_col)
        total = F.sum(cost_col)
        calls = F.count(cost_col)
    out = paid.groupBy(*group_cols).agg(
        calls.alias("n_calls"),
        F.sum(F.coalesce(F.col("input_tokens"), F.lit(0))).cast("long").alias("total_input_tokens"),
        F.sum(F.coalesce(F.col("output_tokens"), F.lit(0))).cast("long").alias("total_output_tokens"),
        total.alias("total_cost_usd"))
    avg = F.col("total_cost_usd") / F.col("n_calls")
    out = out.withColumn("avg_cost_per_sample_usd", avg)
    if round_digits:
        out = out.withColumn("avg_cost_per_sample_usd", F.round(avg, 6)) \
                 .withColumn("total_cost_usd", F.round("total_cost_usd", 4))
    return out.orderBy(*group_cols)


def total_cost(results: DataFrame, cost_col: str = "cost_usd",
               nano_col: str | None = None) -> DataFrame:
    """One row, total over all paid calls (sum of raw values, not of rounded parts)."""
    if nano_col:
        paid = results.filter(F.coalesce(F.col(nano_col) > 0, F.lit(False)))
        return paid.agg((F.coalesce(F.sum(nano_col), F.lit(0)) / F.lit(1e9))
                        .alias("total_cost_usd"), F.count(F.lit(1)).alias("n_calls"))
    paid = paid_rows(results, cost_col)
    return paid.agg(F.coalesce(F.sum(cost_col), F.lit(0.0)).alias("total_cost_usd"),
                    F.count(F.lit(1)).alias("n_calls"))
