"""The tables behind each report figure.

Drawing is not done here; every function returns the exact numbers a figure shows.
All inputs are condition-sized analysis tables, except where noted.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.operators.metrics import pct_text, ratio

ELLIPSIS = "…"


def short_name(col: Column, max_len: int = 20) -> Column:
    """Last ``/`` segment, cut to ``max_len`` characters plus an ellipsis."""
    last = F.element_at(F.split(col, "/", -1), -1)
    return F.when(F.length(last) > max_len,
                  F.concat(F.substring(last, 1, max_len), F.lit(ELLIPSIS))).otherwise(last)


def condition_label(model: Column, prompt: Column, max_len: int = 20) -> Column:
    """P10: two-line display label ``short model \\n prompt``."""
    return F.concat_ws("\n", short_name(model, max_len), prompt)


def file_safe(col: Column, legacy: bool = False) -> Column:
    """``/`` -> ``-`` (``__`` in the legacy form), space -> ``_``."""
    slash = "__" if legacy else "-"
    return F.regexp_replace(F.regexp_replace(col, "/", slash), " ", "_")


def key_grid(table: DataFrame, model_col: str = "model_name",
             prompt_col: str = "prompt_id") -> DataFrame:
    """Every model x prompt combination seen in a condition table.  The distinct
    values are gathered into two arrays (bounded by the condition list) and expanded
    with ``explode``; no join is involved."""
    sets = table.agg(F.array_sort(F.collect_set(model_col)).alias("_ms"),
                     F.array_sort(F.collect_set(prompt_col)).alias("_ps"))
    return (sets.select(F.explode("_ms").alias(model_col), "_ps")
                .select(model_col, F.explode("_ps").alias(prompt_col)))


def row_normalised(cells_grid: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Share of each cell in its true-label row (0 if the row is empty),
    with the ``12.3%\\n(n)`` annotation."""
    w = Window.partitionBy(*group_cols, "true_label")
    row_sum = F.sum("n").over(w)
    share = ratio(F.col("n"), row_sum, 0.0)
    return cells_grid.select(
        *group_cols, "true_label", "predicted_label", "n", share.alias("share"),
        F.concat(pct_text(F.col("n"), row_sum), F.lit("\n("), F.col("n").cast("string"),
                 F.lit(")")).alias("text"))


def all_matrices(cells_grid: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """every condition's normalised matrix with its panel number in key order."""
    rn = row_normalised(cells_grid, group_cols)
    panels = cells_grid.select(*group_cols).distinct().withColumn(
        "panel", (F.row_number().over(Window.orderBy(*group_cols)) - 1).cast("int"))
    return rn.join(panels, list(group_cols), "inner")


def bar_grid(metrics: DataFrame, cis: DataFrame | None = None, metric: str = "macro_f1",
             model_col: str = "model_name", prompt_col: str = "prompt_id") -> DataFrame:
    """Complete model x prompt grid of a metric (missing -> 0.0) with error-bar
    lengths ``value - lower`` and ``upper - value`` when intervals are given."""
    if metric not in metrics.columns:
        raise ValueError(f"metric {metric!r} not found in metrics")
    keys = [model_col, prompt_col]
    grid = key_grid(metrics, model_col, prompt_col)
    m = metrics.select(*keys, F.col(metric).alias("value"))
    if cis is not None and f"{metric}_ci_lower" in cis.columns:
        m = m.join(cis.select(*keys, F.col(f"{metric}_ci_lower").alias("lo"),
                              F.col(f"{metric}_ci_upper").alias("hi")), keys, "left")
    else:
        m = m.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double"))
    out = grid.join(m, keys, "left")
    v = F.coalesce(F.col("value"), F.lit(0.0))
    lo = F.coalesce(F.col("lo"), F.when(F.col("value").isNull(), F.lit(0.0)))
    hi = F.coalesce(F.col("hi"), F.when(F.col("value").isNull(), F.lit(0.0)))
    return out.select(*keys, v.alias("value"), (v - lo).alias("err_low"), (hi - v).alias("err_high"))


def heat_pivot(per_class: DataFrame, labels: Sequence[str], metric: str = "f1",
               group_cols: Sequence[str] = ("model_name", "prompt_id"),
               prompt_filter: str | None = None, max_len: int = 20) -> DataFrame:
    """F4 / A22 (P13 ``prompt_filter``): conditions x classes of a per-class metric, classes
    in label order.

    Grouped on the full condition keys (short names that collide are not merged); the
    display label is a separate column."""
    if "class" not in per_class.columns or metric not in per_class.columns:
        raise ValueError("per_class_metrics must contain 'class' and the metric column")
    df = per_class
    if prompt_filter and "prompt_id" in df.columns:
        df = df.filter(F.col("prompt_id") == prompt_filter)
    group_cols = [c for c in group_cols if c in df.columns]
    label = F.concat_ws(" / ", *[short_name(F.col(c).cast("string"), max_len) for c in group_cols])
    found = {r[0] for r in df.select("class").distinct().collect()}   # label-sized
    present = [x for x in labels if x in found]      # absent classes are left out
    wide = df.groupBy(*group_cols).pivot("class", present).agg(F.avg(metric))
    return wide.withColumn("condition", label).select(*group_cols, "condition", *present)


def ci_table(metrics: DataFrame, cis: DataFrame | None, metric: str = "macro_f1",
             group_cols: Sequence[str] = ("model_name", "prompt_id")) -> DataFrame:
    """point estimate and interval per condition, ascending by point; falls back to
    the metrics table with null bounds when no intervals exist."""
    point, lo, hi = f"{metric}_point", f"{metric}_ci_lower", f"{metric}_ci_upper"
    group_cols = list(group_cols)
    if cis is not None and point in cis.columns:
        t = cis.select(*group_cols, point, lo, hi)
    else:
        if metric not in metrics.columns:
            raise ValueError(f"metric {metric!r} not found")
        t = metrics.select(*group_cols, F.col(metric).alias(point),
                           F.lit(None).cast("double").alias(lo), F.lit(None).cast("double").alias(hi))
    label = F.concat_ws(" / ", *[short_name(F.col(c).cast("string")) for c in group_cols])
    w = Window.orderBy(F.col(point).asc_nulls_first(), *[F.col(c) for c in group_cols])
    return t.withColumn("label", label).withColumn(
        "position", (F.row_number().over(w) - 1).cast("int"))


def best_matrix(cells_grid: DataFrame, metrics: DataFrame, group_cols: Sequence[str],
                metric: str = "macro_f1") -> DataFrame:
    """F9 panel D: normalised matrix of the best condition (first in key order on ties)."""
    best = metrics.orderBy(F.col(metric).desc_nulls_last(), *group_cols).limit(1)
    return row_normalised(cells_grid.join(best.select(*group_cols), list(group_cols), "left_semi"),
                          group_cols)


def cost_grid(cost: DataFrame, model_col: str = "model_name",
              prompt_col: str = "prompt_id") -> DataFrame:
    """Total cost per model x prompt, missing cells 0.0."""
    keys = [model_col, prompt_col]
    grid = key_grid(cost, model_col, prompt_col)
    return grid.join(cost.select(*keys, "total_cost_usd"), keys, "left").select(
        *keys, F.coalesce(F.col("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"))


def save_figure_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """write every figure table under ``out_dir/<name>``; None entries are skipped.
    Tables are condition-sized, so each is written as a single file."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        path = os.path.join(out_dir, name)
        w = df.coalesce(1).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)
        written.append(path)
    return written


def dashboard_tables(analysis, labels: Sequence[str],
                     group_cols: Sequence[str] = ("model_name", "prompt_id")) -> dict[str, DataFrame]:
    """the four dashboard panels' tables: macro-F1 grid with error bars, per-class
    F1 heat table, interval table, and the best condition's normalised matrix."""
    return {
        "dashboard_bars": bar_grid(analysis.metrics, analysis.bootstrap_cis, "macro_f1"),
        "dashboard_heat": heat_pivot(analysis.per_class_metrics, labels, "f1", group_cols, max_len=12),
        "dashboard_ci": ci_table(analysis.metrics, analysis.bootstrap_cis, "macro_f1", group_cols),
        "dashboard_best_matrix": best_matrix(analysis.confusion_cells, analysis.metrics, group_cols),
    }


def figure_tables(analysis, labels: Sequence[str], results: DataFrame | None = None,
                  cost: DataFrame | None = None, prob_cols: dict[str, str] | None = None,
                  group_cols: Sequence[str] = ("model_name", "prompt_id")) -> dict[str, DataFrame]:
    """Every figure's table by name; entries whose inputs are missing are
    skipped (no probabilities -> no ROC / reliability, no cost -> no cost bars)."""
    group_cols = list(group_cols)
    out: dict[str, DataFrame] = {
        "confusion_matrices": all_matrices(analysis.confusion_cells, group_cols),
        "macro_f1_bars": bar_grid(analysis.metrics, analysis.bootstrap_cis, "macro_f1"),
        "per_class_f1_heat": heat_pivot(analysis.per_class_metrics, labels, "f1", group_cols),
        "macro_f1_ci": ci_table(analysis.metrics, analysis.bootstrap_cis, "macro_f1", group_cols),
    }
    if analysis.bootstrap_cis is not None and "prompt_id" in group_cols:
        prompts = [r[0] for r in analysis.metrics.select("prompt_id").distinct().collect()]
        for p in prompts:        # one heat table per prompt (the prompt list is condition-sized)
            out[f"per_class_f1_heat_{p}"] = heat_pivot(analysis.per_class_metrics, labels, "f1",
                                                       group_cols, prompt_filter=p)
    if analysis.reliability is not None:
        out["reliability"] = analysis.reliability
    if results is not None and prob_cols is not None and \
            all(c in results.columns for c in prob_cols.values()):
        from scorebook.operators.roc import roc_macro_grid, roc_points
        pts = roc_points(results, prob_cols, ["model_name"])
        curve, auc = roc_macro_grid(pts, labels, ["model_name"])
        out["roc_curve"], out["roc_auc"] = curve, auc
    if cost is not None and "total_cost_usd" in cost.columns:
        out["cost_bars"] = cost_grid(cost)
    out.update(dashboard_tables(analysis, labels, group_cols))
    return out
