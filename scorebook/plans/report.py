"""E5 report tables and the small condition-level operators behind them.

A10/A11 parse-rate reports, A14-A16 counts, A23 significant-pair counts, J4 metrics +
intervals, W2a best prompt per model, J5 per-class rows of those best conditions,
W2b best condition overall.  Everything here reads condition-sized tables except the
parse-rate and count reports, which are single aggregations over the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.operators.cells import drop_null_keys
from scorebook.operators.metrics import pct_text


def parse_rate_report(results: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """A10: mean / sum / count of parse_success per condition and ``12.3%`` text."""
    ok = F.col("parse_success").cast("long")
    out = drop_null_keys(results, group_cols).groupBy(*group_cols).agg(
        F.sum(ok).alias("n_parsed"), F.count(F.lit(1)).alias("n_total"))
    rate = F.col("n_parsed") / F.col("n_total")
    return out.select(*group_cols, "n_parsed", "n_total", rate.alias("parse_rate"),
                      pct_text(F.col("n_parsed"), F.col("n_total")).alias("parse_rate_text"))


def parse_failures(results: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Failures and their percentage per condition."""
    out = drop_null_keys(results, group_cols).groupBy(*group_cols).agg(
        F.count_if(~F.col("parse_success")).alias("n_failed"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("pct_failed", F.col("n_failed") * F.lit(100.0) / F.col("n_total"))


def class_counts(samples: DataFrame, labels: Sequence[str], label_col: str = "label",
                 id_col: str | None = None, by_count: bool = False) -> DataFrame:
    """Samples per label, zeros included, in label order (``by_count``: most
    frequent first, ties in label order).  With ``id_col`` the rows are first reduced
    to distinct (id, label) pairs (a fact table lists each sample once per condition)."""
    df = samples.select(*( [id_col] if id_col else []), label_col)
    if id_col:
        df = df.distinct()
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = samples.sparkSession.createDataFrame(
        [(x, i) for i, x in enumerate(labels)], "label string, label_order int")
    out = (F.broadcast(grid).join(counts, "label", "left")
           .select("label", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
                   "label_order"))
    return out.orderBy(F.col("n").desc(), "label_order") if by_count else out.orderBy("label_order")


def distinct_values(results: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column (models, prompts)."""
    return results.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def workload_size(samples: DataFrame, conditions: DataFrame) -> DataFrame:
    """Number of (sample, condition) evaluations a run implies (one aggregation
    over the union of both inputs; no product of the two tables is formed)."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = samples.select(one.alias("s"), zero.alias("c")).unionByName(
        conditions.select(zero.alias("s"), one.alias("c")))
    out = both.agg(F.sum("s").alias("n_samples"), F.sum("c").alias("n_conditions"))
    return out.withColumn("n_evaluations", F.col("n_samples") * F.col("n_conditions"))


def table1(metrics: DataFrame, cis: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Metrics left-joined with their bootstrap intervals, sorted by keys."""
    extra = [c for c in cis.columns if c not in group_cols]
    return metrics.join(cis.select(*group_cols, *extra), list(group_cols), "left") \
                  .orderBy(*group_cols)


def best_prompt_per_model(metrics: DataFrame, model_col: str = "model_name",
                          prompt_col: str = "prompt_id", metric: str = "macro_f1") -> DataFrame:
    """W2 (W2a): the highest-scoring prompt per model, first prompt in key order on ties."""
    w = Window.partitionBy(model_col).orderBy(F.col(metric).desc_nulls_last(),
                                              F.col(prompt_col).asc())
    return metrics.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def table2(per_class: DataFrame, best: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Per-class rows of the best condition of each model (semi-join)."""
    return per_class.join(best.select(*group_cols), list(group_cols), "left_semi")


def best_condition(metrics: DataFrame, group_cols: Sequence[str],
                   metric: str = "macro_f1") -> DataFrame:
    """W2 (W2b): the single best condition overall (first in key order on ties)."""
    return metrics.orderBy(F.col(metric).desc_nulls_last(),
                           *[F.col(c).asc() for c in group_cols]).limit(1)


def significant_pair_counts(mcnemar: DataFrame) -> DataFrame:
    """Number of pairs and of pairs significant at 0.05 / 0.01 after correction."""
    return mcnemar.agg(F.count(F.lit(1)).alias("n_pairs"),
                       F.count_if("significant_05").alias("n_significant_05"),
                       F.count_if("significant_01").alias("n_significant_01"))
