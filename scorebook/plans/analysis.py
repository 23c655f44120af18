"""The full analysis of a results table, as lazy DataFrames.

Only the cell table (A1) and the calibration aggregations touch the fact table; the
cell table is persisted once because every count-based output reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.config import DEFAULT_GROUP_COLS, DEFAULT_LABELS
from scorebook.operators.calibration import macro_auc
from scorebook.operators.cells import (confusion_cells, drop_null_keys,
                                      prediction_or_none)
from scorebook.operators.metrics import classification_metrics


@dataclass
class Analysis:
    metrics: DataFrame
    per_class_metrics: DataFrame
    confusion_cells: DataFrame          # K x K grid per condition, zeros included
    cells_all: DataFrame                # every observed cell incl. __NONE__ / foreign
    bootstrap_cis: DataFrame | None = None
    calibration: DataFrame | None = None
    reliability: DataFrame | None = None
    auc_per_class: DataFrame | None = None
    group_cols: tuple = tuple(DEFAULT_GROUP_COLS)
    _persisted: list = None
    _mcnemar: Callable[[], DataFrame] | None = None

    @cached_property
    def mcnemar_results(self) -> DataFrame | None:
        """The pair tests; their pair table is counted and stored when this is first asked for."""
        return self._mcnemar() if self._mcnemar else None

    def release(self) -> None:
        """Unpersist the small tables the analysis cached (summary, per-class AUC)."""
        for df in self._persisted or []:
            df.unpersist()
        self._persisted = []


def require_columns(results: DataFrame, group_cols: Sequence[str]) -> None:
    """True and predicted label (and the grouping columns) must be present."""
    needed = {"true_label", "predicted_label", *group_cols}
    missing = sorted(needed - set(results.columns))
    if missing:
        raise ValueError(f"results must contain columns {sorted(needed)}; missing {missing}")


def prob_columns_present(results: DataFrame, labels: Sequence[str]) -> dict[str, str] | None:
    cols = {label: f"prob_{label}" for label in labels}
    return cols if all(c in results.columns for c in cols.values()) else None


def fact_summary(results: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                 prob_cols: dict[str, str] | None, n_bins: int = 10) -> DataFrame:
    """One aggregation over the fact table serving A1-A20.

    Key: (condition, true, predicted-or-__NONE__, has_probs, bin); values: row count,
    confidence sum, argmax-correct count, Brier-term sum.  At most
    K x (K + 2) x 2 x (n_bins + 1) rows per condition, map-side combined."""
    from scorebook.operators.calibration import binned_columns, complete_row
    df = drop_null_keys(results, group_cols)
    cols = [*[F.col(c) for c in group_cols], F.col("true_label"),
            prediction_or_none().alias("predicted_label")]
    if prob_cols is None:
        staged = df.select(*cols, F.lit(False).alias("has_probs"),
                           F.lit(None).cast("int").alias("bin"),
                           F.lit(None).cast("double").alias("conf"),
                           F.lit(None).cast("long").alias("correct"),
                           F.lit(None).cast("double").alias("sq"))
    else:
        idx = None
        for i, x in enumerate(labels):
            idx = F.when(F.col("true_label") == x, F.lit(i)) if idx is None \
                else idx.when(F.col("true_label") == x, F.lit(i))
        has = complete_row(prob_cols)
        # A truth outside the label list cannot be scored against the probabilities
        idx = idx.otherwise(F.when(has, F.raise_error(F.concat(
            F.lit("true label outside the label list: "), F.col("true_label").cast("string")))))
        staged = df.select(*cols, has.alias("has_probs"),
                           *[F.col(c).cast("double").alias(f"p{i}")
                             for i, c in enumerate(prob_cols.values())],
                           idx.alias("true_idx"))
        binned = binned_columns(len(labels), n_bins)
        staged = staged.select(*group_cols, "true_label", "predicted_label", "has_probs",
                               *[F.when(F.col("has_probs"), c).alias(n)
                                 for n, c in binned.items()])
    return staged.groupBy(*group_cols, "true_label", "predicted_label", "has_probs", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("sum_conf"),
        F.sum("correct").alias("n_correct"), F.sum("sq").alias("sum_sq"))


def run_full_analysis(results: DataFrame | str,
                      group_cols: Sequence[str] = tuple(DEFAULT_GROUP_COLS),
                      labels: Sequence[str] = tuple(DEFAULT_LABELS),
                      n_bootstrap: int = 2000,
                      bootstrap_metrics: Sequence[str] = ("macro_f1", "accuracy"),
                      seed: int = 42,
                      with_mcnemar: bool = True,
                      persist: bool = True, n_bins: int = 10,
                      spark: SparkSession | None = None, id_mode: str = "require") -> Analysis:
    """Every analysis table of a results table, or of the file or folder that holds it
    (``.csv``, else Parquet; needs ``spark``).  ``id_mode``: what to do without sample ids (P7).  Three passes over the fact table: the combined summary (cells, Brier,
    reliability), the tie-grouped scores (AUC) and the per-sample bitmasks (McNemar).
    The summary is persisted; it is at most a few hundred rows per condition."""
    from scorebook.operators.calibration import (auc_per_class, calibration_from_summary,
                                                 complete_prob_rows)
    from scorebook.sources.results import ensure_sample_id, read_results_csv
    group_cols, labels = list(group_cols), list(labels)
    if isinstance(results, str):
        if spark is None:
            raise ValueError("a path needs the spark argument")
        results = read_results_csv(spark, results, labels) if results.rstrip("/").endswith(".csv") \
            else spark.read.parquet(results)
    require_columns(results, group_cols)
    if with_mcnemar:
        results = ensure_sample_id(results, mode=id_mode)
    prob_cols = prob_columns_present(results, labels)
    summary = fact_summary(results, labels, group_cols, prob_cols, n_bins)
    if persist:
        summary = summary.persist(StorageLevel.MEMORY_AND_DISK)
    cells = summary.groupBy(*group_cols, "true_label", "predicted_label").agg(
        F.sum("n").alias("n"))
    metrics, per_class = classification_metrics(cells, labels, group_cols)
    grid = confusion_cells(results, labels, group_cols, cells=cells)

    out = Analysis(metrics=metrics, per_class_metrics=per_class,
                   confusion_cells=grid, cells_all=cells, group_cols=tuple(group_cols))
    out._persisted = [summary] if persist else []

    if prob_cols is not None:
        bins = summary.filter("has_probs").groupBy(*group_cols, "bin").agg(
            F.sum("n").alias("count"), F.sum("sum_conf").alias("sum_conf"),
            F.sum("n_correct").alias("n_correct"), F.sum("sum_sq").alias("sum_sq"))
        base, rel = calibration_from_summary(bins, len(labels), group_cols, n_bins)
        apc = auc_per_class(complete_prob_rows(results, prob_cols, group_cols), labels, group_cols)
        if persist:      # one row per (condition, class); read by metrics and calibration
            apc = apc.persist(StorageLevel.MEMORY_AND_DISK)
            out._persisted.append(apc)
        mauc = macro_auc(apc, len(labels), group_cols)
        out.calibration = base.join(mauc, group_cols, "left").select(
            *group_cols, "ece", "mce", "brier_score", "roc_auc", "n_calibration_samples")
        out.reliability = rel.drop("avg_confidence")
        out.auc_per_class = apc.drop("k")
        out.metrics = metrics.join(mauc, group_cols, "left")
    else:
        out.metrics = metrics.withColumn("roc_auc", F.lit(None).cast("double"))

    if n_bootstrap and bootstrap_metrics:
        from scorebook.operators.bootstrap import bootstrap_cis
        out.bootstrap_cis = bootstrap_cis(cells, labels, group_cols, n_bootstrap,
                                          list(bootstrap_metrics), seed=seed,
                                          metrics_table=metrics)
    if with_mcnemar:
        from scorebook.operators.compare import pairwise_mcnemar
        out._mcnemar = lambda: pairwise_mcnemar(
            results, group_cols, conditions=summary.select(*group_cols).distinct())
    return out


def print_summary(analysis: Analysis) -> str:
    """Human-readable summary from the condition-sized tables only (collects only
    condition- and pair-sized tables)."""
    lines = ["===  Classification Metrics  ==="]
    keys = list(analysis.group_cols)

    def name(r) -> str:
        return " / ".join(str(r[c]) for c in keys)
    m = analysis.metrics.orderBy(*keys)
    cols = [c for c in [*keys, "n_total", "parse_rate", "accuracy",
                        "macro_f1", "kappa", "roc_auc"] if c in m.columns]
    for r in m.select(*cols).collect():
        lines.append("  ".join(str(r[c]) for c in cols))
    if analysis.bootstrap_cis is not None and \
            "macro_f1_ci_lower" in analysis.bootstrap_cis.columns:
        lines.append("===  Bootstrap 95% CI (Macro-F1)  ===")
        for r in analysis.bootstrap_cis.collect():
            lines.append(f"{name(r)}: {r['macro_f1_point']:.4f} "
                         f"[{r['macro_f1_ci_lower']:.4f}, {r['macro_f1_ci_upper']:.4f}]")
    if analysis.mcnemar_results is not None:
        sig = analysis.mcnemar_results.filter("significant_05").collect()
        lines.append(f"===  Significant Pairwise Differences (BH p<0.05): {len(sig)}  ===")
        for r in sig:
            lines.append(f"{r['condition_a']} vs {r['condition_b']}: p_bh={r['p_bh']:.6f}")
    if analysis.calibration is not None:
        lines.append("===  Calibration (ECE / MCE / Brier)  ===")
        for r in analysis.calibration.collect():
            lines.append(f"  {name(r)}: ECE={r['ece']:.4f}  "
                         f"MCE={r['mce']:.4f}  Brier={r['brier_score']:.4f}")
    return "\n".join(lines)
