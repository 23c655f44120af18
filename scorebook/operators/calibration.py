"""Brier score, reliability bins, ECE / MCE and macro one-vs-rest ROC-AUC.

Inputs are the fact table's per-class probability columns (``prob_<label>``); rows
with any null probability or a null true label are left out (P15).

AUC is computed exactly from tie-grouped score counts: for every class, scores are
grouped per distinct value, and the number of negatives strictly below each value
is a prefix sum.  The prefix sum is split in two levels so that no window partition
holds a whole class: a coarse prefix over ranges of scores that hold equal shares of the
class plus a fine prefix inside each range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.operators.cells import drop_null_keys

# Ranges of the two-level prefix sums over scores, per (condition, class); None: by the number of
# shuffle partitions.  Each holds an equal share of the distinct scores.
AUC_RANGES = None
from scorebook.operators.metrics import ratio


def complete_row(prob_cols: dict[str, str], true_col: str = "true_label") -> Column:
    """The truth and every probability are there (a NaN probability is missing)."""
    has = F.col(true_col).isNotNull()
    for c in prob_cols.values():
        has = has & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return has


def complete_prob_rows(results: DataFrame, prob_cols: dict[str, str],
                       group_cols: Sequence[str], true_col: str = "true_label",
                       keep: Sequence[str] = ()) -> DataFrame:
    """P15 + J6: rows with every probability and the truth (and the columns ``keep``).

    Output columns ``p0 .. p{K-1}`` (probabilities in label order) and ``true_idx``
    (0-based position of the truth in the label list).  Plain columns rather than an
    array keep every downstream expression inside whole-stage codegen.
    """
    labels = list(prob_cols.keys())
    df = drop_null_keys(results, group_cols).filter(complete_row(prob_cols, true_col))
    idx = None
    for i, x in enumerate(labels):
        idx = F.when(F.col(true_col) == x, F.lit(i)) if idx is None \
            else idx.when(F.col(true_col) == x, F.lit(i))
    # A truth outside the label list has no probability column: fail loudly
    idx = idx.otherwise(F.raise_error(F.concat(
        F.lit("true label outside the label list: "), F.col(true_col).cast("string"))))
    return df.select(
        *group_cols,
        *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(prob_cols.values())],
        idx.alias("true_idx"), *keep,
    )


def _dbl(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def max_prob_sql(k: int) -> str:
    return "greatest(" + ", ".join(f"p{i}" for i in range(k)) + ")" if k > 1 else "p0"


def first_argmax_sql(k: int) -> str:
    conf = max_prob_sql(k)
    return "CASE " + " ".join(f"WHEN p{i} = {conf} THEN {i}" for i in range(k)) + " END"


def max_prob(k: int) -> Column:
    return F.expr(max_prob_sql(k))


def first_argmax(k: int) -> Column:
    return F.expr(first_argmax_sql(k))


def bin_edges(n_bins: int) -> list[float]:
    """Evenly spaced edges computed as ``i * (1 / n_bins)``, last edge exactly 1.0.

    This reproduces the binary values of an evenly spaced grid, where e.g. the edge
    near 0.3 is 0.30000000000000004, so a confidence of exactly 0.3 falls in bin 2.
    """
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index_sql(conf: str, n_bins: int) -> str:
    """lo <= conf < hi per bin; the last bin takes everything >= its lower edge."""
    edges = bin_edges(n_bins)
    parts = [f"WHEN isnan({conf}) OR {conf} < {_dbl(edges[0])} THEN CAST(NULL AS INT)"]
    parts += [f"WHEN {conf} < {_dbl(edges[b + 1])} THEN {b}" for b in range(n_bins - 1)]
    return "CASE " + " ".join(parts) + f" ELSE {n_bins - 1} END"


def bin_index(conf: Column | str, n_bins: int) -> Column:
    if isinstance(conf, str):
        return F.expr(bin_index_sql(conf, n_bins))
    edges = bin_edges(n_bins)
    expr = F.when(F.isnan(conf) | (conf < F.lit(edges[0])), F.lit(None).cast("int"))
    for b in range(n_bins - 1):
        expr = expr.when(conf < F.lit(edges[b + 1]), F.lit(b))
    return expr.otherwise(F.lit(n_bins - 1))


class CalibrationTables:
    """The calibration tables; those with an AUC are planned when first asked for, since their
    score ranges are computed and stored then."""

    def __init__(self, base: DataFrame, reliability: DataFrame, per_class: Callable[[], DataFrame],
                 k: int, group_cols: Sequence[str]) -> None:
        self._base, self._per_class, self._k, self._group_cols = base, per_class, k, list(group_cols)
        self.reliability = reliability   # C, bin, bin_mid, frac_correct, count

    @cached_property
    def _auc(self) -> DataFrame:
        return self._per_class()

    @cached_property
    def auc_per_class(self) -> DataFrame:
        """C, class, auc, n_pos, n_neg."""
        return self._auc.drop("k")

    @cached_property
    def calibration(self) -> DataFrame:
        """C, ece, mce, brier_score, roc_auc, n_calibration_samples."""
        macro = macro_auc(self._auc, self._k, self._group_cols)
        return self._base.join(macro, self._group_cols, "left").select(
            *self._group_cols, "ece", "mce", "brier_score", "roc_auc", "n_calibration_samples")


def brier_term_sql(k: int) -> str:
    return " + ".join(
        f"(p{i} - CASE WHEN true_idx = {i} THEN 1.0D ELSE 0.0D END) * "
        f"(p{i} - CASE WHEN true_idx = {i} THEN 1.0D ELSE 0.0D END)" for i in range(k))


def brier_term(k: int) -> Column:
    """Per row: sum over classes of (p - onehot)^2."""
    return F.expr(brier_term_sql(k))


def binned_columns(k: int, n_bins: int) -> dict[str, Column]:
    """conf (max prob), correct (first argmax == truth), bin, Brier term, by name."""
    conf = max_prob_sql(k)
    return {"conf": F.expr(conf),
            "correct": F.expr(f"CAST(({first_argmax_sql(k)}) = true_idx AS BIGINT)"),
            "bin": F.expr(bin_index_sql(conf, n_bins)),
            "sq": brier_term(k)}


def bin_summary(rows: DataFrame, k: int, group_cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """One aggregation for A17-A20: per (condition, bin) count, confidence sum, correct
    count and Brier-term sum.  ``bin`` is null for confidences outside every bin; those
    rows still count for n and the Brier score."""
    binned = rows.select(*group_cols, *[c.alias(n) for n, c in binned_columns(k, n_bins).items()])
    return binned.groupBy(*group_cols, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.sum("conf").alias("sum_conf"),
        F.sum("correct").alias("n_correct"), F.sum("sq").alias("sum_sq"))


def brier_and_n(summary: DataFrame, k: int, group_cols: Sequence[str]) -> DataFrame:
    """Mean over rows and classes of (p - onehot)^2, and the row count."""
    return summary.groupBy(*group_cols).agg(
        (F.sum("sum_sq") / (F.sum("count") * F.lit(k))).alias("brier_score"),
        F.sum("count").alias("n_calibration_samples"))


def reliability_bins(summary: DataFrame, group_cols: Sequence[str], n_bins: int = 10,
                     conditions: DataFrame | None = None) -> DataFrame:
    """Per bin count, mean confidence and fraction correct; empty bins as
    (mid, 0.0, 0)."""
    stats = summary.filter(F.col("bin").isNotNull())
    if conditions is None:
        conditions = summary.select(*group_cols).distinct()
    edges = bin_edges(n_bins)
    grid = F.array(*[F.struct(F.lit(b).alias("bin"),
                              F.lit((edges[b] + edges[b + 1]) / 2).alias("bin_mid"))
                     for b in range(n_bins)])
    full = conditions.select(*group_cols, F.inline(grid))
    out = full.join(stats, [*group_cols, "bin"], "left")
    cnt = F.coalesce(F.col("count"), F.lit(0).cast("long"))
    return out.select(
        *group_cols, "bin", "bin_mid",
        ratio(F.coalesce(F.col("n_correct"), F.lit(0)), cnt, 0.0).alias("frac_correct"),
        cnt.alias("count"),
        ratio(F.coalesce(F.col("sum_conf"), F.lit(0.0)), cnt, None).alias("avg_confidence"),
    )


def ece_mce(reliability: DataFrame, n_rows: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """A19/A20 from the bin table: ECE = sum gap * count / n, MCE = max gap (0.0 if none)."""
    gap = F.abs(F.col("avg_confidence") - F.col("frac_correct"))
    j = reliability.filter(F.col("count") > 0).join(n_rows, list(group_cols), "inner")
    return j.groupBy(*group_cols).agg(
        F.sum(gap * F.col("count") / F.col("n_calibration_samples")).alias("ece"),
        F.max(gap).alias("mce"))


def calibration_from_summary(summary: DataFrame, k: int, group_cols: Sequence[str],
                             n_bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(ece / mce / brier / n per condition, reliability table) from a bin summary.

    Brier, ECE and MCE come from one aggregation over the bin summary (n per condition
    via a window over its at most n_bins + 1 rows); the reliability table adds the
    empty bins."""
    from pyspark.sql import Window
    n_c = F.sum("count").over(Window.partitionBy(*group_cols))
    staged = summary.withColumn("_n", n_c)
    filled = F.col("bin").isNotNull() & (F.col("count") > 0)
    gap = F.abs(F.col("sum_conf") / F.col("count") - F.col("n_correct") / F.col("count"))
    cal = staged.groupBy(*group_cols).agg(
        (F.sum("sum_sq") / (F.sum("count") * F.lit(k))).alias("brier_score"),
        F.sum("count").alias("n_calibration_samples"),
        F.coalesce(F.sum(F.when(filled, gap * F.col("count") / F.col("_n"))), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(F.when(filled, gap)), F.lit(0.0)).alias("mce"))
    cal = cal.select(*group_cols, "ece", "mce", "brier_score", "n_calibration_samples")
    rel = reliability_bins(summary, group_cols, n_bins,
                           conditions=summary.select(*group_cols).distinct())
    return cal, rel


def auc_per_class(rows: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                  n_ranges: int | None = AUC_RANGES) -> DataFrame:
    """One-vs-rest AUC per (condition, class), ties credited 1/2; null if one-sided."""
    from scorebook.operators.roc import auc_from_prefix, prefix_below, score_ties
    key = [*group_cols, "k"]
    pre = prefix_below(score_ties(rows, len(labels), group_cols), key, n_ranges)
    auc = auc_from_prefix(pre, key)
    names = F.array(*[F.lit(x) for x in labels])
    return auc.select(*group_cols, F.element_at(names, F.col("k") + 1).alias("class"),
                      "k", "auc", "n_pos", "n_neg")


def macro_auc(per_class: DataFrame, k: int, group_cols: Sequence[str]) -> DataFrame:
    """Unweighted mean over classes in label order; null if any class AUC is undefined."""
    cols = [F.max(F.when(F.col("k") == i, F.col("auc"))).alias(f"a{i}") for i in range(k)]
    undefined = F.count(F.when(F.col("auc").isNull(), 1)) > 0
    wide = per_class.groupBy(*group_cols).agg(
        *cols, undefined.alias("undef"), F.count(F.lit(1)).alias("nk"))
    total = F.col("a0")
    for i in range(1, k):
        total = total + F.col(f"a{i}")
    return wide.select(*group_cols, F.when(F.col("undef") | (F.col("nk") < k),
                                           F.lit(None).cast("double"))
                       .otherwise(total / F.lit(float(k))).alias("roc_auc"))


def calibration_metrics(results: DataFrame, prob_cols: dict[str, str],
                        group_cols: Sequence[str], n_bins: int = 10,
                        n_ranges: int | None = AUC_RANGES) -> CalibrationTables:
    """A17-A21 from two passes over the rows: one bin summary, one tie-grouped AUC."""
    labels = list(prob_cols.keys())
    missing = [c for c in prob_cols.values() if c not in results.columns]
    if missing:
        raise ValueError(f"probability columns missing: {missing}")
    rows = complete_prob_rows(results, prob_cols, group_cols)
    summary = bin_summary(rows, len(labels), group_cols, n_bins)
    base, rel = calibration_from_summary(summary, len(labels), group_cols, n_bins)
    return CalibrationTables(base, rel.drop("avg_confidence"),
                             lambda: auc_per_class(rows, labels, group_cols, n_ranges), len(labels), group_cols)


def roc_auc_table(results: DataFrame, prob_cols: dict[str, str],
                  group_cols: Sequence[str], n_ranges: int | None = AUC_RANGES) -> DataFrame:
    """A21 alone: macro one-vs-rest AUC per condition (for the metrics table)."""
    labels = list(prob_cols.keys())
    rows = complete_prob_rows(results, prob_cols, group_cols)
    return macro_auc(auc_per_class(rows, labels, group_cols, n_ranges), len(labels), group_cols)
