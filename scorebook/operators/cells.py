"""A1/A2: confusion cells, the one aggregation over the fact table.

Every count-based metric (accuracy, F1, kappa, sensitivity, specificity, the
row-normalised matrix, the multinomial bootstrap) is a function of the cell table
``(C..., true_label, predicted_label, n)``: at most K x (K + 2) rows per condition.
The groupBy runs with map-side partial aggregation, so a condition holding a third
of all rows costs one hash-map entry per cell per task, not a hot reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.config import NONE_LABEL


def drop_null_keys(results: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Rows with a null grouping key belong to no condition (pandas groupby semantics)."""
    cond = None
    for c in group_cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return results if cond is None else results.filter(cond)


def prediction_or_none(col: str = "predicted_label") -> Column:
    """P5: an unparsed (null) prediction becomes ``__NONE__``: always wrong, own kappa class."""
    return F.coalesce(F.col(col), F.lit(NONE_LABEL))


def confusion_cells_all(results: DataFrame, group_cols: Sequence[str],
                        true_col: str = "true_label",
                        pred_col: str = "predicted_label") -> DataFrame:
    """All non-empty cells, unparsed predictions as ``__NONE__``, foreign labels kept."""
    df = drop_null_keys(results, group_cols)
    return (df.groupBy(*[F.col(c) for c in group_cols],
                       F.col(true_col).alias("true_label"),
                       prediction_or_none(pred_col).alias("predicted_label"))
              .agg(F.count(F.lit(1)).alias("n")))


def label_grid(conditions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every (condition, true, pred) cell over the label set: K x K rows per condition."""
    pairs = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"))
                      for t in labels for p in labels])
    return conditions.select("*", F.inline(pairs))


def confusion_cells(results: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                    cells: DataFrame | None = None) -> DataFrame:
    """The K x K confusion matrix per condition in long form, absent cells as 0.

    Like a confusion matrix restricted to the label set: unparsed and foreign
    predictions are left out of the grid (they still count in accuracy, F1, kappa).
    """
    if cells is None:
        cells = confusion_cells_all(results, group_cols)
    conds = cells.select(*group_cols).distinct()
    grid = label_grid(conds, labels)
    keys = [*group_cols, "true_label", "predicted_label"]
    return (grid.join(cells, keys, "left")
                .select(*keys, F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n")))


def confusion_arrays(cells_grid: DataFrame, labels: Sequence[str],
                     group_cols: Sequence[str]) -> DataFrame:
    """The K x K matrix per condition as ``array<array<bigint>>`` (rows = true)."""
    row_exprs = []
    for t in labels:
        row_exprs.append(F.array(*[
            F.sum(F.when((F.col("true_label") == t) & (F.col("predicted_label") == p),
                         F.col("n")).otherwise(F.lit(0).cast("long")))
            for p in labels]))
    return cells_grid.groupBy(*group_cols).agg(F.array(*row_exprs).alias("matrix"))
