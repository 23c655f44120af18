"""Count-based classification metrics from the cell table.

All inputs are integer counts per condition; every ratio is one division of two
integers (or of two exactly-summed integer expressions), so results do not depend
on summation order or partitioning.

Definitions kept on purpose:
* accuracy counts an unparsed prediction as wrong;
* per-class F1 is ``2 tp / (row + col)`` with the row total including unparsed rows,
  0.0 when the denominator is 0; macro F1 averages over all K labels, absent ones 0;
* Cohen's kappa runs over the union of all observed values (``__NONE__`` and foreign
  predictions included): ``(tr n - S) / (n^2 - S)`` with ``S = sum_v row_v col_v``;
  null when undefined;
* sensitivity / specificity are read from the K x K matrix only, so unparsed rows
  leave the denominator; ``recall_all`` is the F1-consistent recall over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.config import NONE_LABEL

_DEC = "decimal(38,0)"


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long")))


def ratio(num: Column, den: Column, default: Column | float | None = 0.0) -> Column:
    """num / den as double, ``default`` when den == 0 (no ANSI divide error, no inf)."""
    d = default if isinstance(default, Column) else F.lit(default).cast("double")
    return F.when(den == 0, d).otherwise(num.cast("double") / den.cast("double"))


def condition_counts(cells: DataFrame, labels: Sequence[str],
                     group_cols: Sequence[str], with_chance: bool = True) -> DataFrame:
    """One row per condition with every integer needed by A2-A8 (``s_chance`` for
    kappa only when ``with_chance``)."""
    # conditional sums written as SQL text: one parse per aggregate instead of a tree of
    # Column objects built call by call on the driver
    def q(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lab = ", ".join(q(x) for x in labels)
    in_t, in_p = f"true_label IN ({lab})", f"predicted_label IN ({lab})"

    def s(cond: str, name: str) -> Column:
        return F.expr(f"sum(CASE WHEN {cond} THEN n ELSE CAST(0 AS BIGINT) END) AS {name}")
    aggs = [F.expr("sum(n) AS n_total"),
            s(f"predicted_label <> {q(NONE_LABEL)}", "n_parsed"),
            s("true_label = predicted_label", "n_correct"),
            s(f"{in_t} AND {in_p}", "n_matrix")]
    for i, label in enumerate(labels):
        x = q(label)
        aggs += [s(f"true_label = {x} AND predicted_label = {x}", f"tp_{i}"),
                 s(f"true_label = {x}", f"row_{i}"),
                 s(f"predicted_label = {x}", f"col_{i}"),
                 s(f"true_label = {x} AND {in_p}", f"rowm_{i}"),
                 s(f"predicted_label = {x} AND {in_t}", f"colm_{i}")]
    counts = cells.groupBy(*group_cols).agg(*aggs)
    if not with_chance:
        return counts

    # S = sum over every observed value v of (#true == v) * (#pred == v), exact.
    sides = F.array(
        F.struct(F.col("true_label").alias("v"), F.col("n").alias("r"),
                 F.lit(0).cast("long").alias("c")),
        F.struct(F.col("predicted_label").alias("v"), F.lit(0).cast("long").alias("r"),
                 F.col("n").alias("c")))
    marg = (cells.select(*group_cols, F.inline(sides))
                 .groupBy(*group_cols, "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c")))
    chance = marg.groupBy(*group_cols).agg(
        F.sum(F.col("r").cast(_DEC) * F.col("c").cast(_DEC)).alias("s_chance"))
    return counts.join(chance, list(group_cols), "inner")


def ratio_sql(num: str, den: str, default: str = "0.0") -> str:
    """SQL twin of :func:`ratio`."""
    return (f"CASE WHEN ({den}) = 0 THEN CAST({default} AS DOUBLE) "
            f"ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END")


def f1_sql(i: int) -> str:
    """A4: per-class F1 = 2 tp / (row + col), row including unparsed rows; 0.0 if empty."""
    return ratio_sql(f"2 * tp_{i}", f"row_{i} + col_{i}")


def macro_f1_sql(k: int) -> str:
    """A5: mean of A4 over all K labels in label order (absent labels count 0)."""
    return "(" + " + ".join(f1_sql(i) for i in range(k)) + f") / CAST({k} AS DOUBLE)"


# Cohen kappa over the union of observed values, exact integers until one division.
KAPPA_SQL = ("CASE WHEN CAST(n_total AS DECIMAL(38,0)) * CAST(n_total AS DECIMAL(38,0)) - s_chance = 0 "
             "THEN CAST(NULL AS DOUBLE) ELSE "
             "CAST(CAST(n_correct AS DECIMAL(38,0)) * CAST(n_total AS DECIMAL(38,0)) - s_chance AS DOUBLE) / "
             "CAST(CAST(n_total AS DECIMAL(38,0)) * CAST(n_total AS DECIMAL(38,0)) - s_chance AS DOUBLE) END")


def f1_col(i: int) -> Column:
    return F.expr(f1_sql(i))


def macro_f1_col(k: int) -> Column:
    return F.expr(macro_f1_sql(k))


def kappa_col() -> Column:
    return F.expr(KAPPA_SQL)


def metrics_from_counts(counts: DataFrame, labels: Sequence[str],
                        group_cols: Sequence[str]) -> DataFrame:
    """A2 parse rate, A3 accuracy (unparsed = wrong), A5 macro F1, A6 kappa."""
    return counts.selectExpr(
        *[f"`{c}`" for c in group_cols],
        "n_total", "n_parsed",
        f"{ratio_sql('n_parsed', 'n_total')} AS parse_rate",
        f"{ratio_sql('n_correct', 'n_total')} AS accuracy",
        f"{macro_f1_sql(len(labels))} AS macro_f1",
        f"{KAPPA_SQL} AS kappa",
    )


def per_class_from_counts(counts: DataFrame, labels: Sequence[str],
                          group_cols: Sequence[str]) -> DataFrame:
    """A4 F1, A7 sensitivity and A8 specificity (both inside the K x K matrix), recall_all."""
    rows = []
    for i, label in enumerate(labels):
        fp, fn = f"(colm_{i} - tp_{i})", f"(rowm_{i} - tp_{i})"
        tn = f"(n_matrix - tp_{i} - {fn} - {fp})"
        lit = "'" + label.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows.append(
            f"named_struct('class', {lit}, 'f1', {f1_sql(i)}, "
            f"'sensitivity', {ratio_sql(f'tp_{i}', f'rowm_{i}')}, "
            f"'specificity', {ratio_sql(tn, f'{tn} + {fp}')}, "
            f"'recall_all', {ratio_sql(f'tp_{i}', f'row_{i}')})")
    return counts.selectExpr(*[f"`{c}`" for c in group_cols], f"inline(array({', '.join(rows)}))")


def classification_metrics(cells: DataFrame, labels: Sequence[str],
                           group_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(metrics, per_class_metrics) from the all-cells table."""
    counts = condition_counts(cells, labels, group_cols)
    return (metrics_from_counts(counts, labels, group_cols),
            per_class_from_counts(counts, labels, group_cols))


def per_class_metrics(cells: DataFrame, labels: Sequence[str],
                      group_cols: Sequence[str]) -> DataFrame:
    """Per-class table alone (no kappa term needed)."""
    return per_class_from_counts(condition_counts(cells, labels, group_cols, with_chance=False),
                                 labels, group_cols)


def pct_text(num: Column, den: Column) -> Column:
    """``12.3%`` for num / den, rounded half-up on the exact ratio in integer
    arithmetic (so the text does not depend on a float formatter); ``0.0%`` if den = 0."""
    n, d = num.cast("long"), den.cast("long")
    tenths = F.when(d == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("div", n * 2000 + d, d * 2))
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))
