"""Score-ordered operators: tie-grouped prefix counts, ROC points (F6), the macro ROC
curve on a fixed FPR grid with its trapezoid area (F7 / J9), one-vs-rest AUC (A21).

No window ever spans a whole class.  Prefix sums over scores are two-level (ranges of scores
from a sketch, then scores inside a range); the grid curve is built from per-grid-bin
minima / maxima, so its windows run over at most ``grid_points`` rows per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.operators.calibration import AUC_RANGES, complete_prob_rows
from scorebook.operators.ranges import carried, with_ranges


#: One distinct score in so many, chosen by its hash, goes into the sketch of the score ranges.
SKETCH_SHARE = 8


def score_ties(rows: DataFrame, k: int, group_cols: Sequence[str]) -> DataFrame:
    """(C.., k, score, pos, neg): rows per distinct score of each one-vs-rest class."""
    per_class = F.array(*[
        F.struct(F.lit(i).alias("k"), F.col(f"p{i}").alias("score"),
                 (F.col("true_idx") == i).cast("long").alias("pos"))
        for i in range(k)])
    exploded = rows.select(*group_cols, F.inline(per_class))
    return (exploded.groupBy(*group_cols, "k", "score")
                    .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")))


def prefix_below(ties: DataFrame, key: Sequence[str], n_ranges: int | None = AUC_RANGES) -> DataFrame:
    """Add ``pos_below`` / ``neg_below``, counts at strictly lower scores in the same key.

    Ranges of scores that hold equal shares of a key's distinct scores, wherever these crowd; what
    earlier ranges carry, plus a running sum inside the range.  The ranges' bounds are computed
    and stored when the plan is built."""
    some = ties.filter(F.pmod(F.xxhash64("score"), F.lit(SKETCH_SHARE)) == 0)
    t = with_ranges(ties, key, "score", n_ranges, sketch_of=some).drop("copies")
    before = carried(t, key, ["rng"], {"pos_before": F.col("pos"), "neg_before": F.col("neg")})
    ws = (Window.partitionBy(*key, "rng").orderBy("score")
          .rowsBetween(Window.unboundedPreceding, -1))
    fine = t.withColumn("pos_in", F.coalesce(F.sum("pos").over(ws), F.lit(0))) \
            .withColumn("neg_in", F.coalesce(F.sum("neg").over(ws), F.lit(0)))
    j = fine.join(before, [*key, "rng"], "inner")
    return j.select(*key, "score", "pos", "neg",
                    (F.col("pos_before") + F.col("pos_in")).alias("pos_below"),
                    (F.col("neg_before") + F.col("neg_in")).alias("neg_below"))


def class_totals(ties: DataFrame, key: Sequence[str]) -> DataFrame:
    return ties.groupBy(*key).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _class_name(labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("k") + 1)


def roc_points(results: DataFrame, prob_cols: dict[str, str],
               group_cols: Sequence[str] = ("model_name",), n_ranges: int | None = AUC_RANGES) -> DataFrame:
    """one-vs-rest ROC points per (group, class): for every distinct score used as a
    threshold (predict positive when score >= threshold), fpr and tpr; plus the (0, 0)
    start point with a null threshold.  Classes with no positives or no negatives have
    no curve."""
    labels = list(prob_cols)
    group_cols = list(group_cols)
    rows = complete_prob_rows(results, prob_cols, group_cols)
    key = [*group_cols, "k"]
    ties = score_ties(rows, len(labels), group_cols)
    pre = prefix_below(ties, key, n_ranges)
    tot = class_totals(ties, key).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    j = pre.join(tot, key, "inner")
    pts = j.select(*key, F.col("score").alias("threshold"),
                   ((F.col("n_neg") - F.col("neg_below")) / F.col("n_neg")).alias("fpr"),
                   ((F.col("n_pos") - F.col("pos_below")) / F.col("n_pos")).alias("tpr"))
    start = tot.select(*key, F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    out = pts.unionByName(start)
    return out.select(*group_cols, _class_name(labels).alias("class"), "k",
                      "threshold", "fpr", "tpr")


def grid_x(g: Column, grid_points: int) -> Column:
    """x of grid point g on an evenly spaced [0, 1] grid: g * (1 / (n - 1)), last = 1.0."""
    step = 1.0 / (grid_points - 1)
    return F.when(g == grid_points - 1, F.lit(1.0)).otherwise(g.cast("double") * F.lit(step))


def grid_bin(fpr: Column, grid_points: int) -> Column:
    """Largest g with x_g <= fpr (exact in binary: estimate, then correct by one)."""
    n1 = grid_points - 1
    g0 = F.least(F.greatest(F.floor(fpr * F.lit(float(n1))), F.lit(0)), F.lit(n1)).cast("int")
    up = F.when((g0 < n1) & (grid_x(g0 + 1, grid_points) <= fpr), g0 + 1).otherwise(g0)
    return F.when(grid_x(up, grid_points) > fpr, up - 1).otherwise(up)


def roc_macro_grid(points: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                   grid_points: int = 200) -> tuple[DataFrame, DataFrame]:
    """Per group, the mean over classes of each class curve linearly
    interpolated at ``grid_points`` evenly spaced FPR values (between the last curve
    point at or left of x and the first point right of it), and the trapezoid area.

    Because a ROC curve is monotone, "last point at or left of x" has the largest fpr
    and tpr among points with fpr <= x, and "first point right of x" the smallest among
    points with fpr > x; both come from per-bin max / min aggregates."""
    group_cols = list(group_cols)
    key = [*group_cols, "k"]
    k = len(labels)
    p = points.withColumn("g", grid_bin(F.col("fpr"), grid_points))
    xg = grid_x(F.col("g"), grid_points)
    on_x = F.col("fpr") <= xg            # inside bin g this means fpr == x_g
    per_bin = p.groupBy(*key, "g").agg(
        F.max(F.when(on_x, F.col("fpr"))).alias("le_fpr"),
        F.max(F.when(on_x, F.col("tpr"))).alias("le_tpr"),
        F.max("fpr").alias("la_fpr"), F.max("tpr").alias("la_tpr"),
        F.min(F.when(~on_x, F.col("fpr"))).alias("rs_fpr"),
        F.min(F.when(~on_x, F.col("tpr"))).alias("rs_tpr"),
        F.min("fpr").alias("ra_fpr"), F.min("tpr").alias("ra_tpr"))
    grid = F.array(*[F.lit(g) for g in range(grid_points)])
    # keys from the per-bin table (at most grid_points rows per class), not the points
    full = per_bin.select(*key).distinct().select(*key, F.explode(grid).alias("g"))
    t = full.join(per_bin, [*key, "g"], "left")
    before = Window.partitionBy(*key).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy("g").rowsBetween(1, Window.unboundedFollowing)
    t = t.select(*key, "g",
                 F.greatest(F.col("le_fpr"), F.max("la_fpr").over(before)).alias("xl"),
                 F.greatest(F.col("le_tpr"), F.max("la_tpr").over(before)).alias("yl"),
                 F.least(F.col("rs_fpr"), F.min("ra_fpr").over(after)).alias("xr"),
                 F.least(F.col("rs_tpr"), F.min("ra_tpr").over(after)).alias("yr"))
    x = grid_x(F.col("g"), grid_points)
    slope = (F.col("yr") - F.col("yl")) / (F.col("xr") - F.col("xl"))
    val = F.when(F.col("xr").isNull(), F.col("yl")).otherwise(slope * (x - F.col("xl")) + F.col("yl"))
    per_class = t.select(*key, "g", x.alias("fpr"), val.alias("tpr"))
    wide = per_class.groupBy(*group_cols, "g", "fpr").agg(
        *[F.max(F.when(F.col("k") == i, F.col("tpr"))).alias(f"t{i}") for i in range(k)])
    total = F.col("t0")
    for i in range(1, k):
        total = total + F.col(f"t{i}")
    curve = wide.select(*group_cols, "g", "fpr", (total / F.lit(float(k))).alias("mean_tpr"))
    w = Window.partitionBy(*group_cols).orderBy("g")
    seg = curve.select(*group_cols, ((F.col("fpr") - F.lag("fpr").over(w))
                                     * (F.col("mean_tpr") + F.lag("mean_tpr").over(w))
                                     / F.lit(2.0)).alias("area"))
    auc = seg.groupBy(*group_cols).agg(F.sum("area").alias("macro_auc"))
    return curve, auc


def auc_from_prefix(pre: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mann-Whitney form: sum over positives of (negatives below + ties / 2), exact in
    integers, divided by n_pos * n_neg; null for a one-sided class."""
    dec = "decimal(38,0)"
    contrib = F.col("pos").cast(dec) * (2 * F.col("neg_below").cast(dec) + F.col("neg").cast(dec))
    agg = pre.groupBy(*key).agg(F.sum(contrib).alias("u2"), F.sum("pos").alias("n_pos"),
                                F.sum("neg").alias("n_neg"))
    den = 2 * F.col("n_pos").cast(dec) * F.col("n_neg").cast(dec)
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("u2").cast("double") / den.cast("double"))
    return agg.select(*key, auc.alias("auc"), "n_pos", "n_neg")
