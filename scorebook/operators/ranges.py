"""Ordered work without one big window: ranges of a value from a sketch, and carries between them.

``with_ranges`` gives each row the number of the range of ``value`` that it falls in.  The bounds
are quantiles from ``percentile_approx`` (a mergeable sketch, map-side combined), so ranges hold
equal shares of the rows however the values are crowded.  A value that is a bound has a range of
its own; ``copies`` says how many bounds it is, that is, its share of the rows, so that rows of one
very frequent value can be dealt on (``with_tie_ranges``, or a salt where their order is open).

The sketch depends on the order in which its parts are merged, so bounds are stored once, under
``spark.checkpoint.dir``, and every step of a plan, and every task that runs again, reads the same ones.

Ranges are numbered in the order of the values: a running sum, minimum or rank is one inside the
range plus what the ranges before it carry, and a window over ranges has at most
``2 * n_ranges + 1`` rows a key.  Bounds reach the rows by an equi-join on the key; nothing is collected.

Nulls sort first, NaN last, as in Spark's own order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.session import stored

LEAST_RANGES, MOST_RANGES = 64, 4096


def default_ranges(df: DataFrame) -> int:
    """Ranges a key: four for each shuffle partition, between 64 and 4,096."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_RANGES, min(MOST_RANGES, 4 * parts))


def range_bounds(rows: DataFrame, key: Sequence[str], value: str, n_ranges: int) -> DataFrame:
    """key, ``_bounds``: the n_ranges - 1 inner quantiles of ``value``, in order, repeats included.

    The sketch's error is a tenth of a range."""
    shares = [i / n_ranges for i in range(1, n_ranges)]
    if not shares:
        return rows.groupBy(*key).agg(F.lit(None).cast("array<double>").alias("_bounds"))
    quantiles = F.percentile_approx(F.when(~F.isnan(value), F.col(value)), shares, 10 * n_ranges)
    return rows.groupBy(*key).agg(quantiles.alias("_bounds"))


def _below(value: Column, n_ranges: int, or_equal: bool) -> Column:
    """How many entries of ``_bounds`` are below ``value`` (or equal to it): binary search."""
    steps = [1 << k for k in reversed(range(max(1, n_ranges - 1).bit_length()))]
    bounds = F.col("_bounds")

    def step(found: Column, s: Column) -> Column:
        at = F.get(bounds, found + s - 1)
        return F.when((at <= value) if or_equal else (at < value), found + s).otherwise(found)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_ranges(rows: DataFrame, key: Sequence[str], value: str, n_ranges: int | None = None,
                rng: str = "rng", copies: str = "copies", sketch_of: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``rng`` (order of the value's range) and ``copies`` (number of bounds equal to
    the value; 0 between bounds).  ``sketch_of``: rows to take the bounds from, if not ``rows``; a key
    without any has one range."""
    n = n_ranges or default_ranges(rows)
    bounds = stored(range_bounds(sketch_of if sketch_of is not None else rows, key, value, n), "range-bounds")
    found = rows.join(bounds, list(key), "left").withColumns(
        {"_lo": _below(F.col(value), n, False), "_hi": _below(F.col(value), n, True)})
    same = F.col("_hi") - F.col("_lo")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns],
                        (2 * F.col("_lo") + (same > 0).cast("int")).alias(rng), same.alias(copies))


def carried(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: dict[str, Column],
            how=F.sum, default=0, backwards: bool = False) -> DataFrame:
    """key, order, and per name of ``values`` what the ranges before (``backwards``: after) carry:
    ``how`` over the earlier ranges' ``how`` of the expression, ``default`` where there is none."""
    per = rows.groupBy(*key, *order).agg(*[how(v).alias(n) for n, v in values.items()])
    cols = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    w = Window.partitionBy(*key).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*key, *order, *[
        (F.coalesce(how(n).over(w), F.lit(default)) if default is not None else how(n).over(w)).alias(n)
        for n in values])


def with_tie_ranges(rows: DataFrame, key: Sequence[str], value: str, tie: str,
                    n_ranges: int | None = None) -> DataFrame:
    """``rows`` with ``rng`` and ``sub``: the order of (rng, sub, value, tie) is that of (value,
    tie).  Rows of a value that is ``copies`` bounds are dealt to as many parts by the quantiles of
    their integer ``tie`` column, so no (rng, sub) holds much more than a range's share."""
    n = n_ranges or default_ranges(rows)
    ranged = with_ranges(rows, key, value, n)
    crowded = stored(ranged.filter(F.col("copies") > 1).groupBy(*key, "rng").agg(
        F.percentile_approx(tie, [i / n for i in range(1, n)], 10 * n).alias("_bounds")), "tie-bounds")
    j = ranged.join(crowded, [*key, "rng"], "left")
    # of n - 1 quantiles every (n / copies)-th one counts
    part = F.floor(_below(F.col(tie), n, False) * F.col("copies") / F.lit(n)).cast("int")
    sub = F.when(F.col("copies") > 1, part).otherwise(0)
    return j.select(*[F.col(f"`{c}`") for c in rows.columns], "rng", sub.alias("sub"))


def row_index(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a 0-based row number ``name`` in the order in which the rows are read.

    Rows are counted per partition; the counts of earlier partitions (one row each) plus the place
    inside the partition give the number.  Both come from ``monotonically_increasing_id``, whose
    upper bits are the partition and whose lower 33 bits the place, so no row leaves the engine.
    ``df`` should read the same way twice, as a file scan does."""
    marked = df.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mono", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_all", F.col("_part") - F.col("_part"))
    before = carried(counts, ["_all"], ["_part"], {"_before": F.col("_n")}).drop("_all")
    place = F.col("_mono").bitwiseAND((1 << 33) - 1)
    return marked.withColumn("_part", part).join(before, "_part").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place).alias(name))
