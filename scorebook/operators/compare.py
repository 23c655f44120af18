"""Pairwise McNemar tests between conditions with
Benjamini-Hochberg correction.

Discordant counts without a self-join.  For conditions a < b over the samples both
evaluated:  b_ab = #(a right, b present) - #(a right, b right) and
c_ab = #(b right, a present) - #(a right, b right).  All three terms are entries of
Gram matrices of per-sample indicator vectors, so the plan is:

1. per sample: ``bit_or`` of one-hot condition bits into ``present`` / ``correct``
   words (64 conditions per word).  Constant-size state per group, map-side combined,
   so a sample id holding a third of all rows is no hot spot;
2. samples with equal patterns are counted together (map-side combined), so the
   next step sees one weighted row per distinct pattern;
3. per partition of patterns: unpack the words and add up ``P'P``, ``R'P``, ``R'R``
   with NumPy (``mapInPandas``); each task emits at most C(C-1)/2 rows;
4. ``groupBy(a, b)`` sums the partial matrices.

More than ``TILE`` conditions go by pairs of blocks of conditions (:func:`tiled_pair_counts`).

The shuffle in step 1 moves one row per (sample, condition): the sample id, a condition
index and a correctness flag.  Nothing per pair of samples or pair of rows is ever
materialised.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.config import NONE_LABEL
from scorebook.functions.special import chi2_sf_1df
from scorebook.operators.cells import drop_null_keys
from scorebook.operators.metrics import ratio
from scorebook.session import stored
from scorebook.operators.ranges import carried, with_tie_ranges

#: Conditions a task's matrices span at most (a multiple of 64): four of TILE x TILE longs, 8 MB.
TILE = 512

PAIR_SCHEMA = T.StructType([
    T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
    T.StructField("n_shared", T.LongType()), T.StructField("ra_pb", T.LongType()),
    T.StructField("rb_pa", T.LongType()), T.StructField("ra_rb", T.LongType()),
])


def condition_key(group_cols: Sequence[str]) -> Column:
    """``model / prompt`` display key (any number of grouping columns)."""
    return F.concat_ws(" / ", *[F.col(c).cast("string") for c in group_cols])


def indexed_conditions(results: DataFrame, group_cols: Sequence[str],
                       conditions: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Distinct conditions numbered 0.. in sorted key order (W4), and their count.

    The window has no partition key, but it runs over the distinct-condition table
    (one row per model x prompt), never over the fact table.  ``conditions`` (the
    distinct keys, e.g. from an already computed summary) saves a pass over the facts."""
    src = conditions if conditions is not None else results
    conds = drop_null_keys(src.select(*group_cols), group_cols).distinct()
    w = Window.orderBy(*[F.col(c).asc() for c in group_cols])
    conds = conds.withColumn("cond_idx", (F.row_number().over(w) - 1).cast("int")) \
                 .withColumn("condition", condition_key(group_cols))
    conds = conds.cache()
    return conds, conds.count()


def sample_masks(results: DataFrame, conds: DataFrame, n_conds: int,
                 group_cols: Sequence[str], id_col: str = "sample_id") -> DataFrame:
    """One row per sample: ``present_w`` / ``correct_w`` 64-bit words per block of 64."""
    n_words = max(1, (n_conds + 63) // 64)
    rows = drop_null_keys(results, group_cols).filter(F.col(id_col).isNotNull())
    ok = F.coalesce(F.col("predicted_label"), F.lit(NONE_LABEL)) == F.col("true_label")
    j = rows.select(id_col, *group_cols, "true_label", F.coalesce(ok, F.lit(False)).alias("ok")) \
        .join(conds.select(*group_cols, "cond_idx"),
              list(group_cols), "inner")
    aggs = []
    for w in range(n_words):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cond_idx") % 64)
        in_word = (F.col("cond_idx") / 64).cast("int") == w
        zero = F.lit(0).cast("long")
        aggs.append(F.bit_or(F.when(in_word, bit).otherwise(zero)).alias(f"present_{w}"))
        aggs.append(F.bit_or(F.when(in_word & F.col("ok"), bit).otherwise(zero))
                    .alias(f"correct_{w}"))
    # Q19: pairing assumes one truth per sample; checked in the same aggregation
    aggs += [F.min("true_label").alias("_t_min"), F.max("true_label").alias("_t_max"),
             F.count(F.lit(1)).alias("_rows")]
    masks = j.groupBy(id_col).agg(*aggs)
    conflict = F.col("_t_min") != F.col("_t_max")
    # and one row per (sample, condition): as many rows as bits
    bits = sum((F.bit_count(F.col(f"present_{w}")) for w in range(n_words)), F.lit(0))
    masks = masks.withColumn("present_0", F.when(F.col("_rows") != bits, F.raise_error(F.concat(
        F.lit("sample is there twice under one condition: "), F.col(id_col).cast("string"))))
        .otherwise(F.col("present_0"))).drop("_rows")
    # folded into a column that is consumed, so the check cannot be pruned away
    return masks.withColumn("present_0", F.when(conflict, F.raise_error(F.concat(
        F.lit("sample has different true labels across conditions: "),
        F.col(id_col).cast("string")))).otherwise(F.col("present_0"))).drop("_t_min", "_t_max")


def _unpack(words: np.ndarray, n_conds: int) -> np.ndarray:
    """int64 words (n x W) -> 0/1 float matrix (n x n_conds), bit i = condition i."""
    u8 = words.astype("<i8").view(np.uint8).reshape(words.shape[0], -1)
    bits = np.unpackbits(u8, axis=1, bitorder="little")
    return bits[:, :n_conds].astype(np.float64)


def _gram_partials(n_conds: int, n_words: int):
    pcols = [f"present_{w}" for w in range(n_words)]
    ccols = [f"correct_{w}" for w in range(n_words)]
    iu = np.triu_indices(n_conds, k=1)

    def run(batches):
        pp = np.zeros((n_conds, n_conds))
        rp = np.zeros((n_conds, n_conds))
        rr = np.zeros((n_conds, n_conds))
        seen = False
        for pdf in batches:
            if pdf.empty:
                continue
            seen = True
            pres = _unpack(pdf[pcols].to_numpy(dtype=np.int64), n_conds)
            corr = _unpack(pdf[ccols].to_numpy(dtype=np.int64), n_conds)
            w = pdf["weight"].to_numpy(dtype=np.float64)[:, None] if "weight" in pdf else 1.0
            pp += pres.T @ (pres * w)
            rp += corr.T @ (pres * w)
            rr += corr.T @ (corr * w)
        if not seen:
            return
        out = pd.DataFrame({
            "a": iu[0].astype(np.int32), "b": iu[1].astype(np.int32),
            "n_shared": pp[iu].round().astype(np.int64),
            "ra_pb": rp[iu].round().astype(np.int64),
            "rb_pa": rp.T[iu].round().astype(np.int64),
            "ra_rb": rr[iu].round().astype(np.int64),
        })
        yield out[out["n_shared"] > 0]

    return run


def tile_masks(results: DataFrame, conds: DataFrame, group_cols: Sequence[str], id_col: str,
               tile: int) -> DataFrame:
    """One row per (sample, block of ``tile`` conditions): ``present_w`` / ``correct_w`` words, the
    sample's truth.  Rows given twice and truths that differ inside a block fail here."""
    rows = drop_null_keys(results, group_cols).filter(F.col(id_col).isNotNull())
    ok = F.coalesce(F.col("predicted_label"), F.lit(NONE_LABEL)) == F.col("true_label")
    j = rows.select(F.col(id_col).cast("string").alias("_id"), *group_cols, "true_label",
                    F.coalesce(ok, F.lit(False)).alias("ok")) \
        .join(conds.select(*group_cols, "cond_idx"), list(group_cols)) \
        .withColumn("block", F.floor(F.col("cond_idx") / tile).cast("int")) \
        .withColumn("at", (F.col("cond_idx") % tile).cast("int"))
    aggs, zero = [], F.lit(0).cast("long")
    for w in range(tile // 64):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)
        in_word = (F.col("at") / 64).cast("int") == w
        aggs.append(F.bit_or(F.when(in_word, bit).otherwise(zero)).alias(f"present_{w}"))
        aggs.append(F.bit_or(F.when(in_word & F.col("ok"), bit).otherwise(zero)).alias(f"correct_{w}"))
    masks = j.groupBy("_id", "block").agg(*aggs, F.min("true_label").alias("truth"),
                                          F.max("true_label").alias("_t_max"), F.count(F.lit(1)).alias("_rows"))
    bits = sum((F.bit_count(F.col(f"present_{w}")) for w in range(tile // 64)), F.lit(0))
    fault = F.when(F.col("_rows") != bits, F.lit("sample is there twice under one condition: ")) \
        .when(F.col("truth") != F.col("_t_max"), F.lit("sample has different true labels across conditions: "))
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("_id")))).otherwise(F.col("present_0"))
    return masks.withColumn("present_0", checked).drop("_t_max", "_rows")


def _tile_partials(tile: int, rows_at_once: int = 2048):
    """Rows sorted by (ti, tj, chunk, sample, block) -> partial counts per pair of conditions.

    Held at a time: four ``tile x tile`` matrices of one tile pair and ``rows_at_once`` unpacked
    rows, whatever the number of conditions and samples."""
    n_words = tile // 64
    cols = [[f"{kind}_{w}" for w in range(n_words)] for kind in ("present", "correct")]

    def unpack(words: np.ndarray) -> np.ndarray:
        return _unpack(words, tile).astype(np.float32)

    def emit(key, acc):
        shared = np.triu(acc[0], 1) if key[0] == key[1] else acc[0]
        a, b = np.nonzero(shared)
        out = [a + key[0] * tile, b + key[1] * tile, *[m[a, b] for m in acc]]
        for i in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[i:i + 65536].astype(np.int32 if k < 2 else np.int64)) for k, x in enumerate(out)],
                names=PAIR_SCHEMA.fieldNames())

    def run(batches):
        key, acc, kept = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:        # a sample's two rows may stand on both sides of a batch's edge
                table = pa.concat_tables([kept, table])
            ti, tj, block = (table.column(c).to_numpy() for c in ("ti", "tj", "block"))
            ids, truth = table.column("_id").combine_chunks(), table.column("truth").combine_chunks()
            again = np.zeros(len(ti), dtype=bool)
            if len(ti) > 1:
                again[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            words = [np.column_stack([table.column(c).to_numpy() for c in names]) for names in cols]
            fresh = np.arange(len(ti)) >= (kept is not None)
            edge = np.flatnonzero(np.concatenate([[True], (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1]), [True]]))
            for s, e in zip(edge[:-1], edge[1:]):
                if (ti[s], tj[s]) != key:
                    if acc is not None:
                        yield from emit(key, acc)
                    key, acc = (int(ti[s]), int(tj[s])), [np.zeros((tile, tile), np.int64) for _ in range(4)]
                if key[0] == key[1]:
                    left = right = np.flatnonzero(fresh[s:e]) + s
                else:
                    second = np.arange(s + 1, e)
                    right = second[again[s + 1:e] & (block[s + 1:e] == key[1]) & (block[s:e - 1] == key[0])]
                    left = right - 1
                    odd = np.flatnonzero(pc.not_equal(truth.take(pa.array(left)), truth.take(pa.array(right)))
                                         .fill_null(False).to_numpy(zero_copy_only=False)) if len(left) else []
                    if len(odd):
                        raise ValueError(f"sample has different true labels across conditions: {ids[int(left[odd[0]])]}")
                for i in range(0, len(left), rows_at_once):
                    x, y = left[i:i + rows_at_once], right[i:i + rows_at_once]
                    pl, cl = unpack(words[0][x]), unpack(words[1][x])
                    pr, cr = (pl, cl) if left is right else (unpack(words[0][y]), unpack(words[1][y]))
                    for m, product in zip(acc, (pl.T @ pr, cl.T @ pr, pl.T @ cr, cl.T @ cr)):
                        m += product.astype(np.int64)       # below 2 ** 24, so exact in single precision
            kept = table.slice(len(ti) - 1)
        if acc is not None:
            yield from emit(key, acc)
    return run


def tiled_pair_counts(results: DataFrame, conds: DataFrame, n_conds: int, group_cols: Sequence[str],
                      id_col: str, tile: int) -> DataFrame:
    """The Gram matrices by pairs of blocks of ``tile`` conditions.

    A sample's mask row of a block goes to each pair of blocks that it is part of; a group is one
    pair of blocks and one chunk of samples, streamed in sample order.  The number of chunks
    follows the shuffle partitions, so that all tasks have work and partial results stay few."""
    n_blocks = -(-n_conds // tile)
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-2 * parts // (n_blocks * (n_blocks + 1) // 2)))
    masks = tile_masks(results, conds, group_cols, id_col, tile)
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    sent = masks.select("*", other).select(
        F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
        F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int").alias("chunk"), *masks.columns)
    ordered = sent.repartition(parts, "ti", "tj", "chunk").sortWithinPartitions("ti", "tj", "chunk", "_id", "block")
    return ordered.mapInArrow(_tile_partials(tile), PAIR_SCHEMA)


def discordant_counts(results: DataFrame, group_cols: Sequence[str],
                      id_col: str = "sample_id",
                      conditions: DataFrame | None = None,
                      compress_patterns: bool = True, tile: int = TILE) -> DataFrame:
    """M1 + J3: one row per condition pair a < b with at least one shared sample.

    ``compress_patterns`` groups samples by their (present, correct) bit pattern
    first, so the NumPy step sees at most one weighted row per distinct pattern.  More than
    ``tile`` conditions (a multiple of 64) go by tiles.  The pair table is stored: several steps
    read it, and the facts are passed over once."""
    conds, n_conds = indexed_conditions(results, group_cols, conditions)
    if n_conds < 2:
        conds.unpersist()
        return _empty_pairs(results.sparkSession)
    if n_conds > tile:
        partial = tiled_pair_counts(results, conds, n_conds, group_cols, id_col, tile)
    else:
        masks = sample_masks(results, conds, n_conds, group_cols, id_col)
        n_words = max(1, (n_conds + 63) // 64)
        words = [f"{k}_{w}" for w in range(n_words) for k in ("present", "correct")]
        if compress_patterns:
            # samples with the same (present, correct) pattern contribute identically:
            # count them (map-side combined) and feed the weighted patterns to NumPy
            masks = masks.groupBy(*words).agg(F.count(F.lit(1)).alias("weight"))
        partial = masks.mapInPandas(_gram_partials(n_conds, n_words), PAIR_SCHEMA)
    pairs = partial.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in
                                            ["n_shared", "ra_pb", "rb_pa", "ra_rb"]])
    names = conds.select("cond_idx", "condition")
    pairs = (pairs.join(names.withColumnRenamed("cond_idx", "a")
                        .withColumnRenamed("condition", "condition_a"), "a")
                  .join(names.withColumnRenamed("cond_idx", "b")
                        .withColumnRenamed("condition", "condition_b"), "b"))
    counts = stored(pairs.select(
        "a", "b", "condition_a", "condition_b", "n_shared",
        (F.col("ra_pb") - F.col("ra_rb")).alias("b_count"),
        (F.col("rb_pa") - F.col("ra_rb")).alias("c_count")), "discordant-counts")
    conds.unpersist()
    return counts


def discordant_counts_selfjoin(results: DataFrame, group_cols: Sequence[str],
                               id_col: str = "sample_id") -> DataFrame:
    """J2 reference form: equi-join on sample id with a < b.  Rows ~ samples x pairs,
    so only for small inputs and cross-checking the Gram-matrix plan."""
    conds, n_conds = indexed_conditions(results, group_cols)
    ok = F.coalesce(F.col("predicted_label"), F.lit(NONE_LABEL)) == F.col("true_label")
    r = (drop_null_keys(results, group_cols)
         .select(id_col, *group_cols, ok.alias("ok"))
         .join(conds, list(group_cols))
         .select(id_col, "cond_idx", "condition", "ok"))
    a, b = r.alias("x"), r.alias("y")
    j = a.join(b, (F.col(f"x.{id_col}") == F.col(f"y.{id_col}"))
               & (F.col("x.cond_idx") < F.col("y.cond_idx")))
    xo, yo = F.col("x.ok"), F.col("y.ok")
    return j.groupBy(F.col("x.cond_idx").alias("a"), F.col("y.cond_idx").alias("b"),
                     F.col("x.condition").alias("condition_a"),
                     F.col("y.condition").alias("condition_b")).agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.count_if(xo & ~yo).alias("b_count"),
        F.count_if(~xo & yo).alias("c_count"))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """M2: (|b - c| - 1)^2 / (b + c), not clamped at b = c; 0.0 when b + c = 0."""
    d = F.abs(b - c) - 1
    return ratio(d * d, b + c, 0.0)


@F.pandas_udf(T.DoubleType())
def chi2_1df_pvalue(chi2: pd.Series) -> pd.Series:
    """M3 via Python's erfc; the plans use the native :func:`chi2_sf_1df` instead, this
    vectorised form is kept for cross-checking it."""
    return chi2.map(lambda x: math.erfc(math.sqrt(x / 2.0)) if x == x and x >= 0 else float("nan"))


def benjamini_hochberg(pairs: DataFrame, p_col: str = "p_raw", order_col: str = "pair_idx",
                       by: Sequence[str] = (), n_ranges: int | None = None) -> DataFrame:
    """Step-up correction over each family of tests (``by``; none: one family).

    ``p_bh``: standard step-up, min over ranks >= i of p * m / rank, capped at 1.
    ``p_bh_ref``: the variant that divides by the pair's original position in pair
    order instead of its rank (kept for comparison with earlier results).
    Ties in p are ordered by pair position.

    No window holds a family: pairs are dealt to ranges of (p, position) of equal shares; a rank is
    the number of pairs in earlier ranges plus the place inside, and the minimum over higher ranks is
    the one inside plus the least that later ranges carry (one row per range).
    """
    cols = pairs.columns
    family = list(by)
    if not family:      # one family: a key that the optimiser does not fold away, with one value
        pairs, family = pairs.withColumn("_family", F.col(order_col) - F.col(order_col)), ["_family"]
    t = stored(with_tie_ranges(pairs, family, p_col, order_col, n_ranges), "step-up")
    part = [*family, "rng", "sub"]
    per = t.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    of_family = Window.partitionBy(*family)
    earlier = of_family.orderBy("rng", "sub").rowsBetween(Window.unboundedPreceding, -1)
    size = per.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                      F.sum("_n").over(of_family).alias("_m"))
    inside = Window.partitionBy(*part).orderBy(F.col(p_col).asc(), F.col(order_col).asc())
    t = (t.withColumn("_nth", F.row_number().over(inside)).join(size, part)
          .withColumn("_std", F.col(p_col) * F.col("_m") / (F.col("_before") + F.col("_nth")))
          .withColumn("_ref", F.col(p_col) * F.col("_m") / (F.col(order_col) + 1)))
    later = carried(t, family, ["rng", "sub"], {"_std_later": F.col("_std"), "_ref_later": F.col("_ref")},
                    how=F.min, default=None, backwards=True)
    down = (Window.partitionBy(*part).orderBy(F.col(p_col).desc(), F.col(order_col).desc())
            .rowsBetween(Window.unboundedPreceding, 0))
    out = t.withColumn("_std_in", F.min("_std").over(down)).withColumn("_ref_in", F.min("_ref").over(down)) \
           .join(later, part)
    return out.select(*[F.col(f"`{c}`") for c in cols],
                      F.least("_std_in", "_std_later", F.lit(1.0)).alias("p_bh"),
                      F.least("_ref_in", "_ref_later", F.lit(1.0)).alias("p_bh_ref"))


def significance_flags(df: DataFrame, p_col: str = "p_bh") -> DataFrame:
    """Strict < 0.05 / 0.01."""
    return df.withColumn("significant_05", F.col(p_col) < 0.05) \
             .withColumn("significant_01", F.col(p_col) < 0.01)


def pair_index(pairs: DataFrame) -> DataFrame:
    """0-based position of a pair in sorted-key combination order: the pairs of smaller first
    conditions (one row per condition) plus the place among its own."""
    keyed = pairs.withColumn("_all", F.col("a") - F.col("a"))       # one value, not folded away
    before = carried(keyed, ["_all"], ["a"], {"_before": F.lit(1).cast("long")}).drop("_all")
    w = Window.partitionBy("a").orderBy("b")
    return pairs.join(before, "a").withColumn("_nth", F.row_number().over(w)).select(
        *[F.col(f"`{c}`") for c in pairs.columns],
        (F.col("_before") + F.col("_nth") - 1).cast("int").alias("pair_idx"))


def pairwise_mcnemar(results: DataFrame, group_cols: Sequence[str],
                     id_col: str = "sample_id", method: str = "gram",
                     round_p: int | None = None,
                     conditions: DataFrame | None = None) -> DataFrame:
    """M5: condition_a, condition_b, n_shared, b, c, chi2, p_raw, p_bh, p_bh_ref, flags,
    sorted by adjusted p.  ``round_p=6`` rounds p before correction (earlier tables
    did that, so very small p became 0.0)."""
    if method == "gram":
        counts = discordant_counts(results, group_cols, id_col, conditions)
    elif method == "selfjoin":
        counts = discordant_counts_selfjoin(results, group_cols, id_col)
    else:
        raise ValueError("method must be 'gram' or 'selfjoin'")
    if "a" not in counts.columns:
        return counts
    pairs = pair_index(counts)
    chi2 = mcnemar_chi2(F.col("b_count"), F.col("c_count"))
    pairs = pairs.withColumn("chi2", chi2)
    p = F.when(F.col("b_count") + F.col("c_count") == 0, F.lit(1.0)) \
        .otherwise(chi2_sf_1df("chi2"))
    if round_p is not None:
        p = F.round(p, round_p)
    # the tail function is a large expression: evaluated once, not in each step of the correction
    pairs = stored(pairs.withColumn("p_raw", p), "pair-tests")
    out = significance_flags(benjamini_hochberg(pairs))
    return out.select("condition_a", "condition_b", "n_shared", "b_count", "c_count", "chi2",
                      "p_raw", "p_bh", "p_bh_ref", "significant_05", "significant_01",
                      "pair_idx").orderBy("p_bh", "pair_idx")


def _empty_pairs(spark) -> DataFrame:
    schema = ("condition_a string, condition_b string, n_shared bigint, b_count bigint, "
              "c_count bigint, chi2 double, p_raw double, p_bh double, p_bh_ref double, "
              "significant_05 boolean, significant_01 boolean, pair_idx int")
    return spark.createDataFrame([], schema)


from scorebook._ship import ship  # noqa: E402

ship(__name__)
