"""McNemar, erfc, Benjamini-Hochberg: fixtures and cross-checks."""

import math

import pytest
from pyspark.sql import functions as F

from scorebook.functions.special import chi2_sf_1df
from scorebook.operators.compare import (benjamini_hochberg, discordant_counts,
                                         discordant_counts_selfjoin, mcnemar_chi2,
                                         pairwise_mcnemar)

C = ["model_name", "prompt_id"]


def test_chi2_fixtures(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (10, 0)], "b long, c long")
    got = [r.x for r in df.select(mcnemar_chi2(F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == pytest.approx([0.0, 0.1, 8.1])


def test_native_erfc_matches_python(spark):
    xs = [i * 0.37 for i in range(0, 300)] + [1e-9, 3.841458820694124, 6.634896601021214]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(chi2_sf_1df(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert p == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=2e-15)


def test_bh_fixture(spark):
    df = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03)], "pair_idx int, p_raw double")
    out = {r.pair_idx: r for r in benjamini_hochberg(df).collect()}
    assert [out[i].p_bh for i in range(3)] == pytest.approx([0.04, 0.03, 0.04])
    assert [out[i].p_bh_ref for i in range(3)] == pytest.approx([0.12, 0.015, 0.03])


def _results(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for m in ["a", "b", "c"]:
        for p in ["x", "y"]:
            for i in range(200):
                if (m, p) == ("c", "y") and i >= 150:
                    continue          # fewer shared ids for one condition
                t = "ASD" if i % 2 else "VSD"
                q = rnd.random()
                pred = t if q < {"a": 0.8, "b": 0.6, "c": 0.5}[m] else (None if q > 0.97 else "PDA")
                rows.append((str(i), t, pred, m, p))
    return spark.createDataFrame(rows, "sample_id string, true_label string, "
                                       "predicted_label string, model_name string, prompt_id string")


def test_gram_equals_selfjoin(spark):
    df = _results(spark)
    cols = ["condition_a", "condition_b", "n_shared", "b_count", "c_count"]
    g = sorted(tuple(r) for r in discordant_counts(df, C).select(*cols).collect())
    s = sorted(tuple(r) for r in discordant_counts_selfjoin(df, C).select(*cols).collect())
    assert g == s and len(g) == 15


def test_pairwise_table(spark):
    out = pairwise_mcnemar(_results(spark), C).collect()
    assert len(out) == 15
    for r in out:
        assert r.p_bh >= r.p_raw - 1e-15
        assert r.significant_05 == (r.p_bh < 0.05)
    ps = [r.p_bh for r in out]
    assert ps == sorted(ps)


def test_swap_symmetry(spark):
    df = _results(spark)
    flipped = df.withColumn("model_name", F.when(F.col("model_name") == "a", "z")
                            .otherwise(F.col("model_name")))
    a = {frozenset([r.condition_a.replace("z", "a"), r.condition_b.replace("z", "a")]):
         (r.b_count, r.c_count) for r in discordant_counts(flipped, C).collect()}
    b = {frozenset([r.condition_a, r.condition_b]): (r.b_count, r.c_count)
         for r in discordant_counts(df, C).collect()}
    for k, (bb, cc) in b.items():
        assert a[k] in [(bb, cc), (cc, bb)]


def test_native_pvalue_equals_vectorised_python(spark):
    from scorebook.operators.compare import chi2_1df_pvalue
    df = spark.createDataFrame([(i * 0.13,) for i in range(400)], "x double")
    rows = df.select(chi2_sf_1df("x").alias("a"), chi2_1df_pvalue(F.col("x")).alias("b")).collect()
    for r in rows:
        assert r.a == pytest.approx(r.b, abs=2e-15)


def test_pattern_compression_is_exact(spark):
    df = _results(spark)
    cols = ["condition_a", "condition_b", "n_shared", "b_count", "c_count"]
    a = sorted(tuple(r) for r in discordant_counts(df, C, compress_patterns=True).select(*cols).collect())
    b = sorted(tuple(r) for r in discordant_counts(df, C, compress_patterns=False).select(*cols).collect())
    assert a == b


def test_truth_must_be_constant_per_sample(spark):
    rows = [("1", "ASD", "ASD", "a", "x"), ("1", "VSD", "VSD", "b", "x"), ("2", "ASD", "ASD", "a", "x"),
            ("2", "ASD", "PDA", "b", "x")]
    df = spark.createDataFrame(rows, "sample_id string, true_label string, predicted_label string, "
                                     "model_name string, prompt_id string")
    with pytest.raises(Exception, match="different true labels"):
        discordant_counts(df, C).collect()
