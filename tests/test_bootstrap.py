"""Multinomial cell bootstrap: reproducibility and agreement with row resampling."""

import random

import numpy as np
import pytest

from scorebook.operators.bootstrap import bootstrap_cis, bootstrap_replicates
from scorebook.operators.cells import confusion_cells_all

LABELS = ["ASD", "VSD", "PDA", "Normal"]
C = ["model_name", "prompt_id"]


def _df(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = []
    for m in ["m1", "m2"]:
        for i in range(n):
            t = rnd.choice(LABELS)
            p = t if rnd.random() < (0.7 if m == "m1" else 0.5) else rnd.choice(LABELS + [None])
            rows.append((str(i), t, p, m, "p"))
    return rows, spark.createDataFrame(rows, "sample_id string, true_label string, "
                                             "predicted_label string, model_name string, prompt_id string")


def test_reproducible_and_partition_independent(spark):
    _, df = _df(spark)
    cells = confusion_cells_all(df, C)
    a = bootstrap_replicates(cells, LABELS, C, 300, seed=7).orderBy("model_name", "replicate").collect()
    b = bootstrap_replicates(cells.repartition(5), LABELS, C, 300, seed=7) \
        .orderBy("model_name", "replicate").collect()
    assert a == b and len(a) == 600


def test_interval_contains_point_and_matches_row_bootstrap(spark):
    rows, df = _df(spark)
    cells = confusion_cells_all(df, C)
    cis = {r.model_name: r for r in bootstrap_cis(cells, LABELS, C, 2000, seed=1).collect()}
    rng = np.random.default_rng(3)
    for m, r in cis.items():
        assert r.accuracy_ci_lower <= r.accuracy_point <= r.accuracy_ci_upper
        assert r.macro_f1_ci_lower <= r.macro_f1_point <= r.macro_f1_ci_upper
        sub = [x for x in rows if x[3] == m]
        ok = np.array([x[1] == x[2] for x in sub], dtype=float)
        reps = [ok[rng.integers(0, len(ok), len(ok))].mean() for _ in range(2000)]
        lo, hi = np.percentile(reps, [2.5, 97.5])
        assert r.accuracy_ci_lower == pytest.approx(lo, abs=0.015)
        assert r.accuracy_ci_upper == pytest.approx(hi, abs=0.015)
