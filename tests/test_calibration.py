"""Calibration and AUC against definitions."""

import random

import pytest
from pyspark.sql import functions as F

from scorebook.operators.calibration import bin_edges, bin_index, calibration_metrics

LABELS = ["ASD", "VSD", "PDA", "Normal"]
C = ["model_name", "prompt_id"]


def test_bin_edges_like_evenly_spaced_grid(spark):
    e = bin_edges(10)
    assert e[3] == 0.30000000000000004 and e[6] == 0.6000000000000001 and e[7] == 0.7000000000000001
    confs = [0.0, 0.3, 0.30000000000000004, 0.6, 0.7, 0.9999, 1.0]
    df = spark.createDataFrame([(c,) for c in confs], "c double")
    got = [r.b for r in df.select(bin_index(F.col("c"), 10).alias("b")).collect()]
    assert got == [0, 2, 3, 5, 6, 9, 9]


def _prob_rows(seed=1, n=400):
    rnd = random.Random(seed)
    rows = []
    for m in ["m1", "m2"]:
        for i in range(n):
            t = rnd.randrange(4)
            w = [rnd.randint(1, 20) + (25 if k == t and rnd.random() < 0.7 else 0) for k in range(4)]
            s = sum(w)
            rows.append((str(i), LABELS[t], m, "p", *[x / s for x in w]))
    return rows


def _auc(scores, pos):
    P = [s for s, y in zip(scores, pos) if y]
    N = [s for s, y in zip(scores, pos) if not y]
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in P for q in N)
    return tot / (len(P) * len(N))


def test_calibration_against_definitions(spark):
    rows = _prob_rows()
    schema = "sample_id string, true_label string, model_name string, prompt_id string, " + \
             ", ".join(f"prob_{x} double" for x in LABELS)
    df = spark.createDataFrame(rows, schema)
    cal = calibration_metrics(df, {x: f"prob_{x}" for x in LABELS}, C)
    got = {r.model_name: r for r in cal.calibration.collect()}
    for m in ["m1", "m2"]:
        sub = [r for r in rows if r[2] == m]
        probs = [r[4:] for r in sub]
        y = [LABELS.index(r[1]) for r in sub]
        brier = sum((p[k] - (1.0 if k == t else 0.0)) ** 2 for p, t in zip(probs, y)
                    for k in range(4)) / (len(sub) * 4)
        aucs = [_auc([p[k] for p in probs], [t == k for t in y]) for k in range(4)]
        edges = bin_edges(10)
        ece, mce = 0.0, 0.0
        for b in range(10):
            lo, hi = edges[b], edges[b + 1]
            idx = [i for i, p in enumerate(probs)
                   if max(p) >= lo and (max(p) < hi or b == 9)]
            if not idx:
                continue
            conf = sum(max(probs[i]) for i in idx) / len(idx)
            acc = sum(probs[i].index(max(probs[i])) == y[i] for i in idx) / len(idx)
            ece += abs(conf - acc) * len(idx) / len(sub)
            mce = max(mce, abs(conf - acc))
        r = got[m]
        assert r.brier_score == pytest.approx(brier, abs=1e-12)
        assert r.roc_auc == pytest.approx(sum(aucs) / 4, abs=1e-12)
        assert r.ece == pytest.approx(ece, abs=1e-12)
        assert r.mce == pytest.approx(mce, abs=1e-12)
        assert r.n_calibration_samples == len(sub)


def test_auc_undefined_for_one_sided_class(spark):
    rows = [(str(i), "ASD", "m", "p", 0.7, 0.1, 0.1, 0.1) for i in range(5)]
    schema = "sample_id string, true_label string, model_name string, prompt_id string, " + \
             ", ".join(f"prob_{x} double" for x in LABELS)
    cal = calibration_metrics(spark.createDataFrame(rows, schema),
                              {x: f"prob_{x}" for x in LABELS}, C)
    assert cal.calibration.collect()[0].roc_auc is None


def test_bucketed_prefix_equals_single_window(spark):
    """The two-level prefix must not depend on the bucket count."""
    rows = _prob_rows(seed=4, n=300)
    schema = "sample_id string, true_label string, model_name string, prompt_id string, " + \
             ", ".join(f"prob_{x} double" for x in LABELS)
    df = spark.createDataFrame(rows, schema)
    pc = {x: f"prob_{x}" for x in LABELS}
    a = calibration_metrics(df, pc, C, n_ranges=1).auc_per_class.orderBy("model_name", "class").collect()
    b = calibration_metrics(df, pc, C, n_ranges=97).auc_per_class.orderBy("model_name", "class").collect()
    assert [r.auc for r in a] == [r.auc for r in b]


def test_truth_outside_labels_is_an_error(spark):
    rows = [("1", "ASD", "m", "p", 0.7, 0.1, 0.1, 0.1), ("2", "Other", "m", "p", 0.7, 0.1, 0.1, 0.1)]
    schema = "sample_id string, true_label string, model_name string, prompt_id string, " + \
             ", ".join(f"prob_{x} double" for x in LABELS)
    cal = calibration_metrics(spark.createDataFrame(rows, schema),
                              {x: f"prob_{x}" for x in LABELS}, C)
    with pytest.raises(Exception, match="outside the label list"):
        cal.calibration.collect()
