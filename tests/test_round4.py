"""Findings of round 3: draws in blocks, weighted sums by windows, one pass over contents."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from scorebook.operators import bootstrap as B
from scorebook.operators import draws as D

C = ["model_name", "prompt_id"]
LABELS = ["ASD", "VSD", "PDA", "Normal"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def draw(i, r, seed=42):
    key = f"{r}|{seed}" if i is None else f"{i}|{r}|{seed}"
    u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2.0 ** 52
    return next((k for k, c in enumerate(D.POISSON1_CDF) if u < c), len(D.POISSON1_CDF))


# --- bootstrap --------------------------------------------------------------------------

def test_draws_are_those_of_md5():
    ids = [None, "", "7", "é中", "x" * 45, "y" * 46, "z" * 300] + [str(7 ** i) for i in range(25)]
    got = D.poisson_draws(ids, 5, 1105, 42)
    assert got.tolist() == [[draw(i, r) for r in range(5, 1105)] for i in ids]
    assert D.poisson_draws([], 0, 3, 1).shape == (0, 3)


def test_poisson_replicates_expand_no_rows_by_replicates(spark, monkeypatch):
    """Null ids, repeated rows, missing predictions; sums handed on several times."""
    monkeypatch.setattr(B, "HELD_BYTES", 1)
    rows = [(f"s{i % 30}" if i % 7 else None, LABELS[i % 4], LABELS[i * 5 % 3] if i % 6 else None, "m", "pq"[i % 2])
            for i in range(150)] * 2 + [("s1", "ASD", "ASD", None, "p")]
    df = spark.createDataFrame(rows, "sample_id string, true_label string, predicted_label string, model_name string, prompt_id string")
    out = B.poisson_replicates(df.repartition(3), LABELS, C, 40)
    assert "sequence(" not in plan_of(out)
    got = {(r.prompt_id, r.replicate): r.accuracy for r in out.collect()}
    assert len(got) == 80
    for (p, r), acc in got.items():
        w = np.array([draw(x[0], r) for x in rows if x[3] and x[4] == p])
        ok = np.array([x[1] == x[2] for x in rows if x[3] and x[4] == p])
        assert acc == (w * ok).sum() / w.sum()


SCHEMA = "sample_id string, true_label string, model_name string, prompt_id string, " + ", ".join(f"prob_{x} double" for x in LABELS)


def test_weighted_sums_by_windows(spark, monkeypatch):
    """Brier, ECE and AUC from draws summed per window: no row per replicate, none stored; an infinite
    probability counts only where its row is drawn, and -0.0 ties with 0.0."""
    monkeypatch.setattr(B, "WINDOW_BYTES", 1)
    monkeypatch.setattr(B, "SHORT_ROWS", 2)
    monkeypatch.setattr(B, "PAIR_SUMS", 8)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        p = rng.integers(0, 5, 4) / 4.0
        rows.append((f"s{i % 60}", LABELS[rng.integers(0, 4)], "m", "p", *(float(-0.0 if i % 2 and x == 0 else x) for x in p)))
    rows.append(("big", "ASD", "m", "p", float("inf"), 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    probs = {x: f"prob_{x}" for x in LABELS}
    out = B.weighted_replicates(df, probs, C, n_bootstrap=17, block_size=6, n_ranges=5)
    assert "posexplode(ws" not in plan_of(out)
    got = {r.replicate: r for r in out.collect()}
    assert set(got) == set(range(17))
    for r, x in got.items():
        w = np.array([draw(row[0], r) for row in rows])
        p, t = np.array([row[4:] for row in rows]), np.array([LABELS.index(row[1]) for row in rows])
        own = w > 0
        sq = ((p - np.eye(4)[t]) ** 2).sum(axis=1)
        want = (w[own] * sq[own]).sum() / (w.sum() * 4)
        assert x.brier_score == want or abs(x.brier_score - want) < 1e-12
        auc = []
        for k in range(4):
            P, Q, s = (t == k) * w, (t != k) * w, p[:, k]
            above = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
            auc.append((P[:, None] * Q[None, :] * above).sum() / (P.sum() * Q.sum()))
        assert abs(x.roc_auc - sum(auc) / 4) < 1e-12


# --- results and inference --------------------------------------------------------------

def test_dedupe_carries_a_row_once(spark):
    from scorebook.sources.results import dedupe_results
    rows = [("s1", "m", "p", 1, 2.0, "a"), ("s1", "m", "p", 2, 1.0, "b"), ("s1", "m", "p", 2, 1.5, "a"),
            (None, "m", "p", 1, None, None), (None, "m", "p", 1, None, None), ("s2", "m", "p", None, 3.0, "c")]
    df = spark.createDataFrame(rows, "sample_id string, model_name string, prompt_id string, run int, v double, w string")
    out = dedupe_results(df.repartition(3), order_by=["run"])
    plan = plan_of(out)
    assert "max_by" not in plan and "partial_max" in plan
    assert plan.index("partial_max") < plan.rindex("Exchange hashpartitioning")     # dealt first, one shuffle
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[2], rows[3], rows[5]], key=str)
    # a map has no order: the order goes beside the row
    maps = df.withColumn("extra", F.create_map(F.lit("k"), F.col("w")))
    assert {r.sample_id: r.w for r in dedupe_results(maps, order_by=["run", "sample_id"]).collect()} == {"s1": "a", None: None, "s2": "c"}


def test_conditions_are_expanded_after_contents_are_dealt(spark):
    """The same answers as from expanded rows; no sort or shuffle below the expansion holds a content per condition."""
    from scorebook.operators.inference import batch_inference, expand_conditions
    from scorebook.testing import KeywordBatchPredictor, KeywordPredictor
    samples = spark.createDataFrame([(str(i % 9) if i else None, b"x" * i, i % 3) for i in range(20)], "sample_id string, content binary, bucket int")
    conds = spark.createDataFrame([(m, f"ask {p}") for m in ("a", "b", None) for p in range(4)], "model_id string, prompt_text string")
    keep = ["sample_id", "model_id", "prompt_text"]
    for factory, more in ((KeywordPredictor, {}), (KeywordBatchPredictor, {"batch_size": 5, "group_cols": ["bucket"], "with_calls": True}),
                          (KeywordPredictor, {"parallelism": 2})):
        want = batch_inference(expand_conditions(samples, conds), factory, keep_cols=keep, model_col="model_id", base_delay_s=0.0, **more)
        got = batch_inference(samples, factory, keep_cols=keep, model_col="model_id", base_delay_s=0.0, conditions=conds, **more)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema
        plan = plan_of(got)
        at = plan.rindex("inline(")
        assert "Sort" not in plan[:plan.index("inline(")] and "Exchange" not in plan[:plan.index("inline(")] and at > 0
