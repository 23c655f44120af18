"""Count-based metrics against independent pure-Python definitions."""

import random
from collections import Counter

import pytest

from scorebook.config import NONE_LABEL
from scorebook.operators.cells import confusion_cells, confusion_cells_all
from scorebook.operators.metrics import classification_metrics

LABELS = ["ASD", "VSD", "PDA", "Normal"]
C = ["model_name", "prompt_id"]


def reference_metrics(y_true, y_pred, labels=LABELS):
    """Definitions written from the metric formulas (no library code)."""
    yp = [NONE_LABEL if p is None else p for p in y_pred]
    n = len(y_true)
    acc = sum(t == p for t, p in zip(y_true, yp)) / n
    f1 = {}
    for lab in labels:
        tp = sum(t == lab and p == lab for t, p in zip(y_true, yp))
        row = sum(t == lab for t in y_true)
        col = sum(p == lab for p in yp)
        f1[lab] = 2 * tp / (row + col) if row + col else 0.0
    macro = sum(f1[x] for x in labels) / len(labels)
    values = set(y_true) | set(yp)
    rt, ct = Counter(y_true), Counter(yp)
    po = acc
    pe = sum(rt[v] * ct[v] for v in values) / (n * n)
    kappa = (po - pe) / (1 - pe) if pe != 1 else None
    sens, spec = {}, {}
    inm = [(t, p) for t, p in zip(y_true, yp) if t in labels and p in labels]
    total = len(inm)
    for lab in labels:
        tp = sum(t == lab and p == lab for t, p in inm)
        fn = sum(t == lab for t, _ in inm) - tp
        fp = sum(p == lab for _, p in inm) - tp
        tn = total - tp - fn - fp
        sens[lab] = tp / (tp + fn) if tp + fn else 0.0
        spec[lab] = tn / (tn + fp) if tn + fp else 0.0
    parsed = sum(p is not None for p in y_pred)
    return dict(acc=acc, f1=f1, macro=macro, kappa=kappa, sens=sens, spec=spec,
                parse_rate=parsed / n, n_parsed=parsed)


def make_rows(seed=0, n=300, none_rate=0.05, foreign_rate=0.02):
    rnd = random.Random(seed)
    rows = []
    for m in ["m1", "org/m2"]:
        for pr in ["A", "B"]:
            for i in range(n):
                t = rnd.choice(LABELS)
                r = rnd.random()
                if r < none_rate:
                    p = None
                elif r < none_rate + foreign_rate:
                    p = "Other"
                elif rnd.random() < 0.6:
                    p = t
                else:
                    p = rnd.choice(LABELS)
                rows.append((str(i), t, p, m, pr))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "sample_id string, true_label string, predicted_label string, "
                                     "model_name string, prompt_id string")
    cells = confusion_cells_all(df, C)
    m, pc = classification_metrics(cells, LABELS, C)
    return df, m.collect(), pc.collect()


def test_metrics_match_definitions(spark):
    rows = make_rows()
    _, metrics, per_class = run(spark, rows)
    for r in metrics:
        sub = [x for x in rows if x[3] == r.model_name and x[4] == r.prompt_id]
        ref = reference_metrics([x[1] for x in sub], [x[2] for x in sub])
        assert r.accuracy == pytest.approx(ref["acc"], abs=1e-12)
        assert r.macro_f1 == pytest.approx(ref["macro"], abs=1e-12)
        assert r.kappa == pytest.approx(ref["kappa"], abs=1e-12)
        assert r.parse_rate == pytest.approx(ref["parse_rate"], abs=1e-12)
        assert r.n_parsed == ref["n_parsed"]
        for pcr in [p for p in per_class if p.model_name == r.model_name and p.prompt_id == r.prompt_id]:
            assert pcr.f1 == pytest.approx(ref["f1"][pcr["class"]], abs=1e-12)
            assert pcr.sensitivity == pytest.approx(ref["sens"][pcr["class"]], abs=1e-12)
            assert pcr.specificity == pytest.approx(ref["spec"][pcr["class"]], abs=1e-12)


def test_degenerate_conditions(spark):
    rows = [(str(i), "ASD", None, "all_null", "p") for i in range(10)]
    rows += [(str(i), "ASD", "ASD", "one_class_perfect", "p") for i in range(10)]
    rows += [(str(i), "VSD", "Other", "foreign", "p") for i in range(10)]
    _, metrics, per_class = run(spark, rows)
    by = {r.model_name: r for r in metrics}
    assert by["all_null"].accuracy == 0.0 and by["all_null"].parse_rate == 0.0
    assert by["all_null"].macro_f1 == 0.0
    assert by["one_class_perfect"].accuracy == 1.0
    assert by["one_class_perfect"].kappa is None     # chance agreement 1: undefined
    assert by["one_class_perfect"].macro_f1 == pytest.approx(0.25)   # absent classes count 0
    assert by["foreign"].accuracy == 0.0
    pc = {(p.model_name, p["class"]): p for p in per_class}
    assert pc[("one_class_perfect", "PDA")].f1 == 0.0
    assert pc[("foreign", "VSD")].sensitivity == 0.0   # no in-matrix rows


def test_invariance_and_cell_sums(spark):
    rows = make_rows(seed=3)
    df, m1, _ = run(spark, rows)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    df2 = spark.createDataFrame(shuffled, df.schema).repartition(7)
    cells = confusion_cells_all(df2, C)
    m2, _ = classification_metrics(cells, LABELS, C)
    key = lambda r: (r.model_name, r.prompt_id)
    assert sorted(m1, key=key) == sorted(m2.collect(), key=key)
    total = sum(r.n for r in cells.collect())
    assert total == len(rows)
    grid = confusion_cells(df, LABELS, C).collect()
    assert len(grid) == 4 * len(LABELS) ** 2


def test_kappa_is_one_when_all_correct(spark):
    rows = [(str(i), LABELS[i % 4], LABELS[i % 4], "m", "p") for i in range(40)]
    _, metrics, _ = run(spark, rows)
    assert metrics[0].kappa == pytest.approx(1.0)


def test_null_group_keys_dropped(spark):
    rows = make_rows(n=20) + [("x", "ASD", "ASD", None, "A")]
    _, metrics, _ = run(spark, rows)
    assert all(r.model_name is not None for r in metrics)
    assert sum(r.n_total for r in metrics) == len(rows) - 1
