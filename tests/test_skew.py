"""Skewed inputs: one condition holds half of all rows; results stay exact under any
partitioning (metrics vs direct count, Gram-matrix McNemar vs self-join)."""

import random

import pytest

from scorebook.operators.cells import confusion_cells_all
from scorebook.operators.compare import discordant_counts, discordant_counts_selfjoin
from scorebook.operators.metrics import classification_metrics

LABELS = ["ASD", "VSD", "PDA", "Normal"]
C = ["model_name", "prompt_id"]


def _skewed(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):                      # hot condition: as many rows as all others
        t = LABELS[(i * 7) % 4]                # one truth per sample id, as pairing requires
        rows.append((str(i), t, t if rnd.random() < 0.7 else "VSD", "hot", "p"))
    for m in ["a", "b", "c"]:
        for i in range(1000):
            t = LABELS[(i * 7) % 4]
            rows.append((str(i), t, t if rnd.random() < 0.6 else None, m, "p"))
    return rows, spark.createDataFrame(rows, "sample_id string, true_label string, "
                                             "predicted_label string, model_name string, prompt_id string")


def test_metrics_under_skew(spark):
    rows, df = _skewed(spark)
    m = {r.model_name: r for r in classification_metrics(
        confusion_cells_all(df.repartition(13), C), LABELS, C)[0].collect()}
    hot = [r for r in rows if r[3] == "hot"]
    assert m["hot"].n_total == 3000
    assert m["hot"].accuracy == pytest.approx(sum(r[1] == r[2] for r in hot) / 3000)


def test_mcnemar_under_skew(spark):
    _, df = _skewed(spark)
    cols = ["condition_a", "condition_b", "n_shared", "b_count", "c_count"]
    g = sorted(tuple(r) for r in discordant_counts(df.repartition(7), C).select(*cols).collect())
    s = sorted(tuple(r) for r in discordant_counts_selfjoin(df, C).select(*cols).collect())
    assert g == s
    assert {r[2] for r in g if "hot" in (r[0] + r[1])} == {1000}
