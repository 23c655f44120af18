"""Reports, figure bundles, sinks and the smaller helpers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook.operators.bootstrap import bootstrap_cis, bootstrap_cis_poisson, bootstrap_replicates
from scorebook.operators.cells import confusion_arrays, confusion_cells, confusion_cells_all
from scorebook.operators.figdata import figure_tables, heat_pivot, save_figure_tables
from scorebook.operators.inference import PredictorRegistry
from scorebook.plans.analysis import run_full_analysis
from scorebook.sources.fixtures import eval_results
from scorebook.sources.results import ensure_sample_id, write_report_csv

SF = "/root/testdata/sf0.001"
LABELS = ["ASD", "VSD", "PDA", "Normal"]
C = ["model_name", "prompt_id"]


def test_figure_bundle_and_sink(spark, tmp_path):
    er = eval_results(spark, SF)
    a = run_full_analysis(er, n_bootstrap=100, with_mcnemar=False)
    from scorebook.operators.cost import cost_summary
    tables = figure_tables(a, LABELS, results=er, prob_cols={x: f"prob_{x}" for x in LABELS},
                           cost=cost_summary(er, C, nano_col="cost_nano"))
    for name in ["confusion_matrices", "macro_f1_bars", "roc_curve", "cost_bars",
                 "dashboard_best_matrix", "per_class_f1_heat_ZSD"]:
        assert name in tables
    written = save_figure_tables({k: tables[k] for k in ["macro_f1_bars", "cost_bars"]},
                                 str(tmp_path), fmt="csv")
    assert len(written) == 2 and all(os.path.isdir(p) for p in written)
    assert tables["dashboard_best_matrix"].count() == 16
    assert tables["roc_curve"].count() == 3 * 200


def test_heat_prompt_filter(spark):
    a = run_full_analysis(eval_results(spark, SF), n_bootstrap=0, with_mcnemar=False)
    t = heat_pivot(a.per_class_metrics, LABELS, "f1", C, prompt_filter="CoT")
    assert t.count() == 3 and {r.prompt_id for r in t.collect()} == {"CoT"}


def test_confusion_arrays(spark):
    er = eval_results(spark, SF)
    grid = confusion_cells(er, LABELS, C)
    arr = {(r.model_name, r.prompt_id): r.matrix for r in confusion_arrays(grid, LABELS, C).collect()}
    cells = {(r.model_name, r.prompt_id, r.true_label, r.predicted_label): r.n for r in grid.collect()}
    for (m, p), mat in arr.items():
        assert np.array(mat).shape == (4, 4)
        assert mat[1][2] == cells[(m, p, "VSD", "PDA")]


def test_poisson_vs_multinomial_bootstrap(spark):
    er = eval_results(spark, SF)
    cells = confusion_cells_all(er, C)
    a = {(r.model_name, r.prompt_id): r for r in bootstrap_cis(cells, LABELS, C, 1000).collect()}
    b = {(r.model_name, r.prompt_id): r for r in bootstrap_cis_poisson(er, LABELS, C, 400).collect()}
    for k in a:
        assert a[k].accuracy_ci_lower == pytest.approx(b[k].accuracy_ci_lower, abs=0.03)
        assert a[k].accuracy_ci_upper == pytest.approx(b[k].accuracy_ci_upper, abs=0.03)


def test_custom_bootstrap_metric(spark):
    cells = confusion_cells_all(eval_results(spark, SF), C)

    def parsed_share(counts, true_idx, pred_idx, k):
        return counts[:, pred_idx != -2].sum(axis=1) / counts.sum(axis=1)

    reps = bootstrap_replicates(cells, LABELS, C, 50, custom_metrics={"parsed": parsed_share})
    vals = [r.parsed for r in reps.collect()]
    assert len(vals) == 600 and all(0.8 < v <= 1.0 for v in vals)


def test_ensure_sample_id_and_report_csv(spark, tmp_path):
    df = spark.createDataFrame([("ASD", "m"), ("VSD", "m")], "true_label string, model_name string")
    with pytest.raises(ValueError):
        ensure_sample_id(df)
    out = ensure_sample_id(df, mode="row_index")
    assert sorted(r.sample_id for r in out.collect()) == ["0", "1"]
    write_report_csv(out, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_predictor_registry():
    reg = PredictorRegistry()
    reg.register("api", lambda s: ("api", s["model_id"]))
    assert reg.build({"backend": "api", "model_id": "x"}) == ("api", "x")
    with pytest.raises(ValueError):
        reg.build({"backend": "gpu"})


def test_evaluate_single(spark):
    from scorebook.plans.runner import evaluate_single
    from scorebook.testing import EchoPredictor
    samples = spark.createDataFrame([("s1", "ASD"), ("s2", "Normal")], "sample_id string, label string") \
        .withColumn("content", F.encode("label", "UTF-8"))
    out = evaluate_single(spark, samples, EchoPredictor, "classify", "ZSD", "echo")
    assert {r.sample_id: r.predicted_label for r in out.collect()} == {"s1": "ASD", "s2": "Normal"}


def test_class_counts_orders(spark):
    from scorebook.plans.report import class_counts
    df = spark.createDataFrame([("1", "VSD"), ("2", "VSD"), ("3", "ASD")], "sample_id string, label string")
    assert [r.label for r in class_counts(df, LABELS).collect()] == LABELS
    got = [(r.label, r.n) for r in class_counts(df, LABELS, by_count=True).collect()]
    assert got == [("VSD", 2), ("ASD", 1), ("PDA", 0), ("Normal", 0)]


def test_heat_drops_absent_classes_and_single_condition_pairs(spark):
    from scorebook.operators.compare import pairwise_mcnemar
    pc = spark.createDataFrame([("m", "p", "ASD", 0.5), ("m", "p", "VSD", 0.25)],
                               "model_name string, prompt_id string, class string, f1 double")
    t = heat_pivot(pc, LABELS, "f1", C)
    assert t.columns == ["model_name", "prompt_id", "condition", "ASD", "VSD"]
    one = spark.createDataFrame([("1", "ASD", "ASD", "m", "p")], "sample_id string, true_label string, "
                                "predicted_label string, model_name string, prompt_id string")
    empty = pairwise_mcnemar(one, C)
    assert empty.count() == 0 and "p_bh" in empty.columns
