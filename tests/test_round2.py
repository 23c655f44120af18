"""Equality of the full analysis with its operators, durable runs, exact costs, sources."""

import os

import pytest
from pyspark.sql import functions as F

from scorebook.config import DEFAULT_GROUP_COLS, DEFAULT_LABELS
from scorebook.operators.calibration import calibration_metrics, complete_prob_rows
from scorebook.operators.cost import per_call_cost
from scorebook.plans.analysis import print_summary, run_full_analysis
from scorebook.plans.runner import run_experiment
from scorebook.sources.config import models_frame, prompts_frame
from scorebook.sources.fixtures import eval_results
from scorebook.sources.results import (dedupe_results, missing_columns, present_columns,
                                       read_results_csv)
from scorebook.sources.samples import (balanced_total, check_labels, dropped_directories, first_n,
                                       load_samples_from_directory)

C, L = list(DEFAULT_GROUP_COLS), list(DEFAULT_LABELS)
PROBS = {x: f"prob_{x}" for x in L}
SF = "/root/testdata/sf0.001"


def test_full_analysis_equals_operators_with_nan(spark, tmp_path):
    er = eval_results(spark, SF)
    er = er.withColumn("prob_ASD", F.when(F.col("sample_id") == "3", float("nan")).otherwise(F.col("prob_ASD")))
    path = str(tmp_path / "results")
    er.write.parquet(path)
    a = run_full_analysis(path, n_bootstrap=50, with_mcnemar=False, spark=spark)
    b = calibration_metrics(spark.read.parquet(path), PROBS, C)
    key = lambda df: {(r.model_name, r.prompt_id): r for r in df.collect()}
    x, y = key(a.calibration), key(b.calibration)
    assert x.keys() == y.keys()
    for k in x:
        assert x[k].n_calibration_samples == y[k].n_calibration_samples
        for m in ("brier_score", "ece", "mce", "roc_auc"):
            assert x[k][m] == pytest.approx(y[k][m], abs=1e-12) and x[k][m] == x[k][m]
    assert "Calibration" in print_summary(a)
    a.release()


def test_summary_and_analysis_of_other_keys(spark):
    er = eval_results(spark, SF).filter("prompt_id = 'ZSD'").withColumnRenamed("model_name", "system")
    a = run_full_analysis(er, group_cols=["system"], n_bootstrap=20)
    assert "Api-A" in print_summary(a)
    a.release()


def test_duplicate_sample_in_a_condition_fails(spark):
    er = eval_results(spark, SF)
    twice = er.unionByName(er.filter("sample_id = '5' AND model_name = 'Api-A'"))
    a = run_full_analysis(twice, n_bootstrap=0)
    with pytest.raises(Exception, match="twice under one condition"):
        a.mcnemar_results.collect()
    a.release()


def test_saturated_scores_stay_split(spark):
    from scorebook.operators.roc import prefix_below, score_ties
    rows = spark.range(200_000).select(
        F.lit("m").alias("model_name"), F.exp(-25 + 10 * F.col("id") / 200_000.0).alias("p"), (F.col("id") % 3).cast("int").alias("true_idx"))
    rows = rows.select("model_name", F.col("p").alias("p0"), (1 - F.col("p")).alias("p1"), "true_idx")
    ties = score_ties(rows, 2, ["model_name"])
    from scorebook.operators.ranges import LEAST_RANGES, with_ranges
    most = with_ranges(ties, ["model_name", "k"], "score").groupBy("k", "rng").count().agg(F.max("count")).first()[0]
    assert most < 2 * 200_000 / LEAST_RANGES
    pre = prefix_below(ties, ["model_name", "k"])
    got = [(r.score, r.pos_below) for r in pre.filter("k = 0").orderBy("score").collect()]
    seen = {r.score: r.pos for r in ties.filter("k = 0").collect()}
    total = 0
    for s, below in got:
        assert below == total
        total += seen[s]


def test_price_below_a_nano_and_double_model(spark):
    models = models_frame(spark, [{"model_id": "m", "backend": "api", "cost_per_1k_input_tokens": 0.0000375}])
    calls = spark.createDataFrame([("m", 1_000_000, 0)], "model_id string, input_tokens long, output_tokens long")
    assert per_call_cost(calls, models).first().cost_usd == pytest.approx(0.0375, abs=1e-12)
    with pytest.raises(Exception, match="listed twice"):
        per_call_cost(calls, models.union(models)).collect()


def test_depth_and_dropped_directories(spark, tmp_path):
    for p in ("ASD/a.png", "train/ASD/deep.png", "vsd/b.jpg", "other/c.png", "top.png"):
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = {r.sample_id for r in load_samples_from_directory(spark, str(tmp_path), L).collect()}
    assert got == {"ASD/a", "vsd/b"}
    assert {(r.directory, r.n_files) for r in dropped_directories(spark, str(tmp_path), L).collect()} == {("other", 1)}
    mapped = load_samples_from_directory(spark, str(tmp_path), L, label_map={"other": "PDA"})
    assert ("other/c", "PDA") in {(r.sample_id, r.label) for r in mapped.collect()}


def test_float_typed_tokens_and_columns(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("sample_id,true_label,predicted_label,model_name,prompt_id,input_tokens\n1,ASD,ASD,m,p,512.0\n2,ASD,,m,p,\n3,VSD,VSD,m,p,7\n")
    df = read_results_csv(spark, str(p))
    assert [r.input_tokens for r in df.orderBy("sample_id").collect()] == [512, None, 7]
    assert dict(df.dtypes)["input_tokens"] == "bigint"
    assert present_columns(df, ["prompt_id", "x", "sample_id"]) == ["prompt_id", "sample_id"]
    assert missing_columns(df, ["prompt_id", "x"]) == ["x"]
    with pytest.raises(ValueError, match="missing"):
        run_full_analysis(df.drop("true_label"))


def test_dedupe_keeps_the_latest(spark):
    rows = [("1", "m", "p", "ASD", 1), ("1", "m", "p", "VSD", 3), ("1", "m", "p", "PDA", 2), ("2", "m", "p", None, 1)]
    df = spark.createDataFrame(rows, "sample_id string, model_name string, prompt_id string, predicted_label string, run int")
    got = {r.sample_id: r.predicted_label for r in dedupe_results(df.repartition(3), order_by=["run"]).collect()}
    assert got == {"1": "VSD", "2": None}


def test_exact_totals(spark):
    df = spark.createDataFrame([(str(i), f"p{i:03d}", L[min(3, i // 9)]) for i in range(40)], "sample_id string, image_path string, label string")
    assert balanced_total(df, 10).count() == 10 and balanced_total(df, 400).count() == 40
    per = {r.label: r["count"] for r in balanced_total(df, 10).groupBy("label").count().collect()}
    assert sorted(per.values()) == [2, 2, 3, 3]
    assert [r.image_path for r in first_n(df, 3).collect()] == ["p000", "p001", "p002"]
    good, bad = check_labels(df.union(spark.createDataFrame([("x", "y", "?")], df.schema)), L, raise_on_invalid=False)
    assert good.count() == 40 and bad.count() == 1
    with pytest.raises(ValueError):
        check_labels(df.withColumn("label", F.lit("?")), L)


class Counting:
    """Writes a line per call; one model cannot load."""

    def __init__(self, model_id, folder, broken):
        self.model_id, self.folder, self.broken = model_id, folder, broken

    def note(self, what):
        with open(os.path.join(self.folder, f"{self.model_id}-{what}-{os.getpid()}"), "a") as f:
            f.write("x")

    def load(self):
        if self.model_id == self.broken:
            raise RuntimeError("no memory for this model")
        self.note("load")

    def unload(self):
        self.note("unload")

    def predict(self, content, prompt):
        self.note("call")
        return {"raw_output": "ASD"}


def test_failed_model_leaves_the_others_on_disk(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    samples = spark.createDataFrame([(str(i), f"p{i}", "ASD") for i in range(10)], "sample_id string, image_path string, label string")
    models = models_frame(spark, [{"model_id": "a", "backend": "x"}, {"model_id": "b", "backend": "x"}])
    prompts = prompts_frame(spark, {"p1": "one", "p2": "two"})
    out, folder = str(tmp_path / "out"), str(notes)

    def count(what):
        return sum(os.path.getsize(notes / f) for f in os.listdir(notes) if f.startswith(what))
    with pytest.raises(Exception, match="no memory"):
        run_experiment(spark, samples, models, prompts, lambda m: Counting(m, folder, "b"), out, base_delay_s=0.0)
    assert spark.read.parquet(out).count() == 20 and count("a-call") == 20 and count("a-load") == count("a-unload") > 0
    done = run_experiment(spark, samples, models, prompts, lambda m: Counting(m, folder, None), out, base_delay_s=0.0)
    assert done.results.count() == 40 and count("a-call") == 20 and count("b-call") == 20


def test_png_payload_and_params(spark):
    import json
    from scorebook.operators.inference import image_request_payload
    df = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n123"), "q"), (bytearray(b"\xff\xd8x"), "q")], "content binary, prompt string")
    png, jpg = [json.loads(r[0]) for r in df.select(image_request_payload("content", "prompt", "m", "base64_source", params={"temperature": 0.5})).collect()]
    assert png["messages"][0]["content"][0]["source"]["media_type"] == "image/png" and png["temperature"] == 0.5
    assert jpg["messages"][0]["content"][0]["source"]["media_type"] == "image/jpeg"


def test_unknown_truth_fails_only_when_scored(spark):
    rows = [("m", "?", 0.5, 0.5, 0.0, None)]
    df = spark.createDataFrame(rows, "model_name string, true_label string, prob_ASD double, prob_VSD double, prob_PDA double, prob_Normal double")
    assert complete_prob_rows(df, PROBS, ["model_name"]).count() == 0


from scorebook._ship import ship  # noqa: E402

ship(__name__)
