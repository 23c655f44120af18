"""Inference operator: deterministic predictor, retries, error capture, runner."""

import pytest
from pyspark.sql import functions as F

from scorebook.operators.inference import batch_inference, with_retries


class Flaky(Exception):
    pass


def test_retry_schedule():
    sleeps, calls = [], []

    def call():
        calls.append(1)
        raise Flaky("busy")

    res = with_retries(call, max_retries=3, base_delay_s=2.0, sleep=sleeps.append)
    assert len(calls) == 4 and sleeps == [2.0, 4.0, 8.0]
    assert res["error"] == "Max retries exceeded: Flaky: busy"
    res = with_retries(call, is_transient=lambda e: False, sleep=sleeps.append)
    assert "busy" in res["error"]


from scorebook.testing import EchoPredictor as EchoModel  # noqa: E402


def test_batch_inference_rows_and_errors(spark):
    df = spark.createDataFrame([("1", "ASD", "api"), ("2", "boom", "api"), ("3", "VSD", "local")],
                               "sample_id string, t string, model_id string")
    df = df.withColumn("content", F.encode("t", "UTF-8")).withColumn("prompt_text", F.lit("q"))
    out = batch_inference(df, EchoModel, content_col="content", keep_cols=["sample_id", "model_id"],
                          model_col="model_id", parallelism=2, base_delay_s=0.0, max_retries=1)
    rows = {r.sample_id: r for r in out.collect()}
    assert rows["1"].raw_output == "DIAGNOSIS: ASD" and rows["1"].cost_usd == 0.001
    assert rows["2"].raw_output == "" and rows["2"].error == "Max retries exceeded: RuntimeError: model failed"
    assert rows["3"].input_tokens == 3


def test_runner_end_to_end(spark, tmp_path):
    from scorebook.plans.runner import run_experiment
    from scorebook.sources.config import models_frame, prompts_frame
    samples = spark.createDataFrame([(f"s{i}", f"p{i}.png", ["ASD", "VSD"][i % 2]) for i in range(8)],
                                    "sample_id string, image_path string, label string")
    samples = samples.withColumn("content", F.encode("label", "UTF-8"))
    models = models_frame(spark, [{"model_id": "api", "display_name": "Api", "backend": "api"},
                                  {"model_id": "local", "display_name": "Local", "backend": "hf"}])
    prompts = prompts_frame(spark, {"Z": "classify"})
    path = str(tmp_path / "results")
    out = run_experiment(spark, samples, models, prompts, EchoModel, path, base_delay_s=0.0)
    res = out.results
    assert res.count() == 16
    assert res.filter("predicted_label = true_label").count() == 16
    rates = {r.model_name: r.parse_rate for r in out.parse_rates.collect()}
    assert rates == {"Api": 1.0, "Local": 1.0}
    assert [r.n_calls for r in out.cost.collect()] == [8]
    # resume: nothing left to run, the table stays the same
    again = run_experiment(spark, samples, models, prompts, EchoModel, path, base_delay_s=0.0)
    assert again.results.count() == 16


def test_payload_shapes(spark):
    import json

    from scorebook.operators.inference import image_request_payload, with_media_token
    df = spark.createDataFrame([("hi", "look")], "t string, prompt string") \
        .withColumn("content", F.encode("t", "UTF-8"))
    a = json.loads(df.select(image_request_payload("content", "prompt", "m")).first()[0])
    b = json.loads(df.select(image_request_payload("content", "prompt", "m", "base64_source")).first()[0])
    assert a["messages"][0]["content"][0]["image_url"]["url"] == "data:image/jpeg;base64,aGk="
    assert b["messages"][0]["content"][0]["source"]["data"] == "aGk="
    assert b["messages"][0]["content"][1] == {"type": "text", "text": "look"}
    got = list(df.select(with_media_token(F.lit("x <image> y")),
                         with_media_token(F.lit("q"))).first())
    assert got == ["x <image> y", "<image>\nq"]


def test_runner_partial_resume_keeps_finished_partitions(spark, tmp_path):
    import glob
    import os

    from scorebook.plans.runner import run_experiment
    from scorebook.sources.config import models_frame, prompts_frame
    samples = spark.createDataFrame([(f"s{i}", f"p{i}.png", ["ASD", "VSD"][i % 2]) for i in range(6)],
                                    "sample_id string, image_path string, label string") \
        .withColumn("content", F.encode("label", "UTF-8"))
    prompts = prompts_frame(spark, {"Z": "classify"})
    api = {"model_id": "api", "display_name": "Api", "backend": "api"}
    loc = {"model_id": "local", "display_name": "Local", "backend": "hf"}
    path = str(tmp_path / "results")
    run_experiment(spark, samples, models_frame(spark, [api]), prompts, EchoModel, path,
                   base_delay_s=0.0)
    done_files = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/model_name=Api/**/*.parquet",
                                                            recursive=True)}
    assert done_files
    out = run_experiment(spark, samples, models_frame(spark, [api, loc]), prompts, EchoModel, path,
                         base_delay_s=0.0)
    assert out.results.count() == 12
    assert {f: os.path.getmtime(f) for f in done_files} == done_files
