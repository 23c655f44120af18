"""Sources and sinks: CSV results, manifests, image folders, partitioned writes."""

import os

import pytest
from pyspark.sql import functions as F

from scorebook.sources.config import conditions_frame, models_frame, prompts_frame, remaining_conditions
from scorebook.sources.results import (merge_runs, read_results_csv, widen_legacy,
                                       write_results)
from scorebook.sources.samples import (check_labels, load_samples_from_csv,
                                       load_samples_from_directory, stratified_n)

LABELS = ["ASD", "VSD", "PDA", "Normal"]


def test_results_csv_roundtrip(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(
        'sample_id,true_label,predicted_label,raw_output,parse_success,model_name,prompt_id\n'
        '001,ASD,,"line one\nline ""two""",false,m,ZSD\n'
        '002,VSD,None,plain,false,m,ZSD\n'
        '003,PDA,PDA,"DIAGNOSIS: PDA",true,m,ZSD\n')
    df = read_results_csv(spark, str(p))
    rows = {r.sample_id: r for r in df.collect()}
    assert set(rows) == {"001", "002", "003"}          # ids stay strings
    assert rows["001"].raw_output == 'line one\nline "two"'
    assert rows["001"].predicted_label is None          # empty -> null
    assert rows["002"].predicted_label == "None"        # literal kept by default
    assert rows["003"].parse_success is True
    df2 = read_results_csv(spark, str(p), na_strings=["None"])
    assert {r.sample_id: r for r in df2.collect()}["002"].predicted_label is None


def test_manifest_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("file,cls\na.png,ASD\nb.png,VSD\n")
    df = load_samples_from_csv(spark, str(p), image_col="file", label_col="cls", id_col=None)
    assert df.count() == 2 and df.filter(F.col("sample_id").isNull()).count() == 0
    df2 = load_samples_from_csv(spark, str(p), image_col="file", label_col="cls", id_col=None,
                                id_fallback="row_index")
    assert sorted(r.sample_id for r in df2.collect()) == ["0", "1"]


def test_image_directory(spark, tmp_path):
    for d, files in {"ASD": ["x.PNG", "y.jpg"], "vsd": ["x.jpeg", "notes.txt"], "misc": ["z.png"]}.items():
        os.makedirs(tmp_path / d)
        for f in files:
            (tmp_path / d / f).write_bytes(b"\x89PNG fake")
    df = load_samples_from_directory(spark, str(tmp_path), LABELS, with_content=True)
    rows = sorted((r.sample_id, r.label) for r in df.collect())
    assert rows == [("ASD/x", "ASD"), ("ASD/y", "ASD"), ("vsd/x", "VSD")]
    assert df.filter(F.length("content") > 0).count() == 3
    with pytest.raises(FileNotFoundError):
        load_samples_from_directory(spark, str(tmp_path / "missing"), LABELS)


def test_label_check_and_stratified(spark):
    df = spark.createDataFrame([(str(i), LABELS[i % 4]) for i in range(40)] + [("x", "Bad")],
                               "sample_id string, label string")
    with pytest.raises(ValueError):
        check_labels(df, LABELS)
    ok, bad = check_labels(df, LABELS, raise_on_invalid=False)
    assert ok.count() == 40 and bad.count() == 1
    s = stratified_n(ok, 3).groupBy("label").count().collect()
    assert sorted(r["count"] for r in s) == [3, 3, 3, 3]


def test_partitioned_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "res")
    base = spark.createDataFrame([("1", "m", "A"), ("2", "m", "B")],
                                 "sample_id string, model_name string, prompt_id string")
    write_results(base, path)
    write_results(spark.createDataFrame([("3", "m", "A")], base.schema), path)
    got = sorted((r.sample_id, r.prompt_id) for r in spark.read.parquet(path).collect())
    assert got == [("2", "B"), ("3", "A")]


def test_conditions_and_resume(spark):
    models = models_frame(spark, [{"model_id": "a", "backend": "api"},
                                  {"model_id": "b", "backend": "local", "max_new_tokens": 64}])
    prompts = prompts_frame(spark, {"P1": "x", "P2": "y"})
    conds = conditions_frame(models, None, prompts)
    assert conds.count() == 4
    assert {r.max_new_tokens for r in conds.collect()} == {512, 64}
    with pytest.raises(ValueError):
        conditions_frame(models, ["P1", "nope"], prompts)
    done = spark.createDataFrame([("a", "P1")], "model_name string, prompt_id string")
    left = remaining_conditions(conds.withColumnRenamed("display_name", "model_name"), done)
    assert left.count() == 3


def test_merge_legacy(spark):
    new = spark.createDataFrame([("1", "m", "A", 0.5)], "sample_id string, model_name string, "
                                                         "prompt_id string, cost_usd double")
    old = spark.createDataFrame([("2", "m", "A")], "sample_id string, model_name string, prompt_id string")
    merged = merge_runs(new, old)
    assert merged.count() == 2 and merged.filter("cost_usd IS NULL").count() == 1
    wide = widen_legacy(old, LABELS)
    assert "prob_ASD" in wide.columns and "cost_usd" in wide.columns
