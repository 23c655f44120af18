"""Plan shape: pruning, no Python in the hot path, no cartesian products."""

from scorebook.plans import registry as R
from scorebook.sources.fixtures import eval_results

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_plan_prunes_and_stays_jvm(spark):
    p = plan_of(R.q_metrics(spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_no_cartesian_anywhere(spark):
    for name, fn in R.QUERIES.items():
        p = plan_of(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_fixture_is_narrow(spark):
    p = plan_of(eval_results(spark, SF))
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 12
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)


def test_full_analysis_equals_separate_operators(spark):
    from scorebook.plans.analysis import print_summary, run_full_analysis
    a = run_full_analysis(eval_results(spark, SF), n_bootstrap=200)

    def rows(df, cols):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in df.select(*cols).collect())

    for mine, ref in [(a.metrics, R.q_metrics(spark, SF)),
                      (a.per_class_metrics, R.q_per_class(spark, SF)),
                      (a.calibration, R.q_calibration(spark, SF)),
                      (a.reliability, R.q_reliability(spark, SF))]:
        cols = sorted(ref.columns)
        assert rows(mine, cols) == rows(ref, cols)
    assert a.bootstrap_cis.count() == 12
    assert "Classification Metrics" in print_summary(a)


def test_e1_scan_prunes_raw_output(spark, tmp_path):
    from pyspark.sql import functions as F

    from scorebook.plans.analysis import run_full_analysis
    path = str(tmp_path / "results")
    eval_results(spark, SF).withColumn("raw_output", F.repeat(F.lit("long answer "), 50)) \
        .write.parquet(path)
    a = run_full_analysis(spark.read.parquet(path), n_bootstrap=0)
    for df in [a.metrics, a.calibration, a.mcnemar_results]:
        p = plan_of(df)
        assert "ReadSchema: " in p
        for part in p.split("ReadSchema: ")[1:]:
            assert "raw_output" not in part.split("\n")[0]


def test_image_bytes_not_read_unless_selected(spark, tmp_path):
    import os

    from scorebook.sources.samples import load_samples_from_directory
    os.makedirs(tmp_path / "ASD")
    (tmp_path / "ASD" / "a.png").write_bytes(b"x" * 100)
    p = plan_of(load_samples_from_directory(spark, str(tmp_path), ["ASD"]))
    schema_line = [ln for ln in p.split("\n") if "ReadSchema" in ln or "struct<" in ln]
    assert all("content" not in ln for ln in schema_line)


def test_analysis_release(spark):
    from scorebook.plans.analysis import run_full_analysis
    a = run_full_analysis(eval_results(spark, SF), n_bootstrap=0, with_mcnemar=False)
    assert a.metrics.count() == 12 and len(a._persisted) == 2
    a.release()
    assert a._persisted == []


def test_worker_code_travels_with_the_task():
    """Worker-side modules are pickled by value, so executors need not import the package."""
    from pyspark import cloudpickle

    import scorebook.operators.bootstrap as b
    import scorebook.operators.compare as c
    import scorebook.operators.inference as i
    for mod in (b, c, i):
        assert mod.__name__ in cloudpickle.list_registry_pickle_by_value()
