"""Arrivals with state, and tables whose readers see whole versions only."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from scorebook.sources.results import dedupe_results
from scorebook.sources.versions import CommitConflict, VersionedTable
from scorebook.streaming import arrivals

SCHEMA = "sample_id string, model_name string, prompt_id string, predicted_label string, arrived timestamp"
KEY = ["model_name", "prompt_id", "sample_id"]


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, arrivals.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_latest_arrival_wins_in_any_order(spark, tmp_path, rocksdb):
    rng = random.Random(6)
    t0 = dt.datetime(2024, 5, 1)
    rows = [(f"s{i}", m, "p", rng.choice(["ASD", "VSD", None]), t0 + dt.timedelta(seconds=rng.randrange(40)))
            for i in range(30) for m in ("a", "b") for _ in range(4) if (m, i) != ("b", 7)]
    rng.shuffle(rows)
    rows += [rows[0], (None, "a", "p", "ASD", t0), ("s1", None, "p", "ASD", t0)]       # a repeat; no key
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    parts = [rows[:100], rows[100:]]
    samples = spark.createDataFrame([(f"s{i}",) for i in range(30)], "sample_id string")
    expected = arrivals.expected_by_bucket(samples, 3)
    assert sum(expected.values()) == 30

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        events = arrivals.latest_answers(stream, expected, 3)
        q = events.writeStream.outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True) \
            .foreachBatch(lambda b, e: b.withColumn("batch", F.lit(e)).write.mode("append").parquet(out)).start()
        assert q.awaitTermination(120)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(src)
        run()
    events = spark.read.parquet(out)
    batch = dedupe_results(spark.createDataFrame(rows, SCHEMA).dropna(subset=KEY), KEY, order_by=["arrived"])
    got = sorted(map(repr, arrivals.current_answers(events).select(*batch.columns).collect()))
    assert got == sorted(map(repr, batch.collect()))
    # an answer is passed on only if it is newer than the one before it
    seen = {}
    for r in events.filter("event = 'answer'").orderBy("batch").collect():
        k = (r.model_name, r.sample_id)
        assert k not in seen or (r.arrived, r.predicted_label or "") > seen[k]
        seen[k] = (r.arrived, r.predicted_label or "")
    done = events.filter("event = 'complete'").groupBy("model_name").agg(F.sum("n_samples").alias("n"), F.count(F.lit(1)).alias("b"))
    short = expected[arrivals_bucket(spark, "s7")]
    assert {r.model_name: (r.n, r.b) for r in done.collect()} == {"a": (30, 3), "b": (30 - short, 2)}


def test_stalled_condition_is_told_once(spark, tmp_path, rocksdb):
    t0 = dt.datetime(2024, 5, 1)
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    told = []
    spark.createDataFrame([("s1", "a", "p", "ASD", t0), ("s1", "b", "p", "ASD", t0), ("s2", "b", "p", "ASD", t0)],
                          SCHEMA).coalesce(1).write.parquet(src)
    events = arrivals.latest_answers(spark.readStream.schema(SCHEMA).parquet(src), {0: 2}, 1, idle_s=1.0)
    q = events.writeStream.outputMode("update").option("checkpointLocation", ck).trigger(processingTime="200 milliseconds") \
        .foreachBatch(lambda b, e: told.extend((r.model_name, r.event, r.n_samples) for r in b.collect())).start()
    try:
        until = time.time() + 90
        while time.time() < until and ("a", "stalled", 1) not in told:
            time.sleep(0.5)
        time.sleep(2)
    finally:
        q.stop()
    assert sorted(told) == [("a", "answer", 1), ("a", "stalled", 1), ("b", "answer", 2), ("b", "answer", 2), ("b", "complete", 2)]


def arrivals_bucket(spark, sample_id):
    from scorebook.operators.inference import bucket_of
    return spark.range(1).select(bucket_of(F.lit(sample_id), 3)).first()[0]


# --- versions ---------------------------------------------------------------------------------

def test_versions_replace_append_and_time_travel(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["m", "b"])
    with pytest.raises(FileNotFoundError):
        t.read()
    df = spark.createDataFrame([("a/x", 0, 1), ("a/x", 1, 2), (None, 0, 3)], "m string, b int, v int")
    assert t.commit(df, "parts") == 1
    assert t.commit(spark.createDataFrame([("a/x", 1, 20)], df.schema), "parts") == 2
    rows = lambda v=None: sorted(map(repr, (tuple(r) for r in t.read(v).collect())))     # noqa: E731
    assert rows() == sorted(map(repr, [("a/x", 0, 1), ("a/x", 1, 20), (None, 0, 3)]))
    assert t.commit(spark.createDataFrame([(None, 0, 30)], df.schema), "parts") == 3
    assert t.commit(df.limit(1), "none", token="x") == 4 and t.commit(df.limit(1), "none", token="x") == 4
    assert t.read().count() == 4 and t.read(1).count() == 3 and repr(("a/x", 1, 2)) in rows(1)
    assert t.commit(df.limit(0)) == 5 and t.read().count() == 0 and t.read().columns == ["m", "b", "v"]
    assert len(t.vacuum(keep=1)) >= 3 and t.versions() == [5]


def test_half_written_data_and_lost_races_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "t")
    t = VersionedTable(spark, root)
    t.commit(spark.range(5))
    spark.range(99).write.parquet(f"{root}/data/halfway")          # a writer that died before its manifest
    assert t.read().count() == 5
    base, fresh = t.manifest(), [{"folder": "halfway", "part": None}]
    t.commit(spark.range(7))
    with pytest.raises(CommitConflict):
        t._publish(base, fresh, spark.range(1).schema, "all", None)
    assert t.read().count() == 7


def test_readers_see_one_version_during_writes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(0, 1000, 1, 4).select(F.lit(0).alias("v"), "id"))
    stop, seen = threading.Event(), []

    def reader():
        while not stop.is_set():
            r = VersionedTable(spark, t.root).read().agg(F.min("v"), F.max("v"), F.count("*")).first()
            seen.append(tuple(r))
    th = threading.Thread(target=reader)
    th.start()
    try:
        for v in range(1, 6):
            t.commit(spark.range(0, 1000, 1, 4).select(F.lit(v).alias("v"), "id"))
    finally:
        stop.set()
        th.join()
    assert seen and all(a == b and n == 1000 for a, b, n in seen)
    assert [a for a, _, _ in seen] == sorted(a for a, _, _ in seen)


def test_stream_publishes_versions_once(spark, tmp_path):
    from scorebook.operators.cells import confusion_cells_all
    from scorebook.streaming.live import live_condition_counts, publish_available_now, read_results_stream
    schema = ("sample_id string, true_label string, predicted_label string, parse_success boolean, "
              "model_name string, prompt_id string, cost_usd double")
    rows = [(str(i), "ASD", ["ASD", None][i % 2], i % 2 == 0, "m", "p", 0.0) for i in range(40)]
    src = str(tmp_path / "in")
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    t = VersionedTable(spark, str(tmp_path / "live"))
    agg = live_condition_counts(read_results_stream(spark, src, spark.createDataFrame([], schema).schema, 1))
    publish_available_now(agg, str(tmp_path / "ck"), t)
    C = ["model_name", "prompt_id"]
    want = sorted(map(tuple, confusion_cells_all(spark.read.parquet(src), C).collect()))
    assert sorted(tuple(r) for r in t.read().select(*C, "true_label", "predicted_label", "n").collect()) == want
    assert t.versions() == [1, 2] and t.read(1).agg(F.sum("n")).first()[0] == 25
    # the same batch once more: no new version
    t.commit(spark.range(1), token="batch-1")
    assert t.versions() == [1, 2]


def test_run_into_a_versioned_table(spark, tmp_path):
    from scorebook.plans.runner import run_experiment
    from scorebook.sources.config import models_frame, prompts_frame
    from scorebook.testing import EchoPredictor
    samples = spark.createDataFrame([(f"s{i}", f"p{i}", "ASD") for i in range(20)], "sample_id string, image_path string, label string") \
        .withColumn("content", F.encode("label", "UTF-8"))
    one, two = ({"model_id": m, "backend": "x"} for m in ("a/1", "b"))
    prompts = prompts_frame(spark, {"p1": "one", "p2": "two"})
    path = str(tmp_path / "results")
    args = dict(base_delay_s=0.0, buckets=2, parallelism=2, versioned=True)
    assert run_experiment(spark, samples, models_frame(spark, [one]), prompts, EchoPredictor, path, **args).results.count() == 40
    table = VersionedTable(spark, path)
    assert table.versions() == [1, 2]
    out = run_experiment(spark, samples, models_frame(spark, [one, two]), prompts, EchoPredictor, path, **args)
    assert out.results.count() == 80 and table.versions() == [1, 2, 3, 4] and table.read(2).count() == 40
    assert run_experiment(spark, samples, models_frame(spark, [two]), prompts, EchoPredictor, path, **args).results.count() == 80
    assert table.versions() == [1, 2, 3, 4]
