"""Streaming condition counts over a results folder equal the batch aggregation."""

from scorebook.streaming.live import live_condition_counts, read_results_stream, run_available_now


def test_available_now_equals_batch(spark, tmp_path):
    rows = [(str(i), ["ASD", "VSD"][i % 2], [None, "ASD", "VSD"][i % 3], i % 3 != 0,
             ["m1", "m2"][i % 2], "p", 0.01 * (i % 2)) for i in range(60)]
    schema = ("sample_id string, true_label string, predicted_label string, parse_success boolean, "
              "model_name string, prompt_id string, cost_usd double")
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    df.limit(30).write.parquet(src, mode="append")
    df.subtract(df.limit(30)).write.parquet(src, mode="append")
    stream = read_results_stream(spark, src, df.schema, max_files_per_trigger=1)
    run_available_now(live_condition_counts(stream), str(tmp_path / "ckpt"), "live_counts")
    got = sorted(tuple(r) for r in spark.table("live_counts").select(
        "model_name", "prompt_id", "true_label", "predicted_label", "n").collect())
    from scorebook.operators.cells import confusion_cells_all
    batch = sorted(tuple(r) for r in confusion_cells_all(spark.read.parquet(src),
                                                         ["model_name", "prompt_id"]).collect())
    assert got == batch


def test_stream_dedupe_within_watermark(spark, tmp_path):
    import datetime as dt

    from scorebook.streaming.live import dedupe_stream
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "m", "p", t), ("1", "m", "p", t + dt.timedelta(seconds=5)),
            ("2", "m", "p", t), ("1", "m", "q", t)]
    schema = "sample_id string, model_name string, prompt_id string, arrived timestamp"
    src = str(tmp_path / "arr")
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = dedupe_stream(stream, ["sample_id", "model_name", "prompt_id"], "arrived", "1 hour")
    q = (out.writeStream.format("memory").queryName("dedup_rows").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.sample_id, r.prompt_id) for r in spark.table("dedup_rows").collect())
    assert got == [("1", "p"), ("1", "q"), ("2", "p")]
