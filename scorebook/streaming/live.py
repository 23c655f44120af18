"""Running condition tables while results land in a folder.

The results folder is read as a stream (explicit schema); the same cell / parse-rate
/ cost aggregations as the batch path run as stateful streaming aggregations in
complete mode, so ratios are derived downstream from the running counts.  With
``trigger(availableNow=True)`` one call processes everything present and stops, and
the result equals the batch aggregation over the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.config import NONE_LABEL
from scorebook.sources.versions import VersionedTable


def read_results_stream(spark: SparkSession, path: str, schema: T.StructType,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def live_condition_counts(stream: DataFrame, group_cols: Sequence[str] = ("model_name", "prompt_id")) -> DataFrame:
    """Running per-condition cells (true, pred, n), parsed count and paid cost."""
    keys = [F.col(c) for c in group_cols]
    pred = F.coalesce(F.col("predicted_label"), F.lit(NONE_LABEL))
    return (stream.filter(" AND ".join(f"{c} IS NOT NULL" for c in group_cols))
            .groupBy(*keys, F.col("true_label"), pred.alias("predicted_label"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("parse_success").cast("long")).alias("n_parsed"),
                 F.sum(F.when(F.col("cost_usd") > 0, F.col("cost_usd")).otherwise(F.lit(0.0)))
                 .alias("cost_usd")))


def dedupe_stream(stream: DataFrame, key: Sequence[str], event_time: str,
                  delay: str = "1 hour") -> DataFrame:
    """Keep the first arrival per key; state is bounded by the watermark on the
    arrival time column the writer supplies."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def run_available_now(agg: DataFrame, checkpoint: str, sink_table: str) -> None:
    """Process every file present now into a memory table (tests, notebooks) and stop."""
    q = (agg.writeStream.outputMode("complete").format("memory").queryName(sink_table)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def write_available_now(agg: DataFrame, checkpoint: str, out_path: str) -> None:
    """Process every file present now and overwrite ``out_path`` with the running
    table (complete mode through ``foreachBatch``; each batch replaces the table)."""
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def publish_available_now(agg: DataFrame, checkpoint: str, table: VersionedTable) -> None:
    """Process every file present now; each batch commits the running table as a version of its own.

    Readers of ``table`` see the counts of one batch or of the next, never a half-written table; a
    batch that the stream repeats after a failure is committed once (its number is the token)."""
    def write(batch: DataFrame, epoch: int) -> None:
        table.commit(batch, token=f"batch-{epoch}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
