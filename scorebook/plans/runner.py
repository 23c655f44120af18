"""Run an experiment (samples x models x prompts) and write the results.

Plan: conditions (S7, J10) -> every sample under every condition (J1) -> skip (bucket, condition)
pairs already written (S8) -> model calls (D1) -> label parsing (L0-L6, native expressions) ->
partitioned write (S4/S5).  The written table is then read back for the parse-rate and cost
reports (A10, A12), so a paid call is never re-executed through lineage.

The results are the ledger of paid calls: samples are dealt to buckets by md5 of their id, each
model's buckets are written one after the other, and a bucket of a condition is a folder that
appears whole or not at all.  Inside a bucket an answer log keeps what has been paid since the last
commit.  So a run that ends anywhere, at any point of a model, resumes behind its last logged batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.config import LabelSpec
from scorebook.functions.labels import parse_labels
from scorebook.operators.cost import cost_summary
from scorebook.operators.inference import AnswerLog, batch_inference, bucket_of, expand_conditions
from scorebook.plans.report import parse_rate_report
from scorebook.sources.config import conditions_frame, remaining_conditions
from scorebook.sources.results import write_results
from scorebook.sources.samples import balanced_total, first_n
from scorebook.sources.versions import VersionedTable

C = ["model_name", "prompt_id"]


@dataclass
class RunOutput:
    results: DataFrame
    parse_rates: DataFrame
    cost: DataFrame


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - an empty folder has no readable schema
        return None


def run_experiment(spark: SparkSession, samples: DataFrame, models: DataFrame,
                   prompts: DataFrame, predictor_for: Callable[[str], object],
                   results_path: str, prompt_ids: Sequence[str] | None = None,
                   max_samples: int | None = None, parallelism: int | None = None,
                   spec: LabelSpec | None = None, mode: str = "compat",
                   max_retries: int = 3, base_delay_s: float = 2.0,
                   select: str = "balanced", batch_rows: int = 256, batch_size: int = 1,
                   buckets: int = 8, answer_log: bool = True, barrier: bool = False,
                   versioned: bool = False) -> RunOutput:
    """``predictor_for(model_id)`` builds the user's predictor for one model.

    Each (model, bucket of samples) is a write of its own, all remaining prompts together; what is
    on disk is not asked again by the next run.  ``buckets`` must stay the same for a results folder.
    ``answer_log``: keep answers of unfinished buckets under ``results_path/_answers`` (storage that
    pyarrow reaches from every executor); each task's share of a bucket is one group of it.
    ``versioned``: the folder is a :class:`VersionedTable`, whose readers see whole commits only; the
    resume reads its latest version.
    A model that does not load ends the run; what is written stays.
    ``select``: how ``max_samples`` picks (``balanced`` over labels, or ``first`` in
    path order); exactly that many samples are used."""
    spec = spec or LabelSpec()
    conds = conditions_frame(models, prompt_ids, prompts).join(
        prompts, "prompt_id", "inner").select(
        F.col("model_id"), F.col("display_name").alias("model_name"), "backend",
        "prompt_id", "prompt_text")
    if max_samples is not None:
        if select not in ("balanced", "first"):
            raise ValueError("select must be 'balanced' or 'first'")
        samples = balanced_total(samples, max_samples) if select == "balanced" else first_n(samples, max_samples)
    # the list of models, prompts and buckets is the experiment's own size
    pairs = conds.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    table = VersionedTable(spark, results_path, [*C, "bucket"]) if versioned else None
    done = (table.read() if table.versions() else None) if versioned else _existing(spark, results_path)
    if done is not None:
        if "bucket" not in done.columns:
            raise ValueError(f"{results_path} holds results without buckets; use another folder")
        pairs = remaining_conditions(pairs, done, [*C, "bucket"])
    order = list(dict.fromkeys(r.model_id for r in models.select("model_id").collect()))
    left = {(r.model_id, r.bucket) for r in pairs.select("model_id", "bucket").distinct().collect()}
    parts = parallelism or spark.sparkContext.defaultParallelism
    dealt = samples.withColumn("bucket", bucket_of("sample_id", buckets))
    for model_id, bucket in ((m, b) for m in order for b in range(buckets) if (m, b) in left):
        here = pairs.filter((F.col("model_id") == model_id) & (F.col("bucket") == bucket)).drop("bucket")
        rows = expand_conditions(dealt.filter(F.col("bucket") == bucket), here)
        key = F.sha2(F.concat_ws("\x1f", "sample_id", "model_id", "prompt_id", "prompt_text"), 256)
        rows = rows.withColumn("call_key", key).withColumn("call_group", F.concat_ws(
            "-", F.substring(F.md5("model_id"), 1, 12), F.lit(bucket), bucket_of("call_key", parts)))
        keep = ["sample_id", "image_path", "label", "model_name", "model_id", "backend", "prompt_id", "bucket"]
        keep = [c for c in keep if c in rows.columns]
        content = "content" if "content" in rows.columns else None
        answered = batch_inference(rows, predictor_for, prompt_col="prompt_text",
                                   content_col=content, keep_cols=keep, parallelism=parts,
                                   model_col="model_id", max_retries=max_retries,
                                   base_delay_s=base_delay_s, batch_rows=batch_rows, batch_size=batch_size,
                                   group_cols=["call_group"], key_col="call_key", barrier=barrier, load_errors="raise",
                                   log=AnswerLog(f"{results_path.rstrip('/')}/_answers") if answer_log else None)
        parsed = parse_labels(answered.withColumnRenamed("label", "true_label"),
                              "raw_output", "predicted_label", spec, mode)
        if versioned:
            table.commit(parsed, "parts")
        else:
            write_results(parsed, results_path, [*C, "bucket"])
    results = (table.read() if versioned else spark.read.parquet(results_path)).drop("bucket")
    return RunOutput(results=results, parse_rates=parse_rate_report(results, C),
                     cost=cost_summary(results, C))


def evaluate_single(spark: SparkSession, samples: DataFrame, predictor_factory: Callable[[], object],
                    prompt_text: str, prompt_id: str, model_name: str,
                    spec: LabelSpec | None = None) -> DataFrame:
    """One model under one prompt, returned (not written)."""
    rows = samples.withColumn("prompt_text", F.lit(prompt_text)) \
                  .withColumn("prompt_id", F.lit(prompt_id)) \
                  .withColumn("model_name", F.lit(model_name))
    content = "content" if "content" in rows.columns else None
    keep = [c for c in rows.columns if c not in ("content", "prompt_text")]
    answered = batch_inference(rows, predictor_factory, "prompt_text", content, keep)
    return parse_labels(answered.withColumnRenamed("label", "true_label"), "raw_output",
                        "predicted_label", spec or LabelSpec())
