"""Registered queries: each runs a library operator over tables Spark derives from
the driver's parquet files (``events`` -> ``eval_results``, ``documents`` ->
``raw_outputs``), over whole tables.  Float columns whose value depends on the
order of a floating-point summation are rounded to 9 decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook import oracle
from scorebook.config import DEFAULT_GROUP_COLS, DEFAULT_LABELS
from scorebook.operators.calibration import calibration_metrics
from scorebook.operators.cells import confusion_cells, confusion_cells_all
from scorebook.operators.metrics import classification_metrics
from scorebook.sources.fixtures import eval_results

C = list(DEFAULT_GROUP_COLS)
L = list(DEFAULT_LABELS)
PROB_COLS = {x: f"prob_{x}" for x in L}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_cols(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- step 1: cells and count-based metrics ----------------------------------------

@register("metrics", oracle.metrics_sql())
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.calibration import roc_auc_table
    er = eval_results(spark, sf_dir)
    cells = confusion_cells_all(er, C)
    metrics, _ = classification_metrics(cells, L, C)
    return metrics.join(roc_auc_table(er, PROB_COLS, C), C, "left")


@register("per_class_metrics", oracle.per_class_sql())
def q_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.metrics import per_class_metrics
    return per_class_metrics(confusion_cells_all(eval_results(spark, sf_dir), C), L, C)


@register("confusion_cells", oracle.confusion_cells_sql())
def q_confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_cells(eval_results(spark, sf_dir), L, C)


# --- step 2: label parser -------------------------------------------------------------

@register("parse_labels", oracle.parse_labels_sql())
def q_parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.functions.labels import parse_labels
    from scorebook.sources.fixtures import raw_outputs
    out = parse_labels(raw_outputs(spark, sf_dir), "raw_output", with_branch=True)
    return out.select("answer_id", "tmpl", "predicted_label", "parse_success", "parse_branch")


# --- step 3: pairwise comparison ------------------------------------------------------

@register("mcnemar_counts", oracle.mcnemar_counts_sql())
def q_mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.compare import discordant_counts, mcnemar_chi2, pair_index
    pairs = pair_index(discordant_counts(eval_results(spark, sf_dir), C))
    return pairs.select("condition_a", "condition_b", "n_shared", "b_count", "c_count",
                        mcnemar_chi2(F.col("b_count"), F.col("c_count")).alias("chi2"),
                        "pair_idx")


@register("mcnemar", oracle.mcnemar_sql())
def q_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.compare import pairwise_mcnemar
    out = pairwise_mcnemar(eval_results(spark, sf_dir), C)
    return round_cols(out, ["p_raw", "p_bh", "p_bh_ref"])


@register("mcnemar_selfjoin", oracle.mcnemar_sql())
def q_mcnemar_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.compare import pairwise_mcnemar
    out = pairwise_mcnemar(eval_results(spark, sf_dir), C, method="selfjoin")
    return round_cols(out, ["p_raw", "p_bh", "p_bh_ref"])


@register("bootstrap_cis")
def q_bootstrap_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.bootstrap import bootstrap_cis
    cells = confusion_cells_all(eval_results(spark, sf_dir), C)
    return bootstrap_cis(cells, L, C, n_bootstrap=2000)


# --- step 4: calibration --------------------------------------------------------------

def _calibration(spark: SparkSession, sf_dir: str):
    return calibration_metrics(eval_results(spark, sf_dir), PROB_COLS, C)


@register("calibration", oracle.calibration_sql())
def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_cols(_calibration(spark, sf_dir).calibration, ["ece", "mce", "brier_score"])


@register("reliability_bins", oracle.reliability_sql())
def q_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir).reliability


@register("auc_per_class", oracle.auc_per_class_sql())
def q_auc_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibration(spark, sf_dir).auc_per_class


# --- step 6: cost and report tables ---------------------------------------------------

@register("cost_summary", oracle.cost_summary_sql())
def q_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.cost import cost_summary
    return cost_summary(eval_results(spark, sf_dir), C, nano_col="cost_nano")


@register("total_cost", oracle.total_cost_sql())
def q_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.cost import total_cost
    return total_cost(eval_results(spark, sf_dir), nano_col="cost_nano")


@register("per_call_cost", oracle.per_call_cost_sql())
def q_per_call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.cost import per_call_cost
    from scorebook.sources.config import fixture_models
    er = eval_results(spark, sf_dir).drop("cost_nano")
    out = per_call_cost(er, fixture_models(spark))
    return out.select("sample_id", "model_name", "prompt_id", "cost_nano", "cost_usd")


@register("parse_rate", oracle.parse_rate_sql())
def q_parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import parse_rate_report
    return parse_rate_report(eval_results(spark, sf_dir), C)


@register("parse_failures", oracle.parse_failures_sql())
def q_parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import parse_failures
    return parse_failures(eval_results(spark, sf_dir), C)


@register("class_counts", oracle.class_counts_sql())
def q_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import class_counts
    return class_counts(eval_results(spark, sf_dir), L, label_col="true_label", id_col="sample_id")


@register("distinct_models", oracle.distinct_sql("model_name"))
def q_distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import distinct_values
    return distinct_values(eval_results(spark, sf_dir), "model_name")


@register("distinct_prompts", oracle.distinct_sql("prompt_id"))
def q_distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import distinct_values
    return distinct_values(eval_results(spark, sf_dir), "prompt_id")


@register("workload_size", oracle.workload_size_sql())
def q_workload_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import workload_size
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    conds = eval_results(spark, sf_dir).select(*C).distinct()
    return workload_size(samples, conds)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_metrics(spark, sf_dir)


@register("table1_join", oracle.table1_join_sql())
def q_table1_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import table1
    cal = _calibration(spark, sf_dir).calibration.select(*C, "ece", "mce", "brier_score")
    return round_cols(table1(_metrics(spark, sf_dir), cal, C), ["ece", "mce", "brier_score"])


@register("best_prompt", oracle.best_prompt_sql())
def q_best_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import best_prompt_per_model
    return best_prompt_per_model(_metrics(spark, sf_dir))


@register("table2_semi", oracle.table2_semi_sql())
def q_table2_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import best_prompt_per_model, table2
    best = best_prompt_per_model(_metrics(spark, sf_dir))
    return table2(q_per_class(spark, sf_dir), best, C)


@register("best_condition", oracle.best_condition_sql())
def q_best_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.plans.report import best_condition
    return best_condition(_metrics(spark, sf_dir), C)


@register("significant_pairs", oracle.significant_pairs_sql())
def q_significant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.compare import pairwise_mcnemar
    from scorebook.plans.report import significant_pair_counts
    return significant_pair_counts(pairwise_mcnemar(eval_results(spark, sf_dir), C))


# --- step 7: figure tables ------------------------------------------------------------

@register("row_normalised", oracle.row_normalised_sql())
def q_row_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import row_normalised
    return row_normalised(q_confusion_cells(spark, sf_dir), C)


@register("condition_names", oracle.condition_names_sql())
def q_condition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.compare import condition_key
    from scorebook.operators.figdata import condition_label, file_safe, short_name
    conds = eval_results(spark, sf_dir).select(*C).dropna().distinct()
    return conds.select(*C, condition_key(C).alias("condition"),
                        short_name(F.col("model_name")).alias("short_model"),
                        condition_label(F.col("model_name"), F.col("prompt_id")).alias("two_line_label"),
                        F.concat(file_safe(F.col("model_name")), F.lit("_"), F.col("prompt_id"))
                        .alias("file_stem"))


@register("heat_pivot", oracle.heat_pivot_sql())
def q_heat_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import heat_pivot
    return heat_pivot(q_per_class(spark, sf_dir), L, "f1", C)


@register("heat_pivot_prompt", oracle.heat_pivot_sql("CoT"))
def q_heat_pivot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt only."""
    from scorebook.operators.figdata import heat_pivot
    return heat_pivot(q_per_class(spark, sf_dir), L, "f1", C, prompt_filter="CoT")


@register("bar_grid", oracle.bar_grid_sql())
def q_bar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import bar_grid
    return bar_grid(_metrics(spark, sf_dir), None, "macro_f1")


@register("ci_table", oracle.ci_table_sql())
def q_ci_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import ci_table
    return ci_table(_metrics(spark, sf_dir), None, "macro_f1", C)


@register("cost_grid", oracle.cost_grid_sql())
def q_cost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import cost_grid
    return cost_grid(q_cost_summary(spark, sf_dir))


@register("roc_points", oracle.roc_points_sql())
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.roc import roc_points
    return roc_points(eval_results(spark, sf_dir), PROB_COLS, ["model_name"])


def _roc_grid(spark: SparkSession, sf_dir: str):
    from scorebook.operators.roc import roc_macro_grid, roc_points
    pts = roc_points(eval_results(spark, sf_dir), PROB_COLS, ["model_name"])
    return roc_macro_grid(pts, L, ["model_name"])


@register("roc_macro_grid", oracle.roc_macro_grid_sql())
def q_roc_macro_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_cols(_roc_grid(spark, sf_dir)[0], ["mean_tpr"])


@register("roc_macro_auc", oracle.roc_macro_auc_sql())
def q_roc_macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_cols(_roc_grid(spark, sf_dir)[1], ["macro_auc"])


# --- step 8: sources, experiment expansion ---------------------------------------------

def _fixture_conditions(spark: SparkSession, extra: bool = False) -> DataFrame:
    from scorebook.sources.config import conditions_frame, fixture_models, models_frame, prompts_frame
    from scorebook.sources.fixtures import FIXTURE_PROMPT_TEXTS
    models = fixture_models(spark)
    if extra:
        models = models.unionByName(models_frame(spark, [
            {"model_id": "org/open-27b", "display_name": "org/Open-27B", "backend": "local"}]))
    prompts = prompts_frame(spark, FIXTURE_PROMPT_TEXTS)
    return conditions_frame(models, None, prompts).select(
        F.col("display_name").alias("model_name"), "model_id", "backend", "prompt_id")


@register("experiment_cross", oracle.experiment_cross_sql())
def q_experiment_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.inference import expand_conditions
    from scorebook.sources.fixtures import fixture_samples
    rows = expand_conditions(fixture_samples(spark, sf_dir), _fixture_conditions(spark))
    return rows.select("sample_id", "label", "model_name", "model_id", "prompt_id")


@register("resume_anti", oracle.resume_anti_sql())
def q_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.sources.config import remaining_conditions
    return remaining_conditions(_fixture_conditions(spark, extra=True),
                                eval_results(spark, sf_dir), C)


@register("stratified_n", oracle.stratified_n_sql(25))
def q_stratified_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.sources.fixtures import fixture_samples
    from scorebook.sources.samples import stratified_n
    return stratified_n(fixture_samples(spark, sf_dir), 25)


@register("merge_runs", oracle.merge_runs_sql())
def q_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.sources.results import merge_runs
    er = eval_results(spark, sf_dir)
    legacy = er.filter("backend = 'local'").select(
        "sample_id", "true_label", "predicted_label", "parse_success", "model_name", "prompt_id")
    return merge_runs(er.filter("backend = 'api'"), legacy)


@register("request_payload", oracle.request_payload_sql())
def q_request_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.inference import image_request_payload
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"),
                       F.concat(F.lit("Describe: "), F.col("lang")).alias("prompt"))
    return docs.select("doc_id", image_request_payload("content", "prompt", "api-a-2024")
                       .alias("payload"))


@register("media_token", oracle.media_token_sql())
def q_media_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.inference import with_media_token
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", with_media_token(F.col("text")).alias("prompt"))


def _inference_samples(spark: SparkSession, sf_dir: str, spread_out: bool = True) -> DataFrame:
    from scorebook.sources.fixtures import spread
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = spread(docs) if spread_out else docs
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"),
                       F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _inference_conditions(spark: SparkSession) -> DataFrame:
    return _fixture_conditions(spark).withColumn("prompt_text", F.concat(F.lit("Classify: "), F.col("prompt_id")))


@register("batch_inference", oracle.batch_inference_sql())
def q_batch_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.functions.labels import parse_labels
    from scorebook.operators.inference import batch_inference
    from scorebook.testing import KeywordPredictor
    out = batch_inference(_inference_samples(spark, sf_dir), KeywordPredictor, prompt_col="prompt_text",
                          content_col="content", conditions=_inference_conditions(spark),
                          keep_cols=["sample_id", "model_name", "model_id", "prompt_id"],
                          model_col="model_id", base_delay_s=0.0)
    return parse_labels(out, "raw_output")


CALL_BUCKETS, CALL_ROWS = 16, 32


def _batched(spark: SparkSession, sf_dir: str, with_calls: bool) -> DataFrame:
    from scorebook.operators.inference import batch_inference, bucket_of
    from scorebook.testing import KeywordBatchPredictor
    # dealt by bucket at once, not round-robin before that
    rows = _inference_samples(spark, sf_dir, spread_out=False).withColumn("bucket", bucket_of("sample_id", CALL_BUCKETS))
    return batch_inference(rows, KeywordBatchPredictor, prompt_col="prompt_text", content_col="content",
                           conditions=_inference_conditions(spark),
                           keep_cols=["sample_id", "model_name", "model_id", "prompt_id"],
                           model_col="model_id", base_delay_s=0.0, batch_size=CALL_ROWS,
                           group_cols=["bucket"], with_calls=with_calls)


@register("batched_inference", oracle.batch_inference_sql())
def q_batched_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a predictor that takes several rows a call."""
    from scorebook.functions.labels import parse_labels
    return parse_labels(_batched(spark, sf_dir, False), "raw_output")


@register("batched_calls", oracle.batched_calls_sql(CALL_BUCKETS, CALL_ROWS))
def q_batched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and calls per model: a call of n rows counts one nth at each of them."""
    sizes = _batched(spark, sf_dir, True).groupBy("model_id", "call_rows").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("model_id").agg(F.sum("n").alias("n_rows"),
                                         F.sum(F.expr("n div call_rows")).alias("n_calls"))


@register("faulty_inference", oracle.faulty_inference_sql())
def q_faulty_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor that fails by rule; every row is kept, with its answer or its error."""
    from scorebook.operators.inference import batch_inference
    from scorebook.testing import FaultyPredictor
    out = batch_inference(_inference_samples(spark, sf_dir), FaultyPredictor, prompt_col="prompt_text", content_col="content",
                          conditions=_inference_conditions(spark),
                          keep_cols=["sample_id", "model_id", "prompt_id"], model_col="model_id",
                          max_retries=2, base_delay_s=0.0, is_transient=lambda e: isinstance(e, TimeoutError))
    return out.select("sample_id", "model_id", "prompt_id", "raw_output", "input_tokens", "error")


# --- step 5: row-weighted bootstrap -----------------------------------------------------
POISSON_REPLICATES = 2000     # the operator's default


@register("bootstrap_poisson", oracle.bootstrap_poisson_sql(POISSON_REPLICATES))
def q_bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.bootstrap import poisson_replicates
    return poisson_replicates(eval_results(spark, sf_dir), L, C, POISSON_REPLICATES)


@register("percentile_bounds", oracle.percentile_bounds_sql(POISSON_REPLICATES))
def q_percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.bootstrap import SUPPORTED, percentile_bounds, poisson_replicates
    reps = poisson_replicates(eval_results(spark, sf_dir), L, C, POISSON_REPLICATES)
    out = percentile_bounds(reps, C, SUPPORTED)
    return round_cols(out, ["macro_f1_ci_lower", "macro_f1_ci_upper", "accuracy_ci_lower",
                            "accuracy_ci_upper"])


WEIGHTED_REPLICATES = 200     # rows x classes x replicates in the SQL twin


@register("bootstrap_weighted", oracle.bootstrap_weighted_sql(WEIGHTED_REPLICATES))
def q_bootstrap_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.bootstrap import weighted_replicates
    out = weighted_replicates(eval_results(spark, sf_dir), PROB_COLS, C, WEIGHTED_REPLICATES)
    return round_cols(out, ["brier_score", "ece"])


@register("bootstrap_cis_weighted", oracle.bootstrap_cis_weighted_sql(WEIGHTED_REPLICATES))
def q_bootstrap_cis_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.bootstrap import bootstrap_cis_weighted
    out = bootstrap_cis_weighted(eval_results(spark, sf_dir), PROB_COLS, C, WEIGHTED_REPLICATES)
    return round_cols(out, [c for c in out.columns if c not in C])


# --- more figure tables, set operations --------------------------------------------------

@register("all_matrices", oracle.all_matrices_sql())
def q_all_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import all_matrices
    return all_matrices(q_confusion_cells(spark, sf_dir), C)


@register("best_matrix", oracle.best_matrix_sql())
def q_best_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.figdata import best_matrix
    return best_matrix(q_confusion_cells(spark, sf_dir), _metrics(spark, sf_dir), C)


@register("shared_ids", oracle.shared_ids_sql())
def q_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.sources.results import shared_ids
    return shared_ids(eval_results(spark, sf_dir), {"model_name": "Api-A", "prompt_id": "ZSD"},
                      {"model_name": "org/Open-4B", "prompt_id": "RCE"})


@register("dedupe_results", oracle.dedupe_sql())
def q_dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.sources.results import dedupe_results, merge_runs
    er = eval_results(spark, sf_dir)
    first = er.withColumn("run", F.lit(1))
    again = er.filter("backend = 'api'").withColumn("predicted_label", F.lit("Normal")) \
        .withColumn("parse_success", F.lit(True)).withColumn("run", F.lit(2))
    return dedupe_results(merge_runs(first, again), order_by=["run"]).drop("run")


# --- the full analysis (E1), held to the same SQL as its operators ------------------------

def _analysis(spark: SparkSession, sf_dir: str):
    from scorebook.plans.analysis import run_full_analysis
    return run_full_analysis(eval_results(spark, sf_dir), C, L, n_bootstrap=0, persist=False)


@register("analysis_metrics", oracle.metrics_sql())
def q_analysis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).metrics


@register("analysis_calibration", oracle.calibration_sql())
def q_analysis_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_cols(_analysis(spark, sf_dir).calibration, ["ece", "mce", "brier_score"])


@register("analysis_mcnemar", oracle.mcnemar_sql())
def q_analysis_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_cols(_analysis(spark, sf_dir).mcnemar_results, ["p_raw", "p_bh", "p_bh_ref"])


@register("confusion_arrays", oracle.confusion_arrays_sql())
def q_confusion_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.operators.cells import confusion_arrays
    out = confusion_arrays(q_confusion_cells(spark, sf_dir), L, C)
    return out.select(*C, F.to_json("matrix").alias("matrix"))


@register("check_labels", oracle.check_labels_sql())
def q_check_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorebook.sources.samples import check_labels
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("label"))
    good, bad = check_labels(events, ["click", "view"], raise_on_invalid=False)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.groupBy("label", "valid").agg(F.count(F.lit(1)).alias("n"))


# --- tables written and read back: sinks, versions, the stream --------------------------------

def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from scorebook.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scorebook/{name}-{uuid.uuid4().hex}"


@register("results_round_trip", oracle.round_trip_sql())
def q_results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conditions written, one model's written again with other answers, read back."""
    from scorebook.sources.results import write_results
    er, path = eval_results(spark, sf_dir), _scratch(spark, "round-trip")
    write_results(er, path)
    write_results(er.filter("model_name = 'Api-B'").withColumn("predicted_label", F.lit("PDA")), path)
    return spark.read.parquet(path).select(*er.columns)


@register("versioned_results", oracle.round_trip_sql())
def q_versioned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as versions of a table: the second commit replaces the conditions that it holds."""
    from scorebook.sources.versions import VersionedTable
    er = eval_results(spark, sf_dir)
    table = VersionedTable(spark, _scratch(spark, "versions"), C)
    table.commit(er, "parts")
    table.commit(er.filter("model_name = 'Api-B'").withColumn("predicted_label", F.lit("PDA")), "parts")
    return table.read()


@register("live_counts", oracle.live_counts_sql())
def q_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of results, running counts published as versions."""
    from scorebook.sources.fixtures import eval_results_from_events
    from scorebook.sources.versions import VersionedTable
    from scorebook.streaming.live import live_condition_counts, publish_available_now
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    results = eval_results_from_events(stream).withColumn("cost_usd", F.col("cost_nano") / 1e9)
    table = VersionedTable(spark, _scratch(spark, "live"))
    publish_available_now(live_condition_counts(results), _scratch(spark, "live-checkpoint"), table)
    return round_cols(table.read(), ["cost_usd"])
