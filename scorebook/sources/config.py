"""Experiment settings as DataFrames.

Settings arrive as plain dicts (already parsed); they become small typed DataFrames
(the condition list) that the plans join or expand.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS_SCHEMA = ("model_id string, display_name string, backend string, max_new_tokens int, "
                 "inference_params map<string,string>, cost_per_1k_input_tokens double, "
                 "cost_per_1k_output_tokens double")
PROMPTS_SCHEMA = "prompt_id string, prompt_text string"

MODEL_DEFAULTS = {"max_new_tokens": 512, "inference_params": {},
                  "cost_per_1k_input_tokens": 0.0, "cost_per_1k_output_tokens": 0.0}


def models_frame(spark: SparkSession, models: Iterable[dict]) -> DataFrame:
    """Model settings -> ``models`` table, defaults filled (512 tokens, cost 0.0)."""
    rows = []
    for m in models:
        if "model_id" not in m or "backend" not in m:
            raise ValueError("each model needs 'model_id' and 'backend'")
        r = {**MODEL_DEFAULTS, **m}
        r.setdefault("display_name", r["model_id"])
        r["inference_params"] = {str(k): str(v) for k, v in (r["inference_params"] or {}).items()}
        rows.append((r["model_id"], r["display_name"], r["backend"], int(r["max_new_tokens"]),
                     r["inference_params"], float(r["cost_per_1k_input_tokens"]),
                     float(r["cost_per_1k_output_tokens"])))
    return spark.createDataFrame(rows, MODELS_SCHEMA)


def prompts_frame(spark: SparkSession, prompts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(prompts.items()), PROMPTS_SCHEMA)


def conditions_frame(models: DataFrame, prompt_ids: Sequence[str] | None,
                     prompts: DataFrame) -> DataFrame:
    """S7 + J10: model x prompt conditions; all prompts when ``prompt_ids`` is None; an
    unknown prompt id is an error (anti-join against the prompt table)."""
    spark = models.sparkSession
    if prompt_ids is None:
        wanted = prompts.select("prompt_id")
    else:
        wanted = spark.createDataFrame([(p,) for p in prompt_ids], "prompt_id string")
        unknown = [r.prompt_id for r in wanted.join(prompts, "prompt_id", "left_anti").collect()]
        if unknown:
            raise ValueError(f"unknown prompt ids: {sorted(unknown)}")
    ids = [r.prompt_id for r in wanted.collect()]   # the prompt list (condition-sized)
    return models.select("*", F.explode(F.array(*[F.lit(p) for p in ids])).alias("prompt_id"))


def remaining_conditions(conditions: DataFrame, done: DataFrame,
                         keys: Sequence[str] = ("model_name", "prompt_id")) -> DataFrame:
    """Conditions not yet present in the results already written (resume)."""
    return conditions.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fixture_models(spark: SparkSession) -> DataFrame:
    """The models of the fixture derivation, priced per 1K tokens."""
    from scorebook.sources.fixtures import FIXTURE_MODELS
    return models_frame(spark, [
        {"model_id": mid, "display_name": name, "backend": backend,
         "cost_per_1k_input_tokens": rin / 1e6, "cost_per_1k_output_tokens": rout / 1e6}
        for (_, name, mid, backend, rin, rout) in FIXTURE_MODELS])
