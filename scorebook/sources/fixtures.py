"""Deterministic results tables derived from the driver tables.

``eval_results``: every ``events`` row becomes one sample evaluated under 12
conditions (3 models x 4 prompts).  ``raw_outputs``: every ``documents`` row and every
``conversations`` turn becomes one model answer: its whole text, followed by one of 16
endings that cover every parser branch.  Both derivations are narrow: the condition
list is a literal array expanded with ``inline``, not a join.  The only shuffle is
``spread``'s round-robin of the input columns.

The SQL texts are the same derivations for DuckDB, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the fixture derivation ---------------------------------------
# (model index, model_name, model_id, backend, nano-USD per input token, per output token)
FIXTURE_MODELS = [
    (0, "org/Open-4B", "org/open-4b", "local", 0, 0),
    (1, "Api-A", "api-a-2024", "api", 2500, 10000),
    (2, "Api-B", "api-b-2024", "api", 3000, 15000),
]
# (prompt index, prompt_id)
FIXTURE_PROMPTS = [(0, "ZSD"), (1, "RCE"), (2, "CoT"), (3, "RAC")]
# event_type -> true label index; label index -> label
FIXTURE_EVENT_CLASS = {"click": 0, "view": 1, "purchase": 2}  # everything else -> 3
FIXTURE_LABELS = ["ASD", "VSD", "PDA", "Normal"]
# -----------------------------------------------------------------------------------


def _label_of(idx: Column) -> Column:
    expr = F.when(idx == 0, F.lit(FIXTURE_LABELS[0]))
    for i, name in enumerate(FIXTURE_LABELS[1:], start=1):
        expr = expr.when(idx == i, F.lit(name))
    return expr


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "\\'") + "'"


def eval_results_from_events(events: DataFrame) -> DataFrame:
    """The 12-condition fact table, written as SQL expressions (a handful of calls
    instead of thousands of Column objects built one by one on the driver)."""
    conds = ", ".join(
        f"named_struct('mi', CAST({mi} AS BIGINT), 'model_name', {_sql_str(name)}, "
        f"'model_id', {_sql_str(mid)}, 'backend', {_sql_str(backend)}, "
        f"'rate_in', CAST({rin} AS BIGINT), 'rate_out', CAST({rout} AS BIGINT), "
        f"'pi', CAST({pi} AS BIGINT), 'prompt_id', {_sql_str(pid)})"
        for (mi, name, mid, backend, rin, rout) in FIXTURE_MODELS
        for (pi, pid) in FIXTURE_PROMPTS)
    label = ("CASE {x} WHEN 0 THEN 'ASD' WHEN 1 THEN 'VSD' WHEN 2 THEN 'PDA' "
             "WHEN 3 THEN 'Normal' END")
    base = events.selectExpr(
        "event_id", "CAST(event_id AS STRING) AS sample_id",
        "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 "
        "ELSE 3 END AS ti",
        f"inline(array({conds}))")
    base = base.selectExpr(
        "*", "(event_id * 7919 + mi * 104729 + pi * 1299709 + (event_id % 13) * (mi * 31 + pi * 7))"
             " % 1000 AS hv")
    base = base.selectExpr(
        "*", "CASE WHEN hv >= 970 THEN CAST(NULL AS INT) WHEN hv < 600 + 40 * mi + 20 * pi THEN ti "
             "ELSE CAST(hv % 4 AS INT) END AS pidx")
    ws = [f"1 + (event_id * {m} + mi * 17 + pi * 5) % 97 + CASE WHEN pidx = {k} THEN 150 ELSE 0 END AS w{k}"
          for k, m in enumerate([93, 124, 155, 186])]
    base = base.selectExpr("*", "200 + event_id % 57 + 40 * pi AS input_tokens",
                           "3 + (event_id % 11) * (1 + 5 * pi) AS output_tokens", *ws)
    probs = ", ".join(f"'prob_{FIXTURE_LABELS[k]}', CAST(w{k} AS DOUBLE) / (w0 + w1 + w2 + w3)"
                      for k in range(4))
    # The derived columns are produced by a one-element ``inline`` so that each is
    # computed once per row: filters written later against them (e.g. dropping rows
    # with a null probability) stay above this point instead of being rewritten into
    # the hash arithmetic many times over, which would defeat whole-stage codegen.
    return base.selectExpr(
        "inline(array(named_struct("
        "'sample_id', sample_id, "
        f"'true_label', {label.format(x='ti')}, "
        f"'predicted_label', {label.format(x='pidx')}, "
        "'parse_success', pidx IS NOT NULL, "
        "'model_name', model_name, 'model_id', model_id, 'backend', backend, "
        "'prompt_id', prompt_id, 'input_tokens', input_tokens, 'output_tokens', output_tokens, "
        "'cost_nano', input_tokens * rate_in + output_tokens * rate_out, "
        f"{probs})))")


def spread(df: DataFrame) -> DataFrame:
    """Deal a narrow input round-robin over the cluster's cores, at every size.

    Part of the fixture only: the test files are one row group each, and the derived
    tables are an order of magnitude wider than what is dealt here."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return eval_results_from_events(spread(events))


# --- fixed values: the 15 answer templates of raw_outputs (template 15 = full text) -
RAW_OUTPUT_TEMPLATES = [
    "VSD",
    "  normal \n",
    "DIAGNOSIS: PDA",
    "Shunt ratio given.\nDiagnosis : Ventricular Septal Defect.",
    '{"label": "ASD", "score": 0.9}',
    'Result {"diagnosis": null, "class": "patent duct"}',
    "Result {'label': 'healthy'}",
    "Findings suggest an interventricular defect.",
    "ASD is excluded; final answer VSD",
    "abnormal study",
    "",
    None,
    "DIAGNOSIS: PDA\nbecause flow is normal",
    "DIAGNOSIS: VSD\nno ASD seen",
    "xNormal_1 Normal2",
]
# -----------------------------------------------------------------------------------


def answers_from_texts(texts: DataFrame) -> DataFrame:
    """(answer_id, n, text) -> model answers: the whole text, followed by one of the answer
    templates on a line of its own (template 15 and the null template: the text alone)."""
    tmpl = (F.col("n") % 16).cast("int")
    expr = None
    for i, t in enumerate(RAW_OUTPUT_TEMPLATES):
        value = F.col("text") if t is None else F.concat(F.col("text"), F.lit("\n" + t))
        expr = F.when(tmpl == i, value) if expr is None else expr.when(tmpl == i, value)
    return texts.select("answer_id", tmpl.alias("tmpl"), expr.otherwise(F.col("text")).alias("raw_output"))


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every conversation turn, whole, as a model answer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("answer_id"), F.col("doc_id").alias("n"), "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("answer_id"),
        (F.col("conv_id") + F.col("turn")).alias("n"), "text")
    return answers_from_texts(spread(docs.unionByName(turns)))


# DuckDB forms of the two derivations (views ``events`` / ``documents`` registered).
EVAL_RESULTS_SQL = """
SELECT sample_id,
    CASE ti WHEN 0 THEN 'ASD' WHEN 1 THEN 'VSD' WHEN 2 THEN 'PDA' ELSE 'Normal' END AS true_label,
    CASE pidx WHEN 0 THEN 'ASD' WHEN 1 THEN 'VSD' WHEN 2 THEN 'PDA' WHEN 3 THEN 'Normal' END AS predicted_label,
    pidx IS NOT NULL AS parse_success,
    model_name, model_id, backend, prompt_id, input_tokens, output_tokens,
    input_tokens*rate_in + output_tokens*rate_out AS cost_nano,
    CAST(w0 AS DOUBLE)/(w0+w1+w2+w3) AS "prob_ASD",
    CAST(w1 AS DOUBLE)/(w0+w1+w2+w3) AS "prob_VSD",
    CAST(w2 AS DOUBLE)/(w0+w1+w2+w3) AS "prob_PDA",
    CAST(w3 AS DOUBLE)/(w0+w1+w2+w3) AS "prob_Normal"
FROM (
  SELECT *,
    1 + (event_id*93  + mi*17 + pi*5) % 97 + CASE WHEN pidx=0 THEN 150 ELSE 0 END AS w0,
    1 + (event_id*124 + mi*17 + pi*5) % 97 + CASE WHEN pidx=1 THEN 150 ELSE 0 END AS w1,
    1 + (event_id*155 + mi*17 + pi*5) % 97 + CASE WHEN pidx=2 THEN 150 ELSE 0 END AS w2,
    1 + (event_id*186 + mi*17 + pi*5) % 97 + CASE WHEN pidx=3 THEN 150 ELSE 0 END AS w3
  FROM (
    SELECT *,
      CASE WHEN hv >= 970 THEN NULL WHEN hv < 600 + 40*mi + 20*pi THEN ti
           ELSE CAST(hv % 4 AS INT) END AS pidx,
      200 + event_id % 57 + 40*pi AS input_tokens,
      3 + (event_id % 11)*(1 + 5*pi) AS output_tokens
    FROM (
      SELECT s.*, m.*, p.*,
        (event_id*7919 + mi*104729 + pi*1299709 + (event_id % 13)*(mi*31+pi*7)) % 1000 AS hv
      FROM (SELECT event_id, CAST(event_id AS VARCHAR(20)) AS sample_id,
              CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS ti
            FROM events) s
      CROSS JOIN (SELECT * FROM (VALUES
          (0,'org/Open-4B','org/open-4b','local',0,0),
          (1,'Api-A','api-a-2024','api',2500,10000),
          (2,'Api-B','api-b-2024','api',3000,15000))
          v(mi, model_name, model_id, backend, rate_in, rate_out)) m
      CROSS JOIN (SELECT * FROM (VALUES (0,'ZSD'),(1,'RCE'),(2,'CoT'),(3,'RAC')) v(pi, prompt_id)) p
    ) h
  ) r
) w
"""

RAW_OUTPUTS_SQL = """
SELECT answer_id, CAST(n % 16 AS INT) AS tmpl,
  CASE n % 16
    WHEN 0  THEN text || chr(10) || 'VSD'
    WHEN 1  THEN text || chr(10) || '  normal ' || chr(10)
    WHEN 2  THEN text || chr(10) || 'DIAGNOSIS: PDA'
    WHEN 3  THEN text || chr(10) || 'Shunt ratio given.' || chr(10) || 'Diagnosis : Ventricular Septal Defect.'
    WHEN 4  THEN text || chr(10) || '{"label": "ASD", "score": 0.9}'
    WHEN 5  THEN text || chr(10) || 'Result {"diagnosis": null, "class": "patent duct"}'
    WHEN 6  THEN text || chr(10) || 'Result {''label'': ''healthy''}'
    WHEN 7  THEN text || chr(10) || 'Findings suggest an interventricular defect.'
    WHEN 8  THEN text || chr(10) || 'ASD is excluded; final answer VSD'
    WHEN 9  THEN text || chr(10) || 'abnormal study'
    WHEN 10 THEN text || chr(10) || ''
    WHEN 12 THEN text || chr(10) || 'DIAGNOSIS: PDA' || chr(10) || 'because flow is normal'
    WHEN 13 THEN text || chr(10) || 'DIAGNOSIS: VSD' || chr(10) || 'no ASD seen'
    WHEN 14 THEN text || chr(10) || 'xNormal_1 Normal2'
    ELSE text END AS raw_output
FROM (SELECT 'd' || CAST(doc_id AS VARCHAR) AS answer_id, doc_id AS n, text FROM documents
      UNION ALL
      SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), conv_id + turn, text FROM conversations) t
"""


# --- fixed values: fixture prompt texts (invented placeholders, one per prompt id) ----
FIXTURE_PROMPT_TEXTS = {
    "ZSD": "Classify the image as ASD, VSD, PDA or Normal.",
    "RCE": "You are an expert reader. Classify the image as ASD, VSD, PDA or Normal.",
    "CoT": "Reason step by step, then answer with DIAGNOSIS: <label>.",
    "RAC": "Answer in JSON with a 'diagnosis' key.",
}
# -----------------------------------------------------------------------------------


def samples_from_events(events: DataFrame) -> DataFrame:
    """Labelled samples (one per event): id, a path-like string and the class label."""
    et = F.col("event_type")
    ti = F.when(et == "click", 0).when(et == "view", 1).when(et == "purchase", 2).otherwise(3)
    label = _label_of(ti)
    return events.select(
        F.col("event_id").cast("string").alias("sample_id"),
        F.concat(F.lit("images/"), label, F.lit("/"), F.col("event_id").cast("string"),
                 F.lit(".png")).alias("image_path"),
        label.alias("label"))


def fixture_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return samples_from_events(spread(events))
