"""DuckDB SQL for the registered queries (the correctness oracle).

Each statement re-derives its input from the registered driver tables (``events``,
``documents``) and computes the operator with plain SQL, written independently of the
Spark plans (single windows instead of bucketed ones, self-joins instead of bitmask
Gram matrices, ...).  Label-dependent parts are expanded from the label list.
"""

from __future__ import annotations

from scorebook.config import DEFAULT_LABELS, NONE_LABEL
from scorebook.sources.fixtures import EVAL_RESULTS_SQL, RAW_OUTPUTS_SQL

LABELS = DEFAULT_LABELS
K = len(LABELS)
C = "model_name, prompt_id"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rounded(inner: str, cols: list[str], digits: int = 9) -> str:
    """Round float columns whose value depends on floating summation order."""
    rep = ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) _r"


ER = f"er AS ({EVAL_RESULTS_SQL})"
RO = f"ro AS ({RAW_OUTPUTS_SQL})"

CELLS = f"""cells AS (
  SELECT {C}, true_label, coalesce(predicted_label, '{NONE_LABEL}') AS predicted_label,
         count(*) AS n
  FROM er WHERE model_name IS NOT NULL AND prompt_id IS NOT NULL
  GROUP BY {C}, true_label, coalesce(predicted_label, '{NONE_LABEL}'))"""


def _counts_cte() -> str:
    lab = ", ".join(q(x) for x in LABELS)
    parts = [
        "CAST(sum(n) AS BIGINT) AS n_total",
        f"CAST(sum(CASE WHEN predicted_label <> '{NONE_LABEL}' THEN n ELSE 0 END) AS BIGINT) AS n_parsed",
        "CAST(sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) AS BIGINT) AS n_correct",
        f"CAST(sum(CASE WHEN true_label IN ({lab}) AND predicted_label IN ({lab}) THEN n ELSE 0 END) AS BIGINT) AS n_matrix",
    ]
    for i, x in enumerate(LABELS):
        parts += [
            f"CAST(sum(CASE WHEN true_label = {q(x)} AND predicted_label = {q(x)} THEN n ELSE 0 END) AS BIGINT) AS tp_{i}",
            f"CAST(sum(CASE WHEN true_label = {q(x)} THEN n ELSE 0 END) AS BIGINT) AS row_{i}",
            f"CAST(sum(CASE WHEN predicted_label = {q(x)} THEN n ELSE 0 END) AS BIGINT) AS col_{i}",
            f"CAST(sum(CASE WHEN true_label = {q(x)} AND predicted_label IN ({lab}) THEN n ELSE 0 END) AS BIGINT) AS rowm_{i}",
            f"CAST(sum(CASE WHEN predicted_label = {q(x)} AND true_label IN ({lab}) THEN n ELSE 0 END) AS BIGINT) AS colm_{i}",
        ]
    return f"cnt AS (SELECT {C}, " + ",\n    ".join(parts) + f" FROM cells GROUP BY {C})"


CHANCE = f"""chance AS (
  SELECT {C}, sum(CAST(r AS HUGEINT) * CAST(c AS HUGEINT)) AS s_chance FROM (
    SELECT {C}, v, sum(r) AS r, sum(c) AS c FROM (
      SELECT {C}, true_label AS v, n AS r, 0 AS c FROM cells
      UNION ALL
      SELECT {C}, predicted_label AS v, 0 AS r, n AS c FROM cells) u
    GROUP BY {C}, v) m
  GROUP BY {C})"""


def _div(num: str, den: str, default: str = "0.0") -> str:
    return f"(CASE WHEN ({den}) = 0 THEN CAST({default} AS DOUBLE) ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def _f1(i: int) -> str:
    return _div(f"2 * tp_{i}", f"row_{i} + col_{i}")


def _macro_f1() -> str:
    return "(" + " + ".join(_f1(i) for i in range(K)) + f") / CAST({K} AS DOUBLE)"


KAPPA = ("(CASE WHEN CAST(n_total AS HUGEINT) * n_total - s_chance = 0 THEN CAST(NULL AS DOUBLE) "
         "ELSE CAST(CAST(n_correct AS HUGEINT) * n_total - s_chance AS DOUBLE) / "
         "CAST(CAST(n_total AS HUGEINT) * n_total - s_chance AS DOUBLE) END)")

# complete-probability rows with the truth as a 0-based index
PROBS = f"""pr AS (
  SELECT {C}, true_label,
    {", ".join(f'"prob_{x}" AS p{i}' for i, x in enumerate(LABELS))},
    CASE true_label {" ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(LABELS))} END AS true_idx
  FROM er
  WHERE model_name IS NOT NULL AND prompt_id IS NOT NULL AND true_label IS NOT NULL
    AND {" AND ".join(f'"prob_{x}" IS NOT NULL' for x in LABELS)})"""

AUC = f"""ties AS (
  SELECT {C}, k, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM (
    {" UNION ALL ".join(f"SELECT {C}, {i} AS k, p{i} AS score, CASE WHEN true_idx = {i} THEN 1 ELSE 0 END AS pos FROM pr" for i in range(K))}
  ) x GROUP BY {C}, k, score),
below AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {C}, k ORDER BY score
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM ties),
auc_k AS (
  SELECT {C}, k,
    CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN CAST(NULL AS DOUBLE)
         ELSE CAST(sum(CAST(pos AS HUGEINT) * (2 * nb + neg)) AS DOUBLE)
              / CAST(2 * CAST(sum(pos) AS HUGEINT) * sum(neg) AS DOUBLE) END AS auc,
    CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
  FROM below GROUP BY {C}, k),
auc AS (
  SELECT {C}, ({" + ".join(f"max(CASE WHEN k = {i} THEN auc END)" for i in range(K))}) / CAST({K} AS DOUBLE) AS roc_auc
  FROM auc_k GROUP BY {C})"""


def metrics_sql() -> str:
    return f"""WITH {ER}, {CELLS}, {_counts_cte()}, {CHANCE}, {PROBS}, {AUC}
SELECT cnt.model_name, cnt.prompt_id, n_total, n_parsed,
  {_div("n_parsed", "n_total")} AS parse_rate,
  {_div("n_correct", "n_total")} AS accuracy,
  {_macro_f1()} AS macro_f1,
  {KAPPA} AS kappa,
  auc.roc_auc
FROM cnt JOIN chance USING ({C}) LEFT JOIN auc USING ({C})"""


def per_class_sql() -> str:
    rows = []
    for i, x in enumerate(LABELS):
        fp, fn = f"(colm_{i} - tp_{i})", f"(rowm_{i} - tp_{i})"
        tn = f"(n_matrix - tp_{i} - {fn} - {fp})"
        rows.append(f"""SELECT {C}, {q(x)} AS class, {_f1(i)} AS f1,
  {_div(f"tp_{i}", f"rowm_{i}")} AS sensitivity,
  {_div(tn, f"{tn} + {fp}")} AS specificity,
  {_div(f"tp_{i}", f"row_{i}")} AS recall_all FROM cnt""")
    return f"WITH {ER}, {CELLS}, {_counts_cte()}\n" + "\nUNION ALL\n".join(rows)


def confusion_cells_sql() -> str:
    vals = ", ".join(f"({q(t)}, {q(p)})" for t in LABELS for p in LABELS)
    return f"""WITH {ER}, {CELLS},
conds AS (SELECT DISTINCT {C} FROM cells),
grid AS (SELECT * FROM conds CROSS JOIN (VALUES {vals}) g(true_label, predicted_label))
SELECT g.model_name, g.prompt_id, g.true_label, g.predicted_label,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cells c USING ({C}, true_label, predicted_label)"""


def class_counts_sql() -> str:
    vals = ", ".join(f"({q(x)})" for x in LABELS)
    return f"""WITH {ER},
one AS (SELECT * FROM er WHERE model_name = (SELECT min(model_name) FROM er)
        AND prompt_id = (SELECT min(prompt_id) FROM er WHERE model_name = (SELECT min(model_name) FROM er)))
SELECT l.label, CAST(count(one.true_label) AS BIGINT) AS n
FROM (VALUES {vals}) l(label) LEFT JOIN one ON one.true_label = l.label GROUP BY l.label"""


# --- label parser (RE2 regexes; same character classes as the Spark parser) ---------

def _parser_sql_parts():
    from scorebook.config import LabelSpec
    from scorebook.functions import labels as P
    spec = LabelSpec()
    table = P.alias_table(spec)

    def lookup(key: str) -> str:
        return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"

    def strip(x: str) -> str:
        return f"regexp_replace({x}, {q(P.STRIP_RE)}, '', 'g')"

    exact = "CASE lower(s) " + " ".join(
        f"WHEN {q(x.lower())} THEN {q(x)}" for x in spec.labels) + " END"
    json_keys = ", ".join(
        lookup("lower(" + strip(f"json_extract_string(js, {q(chr(36) + '.' + chr(34) + k + chr(34))})") + ")")
        for k in spec.json_keys)
    alias = "CASE " + " ".join(
        f"WHEN regexp_matches(s, {q(P.whole_words_re([x.lower(), *spec.aliases[x]]))}, 'i') THEN {q(x)}"
        for x in spec.labels) + " END"
    diag = f"regexp_extract(s, {q(P.diagnosis_re(False))}, 1, 'i')"
    return lookup, strip, exact, json_keys, alias, diag


def parse_labels_sql() -> str:
    from scorebook.functions import labels as P
    lookup, strip, exact, json_keys, alias, diag = _parser_sql_parts()
    return f"""WITH {RO},
st AS (SELECT answer_id, tmpl,
         CASE WHEN raw_output IS NULL OR raw_output = '' THEN NULL ELSE {strip('raw_output')} END AS s
       FROM ro),
br AS (SELECT answer_id, tmpl, s, {exact} AS b1, {diag} AS cap,
              regexp_extract(s, {q(P.JSON_RE)}, 0) AS js
       FROM st),
lab AS (SELECT answer_id, tmpl,
  {exact} AS b1,
  CASE WHEN cap <> '' THEN {lookup('lower(' + strip('cap') + ')')} END AS b2,
  CASE WHEN js <> '' AND json_valid(js) THEN coalesce({json_keys}) END AS b3,
  {alias} AS b4
  FROM br)
SELECT answer_id, tmpl, coalesce(b1, b2, b3, b4) AS predicted_label,
       coalesce(b1, b2, b3, b4) IS NOT NULL AS parse_success,
       CASE WHEN b1 IS NOT NULL THEN 1 WHEN b2 IS NOT NULL THEN 2 WHEN b3 IS NOT NULL THEN 3
            WHEN b4 IS NOT NULL THEN 4 ELSE 0 END AS parse_branch
FROM lab"""


# --- pairwise McNemar: self-join on sample id ------------------------------------------

def _pairs_cte() -> str:
    return f"""ok AS (
  SELECT {C}, model_name || ' / ' || prompt_id AS cond, sample_id,
         coalesce(coalesce(predicted_label, '{NONE_LABEL}') = true_label, false) AS ok
  FROM er WHERE model_name IS NOT NULL AND prompt_id IS NOT NULL AND sample_id IS NOT NULL),
pc AS (
  SELECT x.cond AS condition_a, y.cond AS condition_b,
         x.model_name AS ma, x.prompt_id AS pa, y.model_name AS mb, y.prompt_id AS pb,
         CAST(count(*) AS BIGINT) AS n_shared,
         CAST(sum(CASE WHEN x.ok AND NOT y.ok THEN 1 ELSE 0 END) AS BIGINT) AS b_count,
         CAST(sum(CASE WHEN NOT x.ok AND y.ok THEN 1 ELSE 0 END) AS BIGINT) AS c_count
  FROM ok x JOIN ok y ON x.sample_id = y.sample_id
   AND (x.model_name < y.model_name OR (x.model_name = y.model_name AND x.prompt_id < y.prompt_id))
  GROUP BY 1, 2, 3, 4, 5, 6),
pi AS (
  SELECT *, CAST(row_number() OVER (ORDER BY ma, pa, mb, pb) - 1 AS INT) AS pair_idx,
    CASE WHEN b_count + c_count = 0 THEN CAST(0.0 AS DOUBLE)
         ELSE CAST((abs(b_count - c_count) - 1) * (abs(b_count - c_count) - 1) AS DOUBLE)
              / CAST(b_count + c_count AS DOUBLE) END AS chi2
  FROM pc)"""


def mcnemar_counts_sql() -> str:
    return f"""WITH {ER}, {_pairs_cte()}
SELECT condition_a, condition_b, n_shared, b_count, c_count, chi2, pair_idx FROM pi"""


def mcnemar_sql() -> str:
    from scorebook.functions.special import chi2_sf_1df_sql
    inner = f"""WITH {ER}, {_pairs_cte()},
pv AS (SELECT *, CASE WHEN b_count + c_count = 0 THEN CAST(1.0 AS DOUBLE)
                      ELSE {chi2_sf_1df_sql('chi2')} END AS p_raw FROM pi),
rk AS (SELECT *, count(*) OVER () AS m,
              row_number() OVER (ORDER BY p_raw, pair_idx) AS rnk FROM pv),
bh AS (SELECT *,
  least(min(p_raw * m / rnk) OVER (ORDER BY p_raw DESC, pair_idx DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS p_bh,
  least(min(p_raw * m / (pair_idx + 1)) OVER (ORDER BY p_raw DESC, pair_idx DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS p_bh_ref
  FROM rk)
SELECT condition_a, condition_b, n_shared, b_count, c_count, chi2, p_raw, p_bh, p_bh_ref,
       p_bh < 0.05 AS significant_05, p_bh < 0.01 AS significant_01, pair_idx FROM bh"""
    return rounded(inner, ["p_raw", "p_bh", "p_bh_ref"])


# --- cost, reports, calibration, figure tables ----------------------------------------

NOTNULL = "model_name IS NOT NULL AND prompt_id IS NOT NULL"


def pct_sql(num: str, den: str) -> str:
    t = f"(CASE WHEN ({den}) = 0 THEN 0 ELSE (CAST({num} AS BIGINT) * 2000 + ({den})) // (CAST({den} AS BIGINT) * 2) END)"
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%')"


def cost_summary_sql() -> str:
    return f"""WITH {ER}
SELECT {C}, CAST(count(cost_nano) AS BIGINT) AS n_calls,
  CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS total_input_tokens,
  CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS total_output_tokens,
  CAST(sum(cost_nano) AS DOUBLE) / 1e9 AS total_cost_usd,
  (CAST(sum(cost_nano) AS DOUBLE) / 1e9) / count(cost_nano) AS avg_cost_per_sample_usd
FROM er WHERE {NOTNULL} AND coalesce(cost_nano > 0, false) GROUP BY {C}"""


def total_cost_sql() -> str:
    return f"""WITH {ER}
SELECT CAST(coalesce(sum(cost_nano), 0) AS DOUBLE) / 1e9 AS total_cost_usd,
       CAST(count(*) AS BIGINT) AS n_calls
FROM er WHERE coalesce(cost_nano > 0, false)"""


def per_call_cost_sql() -> str:
    from scorebook.sources.fixtures import FIXTURE_MODELS
    vals = ", ".join(f"({q(mid)}, {rin}, {rout})" for (_, _, mid, _, rin, rout) in FIXTURE_MODELS)
    return f"""WITH {ER}
SELECT er.sample_id, er.model_name, er.prompt_id,
  coalesce(er.input_tokens, 0) * coalesce(m.nin, 0) + coalesce(er.output_tokens, 0) * coalesce(m.nout, 0) AS cost_nano,
  CAST(coalesce(er.input_tokens, 0) * coalesce(m.nin, 0) + coalesce(er.output_tokens, 0) * coalesce(m.nout, 0) AS DOUBLE) / 1e9 AS cost_usd
FROM er LEFT JOIN (VALUES {vals}) m(model_id, nin, nout) ON er.model_id = m.model_id"""


def parse_rate_sql() -> str:
    return f"""WITH {ER}
SELECT {C}, CAST(sum(CAST(parse_success AS BIGINT)) AS BIGINT) AS n_parsed,
  CAST(count(*) AS BIGINT) AS n_total,
  CAST(sum(CAST(parse_success AS BIGINT)) AS DOUBLE) / count(*) AS parse_rate,
  {pct_sql('sum(CAST(parse_success AS BIGINT))', 'count(*)')} AS parse_rate_text
FROM er WHERE {NOTNULL} GROUP BY {C}"""


def parse_failures_sql() -> str:
    return f"""WITH {ER}
SELECT {C}, CAST(count_if(NOT parse_success) AS BIGINT) AS n_failed,
  CAST(count(*) AS BIGINT) AS n_total,
  count_if(NOT parse_success) * 100.0 / count(*) AS pct_failed
FROM er WHERE {NOTNULL} GROUP BY {C}"""


def class_counts_sql() -> str:
    vals = ", ".join(f"({q(x)}, {i})" for i, x in enumerate(LABELS))
    return f"""WITH {ER},
s AS (SELECT DISTINCT sample_id, true_label FROM er),
c AS (SELECT true_label AS label, count(*) AS n FROM s GROUP BY true_label)
SELECT g.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n, g.label_order
FROM (VALUES {vals}) g(label, label_order) LEFT JOIN c USING (label)"""


def distinct_sql(col: str) -> str:
    return f"WITH {ER} SELECT DISTINCT {col} FROM er WHERE {col} IS NOT NULL"


def workload_size_sql() -> str:
    return f"""WITH {ER}
SELECT n_samples, n_conditions, n_samples * n_conditions AS n_evaluations FROM
 (SELECT CAST(count(*) AS BIGINT) AS n_samples FROM events) a,
 (SELECT CAST(count(*) AS BIGINT) AS n_conditions FROM (SELECT DISTINCT {C} FROM er) d) b"""


def _metrics_body() -> str:
    return f"""{ER}, {CELLS}, {_counts_cte()}, {CHANCE}, {PROBS}, {AUC},
met AS (
SELECT cnt.model_name, cnt.prompt_id, n_total, n_parsed,
  {_div("n_parsed", "n_total")} AS parse_rate,
  {_div("n_correct", "n_total")} AS accuracy,
  {_macro_f1()} AS macro_f1,
  {KAPPA} AS kappa,
  auc.roc_auc
FROM cnt JOIN chance USING ({C}) LEFT JOIN auc USING ({C}))"""


def _edges(n_bins: int = 10):
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _bin_sql(conf: str, n_bins: int = 10) -> str:
    e = _edges(n_bins)
    parts = [f"WHEN isnan({conf}) OR {conf} < CAST('{e[0]!r}' AS DOUBLE) THEN NULL"]
    for b in range(n_bins - 1):
        parts.append(f"WHEN {conf} < CAST('{e[b + 1]!r}' AS DOUBLE) THEN {b}")
    return "CASE " + " ".join(parts) + f" ELSE {n_bins - 1} END"


def _calib_body(n_bins: int = 10) -> str:
    conf = "greatest(" + ", ".join(f"p{i}" for i in range(K)) + ")"
    argmax = "CASE " + " ".join(f"WHEN p{i} = conf THEN {i}" for i in range(K)) + " END"
    sq = " + ".join(f"(p{i} - CASE WHEN true_idx = {i} THEN 1.0 ELSE 0.0 END) * (p{i} - CASE WHEN true_idx = {i} THEN 1.0 ELSE 0.0 END)" for i in range(K))
    e = _edges(n_bins)
    mids = ", ".join(f"({b}, CAST('{(e[b] + e[b + 1]) / 2!r}' AS DOUBLE))" for b in range(n_bins))
    return f"""cf AS (SELECT *, {conf} AS conf FROM pr),
bn AS (SELECT {C}, conf, CASE WHEN ({argmax}) = true_idx THEN 1 ELSE 0 END AS correct,
              {_bin_sql('conf', n_bins)} AS bin FROM cf),
st AS (SELECT {C}, bin, count(*) AS cnt, sum(conf) AS sum_conf, sum(correct) AS n_correct
       FROM bn WHERE bin IS NOT NULL GROUP BY {C}, bin),
br AS (SELECT {C}, sum({sq}) / (count(*) * {K}) AS brier_score,
              CAST(count(*) AS BIGINT) AS n_calibration_samples FROM pr GROUP BY {C}),
rel AS (SELECT br.model_name, br.prompt_id, g.bin, g.bin_mid,
          CASE WHEN coalesce(st.cnt, 0) = 0 THEN 0.0 ELSE CAST(st.n_correct AS DOUBLE) / st.cnt END AS frac_correct,
          CAST(coalesce(st.cnt, 0) AS BIGINT) AS count,
          CASE WHEN coalesce(st.cnt, 0) = 0 THEN NULL ELSE st.sum_conf / st.cnt END AS avg_conf
        FROM br CROSS JOIN (VALUES {mids}) g(bin, bin_mid)
        LEFT JOIN st ON st.model_name = br.model_name AND st.prompt_id = br.prompt_id AND st.bin = g.bin),
em AS (SELECT rel.model_name, rel.prompt_id,
         sum(abs(avg_conf - frac_correct) * count / n_calibration_samples) AS ece,
         max(abs(avg_conf - frac_correct)) AS mce
       FROM rel JOIN br USING ({C}) WHERE count > 0 GROUP BY rel.model_name, rel.prompt_id),
cal AS (SELECT br.model_name, br.prompt_id, coalesce(em.ece, 0.0) AS ece, coalesce(em.mce, 0.0) AS mce,
          brier_score, auc.roc_auc, n_calibration_samples
        FROM br LEFT JOIN em USING ({C}) LEFT JOIN auc USING ({C}))"""


def calibration_sql() -> str:
    return rounded(f"WITH {ER}, {PROBS}, {AUC}, {_calib_body()} SELECT * FROM cal",
                   ["ece", "mce", "brier_score"])


def reliability_sql() -> str:
    return f"""WITH {ER}, {PROBS}, {AUC}, {_calib_body()}
SELECT model_name, prompt_id, CAST(bin AS INT) AS bin, bin_mid, frac_correct, count FROM rel"""


def auc_per_class_sql() -> str:
    cls = "CASE k " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(LABELS)) + " END"
    return f"""WITH {ER}, {PROBS}, {AUC}
SELECT {C}, {cls} AS class, auc, n_pos, n_neg FROM auc_k"""


def table1_join_sql() -> str:
    inner = f"""WITH {_metrics_body()}, {_calib_body()}
SELECT met.*, cal.ece, cal.mce, cal.brier_score FROM met LEFT JOIN cal USING ({C})"""
    return rounded(inner, ["ece", "mce", "brier_score"])


def best_prompt_sql() -> str:
    return f"""WITH {_metrics_body()}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_name
  ORDER BY macro_f1 DESC NULLS LAST, prompt_id ASC) AS rn FROM met) t WHERE rn = 1"""


def table2_semi_sql() -> str:
    return f"""WITH {_metrics_body()},
best AS (SELECT model_name, prompt_id FROM (SELECT *, row_number() OVER (PARTITION BY model_name
  ORDER BY macro_f1 DESC NULLS LAST, prompt_id ASC) AS rn FROM met) t WHERE rn = 1),
pcm AS ({per_class_body()})
SELECT * FROM pcm WHERE (model_name, prompt_id) IN (SELECT (model_name, prompt_id) FROM best)"""


def per_class_body() -> str:
    rows = []
    for i, x in enumerate(LABELS):
        fp, fn = f"(colm_{i} - tp_{i})", f"(rowm_{i} - tp_{i})"
        tn = f"(n_matrix - tp_{i} - {fn} - {fp})"
        rows.append(f"""SELECT {C}, {q(x)} AS class, {_f1(i)} AS f1,
  {_div(f"tp_{i}", f"rowm_{i}")} AS sensitivity,
  {_div(tn, f"{tn} + {fp}")} AS specificity,
  {_div(f"tp_{i}", f"row_{i}")} AS recall_all FROM cnt""")
    return "\nUNION ALL\n".join(rows)


def best_condition_sql() -> str:
    return f"""WITH {_metrics_body()}
SELECT * FROM met ORDER BY macro_f1 DESC NULLS LAST, model_name, prompt_id LIMIT 1"""


def significant_pairs_sql() -> str:
    inner = mcnemar_sql()
    return f"""SELECT CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(count_if(significant_05) AS BIGINT) AS n_significant_05,
  CAST(count_if(significant_01) AS BIGINT) AS n_significant_01 FROM ({inner}) t"""


def row_normalised_sql() -> str:
    body = confusion_cells_sql()
    return f"""SELECT * EXCLUDE (rs), CASE WHEN rs = 0 THEN 0.0 ELSE CAST(n AS DOUBLE) / rs END AS share,
  {pct_sql('n', 'rs')} || chr(10) || '(' || CAST(n AS VARCHAR) || ')' AS text
FROM (SELECT *, sum(n) OVER (PARTITION BY model_name, prompt_id, true_label) AS rs FROM ({body}) c) t"""


def _short_sql(x: str, n: int = 20) -> str:
    last = f"string_split({x}, '/')[-1]"
    return f"(CASE WHEN length({last}) > {n} THEN left({last}, {n}) || '…' ELSE {last} END)"


def condition_names_sql() -> str:
    return f"""WITH {ER}
SELECT DISTINCT model_name, prompt_id, model_name || ' / ' || prompt_id AS condition,
  {_short_sql('model_name')} AS short_model,
  {_short_sql('model_name')} || chr(10) || prompt_id AS two_line_label,
  replace(replace(model_name, '/', '-'), ' ', '_') || '_' || prompt_id AS file_stem
FROM er WHERE {NOTNULL}"""


def heat_pivot_sql(prompt: str | None = None) -> str:
    only = f"WHERE prompt_id = {q(prompt)}" if prompt else ""
    cols = ", ".join(f"avg(CASE WHEN class = {q(x)} THEN f1 END) AS \"{x}\"" for x in LABELS)
    return f"""WITH {ER}, {CELLS}, {_counts_cte()}, pcm AS ({per_class_body()})
SELECT {C}, {_short_sql('model_name')} || ' / ' || {_short_sql('prompt_id')} AS condition, {cols}
FROM pcm {only} GROUP BY {C}"""


def bar_grid_sql() -> str:
    return f"""WITH {_metrics_body()},
g AS (SELECT * FROM (SELECT DISTINCT model_name FROM met) a, (SELECT DISTINCT prompt_id FROM met) b)
SELECT g.model_name, g.prompt_id, coalesce(met.macro_f1, 0.0) AS value,
  CASE WHEN met.macro_f1 IS NULL THEN CAST(0.0 AS DOUBLE) END AS err_low,
  CASE WHEN met.macro_f1 IS NULL THEN CAST(0.0 AS DOUBLE) END AS err_high
FROM g LEFT JOIN met USING ({C})"""


def ci_table_sql() -> str:
    return f"""WITH {_metrics_body()}
SELECT {C}, macro_f1 AS macro_f1_point, CAST(NULL AS DOUBLE) AS macro_f1_ci_lower,
  CAST(NULL AS DOUBLE) AS macro_f1_ci_upper,
  {_short_sql('model_name')} || ' / ' || {_short_sql('prompt_id')} AS label,
  CAST(row_number() OVER (ORDER BY macro_f1 ASC NULLS FIRST, model_name, prompt_id) - 1 AS INT) AS position
FROM met"""


def cost_grid_sql() -> str:
    return f"""WITH cs AS ({cost_summary_sql()}),
g AS (SELECT * FROM (SELECT DISTINCT model_name FROM cs) a, (SELECT DISTINCT prompt_id FROM cs) b)
SELECT g.model_name, g.prompt_id, coalesce(cs.total_cost_usd, 0.0) AS total_cost_usd
FROM g LEFT JOIN cs USING ({C})"""


# --- ROC curves (one curve per model, prompts pooled) ---------------------------------

def _roc_points_body() -> str:
    return f"""rt AS (
  SELECT model_name, k, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM (
    {" UNION ALL ".join(f"SELECT model_name, {i} AS k, p{i} AS score, CASE WHEN true_idx = {i} THEN 1 ELSE 0 END AS pos FROM pr" for i in range(K))}
  ) x GROUP BY model_name, k, score),
rc AS (SELECT *,
  coalesce(sum(pos) OVER (PARTITION BY model_name, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
  coalesce(sum(neg) OVER (PARTITION BY model_name, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM rt),
rtot AS (SELECT model_name, k, sum(pos) AS np, sum(neg) AS nn FROM rt GROUP BY model_name, k
         HAVING sum(pos) > 0 AND sum(neg) > 0),
pts AS (
  SELECT model_name, k, score AS threshold, CAST(nn - nb AS DOUBLE) / nn AS fpr,
         CAST(np - pb AS DOUBLE) / np AS tpr FROM rc JOIN rtot USING (model_name, k)
  UNION ALL
  SELECT model_name, k, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM rtot)"""


def roc_points_sql() -> str:
    cls = "CASE k " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(LABELS)) + " END"
    return f"""WITH {ER}, {PROBS}, {_roc_points_body()}
SELECT model_name, {cls} AS class, CAST(k AS INT) AS k, threshold, fpr, tpr FROM pts"""


def _roc_grid_body(grid_points: int = 200) -> str:
    step = 1.0 / (grid_points - 1)
    xg = f"(CASE WHEN g = {grid_points - 1} THEN 1.0 ELSE CAST(g AS DOUBLE) * CAST('{step!r}' AS DOUBLE) END)"
    mean = "(" + " + ".join(f"max(CASE WHEN k = {i} THEN tpr END)" for i in range(K)) + f") / CAST({K} AS DOUBLE)"
    return f"""gr AS (SELECT g, {xg} AS x FROM range({grid_points}) r(g)),
keys AS (SELECT DISTINCT model_name, k FROM pts),
lr AS (SELECT keys.model_name, keys.k, gr.g, gr.x,
  (SELECT max(fpr) FROM pts WHERE pts.model_name = keys.model_name AND pts.k = keys.k AND pts.fpr <= gr.x) AS xl,
  (SELECT max(tpr) FROM pts WHERE pts.model_name = keys.model_name AND pts.k = keys.k AND pts.fpr <= gr.x) AS yl,
  (SELECT min(fpr) FROM pts WHERE pts.model_name = keys.model_name AND pts.k = keys.k AND pts.fpr > gr.x) AS xr,
  (SELECT min(tpr) FROM pts WHERE pts.model_name = keys.model_name AND pts.k = keys.k AND pts.fpr > gr.x) AS yr
  FROM keys, gr),
iv AS (SELECT model_name, k, g, x,
  CASE WHEN xr IS NULL THEN yl ELSE (yr - yl) / (xr - xl) * (x - xl) + yl END AS tpr FROM lr),
curve AS (SELECT model_name, CAST(g AS INT) AS g, x AS fpr, {mean} AS mean_tpr
          FROM iv GROUP BY model_name, g, x)"""


def roc_macro_grid_sql() -> str:
    return rounded(f"""WITH {ER}, {PROBS}, {_roc_points_body()}, {_roc_grid_body()}
SELECT * FROM curve""", ["mean_tpr"])


def roc_macro_auc_sql() -> str:
    return rounded(f"""WITH {ER}, {PROBS}, {_roc_points_body()}, {_roc_grid_body()}
SELECT model_name, sum(area) AS macro_auc FROM (
  SELECT model_name, (fpr - lag(fpr) OVER (PARTITION BY model_name ORDER BY g))
       * (mean_tpr + lag(mean_tpr) OVER (PARTITION BY model_name ORDER BY g)) / 2.0 AS area
  FROM curve) a GROUP BY model_name""", ["macro_auc"])


# --- sources, experiment expansion, inference helpers ---------------------------------

SAMPLES = """smp AS (
  SELECT CAST(event_id AS VARCHAR) AS sample_id,
    'images/' || lab || '/' || CAST(event_id AS VARCHAR) || '.png' AS image_path, lab AS label
  FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'ASD' WHEN 'view' THEN 'VSD'
          WHEN 'purchase' THEN 'PDA' ELSE 'Normal' END AS lab FROM events) e)"""


def _fixture_conditions_values(extra: bool = False) -> str:
    from scorebook.sources.fixtures import FIXTURE_MODELS, FIXTURE_PROMPTS
    models = [(name, mid, backend) for (_, name, mid, backend, _, _) in FIXTURE_MODELS]
    if extra:
        models.append(("org/Open-27B", "org/open-27b", "local"))
    return ", ".join(f"({q(n)}, {q(m)}, {q(b)}, {q(p)})"
                     for (n, m, b) in models for (_, p) in FIXTURE_PROMPTS)


def experiment_cross_sql() -> str:
    return f"""WITH {SAMPLES}
SELECT smp.sample_id, smp.label, c.model_name, c.model_id, c.prompt_id
FROM smp CROSS JOIN (VALUES {_fixture_conditions_values()}) c(model_name, model_id, backend, prompt_id)"""


def resume_anti_sql() -> str:
    return f"""WITH {ER}
SELECT c.model_name, c.model_id, c.backend, c.prompt_id
FROM (VALUES {_fixture_conditions_values(extra=True)}) c(model_name, model_id, backend, prompt_id)
WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.model_name = c.model_name AND er.prompt_id = c.prompt_id)"""


def stratified_n_sql(n: int = 25) -> str:
    return f"""WITH {SAMPLES}
SELECT sample_id, image_path, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id), sample_id) AS r FROM smp) t
WHERE r <= {n}"""


def merge_runs_sql() -> str:
    return f"""WITH {ER}
SELECT * FROM er WHERE backend = 'api'
UNION ALL BY NAME
SELECT sample_id, true_label, predicted_label, parse_success, model_name, prompt_id
FROM er WHERE backend = 'local'"""


def request_payload_sql() -> str:
    image = ("json_object('type', 'image_url', 'image_url', json_object('url', "
             "'data:image/jpeg;base64,' || to_base64(encode(text))))")
    text = "json_object('type', 'text', 'text', 'Describe: ' || lang)"
    msg = f"json_object('role', 'user', 'content', json_array({image}, {text}))"
    body = f"json_object('model', 'api-a-2024', 'max_tokens', 512, 'messages', json_array({msg}))"
    return f"""SELECT doc_id, CAST({body} AS VARCHAR) AS payload
FROM documents"""


def media_token_sql() -> str:
    return """SELECT doc_id, CASE WHEN position('<image>' IN text) > 0 THEN text
  ELSE '<image>' || chr(10) || text END AS prompt FROM documents"""


# --- B2 / B3: Poisson bootstrap from md5 weights ---------------------------------------

def _poisson_reps_body(n_boot: int, seed: int = 42) -> str:
    from scorebook.operators.bootstrap import POISSON1_CDF
    key = f"x.sample_id || '|' || CAST(r.replicate AS VARCHAR) || '|' || '{seed}'"
    bits = f"CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT)"
    u = f"(CAST({bits} AS DOUBLE) / CAST('{float(2 ** 52)!r}' AS DOUBLE))"
    w = "CASE " + " ".join(f"WHEN u < CAST('{c!r}' AS DOUBLE) THEN {k}"
                           for k, c in enumerate(POISSON1_CDF)) + f" ELSE {len(POISSON1_CDF)} END"
    f1 = []
    for i, x in enumerate(LABELS):
        tp = f"sum(CASE WHEN true_label = {q(x)} AND pred = {q(x)} THEN w ELSE 0 END)"
        row = f"sum(CASE WHEN true_label = {q(x)} THEN w ELSE 0 END)"
        col = f"sum(CASE WHEN pred = {q(x)} THEN w ELSE 0 END)"
        f1.append(_div(f"2 * {tp}", f"{row} + {col}"))
    macro = "(" + " + ".join(f1) + f") / CAST({K} AS DOUBLE)"
    return f"""x AS (SELECT model_name, prompt_id, CAST(sample_id AS VARCHAR) AS sample_id, true_label,
              coalesce(predicted_label, '{NONE_LABEL}') AS pred FROM er WHERE {NOTNULL}),
draws AS (SELECT sample_id, replicate, {w} AS w FROM (
         SELECT x.sample_id, r.replicate, {u} AS u
         FROM (SELECT DISTINCT sample_id FROM x) x CROSS JOIN range({n_boot}) r(replicate)) z),
wx AS (SELECT model_name, prompt_id, replicate, true_label, pred, sum(w) AS w
       FROM x JOIN (SELECT * FROM draws WHERE w > 0) d USING (sample_id)
       GROUP BY model_name, prompt_id, replicate, true_label, pred),
reps AS (SELECT model_name, prompt_id, CAST(replicate AS INT) AS replicate,
    {macro} AS macro_f1,
    {_div("sum(CASE WHEN true_label = pred THEN w ELSE 0 END)", "sum(w)")} AS accuracy
  FROM wx GROUP BY model_name, prompt_id, replicate)"""


def bootstrap_poisson_sql(n_boot: int) -> str:
    return f"WITH {ER}, {_poisson_reps_body(n_boot)} SELECT * FROM reps"


def percentile_bounds_sql(n_boot: int) -> str:
    inner = f"""WITH {ER}, {_poisson_reps_body(n_boot)}
SELECT model_name, prompt_id,
  quantile_cont(macro_f1, 0.025) AS macro_f1_ci_lower, quantile_cont(macro_f1, 0.975) AS macro_f1_ci_upper,
  quantile_cont(accuracy, 0.025) AS accuracy_ci_lower, quantile_cont(accuracy, 0.975) AS accuracy_ci_upper
FROM reps GROUP BY model_name, prompt_id"""
    return rounded(inner, ["macro_f1_ci_lower", "macro_f1_ci_upper", "accuracy_ci_lower",
                           "accuracy_ci_upper"])


def bootstrap_weighted_sql(n_boot: int, seed: int = 42, in_full: bool = False) -> str:
    """Brier score, ECE and macro AUC of the weighted rows, with one window per class."""
    from scorebook.operators.bootstrap import POISSON1_CDF
    key = f"sample_id || '|' || CAST(r.replicate AS VARCHAR) || '|' || '{seed}'"
    u = f"(CAST(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) AS DOUBLE) / CAST('{float(2 ** 52)!r}' AS DOUBLE))"
    w = "CASE " + " ".join(f"WHEN u < CAST('{c!r}' AS DOUBLE) THEN {k}"
                           for k, c in enumerate(POISSON1_CDF)) + f" ELSE {len(POISSON1_CDF)} END"
    conf = "greatest(" + ", ".join(f"p{i}" for i in range(K)) + ")"
    argmax = "CASE " + " ".join(f"WHEN p{i} = conf THEN {i}" for i in range(K)) + " END"
    sq = " + ".join(f"(p{i} - CASE WHEN true_idx = {i} THEN 1.0 ELSE 0.0 END) * (p{i} - CASE WHEN true_idx = {i} THEN 1.0 ELSE 0.0 END)" for i in range(K))
    each = " UNION ALL ".join(f"SELECT {C}, {i} AS k, replicate, p{i} AS score, w, CASE WHEN true_idx = {i} THEN 1 ELSE 0 END AS pos FROM jw" for i in range(K))
    inner = f"""WITH {ER}, {PROBS.replace("true_label,", "true_label, CAST(sample_id AS VARCHAR) AS sample_id,", 1)},
draws AS (SELECT sample_id, CAST(replicate AS INT) AS replicate, {w} AS w FROM (
  SELECT sample_id, r.replicate, {u} AS u
  FROM (SELECT DISTINCT sample_id FROM pr WHERE sample_id IS NOT NULL) x CROSS JOIN range({n_boot}) r(replicate)) z),
cf AS (SELECT *, {conf} AS conf, {sq} AS sq FROM pr),
jw AS (SELECT cf.*, CASE WHEN ({argmax}) = true_idx THEN 1 ELSE 0 END AS correct, {_bin_sql('conf')} AS bin, replicate, w
  FROM cf JOIN (SELECT * FROM draws WHERE w > 0) d USING (sample_id)),
br AS (SELECT {C}, replicate, sum(w * sq) / (sum(w) * {K}) AS brier_score, sum(w) AS n FROM jw GROUP BY {C}, replicate),
bn AS (SELECT {C}, replicate, sum(w) AS wn, sum(w * conf) AS wc, sum(w * correct) AS wok
  FROM jw WHERE bin IS NOT NULL GROUP BY {C}, replicate, bin),
ec AS (SELECT {C}, replicate, sum(abs(wc / wn - wok / wn) * wn) AS gaps FROM bn GROUP BY {C}, replicate),
ti AS (SELECT {C}, k, replicate, score, sum(w * pos) AS p, sum(w * (1 - pos)) AS q FROM ({each}) e GROUP BY {C}, k, replicate, score),
be AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {C}, k, replicate ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM ti),
ak AS (SELECT {C}, k, replicate, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN
  CAST(sum(CAST(p AS HUGEINT) * (2 * qb + q)) AS DOUBLE) / CAST(2 * CAST(sum(p) AS HUGEINT) * sum(q) AS DOUBLE) END AS auc
  FROM be GROUP BY {C}, k, replicate),
au AS (SELECT {C}, replicate, ({" + ".join(f"max(CASE WHEN k = {i} THEN auc END)" for i in range(K))}) / CAST({K} AS DOUBLE) AS roc_auc
  FROM ak GROUP BY {C}, replicate)
SELECT br.model_name, br.prompt_id, br.replicate, brier_score, coalesce(gaps, 0.0) / n AS ece, roc_auc
FROM br LEFT JOIN ec USING ({C}, replicate) LEFT JOIN au USING ({C}, replicate)"""
    return inner if in_full else rounded(inner, ["brier_score", "ece"])


def bootstrap_cis_weighted_sql(n_boot: int) -> str:
    cols = ", ".join(f"quantile_cont({m}, {s}) AS {m}_ci_{n}" for m in ("brier_score", "ece", "roc_auc")
                     for s, n in ((0.025, "lower"), (0.975, "upper")))
    return rounded(f"SELECT {C}, {cols} FROM ({bootstrap_weighted_sql(n_boot, in_full=True)}) t GROUP BY {C}",
                   [f"{m}_ci_{n}" for m in ("brier_score", "ece", "roc_auc") for n in ("lower", "upper")])


# --- more figure tables and set operations ---------------------------------------------

def all_matrices_sql() -> str:
    return f"""WITH rn AS ({row_normalised_sql()}),
pan AS (SELECT model_name, prompt_id,
          CAST(row_number() OVER (ORDER BY model_name, prompt_id) - 1 AS INT) AS panel
        FROM (SELECT DISTINCT model_name, prompt_id FROM rn) d)
SELECT rn.*, pan.panel FROM rn JOIN pan USING ({C})"""


def best_matrix_sql() -> str:
    return f"""WITH rn AS ({row_normalised_sql()}),
best AS ({best_condition_sql()})
SELECT rn.* FROM rn JOIN best USING ({C})"""


def shared_ids_sql() -> str:
    return f"""WITH {ER}
SELECT sample_id FROM er WHERE model_name = 'Api-A' AND prompt_id = 'ZSD'
INTERSECT
SELECT sample_id FROM er WHERE model_name = 'org/Open-4B' AND prompt_id = 'RCE'"""


def dedupe_sql() -> str:
    return f"""WITH {ER}
SELECT * FROM er WHERE backend = 'local'
UNION ALL
SELECT * REPLACE ('Normal' AS predicted_label, true AS parse_success) FROM er WHERE backend = 'api'"""


# --- D1 end to end: deterministic predictor + parser, in SQL ----------------------------

def _parsed_from(src: str, text_col: str, keep: str) -> str:
    """CTEs that parse ``text_col`` of CTE ``src`` (keeping columns ``keep``); the last
    CTE is ``parsed`` with ``predicted_label`` and ``parse_success``."""
    from scorebook.functions import labels as P
    lookup, strip, exact, json_keys, alias, diag = _parser_sql_parts()
    return f"""pst AS (SELECT {keep}, {text_col},
         CASE WHEN {text_col} IS NULL OR {text_col} = '' THEN NULL ELSE {strip(text_col)} END AS s
       FROM {src}),
pbr AS (SELECT *, {exact} AS b1, {diag} AS cap, regexp_extract(s, {q(P.JSON_RE)}, 0) AS js FROM pst),
plab AS (SELECT *,
  CASE WHEN cap <> '' THEN {lookup('lower(' + strip('cap') + ')')} END AS b2,
  CASE WHEN js <> '' AND json_valid(js) THEN coalesce({json_keys}) END AS b3,
  {alias} AS b4 FROM pbr),
parsed AS (SELECT * EXCLUDE (s, b1, cap, js, b2, b3, b4),
  coalesce(b1, b2, b3, b4) AS predicted_label,
  coalesce(b1, b2, b3, b4) IS NOT NULL AS parse_success FROM plab)"""


def batch_inference_sql() -> str:
    from scorebook.sources.fixtures import FIXTURE_MODELS, FIXTURE_PROMPTS
    conds = ", ".join(f"({q(name)}, {q(mid)}, {q(p)})" for (_, name, mid, _, _, _) in FIXTURE_MODELS
                      for (_, p) in FIXTURE_PROMPTS)
    words = ["atrial", "ventricular", "ductus", "normal"]
    answer = "CASE " + " ".join(f"WHEN contains(lt, {q(w)}) THEN {q('Findings: ' + w + ' pattern.')}"
                                for w in words) + \
        " ELSE 'DIAGNOSIS: ' || (['ASD', 'VSD', 'PDA', 'Normal'])[length(lt) % 4 + 1] END"
    return f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, lower(coalesce(text, '')) AS lt
           FROM documents),
x AS (SELECT d.sample_id, c.model_name, c.model_id, c.prompt_id, d.lt,
             'Classify: ' || c.prompt_id AS prompt
      FROM d CROSS JOIN (VALUES {conds}) c(model_name, model_id, prompt_id)),
a AS (SELECT sample_id, model_name, model_id, prompt_id, {answer} AS raw_output,
             CAST(0.0 AS DOUBLE) AS inference_time_s,
             CAST(length(lt) // 4 + length(prompt) // 4 AS BIGINT) AS input_tokens,
             lt, prompt FROM x),
b AS (SELECT sample_id, model_name, model_id, prompt_id, raw_output, inference_time_s, input_tokens,
             CAST(length(raw_output) // 4 AS BIGINT) AS output_tokens,
             CAST(0.0 AS DOUBLE) AS cost_usd, CAST(NULL AS VARCHAR) AS error FROM a),
{_parsed_from('b', 'raw_output', 'sample_id, model_name, model_id, prompt_id, inference_time_s, input_tokens, output_tokens, cost_usd, error')}
SELECT * FROM parsed"""


def batched_calls_sql(buckets: int, size: int) -> str:
    from scorebook.sources.fixtures import FIXTURE_MODELS, FIXTURE_PROMPTS
    models = ", ".join(f"({q(mid)})" for (_, _, mid, _, _, _) in FIXTURE_MODELS)
    return f"""WITH b AS (SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {buckets} AS bucket,
         count(*) * {len(FIXTURE_PROMPTS)} AS n FROM documents GROUP BY 1)
SELECT model_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum((n + {size} - 1) // {size}) AS BIGINT) AS n_calls
FROM b CROSS JOIN (VALUES {models}) m(model_id) GROUP BY model_id"""


def confusion_arrays_sql() -> str:
    rows = ", ".join("[" + ", ".join(
        f"sum(CASE WHEN true_label = {q(t)} AND predicted_label = {q(p)} THEN n ELSE 0 END)::BIGINT"
        for p in LABELS) + "]" for t in LABELS)
    return f"""WITH cc AS ({confusion_cells_sql()})
SELECT {C}, CAST(to_json([{rows}]) AS VARCHAR) AS matrix FROM cc GROUP BY {C}"""


def check_labels_sql() -> str:
    return """SELECT event_type AS label, coalesce(event_type IN ('click', 'view'), false) AS valid,
  count(*) AS n FROM events GROUP BY 1, 2"""


def round_trip_sql() -> str:
    return f"""WITH {ER}
SELECT * REPLACE (CASE WHEN model_name = 'Api-B' THEN 'PDA' ELSE predicted_label END AS predicted_label) FROM er"""


def live_counts_sql() -> str:
    return rounded(f"""WITH {ER}
SELECT {C}, true_label, coalesce(predicted_label, '{NONE_LABEL}') AS predicted_label, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CAST(parse_success AS BIGINT)) AS BIGINT) AS n_parsed,
  CAST(sum(cost_nano) AS DOUBLE) / 1e9 AS cost_usd
FROM er WHERE {NOTNULL} GROUP BY {C}, true_label, coalesce(predicted_label, '{NONE_LABEL}')""", ["cost_usd"])


def faulty_inference_sql() -> str:
    from scorebook.sources.fixtures import FIXTURE_MODELS, FIXTURE_PROMPTS
    conds = ", ".join(f"({q(mid)}, {q(p)})" for (_, _, mid, _, _, _) in FIXTURE_MODELS for (_, p) in FIXTURE_PROMPTS)
    return f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT sample_id, model_id, prompt_id,
  CASE WHEN n % 5 IN (0, 1) THEN '' ELSE CAST(n AS VARCHAR) || ' bytes' END AS raw_output,
  CAST(CASE WHEN n % 5 IN (0, 1) THEN NULL ELSE n END AS BIGINT) AS input_tokens,
  CASE n % 5 WHEN 0 THEN 'ValueError: not a picture' WHEN 1 THEN 'Max retries exceeded: TimeoutError: busy' END AS error
FROM d CROSS JOIN (VALUES {conds}) c(model_id, prompt_id)"""
