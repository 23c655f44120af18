"""Operator 5, quality rules on hosts [native].

Every document is measured by simple text rules.  Failures are counted per rule and host;
each host's failure rate is shrunk towards the corpus by a beta prior whose two parameters
come from the hosts themselves (method of moments), so a host with three documents is not
judged on three documents alone.  A host whose shrunk rate of any rule is above the limit
is rejected, and the verdict is joined back to its documents.

Cases: a null text counts as empty; a null host is a host of its own; an empty table gives
an empty result; repeated rows count as often as they occur; extra columns do not matter.
A host rate exactly at the limit is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import SPACES, let, staged, unused, words_of

WINDOW = 8


@dataclass(frozen=True)
class HostLimits:
    """Parameters of the host verdict.

    ``limit``: shrunk failure rate above which a host is rejected.
    ``least``, ``most``: range of the prior's weight in documents (a + b).
    ``unknown``: that weight if the hosts' rates do not vary beyond chance or there is one host.
    """

    limit: float = 0.5
    least: float = 1.0
    most: float = 10_000.0
    unknown: float = 10_000.0


def rules(n_words: Column, word_chars: Column, n_symbols: Column, n_lines: Column,
          n_dup_lines: Column, n_repeat_words: Column) -> dict[str, Column]:
    """Rule name -> does the document fail it.  The first two are the base rules."""
    return {
        "short": n_words < 20,
        "repeats": 100 * n_repeat_words > 30 * n_words,
        "symbols": 10 * n_symbols > word_chars,
        "dup_lines": 10 * n_dup_lines > 3 * n_lines,
    }


RULES = ("short", "repeats", "symbols", "dup_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _windows(words: Column) -> Column:
    """64-bit digest of each window of eight words, in order; fewer than eight words: none."""
    def over(digests: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(digests) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(digests, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW,
                  let(F.transform(words, lambda w: F.xxhash64(w)), over)
                  ).otherwise(F.array().cast("array<bigint>"))


def _covered(words: Column) -> Column:
    """Words that lie in a window occurring twice or more (128 bits identify a window)."""
    keyed = let(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("a"),
                                                      F.xxhash64(F.lit(7), w).alias("b"))),
                lambda d: F.transform(
                    F.sequence(F.lit(1), F.size(d) - (WINDOW - 1)),
                    lambda i: F.struct(F.xxhash64(F.slice(d["a"], i, WINDOW)).alias("a"),
                                       F.xxhash64(F.slice(d["b"], i, WINDOW)).alias("b"),
                                       i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))

    def repeated(s: Column) -> Column:
        marked = F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"),
            (same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))).alias("twice")))
        return F.filter(marked, lambda x: x["twice"])

    starts = F.sort_array(let(F.array_sort(keyed), repeated)["i"])
    return F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"),
                                (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])


def measures(text: Column) -> Column:
    """Struct of the measures of one text; the words are split once."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def fields(words: Column) -> Column:
        seen_twice = let(_windows(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        parts = let(lines, lambda ls: F.struct(
            F.size(ls).cast("long").alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", "")))
            .cast("long").alias("n_symbols"),
            parts.alias("lines"),
            F.when(seen_twice, _covered(words)).otherwise(F.lit(0)).cast("long")
            .alias("n_repeat_words"))

    return let(words_of(text), fields)


def quality(text: Column) -> Column:
    """Struct of the measures of one text and of the rules it fails."""
    def fields(m: Column) -> Column:
        vals = {"n_words": m["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"],
                "n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["dup"],
                "n_repeat_words": m["n_repeat_words"]}
        fails = rules(*(vals[k] for k in MEASURES))
        return F.struct(*(v.alias(k) for k, v in vals.items()), *(f.alias(k) for k, f in fails.items()))
    return let(measures(text), fields)


def host_verdicts(judged: DataFrame, host_col: str, limits: HostLimits = HostLimits()) -> DataFrame:
    """One row per host: documents, shrunk rate per rule, ``host_kept``.

    ``judged`` has the host column and ``quality``.  The prior is one row of sums over the
    hosts (two numbers a rule), all that reaches the driver.
    """
    hosts = staged(judged.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(F.col(f"quality.{r}").cast("long")).alias(f"f_{r}") for r in RULES)), "hosts")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"),
        F.avg(1.0 / F.col("n_docs")).alias("inverse"),
        *(F.sum(f"f_{r}").alias(f"sum_{r}") for r in RULES),
        *(F.var_pop(F.col(f"f_{r}") / F.col("n_docs")).alias(f"var_{r}") for r in RULES)).first()
    out = hosts
    for r in RULES:
        mean, weight = beta_prior(sums, r, limits)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + mean * weight) / (F.col("n_docs") + weight))
    worst = F.greatest(*(F.col(f"rate_{r}") for r in RULES))
    return out.withColumn("host_kept", worst <= limits.limit)


def beta_prior(sums, rule: str, limits: HostLimits) -> tuple[float, float]:
    """Mean and weight (a + b) of the prior; the variance within hosts is taken off first."""
    if not sums["docs"]:
        return 0.0, limits.unknown
    mean = sums[f"sum_{rule}"] / sums["docs"]
    between = sums[f"var_{rule}"] - mean * (1 - mean) * sums["inverse"]
    if sums["hosts"] < 2 or between <= 1e-12 or not 0 < mean < 1:
        return mean, limits.unknown
    return mean, min(limits.most, max(limits.least, mean * (1 - mean) / between - 1))


def judge_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                    id_col: str = "doc_id", limits: HostLimits = HostLimits()) -> DataFrame:
    """One row per document: id, measures, ``base_failed``, the host's rates, ``kept``.

    The texts are measured once; only the measures are written to the shared folder.
    """
    judged = staged(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("doc_host"),
                                quality(F.col(text_col)).alias("quality")), "quality")
    hosts = host_verdicts(judged, "doc_host", limits)
    base_failed = F.col("quality.short") | F.col("quality.repeats")
    joined = judged.join(hosts, F.col("doc_host").eqNullSafe(F.col("host")), "left")
    return joined.select(
        F.col("id").alias(id_col), *(F.col(f"quality.{m}").alias(m) for m in MEASURES),
        base_failed.alias("base_failed"), "host_kept",
        F.greatest(*(F.col(f"rate_{r}") for r in RULES)).alias("host_rate"),
        (~base_failed & F.col("host_kept")).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source",
              limits: HostLimits = HostLimits()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came.

    Texts are measured once: the rows that pass the base rules are written to the shared folder
    with the measures of all rows, so no text is shuffled nor measured again.
    """
    box, own = unused(docs, "quality_of_text", "base_failed_text")
    host = f"`{host_col}`"
    measured = docs.withColumn(box, quality(F.col(f"`{text_col}`")))
    # one write: rows that fail lose their other columns, their host and measures still count
    failed = F.col(f"{box}.short") | F.col(f"{box}.repeats")
    rows = staged(measured.withColumn(own, failed).select(
        *((F.col(f"`{c}`") if c.lower() == host_col.lower() else F.when(~F.col(own), F.col(f"`{c}`")).alias(c)) for c in docs.columns),
        box, own), "measured")
    hosts = host_verdicts(rows.select(F.col(host).alias("doc_host"), F.col(box).alias("quality")), "doc_host", limits)
    bad = hosts.filter(~F.col("host_kept")).select("host")
    good = rows.filter(~F.col(own))
    return good.join(bad, good[host].eqNullSafe(bad["host"]), "left_anti").select(
        *(good[f"`{c}`"] for c in docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL of the query: measures, moments prior, verdict."""
    limits = HostLimits()
    ws = r"[^\x20\x09-\x0D]+"
    fails = {"short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words",
             "symbols": "10 * n_symbols > word_chars", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}
    sums = ", ".join(f"sum(({c})::int) AS f_{r}" for r, c in fails.items())
    prior = ", ".join(f"sum(f_{r}) / sum(n_docs) AS mean_{r}, "
                      f"var_pop(f_{r} / n_docs) - (sum(f_{r}) / sum(n_docs)) * (1 - sum(f_{r}) / sum(n_docs)) "
                      f"* avg(1.0 / n_docs) AS between_{r}" for r in RULES)
    weight = ", ".join(
        f"mean_{r}, CASE WHEN hosts < 2 OR between_{r} <= 1e-12 OR mean_{r} <= 0 OR mean_{r} >= 1 "
        f"THEN {limits.unknown} ELSE least({limits.most}, greatest({limits.least}, "
        f"mean_{r} * (1 - mean_{r}) / between_{r} - 1)) END AS w_{r}" for r in RULES)
    worst = "greatest(" + ", ".join(f"(f_{r} + mean_{r} * w_{r}) / (n_docs + w_{r})" for r in RULES) + ")"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{ws}') AS w FROM documents),
l AS (
  SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS ls FROM d),
win AS (
  SELECT k, unnest(range(1, len(w) - 6)) AS i,
         unnest(list_transform(range(1, len(w) - 6), lambda i: list_slice(w, i, i + 7))) AS v
  FROM d WHERE len(w) >= 8),
rep AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, v) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY k),
m AS (
  SELECT d.k, doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN l ON d.k = l.k LEFT JOIN cov ON cov.k = d.k),
h AS (SELECT source, count(*) AS n_docs, {sums} FROM m GROUP BY source),
p AS (SELECT count(*) AS hosts, {prior} FROM h),
q AS (SELECT {weight} FROM p),
v AS (SELECT source, {worst} <= {limits.limit} AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({fails["short"]} OR {fails["repeats"]}) AS base_failed,
       (NOT ({fails["short"]} OR {fails["repeats"]})) AND host_kept AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""
