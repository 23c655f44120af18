"""Operator 6, mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern
(the sorted list of their sources); a flow routes each pattern's words to the quotas of its
sources.  One pass over a pattern costs nothing, each further pass costs more than the one
before (convex), so words repeat only where the quotas cannot be met without.  The words that
the flow takes from a pattern become full passes over all its documents plus a seeded part:
documents in the order of a seeded digest until the words are reached; the document at the
edge is taken in part.

Spark does the work on documents (sizes, sums per pattern, running sums).  The driver holds
one row per pattern and per source only: names and sums, never documents.

Running sums are taken per digest bucket: the buckets' sums give each bucket's start, and
only rows of one bucket are ordered together, so a source with a third of all rows is split
over thousands of groups.

Cases: a null text has size 0 and is taken 0 words; a null source is a source of its own and
sorts last; a document of no source is taken 0 words; repeated rows are documents of their own
(equal rows are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorebook.llm.common import staged, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class MixPlan:
    """``share``: words of the mix as a part of all words; ``passes``: most passes over a document."""

    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5
    passes: int = 2
    seed: str = "mix-1"


def source_targets(sizes: dict[str | None, int], plan: MixPlan) -> dict[str | None, float]:
    """Target words per source: weights share the mix, no target above ``passes`` times its
    source's size, the excess shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: plan.weights[i % len(plan.weights)] for i, s in enumerate(names)}
    left, open_, target = plan.share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > plan.passes * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = float(plan.passes * sizes[s])
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return target


def route(patterns: dict[str, tuple[list, int]], quotas: dict, passes: int) -> dict[str, int]:
    """Words taken per pattern by a maximum flow of least convex repetition cost.

    ``patterns``: key -> (sources, words).  Costs of passes rise with their number and are the
    same for all patterns, so the flow of least cost opens the passes one after another and
    each time augments along shortest residual paths (pattern -> source -> ... -> free quota).
    """
    flow = {(p, s): 0 for p, (members, _) in patterns.items() for s in members}
    used = dict.fromkeys(patterns, 0)
    free = dict(quotas)
    users: dict = {}
    for p, (members, _) in patterns.items():
        for s in members:
            users.setdefault(s, []).append(p)

    def augment(p: str, room: int) -> int:
        """Push up to ``room`` words out of ``p``; returns the words pushed."""
        before, queue, end = {p: None}, deque([p]), None
        found = None
        while queue and found is None:
            at = queue.popleft()
            for s in patterns[at][0]:
                key = ("s", s)
                if key in before:
                    continue
                before[key] = at
                if free.get(s, 0) > 0:
                    found = key
                    break
                for other in users[s]:      # words that ``other`` sends here may go elsewhere
                    if other not in before and flow[other, s] > 0:
                        before[other] = key
                        queue.append(other)
        if found is None:
            return 0
        amount, end = min(room, free[found[1]]), found
        node = found
        while before[node] is not None:
            prev = before[node]
            if isinstance(prev, tuple):
                amount = min(amount, flow[node, prev[1]])
            node = prev
        node = end
        free[end[1]] -= amount
        while before[node] is not None:
            prev = before[node]
            if isinstance(prev, tuple):
                flow[node, prev[1]] -= amount
            else:
                flow[prev, node[1]] += amount
            node = prev
        return amount

    for _ in range(passes):
        for p, (members, size) in sorted(patterns.items()):
            room = size if members else 0
            while room > 0 and (pushed := augment(p, room)):
                room -= pushed
                used[p] += pushed
    return used


def mix(docs: DataFrame, sources: Column, size: Column, order: list[Column],
        plan: MixPlan = MixPlan(), carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict, dict]:
    """(table, targets, sizes): the table has ``carry``, ``size``, ``pattern``, ``passes`` (full
    passes) and ``extra`` (words of a further pass in part).

    ``sources``: array column of a document's sources.  ``order``: columns that identify a
    document; their seeded digest orders the selection.  The targets and sizes are per source.
    """
    base = staged(docs.select(
        *carry, size.cast("long").alias("size"),
        F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s"))).alias("pattern"),
        F.md5(F.concat_ws("\x1f", F.lit(plan.seed), *(F.coalesce(c.cast("string"), F.lit("\x00"))
                                                       for c in order))).alias("turn")), "mix")
    sums = {r["pattern"]: (json.loads(r["pattern"]).get("s", []), r["words"], r["n"])
            for r in base.groupBy("pattern").agg(F.sum("size").alias("words"),
                                                 F.count(F.lit(1)).alias("n")).collect()}
    sizes: dict = {}
    for members, words, _ in sums.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, plan)
    taken = route({p: (m, w) for p, (m, w, _) in sums.items()},
                  {s: round(t) for s, t in targets.items()}, plan.passes)
    # one bucket of the seeded order holds about 20,000 documents of a pattern at most
    digits = max(3, math.ceil(math.log(max([1, *(n for _, _, n in sums.values())]) / 20_000, 16)))
    todo = base.sparkSession.createDataFrame(
        [(p, t // w if w else 0, t % w if w else 0) for p, t in taken.items() for w in [sums[p][1]]],
        T.StructType([T.StructField("pattern", T.StringType()), T.StructField("passes", T.LongType()),
                      T.StructField("rest", T.LongType())]))
    base = base.withColumn("bucket", F.substring("turn", 1, digits))
    starts = base.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")).select(
        "pattern", "bucket", (F.sum("words").over(
            Window.partitionBy("pattern").orderBy("bucket")) - F.col("words")).alias("start"))
    starts = starts.join(todo, "pattern")
    within = Window.partitionBy("pattern", "bucket").orderBy("turn", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    rows = base.withColumn("upto", F.sum("size").over(within)).join(starts, ["pattern", "bucket"], "left")
    extra = F.greatest(F.lit(0), F.least(F.col("size"),
                                         F.col("rest") - F.col("start") - F.col("upto") + F.col("size")))
    return rows.select(*carry, "size", "pattern", F.coalesce("passes", F.lit(0)).alias("passes"),
                       F.coalesce(extra, F.lit(0)).cast("long").alias("extra")), targets, sizes


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:
    """One row per document of a table with one source each: size, its source's size and
    target, ``taken`` words (repeats counted)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"),
                       F.col(text_col).alias("t"))
    rows, targets, sizes = mix(slim, F.array("src"), word_count(F.col("t")), [F.col("id")], plan,
                               carry=("id", "src"))
    per_source = rows.sparkSession.createDataFrame(
        [(s, sizes[s], float(t)) for s, t in targets.items()],
        T.StructType([T.StructField("name", T.StringType()), T.StructField("source_size", T.LongType()),
                      T.StructField("target", T.DoubleType())]))
    out = rows.join(per_source, F.col("src").eqNullSafe(F.col("name")), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, columns as they came.

    Whole documents only: the one at the edge is taken if half its words or more are.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    slim = docs.select(whole.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"),
                       word_count(F.col(text_col)).alias("n"))
    rows, _, _ = mix(slim, F.array("src"), F.col("n"), [F.col("id")], plan, carry=("row",))
    copies = F.col("passes") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    return rows.filter(copies > 0).select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))).alias("copy")).select("row.*")


def oracle_sql() -> str:
    """DuckDB SQL of the query (one source a document: the flow splits into its sources)."""
    plan = MixPlan()
    n = len(plan.weights)
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(plan.weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{plan.seed}' || chr(31) || coalesce(doc_id::varchar, chr(0))) AS turn FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} {weight} END AS wt FROM s),
o AS (
  SELECT *, {plan.passes} * source_size / wt AS ratio,
         coalesce(sum({plan.passes} * source_size) OVER r, 0) AS capped,
         sum(wt) OVER () - coalesce(sum(wt) OVER r, 0) AS open_wt,
         {plan.share} * sum(source_size) OVER () AS total
  FROM w WINDOW r AS (ORDER BY {plan.passes} * source_size / wt, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT max((total - capped) / open_wt) FILTER ((total - capped) / open_wt <= ratio) AS lam FROM o),
t AS (SELECT source, source_size, least({plan.passes}.0 * source_size, coalesce(lam, 1e300) * wt)::double AS target FROM o, lam),
q AS (SELECT *, round_even(target, 0)::bigint AS quota FROM t),
x AS (
  SELECT doc_id, size, source_size, target, quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
        + greatest(0, least(size, quota % source_size - upto + size)) END)::bigint AS taken
FROM x"""
