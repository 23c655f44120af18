"""Bootstrap confidence intervals for cell-based metrics.

Resampling n rows with replacement and recomputing a metric that depends only on the
confusion cells is the same, in distribution, as drawing the cell counts from
Multinomial(n, cells / n).  So the bootstrap runs on the cell table (at most
K x (K + 2) rows per condition) instead of the fact table: work is independent of
the number of rows.  Replicates are split into blocks; one ``applyInPandas`` group is
one (condition, block), so large replicate counts spread over the cluster and no
group ever holds more than the cells of one condition.

Random streams are seeded from (seed, condition key, block), so results do not
depend on partitioning or on the order conditions are processed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.config import NONE_LABEL
from scorebook.operators.draws import POISSON1_CDF, poisson_draws

SUPPORTED = ("macro_f1", "accuracy")


def _metric_arrays(counts: np.ndarray, true_idx: np.ndarray, pred_idx: np.ndarray,
                   k: int) -> dict[str, np.ndarray]:
    """counts: (R x cells); true_idx / pred_idx: label index per cell (-1 = outside)."""
    n = counts.sum(axis=1).astype(np.float64)
    same = (true_idx == pred_idx) & (true_idx >= 0)
    correct = counts[:, same].sum(axis=1)
    # cells whose truth is outside the label list still count as correct when equal
    out = {"accuracy": np.where(n > 0, correct / np.where(n > 0, n, 1), np.nan)}
    f1 = np.zeros((counts.shape[0], k))
    for i in range(k):
        tp = counts[:, (true_idx == i) & (pred_idx == i)].sum(axis=1)
        row = counts[:, true_idx == i].sum(axis=1)
        col = counts[:, pred_idx == i].sum(axis=1)
        den = row + col
        f1[:, i] = np.where(den > 0, 2 * tp / np.where(den > 0, den, 1), 0.0)
    out["macro_f1"] = f1.mean(axis=1)
    return out


def _stream_seed(seed: int, key: str, block: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}|{key}|{block}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "little") for i in range(0, 16, 4)]


def _replicate_fn(labels: Sequence[str], group_cols: Sequence[str], metrics: Sequence[str],
                  n_bootstrap: int, block_size: int, seed: int, custom: dict | None = None):
    index = {x: i for i, x in enumerate(labels)}
    k = len(labels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # draws are assigned to cells in a fixed order, whatever order the rows arrive in
        pdf = pdf.sort_values(["true_label", "predicted_label"], kind="mergesort") \
                 .reset_index(drop=True)
        key = " / ".join(str(pdf[c].iloc[0]) for c in group_cols)
        block = int(pdf["block"].iloc[0])
        first = block * block_size
        reps = min(block_size, n_bootstrap - first)
        counts = pdf["n"].to_numpy(dtype=np.int64)
        total = int(counts.sum())
        true_idx = pdf["true_label"].map(lambda x: index.get(x, -1)).to_numpy()
        pred_idx = pdf["predicted_label"].map(
            lambda x: -2 if x == NONE_LABEL else index.get(x, -3)).to_numpy()
        rng = np.random.default_rng(_stream_seed(seed, key, block))
        draws = rng.multinomial(total, counts / total, size=reps) if total > 0 \
            else np.zeros((reps, len(counts)), dtype=np.int64)
        values = _metric_arrays(draws, true_idx, pred_idx, k)
        for name, fn in (custom or {}).items():
            values[name] = np.asarray(fn(draws, true_idx, pred_idx, k), dtype=np.float64)
        out = {c: [pdf[c].iloc[0]] * reps for c in group_cols}
        out["replicate"] = np.arange(first, first + reps, dtype=np.int32)
        for m in metrics:
            out[m] = values[m]
        return pd.DataFrame(out)

    return run


def bootstrap_replicates(cells: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                         n_bootstrap: int = 2000, metrics: Sequence[str] = SUPPORTED,
                         seed: int = 42, block_size: int = 250,
                         custom_metrics: dict | None = None) -> DataFrame:
    """One row per (condition, replicate) with each metric recomputed on a resample.

    D8: ``custom_metrics`` maps a name to ``fn(counts, true_idx, pred_idx, k)`` returning
    one value per replicate; ``counts`` is (replicates x cells), the index arrays give
    each cell's label position (-1 / -2 / -3 = foreign truth / unparsed / foreign)."""
    custom_metrics = dict(custom_metrics or {})
    metrics = [*metrics, *[m for m in custom_metrics if m not in metrics]]
    for m in metrics:
        if m not in SUPPORTED and m not in custom_metrics:
            raise ValueError(f"unsupported bootstrap metric {m!r}; choose from {SUPPORTED}")
    n_blocks = (n_bootstrap + block_size - 1) // block_size
    blocks = cells.select(*group_cols, "true_label", "predicted_label", "n",
                          F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    schema = ", ".join([f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in group_cols]
                       + ["replicate int"] + [f"{m} double" for m in metrics])
    fn = _replicate_fn(list(labels), list(group_cols), list(metrics), n_bootstrap,
                       block_size, seed, custom_metrics)
    return blocks.groupBy(*group_cols, "block").applyInPandas(fn, schema)


def percentile_bounds(replicates: DataFrame, group_cols: Sequence[str],
                      metrics: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Linear-interpolation percentiles at alpha/2 and 1 - alpha/2, NaN dropped."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m)), F.col(m))
        q = F.percentile(v, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
        aggs.append(q.alias(f"_{m}_q"))
    out = replicates.groupBy(*group_cols).agg(*aggs)
    cols = [F.col(c) for c in group_cols]
    for m in metrics:
        cols += [F.col(f"_{m}_q")[0].alias(f"{m}_ci_lower"),
                 F.col(f"_{m}_q")[1].alias(f"{m}_ci_upper")]
    return out.select(*cols)


def bootstrap_cis(cells: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                  n_bootstrap: int = 2000, metrics: Sequence[str] = SUPPORTED,
                  seed: int = 42, alpha: float = 0.05,
                  metrics_table: DataFrame | None = None) -> DataFrame:
    """B1 + B4: point estimate on the full data and percentile interval per metric."""
    reps = bootstrap_replicates(cells, labels, group_cols, n_bootstrap, metrics, seed)
    bounds = percentile_bounds(reps, group_cols, metrics, alpha)
    if metrics_table is None:
        from scorebook.operators.metrics import classification_metrics
        metrics_table = classification_metrics(cells, labels, group_cols)[0]
    points = metrics_table.select(*group_cols, *[F.col(m).alias(f"{m}_point") for m in metrics])
    out = points.join(bounds, list(group_cols), "left")
    order = [*group_cols]
    for m in metrics:
        order += [f"{m}_point", f"{m}_ci_lower", f"{m}_ci_upper"]
    return out.select(*order)


# --- B2: row-weighted Poisson bootstrap -------------------------------------------------

def uniform_from_key(key) -> "F.Column":
    """Uniform in [0, 1) from the first 52 bits of md5(key): the same value in any
    engine that has md5, so the weights can be recomputed independently."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(2 ** 52))


def poisson1_weight(u) -> "F.Column":
    """Inverse-CDF draw from Poisson(1)."""
    expr = None
    for k, c in enumerate(POISSON1_CDF):
        expr = F.when(u < F.lit(c), F.lit(k)) if expr is None else expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(POISSON1_CDF))).cast("long")


#: Sums that a task holds before it hands them on, and rows of a window, in bytes.
HELD_BYTES, WINDOW_BYTES = 1 << 26, 1 << 26
#: So many draws add up in 16 bits.
SHORT_ROWS = 3000


def _codes(table: pa.Table, cols: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """(number of each row's combination of ``cols``, the combinations)."""
    code = np.zeros(table.num_rows, np.int64)
    for c in cols:
        d = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    combinations = table.select(list(cols)).take(pa.array(first)).to_pydict()
    return number, list(zip(*(combinations[c] for c in cols)))


def _draws_of(table: pa.Table, first: int, last: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(each row's number among the ids, the draws of those ids)."""
    ids = table.column("_id").combine_chunks().dictionary_encode(null_encoding="encode")
    return (ids.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            poisson_draws(ids.dictionary.to_pylist(), first, last, seed))


def _stretches(number: np.ndarray):
    """(value, rows) for each value of ``number``."""
    order = np.argsort(number, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(number[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
    for a, b in zip(edge, edge[1:]):
        yield int(number[order[a]]), order[a:b]


def _cell_sums(outcome: Sequence[str], n_bootstrap: int, seed: int):
    """Rows (_id, outcome, _m) to (outcome, n): per outcome an array of the replicates' sums of draw
    times ``_m``; an outcome may be handed on several times."""
    def run(batches):
        schema, held, size = None, {}, 0

        def handed_on():
            keys = list(zip(*held)) if held else [()] * len(outcome)
            arrays = [pa.array(list(k), schema.field(c).type) for c, k in zip(outcome, keys)]
            sums = np.array(list(held.values()))
            arrays.append(pa.ListArray.from_arrays(
                pa.array(np.arange(0, sums.size + 1, n_bootstrap), pa.int32()), pa.array(sums.reshape(-1))))
            return pa.RecordBatch.from_arrays(arrays, names=[*outcome, "n"])
        for batch in batches:
            schema = batch.schema
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            at, draws = _draws_of(table, 0, n_bootstrap, seed)
            draws = draws.astype(np.uint16)
            number, keys = _codes(table, outcome)
            times = table.column("_m").to_numpy()
            for k, rows in _stretches(number):
                if keys[k] not in held:
                    held[keys[k]] = np.zeros(n_bootstrap, np.int64)
                m, own = times[rows], at[rows]
                once = own[m == 1]
                for s in range(0, len(once), SHORT_ROWS):
                    held[keys[k]] += draws[once[s:s + SHORT_ROWS]].sum(axis=0, dtype=np.uint16)
                if len(once) < len(own):
                    held[keys[k]] += m[m != 1] @ draws[own[m != 1]].astype(np.int64)
            size = len(held) * n_bootstrap * 8
            if size > HELD_BYTES:
                yield handed_on()
                held = {}
        if held:
            yield handed_on()
    return run


def poisson_replicates(results: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                       n_bootstrap: int = 2000, seed: int = 42,
                       id_col: str = "sample_id") -> DataFrame:
    """B2: replicate r gives row i the weight Poisson(1) drawn from md5(id|r|seed).

    The weight depends on the sample id, not the condition, so all conditions are
    resampled together (paired).  The rows of an id are first counted per (condition, truth,
    prediction) and brought together, so that a weight is drawn once per (id, replicate); a task
    draws the replicates of a batch of ids at once and adds them to its cells, an array of
    replicates each.  Only the cells are shuffled, and the count-based metric code runs on
    them with ``replicate`` as an extra grouping column."""
    from scorebook.operators.cells import drop_null_keys, prediction_or_none
    from scorebook.operators.metrics import condition_counts, metrics_from_counts
    rows = drop_null_keys(results, group_cols).select(
        *group_cols, F.col(id_col).cast("string").alias("_id"), "true_label",
        prediction_or_none().alias("predicted_label"))
    outcome = [*group_cols, "true_label", "predicted_label"]
    per_id = rows.groupBy("_id", *outcome).agg(F.count(F.lit(1)).alias("_m")) \
        .repartition("_id").sortWithinPartitions("_id")
    fields = ", ".join(f"`{c}` {per_id.schema[c].dataType.simpleString()}" for c in outcome)
    sums = per_id.mapInArrow(_cell_sums(outcome, n_bootstrap, seed), f"{fields}, n array<long>")
    cells = (sums.select(*outcome, F.posexplode("n").alias("replicate", "w")).filter(F.col("w") > 0)
                 .groupBy(*group_cols, "replicate", "true_label", "predicted_label")
                 .agg(F.sum("w").alias("n")))
    keys = [*group_cols, "replicate"]
    counts = condition_counts(cells, labels, keys, with_chance=False)
    m = metrics_from_counts(counts.withColumn("s_chance", F.lit(0).cast("decimal(38,0)")),
                            labels, keys)
    return m.select(*group_cols, F.col("replicate").cast("int").alias("replicate"),
                    "macro_f1", "accuracy")


def bootstrap_cis_poisson(results: DataFrame, labels: Sequence[str], group_cols: Sequence[str],
                          n_bootstrap: int = 2000, seed: int = 42, alpha: float = 0.05,
                          metrics_table: DataFrame | None = None) -> DataFrame:
    """B2 + B3: percentile intervals from the Poisson replicates."""
    reps = poisson_replicates(results, labels, group_cols, n_bootstrap, seed)
    return percentile_bounds(reps, group_cols, SUPPORTED, alpha)


# --- B2 / D8: row metrics under the same weights ----------------------------------------

@dataclass
class WeightedMetric:
    """A metric of weighted rows, given as Columns.

    ``sums``: name -> aggregate of the row columns and the weight column ``w`` (a sum, or any
    other mergeable aggregate); ``by``: row columns that split a replicate into parts first, with
    ``parts`` (name -> aggregate over the parts) after; ``value``: the metric from the last names.
    Rows of weight 0 are not there.  ``terms``: if every one of the ``sums`` is a sum of ``w`` times a
    row column (null: 1), those columns by name; the sums are then taken for a block of replicates at once."""
    sums: dict[str, Column]
    value: Column
    by: tuple[str, ...] = ()
    parts: dict[str, Column] = field(default_factory=dict)
    terms: dict[str, str | None] | None = None


def weighted_brier(k: int) -> WeightedMetric:
    """A17 on weighted rows: sum of w * sq / (k * sum of w)."""
    return WeightedMetric({"ws": F.sum(F.col("w") * F.col("sq")), "wn": F.sum("w")},
                          F.col("ws") / (F.col("wn") * F.lit(k)), terms={"ws": "sq", "wn": None})


def weighted_ece() -> WeightedMetric:
    """A19 on weighted rows: per confidence bin the gap of means, weighted by the bin's share."""
    gap = F.abs(F.col("wc") / F.col("wn") - F.col("wok") / F.col("wn"))
    return WeightedMetric(
        {"wn": F.sum("w"), "wc": F.sum(F.col("w") * F.col("conf")), "wok": F.sum(F.col("w") * F.col("correct"))},
        F.coalesce(F.col("gaps"), F.lit(0.0)) / F.col("all"), ("bin",),
        {"all": F.sum("wn"), "gaps": F.sum(F.when(F.col("bin").isNotNull(), gap * F.col("wn")))},
        {"wn": None, "wc": "conf", "wok": "correct"})


def drawn_weights(rows: DataFrame, id_col: str, n_bootstrap: int, seed: int, block_size: int) -> DataFrame:
    """``rows`` (without ``id_col``) once per block of replicates, with ``first`` (the block's first
    replicate) and ``ws``, the Poisson(1) weights of its replicates as an array.

    Weights are those of :func:`poisson_replicates`, md5 of id, replicate and seed.  The rows of an
    id (a list bounded by conditions) are brought together, so that each weight is drawn once."""
    cols = [c for c in rows.columns if c != id_col]
    per_id = rows.groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.struct(*cols)).alias("_rows"))
    blocks = per_id.select("_id", "_rows", F.explode(F.sequence(
        F.lit(0), F.lit(n_bootstrap - 1), F.lit(block_size))).alias("first"))
    last = F.least(F.col("first") + (block_size - 1), F.lit(n_bootstrap - 1))
    draw = F.transform(F.sequence("first", last), lambda r: poisson1_weight(uniform_from_key(F.concat_ws(
        "|", F.col("_id"), r.cast("string"), F.lit(str(seed))))).cast("byte"))
    return blocks.select("_rows", "first", draw.alias("ws")).select("first", "ws", F.inline("_rows"))


def weighted_metric_replicates(drawn: DataFrame, group_cols: Sequence[str],
                               metrics: dict[str, WeightedMetric]) -> DataFrame:
    """group, replicate and each metric: weighted rows straight into the metric's sums (map-side
    combined; groups x replicates x parts entries).  Metrics of one ``by`` share a pass."""
    wide = drawn.select(*[c for c in drawn.columns if c != "ws"], F.posexplode("ws").alias("_k", "w")) \
        .filter(F.col("w") > 0).withColumn("replicate", F.col("first") + F.col("_k"))
    keys = [*group_cols, "replicate"]
    out = None
    for by in dict.fromkeys(m.by for m in metrics.values()):
        mine = {n: m for n, m in metrics.items() if m.by == by}
        agg = wide.groupBy(*keys, *by).agg(*[v.alias(f"{n}:{s}") for n, m in mine.items() for s, v in m.sums.items()])
        out = _with_values(out, agg, keys, by, mine)
    return out


def _with_values(out: DataFrame | None, agg: DataFrame, keys: Sequence[str], by: Sequence[str],
                 metrics: dict[str, WeightedMetric]) -> DataFrame:
    """``out`` and the values of ``metrics``, whose sums are the columns ``metric:sum`` of ``agg``."""
    for n, m in metrics.items():
        one = agg.select(*keys, *by, *[F.col(f"`{n}:{s}`").alias(s) for s in m.sums])
        if by:
            one = one.groupBy(*keys).agg(*[v.alias(s) for s, v in m.parts.items()])
        v = one.select(*keys, m.value.alias(n))
        out = v if out is None else out.join(v, list(keys), "full")
    return out


def _windows(batches, reps: int):
    """Tables of several batches, bounded by the bytes of their rows' draws."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes + batch.num_rows * reps // 4
        if size > WINDOW_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _term_sums(part: Sequence[str], terms: Sequence[str], first: int, last: int, seed: int):
    """Rows to (part, _w, terms): per part of a window, the replicates' sums of the draws and of the
    draws times each term."""
    def run(batches):
        for table in _windows(batches, last - first):
            at, draws = _draws_of(table, first, last, seed)
            number, keys = _codes(table, part)
            values = np.column_stack([np.ones(table.num_rows), *(table.column(c).to_numpy() for c in terms)]).astype(np.float64)
            found, sums = [], []
            for k, rows in _stretches(number):
                total = np.zeros((values.shape[1], last - first))
                for s in range(0, len(rows), SHORT_ROWS):
                    some = rows[s:s + SHORT_ROWS]
                    drawn, mine = draws[at[some]].astype(np.float64), values[some]
                    odd = ~np.isfinite(mine).all(axis=1)
                    for w, v in zip(drawn[odd], mine[odd]):     # a row of weight 0 is not there
                        total[:, w > 0] += v[:, None] * w[w > 0]
                    total += mine[~odd].T @ drawn[~odd]
                found.append(keys[k])
                sums.append(total)
            arrays = [pa.array([k[i] for k in found], table.schema.field(c).type) for i, c in enumerate(part)]
            ends = pa.array(np.arange(0, len(found) * (last - first) + 1, last - first), pa.int32())
            arrays += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t[j] for t in sums])))
                       for j in range(values.shape[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part, "_w", *terms])
    return run


def weighted_sum_replicates(rows: DataFrame, group_cols: Sequence[str], metrics: dict[str, WeightedMetric],
                            n_bootstrap: int, seed: int, block_size: int) -> DataFrame:
    """:func:`weighted_metric_replicates` for metrics that have ``terms``.  ``rows`` with ``_id``, those of
    an id together; only the sums, an array of replicates per part, are shuffled."""
    keys = [*group_cols, "replicate"]
    out = None
    for by in dict.fromkeys(m.by for m in metrics.values()):
        mine = {n: m for n, m in metrics.items() if m.by == by}
        part = [*group_cols, *by]
        terms = list(dict.fromkeys(t for m in mine.values() for t in m.terms.values() if t))
        fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in part)
        schema = ", ".join([fields, *(f"`{c}` array<double>" for c in ("_w", *terms))])
        src = rows.select("_id", *dict.fromkeys([*part, *terms]))
        blocks = None
        for first in range(0, n_bootstrap, block_size):
            last = min(first + block_size, n_bootstrap)
            sums = src.mapInArrow(_term_sums(part, terms, first, last, seed), schema)
            flat = sums.select(*part, F.posexplode(F.arrays_zip("_w", *terms)).alias("_k", "_v")).filter("_v._w > 0") \
                .select(*part, (F.col("_k") + first).alias("replicate"), "_v.*")
            blocks = flat if blocks is None else blocks.unionByName(flat)
        # weights are whole numbers, and so are sums of weights
        agg = blocks.groupBy(*keys, *by).agg(*[
            (F.sum(t) if t else F.sum(F.col("_w").cast("long"))).alias(f"{n}:{s}")
            for n, m in mine.items() for s, t in m.terms.items()])
        out = _with_values(out, agg, keys, by, mine)
    return out


def _score_sums(key: Sequence[str], k: int, first: int, last: int, seed: int):
    """Rows to (key, k, score, pos, first, ws): per distinct score of a class in a window, the sums of
    the draws of its positive and of its negative rows, unsigned little-endian numbers."""
    def run(batches):
        reps = last - first
        for table in _windows(batches, reps):
            at, draws = _draws_of(table, first, last, seed)
            group, names = _codes(table, key)
            truth = table.column("true_idx").to_numpy()
            columns = [pa.array([n[i] for n in names], table.schema.field(c).type) for i, c in enumerate(key)]
            for i in range(k):
                score = table.column(f"p{i}").to_numpy() + 0.0      # no negative zero
                pos = (truth == i).astype(np.int8)
                order = np.lexsort((pos, score, group))
                g, s, p = group[order], score[order], pos[order]
                new = (np.diff(g) != 0) | (np.diff(p) != 0) | ((s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1])))
                edge = np.flatnonzero(np.concatenate([[True], new, [True]]))
                a = 0
                while a < len(edge) - 1:        # some scores at a time, of at most SHORT_ROWS rows together or one
                    b = max(a + 1, int(np.searchsorted(edge, edge[a] + SHORT_ROWS, side="right")) - 1)
                    own = draws[at[order[edge[a]:edge[b]]]]
                    if b - a == len(own):
                        sums = own
                    elif b == a + 1:
                        sums = own.sum(axis=0, dtype=np.int64)[None, :]
                    else:
                        sums = np.add.reduceat(own.astype(np.int32), edge[a:b] - edge[a], axis=0)
                    width = np.uint8 if sums.max(initial=0) < 256 else np.dtype("<u4")
                    data = sums.astype(width).tobytes()
                    at_row = edge[a:b]
                    ends = np.arange(b - a + 1, dtype=np.int32) * (reps * np.dtype(width).itemsize)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(g[at_row])) for c in columns), pa.array(np.full(b - a, i, np.int32)),
                         pa.array(s[at_row]), pa.array(p[at_row].astype(np.int32)),
                         pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(data)])],
                        names=[*key, "k", "score", "pos", "ws"])
                    a = b
    return run


#: Sums of draws whose pairs are counted at once.
PAIR_SUMS = 1 << 20


def _pair_sums(key: Sequence[str]):
    """Per range of scores and block of replicates: weighted positives and negatives, and twice the
    pairs of a positive above a negative plus the tied ones, inside the range."""
    def run(table: pa.Table) -> pa.Table:
        score = table.column("score").to_numpy()
        order = np.argsort(score, kind="stable")
        score = score[order]
        pos = table.column("pos").to_numpy().astype(np.int64)[order][:, None]
        edge = np.flatnonzero(np.concatenate([[True], (score[1:] != score[:-1]) & ~np.isnan(score[:-1])]))
        reps = table.column("reps")[0].as_py()
        held = table.column("ws").combine_chunks().take(pa.array(order)).to_pylist()
        wide = [len(b) > reps for b in held]
        same = np.frombuffer(b"".join(held), "<u4" if wide[0] else np.uint8).reshape(-1, reps) if len(set(wide)) == 1 else None
        out = [[], [], []]
        step = max(1, PAIR_SUMS // len(held))
        for s in range(0, reps, step):
            n = min(step, reps - s)
            w = same[:, s:s + n].astype(np.int64) if same is not None else np.array([
                np.frombuffer(b, "<u4" if big else np.uint8)[s:s + n] for b, big in zip(held, wide)], np.int64)
            p, q = np.add.reduceat(w * pos, edge), np.add.reduceat(w * (1 - pos), edge)
            below = np.cumsum(q, axis=0) - q
            for o, v in zip(out, (p.sum(axis=0), q.sum(axis=0), (p * (2 * below + q)).sum(axis=0))):
                o.append(v)
        first = table.column("first")[0].as_py()
        cols = {c: pa.array([table.column(c)[0].as_py()] * reps, table.schema.field(c).type) for c in key}
        cols["replicate"] = pa.array(np.arange(first, first + reps), pa.int32())
        cols |= {c: pa.array(np.concatenate(o)) for c, o in zip(("p", "q", "u2"), out)}
        return pa.table(cols)
    return run


def weighted_auc_replicates(rows: DataFrame, k: int, group_cols: Sequence[str], n_ranges: int,
                            n_bootstrap: int, seed: int, block_size: int) -> DataFrame:
    """group, replicate, roc_auc: macro one-vs-rest AUC of the weighted rows, exact in integers.

    ``rows`` with ``_id``, those of an id together.  A task adds the draws of rows of equal scores; the
    sums go to ranges of scores of equal shares; a score that is a bound by itself is a
    range of ties and is dealt on by a salt, its parts being added before they are used.  A range
    gives, per replicate, its weighted positives, negatives and pairs; the negatives of lower
    ranges are a running sum over at most ``2 * n_ranges + 1`` rows."""
    from scorebook.operators.ranges import with_ranges
    src = rows.select("_id", *group_cols, "true_idx", *[f"p{i}" for i in range(k)])
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group_cols)
    base = None
    for first in range(0, n_bootstrap, block_size):
        last = min(first + block_size, n_bootstrap)
        one = src.mapInArrow(_score_sums(list(group_cols), k, first, last, seed),
                             f"{fields}, k int, score double, pos int, ws binary") \
            .withColumns({"first": F.lit(first), "reps": F.lit(last - first)})
        base = one if base is None else base.unionByName(one)
    key = [*group_cols, "k"]
    each = F.array(*[F.struct(F.lit(i).alias("k"), (F.col(f"p{i}") + 0.0).alias("score")) for i in range(k)])
    ranged = with_ranges(base, key, "score", n_ranges, sketch_of=rows.select(*group_cols, F.inline(each)))
    # by the row's own weights, so that a task run again deals its rows alike
    ranged = ranged.withColumn("salt", F.when(F.col("copies") > 1, F.pmod(
        F.xxhash64("ws"), F.col("copies"))).otherwise(0).cast("int"))
    part = [*key, "rng", "copies", "salt"]
    fields = ", ".join(f"`{c}` {ranged.schema[c].dataType.simpleString()}" for c in part)
    sums = ranged.groupBy(*part, "first").applyInArrow(
        _pair_sums(part), f"{fields}, replicate int, p long, q long, u2 long")
    # the parts of one tie: pairs between parts are ties too
    whole = sums.groupBy(*key, "rng", "replicate").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"),
        F.when(F.max("copies") > 0, F.sum("p") * F.sum("q")).otherwise(F.sum("u2")).alias("u2"))
    below = Window.partitionBy(*key, "replicate").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    dec = "decimal(38,0)"
    total = (whole.withColumn("qb", F.coalesce(F.sum("q").over(below), F.lit(0)))
             .groupBy(*key, "replicate").agg(
                 F.sum(F.col("u2").cast(dec) + 2 * F.col("p").cast(dec) * F.col("qb").cast(dec)).alias("u2"),
                 F.sum("p").alias("np"), F.sum("q").alias("nq")).filter("np + nq > 0"))
    den = (2 * F.col("np").cast(dec) * F.col("nq").cast(dec)).cast("double")
    auc = total.select(*group_cols, "k", "replicate", F.when(
        (F.col("np") > 0) & (F.col("nq") > 0), F.col("u2").cast("double") / den).alias("auc"))
    wide = auc.groupBy(*group_cols, "replicate").agg(*[F.max(F.when(F.col("k") == i, F.col("auc"))).alias(f"a{i}")
                                                       for i in range(k)])
    total_auc = sum((F.col(f"a{i}") for i in range(1, k)), F.col("a0"))     # null if one class has none
    return wide.select(*group_cols, "replicate", (total_auc / F.lit(float(k))).alias("roc_auc"))


def weighted_replicates(results: DataFrame, prob_cols: dict[str, str], group_cols: Sequence[str],
                        n_bootstrap: int = 2000, seed: int = 42, n_bins: int = 10,
                        id_col: str = "sample_id", metrics: dict[str, WeightedMetric] | None = None,
                        with_auc: bool = True, block_size: int = 250, n_ranges: int | None = None) -> DataFrame:
    """Group, replicate, and metrics that are no functions of cells, each recomputed on the
    rows weighted by the replicate's Poisson draws.

    ``metrics`` default to Brier score and ECE; a metric of one's own is a :class:`WeightedMetric`
    over the row columns p0 .. p(k-1), true_idx, conf, correct, bin and sq.  ``with_auc`` adds the
    macro AUC.  A condition without any weight in a replicate has no row for it.  Rows with a
    missing probability, truth, key or id take no part."""
    from scorebook.operators.calibration import binned_columns, complete_prob_rows
    from scorebook.operators.ranges import default_ranges
    from scorebook.session import stored
    k = len(prob_cols)
    if metrics is None:
        metrics = {"brier_score": weighted_brier(k), "ece": weighted_ece()}
    rows = complete_prob_rows(results, prob_cols, group_cols, keep=[id_col]).filter(F.col(id_col).isNotNull())
    rows = rows.withColumn(id_col, F.col(id_col).cast("string"))
    binned = binned_columns(k, n_bins)
    together = rows.withColumnRenamed(id_col, "_id").repartition("_id").sortWithinPartitions("_id")
    keys = [*group_cols, "replicate"]
    summed = {n: m for n, m in metrics.items() if m.terms is not None}
    own = {n: m for n, m in metrics.items() if m.terms is None}
    found = []
    if summed:
        found.append(weighted_sum_replicates(together.withColumns(binned), group_cols, summed, n_bootstrap, seed, block_size))
    if own:
        drawn = stored(drawn_weights(rows.withColumns(binned), id_col, n_bootstrap, seed, block_size), "bootstrap-weights")
        found.append(weighted_metric_replicates(drawn, group_cols, own))
    if with_auc:
        found.append(weighted_auc_replicates(together, k, group_cols, n_ranges or default_ranges(rows),
                                             n_bootstrap, seed, block_size))
    out = found[0]
    for other in found[1:]:
        out = out.join(other, keys, "full")
    columns = [*metrics, *(["roc_auc"] if with_auc else [])]
    return out.select(*group_cols, F.col("replicate").cast("int").alias("replicate"), *columns)


def bootstrap_cis_weighted(results: DataFrame, prob_cols: dict[str, str], group_cols: Sequence[str],
                           n_bootstrap: int = 2000, seed: int = 42, alpha: float = 0.05,
                           metrics: dict[str, WeightedMetric] | None = None, with_auc: bool = True) -> DataFrame:
    """B2 + B3: percentile intervals of Brier score, ECE and AUC (or of the given metrics)."""
    reps = weighted_replicates(results, prob_cols, group_cols, n_bootstrap, seed, metrics=metrics, with_auc=with_auc)
    names = [c for c in reps.columns if c not in (*group_cols, "replicate")]
    return percentile_bounds(reps, group_cols, names, alpha)


from scorebook._ship import ship  # noqa: E402

ship(__name__)
