"""Operator 9, embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of equal label (and length) are dealt by key digest into tiles of about ``tile``
vectors; each pair of tiles is one task-sized group, so a hot label spreads over many groups.
A vector u (unit length) is stored as integers q in [-127, 127] and a scale s with the exact
rest e = |u - s q|.  For two vectors

    | u.v - s_u s_v q_u.q_v |  <=  e_u + e_v + e_u e_v,

so a tile product of integers decides all pairs but those whose bound reaches the threshold;
only these are computed in double precision.  Integer products run as float32 matrix products
in chunks of 1,024 components, where every partial sum is an integer below 2^24, hence exact.

A group returns counts per vector and a spanning forest of its links instead of all pairs:
groups of many copies cost no more rows than vectors, and the components are the same.

The comparison of equal labels is all against all, as its contract says: work grows with the
square of a label's vectors, rows sent grow with its number of tiles.

Cases: vectors that are null, empty, zero or hold null, infinite or NaN components, and null
labels, link with nothing; equal ids are vectors of their own (``component_id`` is the smallest
id of the component); a null id never is the smallest and is not kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook._ship import ship
from scorebook.llm.common import staged
from scorebook.llm.components import connected_components

ship(__name__)

TILE = 1024
CHUNK = 1024
SLACK = 1e-9        # above the rounding of double sums of unit vectors


def quantise(x):
    """(integers as float32, scale, error bound, unit vectors) of the rows of a double matrix."""
    import numpy as np
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    rest = unit - q * scale[:, None]
    bound = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + SLACK
    return q.astype(np.float32), scale, bound, unit


def tile_links(x, y, threshold: float):
    """Index pairs (i, j) of rows of ``x`` and ``y`` with cosine >= threshold, in double precision."""
    import numpy as np
    qx, sx, ex, ux = quantise(x)
    qy, sy, ey, uy = quantise(y)
    found = []
    for top in range(0, len(x), 256):
        part = slice(top, top + 256)
        dot = np.zeros((len(qx[part]), len(y)))
        for at in range(0, x.shape[1], CHUNK):
            dot += qx[part, at:at + CHUNK] @ qy[:, at:at + CHUNK].T
        upper = dot * sx[part, None] * sy[None, :] + ex[part, None] + ey[None, :] + ex[part, None] * ey[None, :]
        i, j = np.nonzero(upper >= threshold - SLACK)
        for k in range(0, len(i), 65536):
            a, b = i[k:k + 65536] + top, j[k:k + 65536]
            num = np.einsum("ij,ij->i", x[a], y[b])
            den = np.sqrt(np.einsum("ij,ij->i", x[a], x[a])) * np.sqrt(np.einsum("ij,ij->i", y[b], y[b]))
            sure = num / den >= threshold
            found.append((a[sure], b[sure]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(a, b):
    """Links that join new components only (same components, at most one link a node)."""
    parent: dict = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    out = []
    for p, q in zip(a, b):
        r, s = root(p), root(q)
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append((p, q))
    return out


def _compare(threshold: float) -> Callable:
    def run(table):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        uid = table.column("uid").to_numpy()
        if len(uid) < 2:
            return schema.empty_table()
        vectors = table.column("v").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(uid), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i == j:
            p, q = tile_links(x, x, threshold)
            keep = p < q
            p, q = uid[p[keep]], uid[q[keep]]
        else:
            left = table.column("t").to_numpy() == i
            if left.all() or not left.any():
                return schema.empty_table()
            p, q = tile_links(x[left], x[~left], threshold)
            p, q = uid[left][p], uid[~left][q]
        who, n = np.unique(np.concatenate([p, q]), return_counts=True)
        links = forest(p.tolist(), q.tolist())
        return pa.table({
            "a": pa.array([*who.tolist(), *(x for x, _ in links)], pa.int64()),
            "b": pa.array([*[None] * len(who), *(y for _, y in links)], pa.int64()),
            "n": pa.array([*n.tolist(), *[0] * len(links)], pa.int64())}, schema=schema)
    return run


def usable(vector: Column) -> Column:
    """Is the vector non-null, non-zero and finite in every component?"""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    # a row number that stays: it is written once
    rows = staged(vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.when(F.col(label_col).isNotNull() & usable(F.col(vector_col)), F.col(vector_col)).alias("v")), "vectors")
    good = rows.filter(F.col("v").isNotNull()).withColumn("dim", F.size("v"))
    sizes = good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    dealt = good.join(sizes, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("uid"), F.col("tiles")))
    paired = dealt.select("label", "dim", "t", "uid", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("o"))
    paired = paired.select("label", "dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "uid", "v")
    found = staged(paired.groupBy("label", "dim", "i", "j").applyInArrow(
        _compare(threshold), "a long, b long, n long"), "vector-links")
    counts = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    members = rows.select("uid", "id").join(comps, F.col("uid") == F.col("node")).select("uid", "id", "component")
    least = members.groupBy("component").agg(F.min("id").alias("least_id"))
    named = members.join(least, "component").select("uid", "least_id")
    out = rows.select("uid", "id").join(counts, F.col("uid") == F.col("a"), "left").join(named, "uid", "left")
    comp = F.coalesce("least_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp.cast("long").alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def oracle_sql() -> str:
    return """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id
      AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.98),
r(v, n) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.v, l.b FROM r JOIN l ON r.n = l.a),
c AS (SELECT v, min(n) AS component_id FROM r GROUP BY v),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.v = e.vec_id LEFT JOIN k ON k.a = e.vec_id"""
