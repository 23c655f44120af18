"""Ranges and carries, the row-weighted bootstrap, tiles of conditions, the native row index."""

import hashlib
import os
import random
import signal
import threading
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorebook.operators import bootstrap as B
from scorebook.operators import compare as M
from scorebook.operators.ranges import row_index, with_ranges, with_tie_ranges
from scorebook.sources.fixtures import eval_results

C = ["model_name", "prompt_id"]
LABELS = ["ASD", "VSD", "PDA", "Normal"]
PROBS = {x: f"prob_{x}" for x in LABELS}
SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranges -----------------------------------------------------------------------------

def test_ranges_follow_the_order_and_stay_even(spark):
    rng = random.Random(1)
    data = [(k, 0.7 + rng.random() * 1e-9) for k in "ab" for _ in range(20000)]
    data += [("c", 0.5)] * 3000 + [("c", rng.random()) for _ in range(3000)] + [("d", None), ("d", float("nan")), ("d", 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = with_ranges(df, ["k"], "v", 64).collect()
    assert len(got) == len(data)
    for k in "abcd":
        rows = sorted((r for r in got if r.k == k), key=lambda r: (r.v is not None, r.v != r.v, r.v or 0))
        assert [r.rng for r in rows] == sorted(r.rng for r in rows)
    sizes = {k: np.unique([r.rng for r in got if r.k == k and not r.copies], return_counts=True)[1] for k in "ab"}
    for n in sizes.values():
        assert n.max() <= 2 * np.median(n)
    half = {r.copies for r in got if r.k == "c" and r.v == 0.5}
    assert len(half) == 1 and 28 <= half.pop() <= 36        # half of the 63 bounds


def test_tie_ranges_split_one_frequent_value(spark):
    df = spark.range(40000).select(F.when(F.col("id") % 4 > 0, 1.0).otherwise(F.col("id") / 1e5).alias("p"),
                                   F.col("id").cast("int").alias("i")).withColumn("g", F.lit("x"))
    got = with_tie_ranges(df, ["g"], "p", "i", 64).collect()
    rows = sorted(got, key=lambda r: (r.p, r.i))
    order = [(r.rng, r.sub) for r in rows]
    assert len(rows) == 40000 and order == sorted(order)
    assert np.unique(order, axis=0, return_counts=True)[1].max() <= 2 * 40000 / 64


def test_crowded_scores_have_even_tasks(spark):
    """All scores inside one factor of 2 ** -12 of each other: no window task above twice the median."""
    from scorebook.operators.roc import prefix_below
    ties = spark.range(60000).select(F.lit("m").alias("g"), (0.6 + F.col("id") * 1e-12).alias("score"),
                                     (F.col("id") % 2).alias("pos"), F.lit(1).cast("long").alias("neg"))
    pre = prefix_below(ties, ["g"])
    got = pre.orderBy("score").collect()
    assert [r.neg_below for r in got] == list(range(60000))
    assert [r.pos_below for r in got] == [i // 2 for i in range(60000)]
    per_task = [r[1] for r in with_ranges(ties, ["g"], "score").repartition(8, "g", "rng")
                .groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) <= 2 * np.median(per_task)


# --- step-up -----------------------------------------------------------------------------

def step_up(p, order):
    n = len(p)
    rank = np.lexsort((order, p))
    out, low, low_ref = {}, 1.0, 1.0
    for k in range(n - 1, -1, -1):
        i = rank[k]
        low = min(low, p[i] * n / (k + 1))
        low_ref = min(low_ref, p[i] * n / (order[i] + 1))
        out[order[i]] = (low, low_ref)
    return out


def test_step_up_equals_one_window(spark):
    rng = random.Random(4)
    p = [rng.choice([1.0, 0.0, 0.25, rng.random(), rng.random() ** 6]) for _ in range(9000)]
    rows = [(f, i, x, "keep") for f in ("f", "g") for i, x in enumerate(p if f == "f" else p[:500])]
    df = spark.createDataFrame(rows, "fam string, pair_idx int, p_raw double, rng string").repartition(5)
    out = M.benjamini_hochberg(df.drop("rng"), by=["fam"])
    assert "SinglePartition" not in plan_of(out)
    got = {(r.fam, r.pair_idx): (r.p_bh, r.p_bh_ref) for r in out.collect()}
    for f, q in (("f", p), ("g", p[:500])):
        assert {i: got[f, i] for i in range(len(q))} == step_up(np.array(q), np.arange(len(q)))
    one = M.benjamini_hochberg(df.filter("fam = 'g'").drop("fam", "rng"))
    assert {r.pair_idx: (r.p_bh, r.p_bh_ref) for r in one.collect()} == step_up(np.array(p[:500]), np.arange(500))


def test_mcnemar_has_no_single_partition(spark):
    out = M.pairwise_mcnemar(eval_results(spark, SF), C)
    assert out.count() == 66 and "SinglePartition" not in plan_of(out)


# --- tiles of conditions ------------------------------------------------------------------

RESULTS = "sample_id string, true_label string, predicted_label string, model_name string, prompt_id string"


def many_conditions(spark, n_conds, n_samples, share, seed=2):
    rng = random.Random(seed)
    rows = [(f"s{i}", "ASD" if i % 2 else "VSD", rng.choice(["ASD", "VSD", None]), f"m{c:05d}", "p")
            for c in range(n_conds) for i in range(n_samples) if share(c, i, rng)]
    return spark.createDataFrame(rows, RESULTS)


def test_tiles_equal_selfjoin(spark):
    df = many_conditions(spark, 150, 40, lambda c, i, r: r.random() < .6)
    cols = ["condition_a", "condition_b", "n_shared", "b_count", "c_count"]
    tiled = M.discordant_counts(df, C, tile=64).select(*cols)
    assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, M.discordant_counts_selfjoin(df, C).select(*cols).collect()))


@pytest.mark.parametrize("change,message", [("twice", "twice under one condition"), ("truth", "different true labels")])
def test_tiles_check_their_input(spark, change, message):
    df = many_conditions(spark, 130, 4, lambda c, i, r: True)
    one = df.filter("model_name = 'm00001' AND sample_id = 's1'")
    if change == "twice":
        df = df.unionByName(one)
    else:       # one condition of the last block says otherwise
        df = df.withColumn("true_label", F.when((F.col("model_name") == "m00129") & (F.col("sample_id") == "s1"), "PDA")
                           .otherwise(F.col("true_label")))
    with pytest.raises(Exception, match=message):
        M.discordant_counts(df, C, tile=64)


def test_five_thousand_conditions(spark):
    """Groups of 100 conditions share four samples each."""
    df = many_conditions(spark, 5000, 200, lambda c, i, r: i // 4 == c % 50)
    out = M.discordant_counts(df, C)
    assert out.count() == 50 * 4950
    assert out.agg(F.min("n_shared"), F.max("n_shared")).first() == (4, 4)
    right = df.select("sample_id", F.coalesce(F.col("predicted_label") == F.col("true_label"), F.lit(False)).alias("ok")) \
        .groupBy("sample_id").agg(F.count_if("ok").alias("r"), F.count_if(~F.col("ok")).alias("w"))
    both = out.agg(F.sum(F.col("b_count") + F.col("c_count"))).first()[0]
    assert both == right.agg(F.sum(F.col("r") * F.col("w"))).first()[0]


def test_tile_memory_does_not_grow_with_conditions_or_samples():
    rng = np.random.default_rng(0)
    tile, peak = 128, {}
    for blocks, samples in ((2, 2000), (8, 8000)):
        batches = []
        for ti in range(blocks):
            for tj in range(ti, blocks):
                ids = np.repeat(np.arange(samples), 1 if ti == tj else 2)
                n = len(ids)
                block = np.full(n, ti) if ti == tj else np.tile([ti, tj], samples)
                words = {f"{k}_{w}": pa.array(rng.integers(-2 ** 62, 2 ** 62, n)) for k in ("present", "correct") for w in range(2)}
                t = pa.table({"ti": pa.array(np.full(n, ti), pa.int32()), "tj": pa.array(np.full(n, tj), pa.int32()),
                              "block": pa.array(block, pa.int32()), "_id": pa.array(np.char.mod("%08d", ids).tolist()),
                              "truth": pa.array(["x"] * n), **words})
                batches += t.to_batches(max_chunksize=999)
        tracemalloc.start()
        n_pairs = sum(b.num_rows for b in M._tile_partials(tile)(iter(batches)))
        peak[blocks] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n_pairs == blocks * tile * (blocks * tile - 1) // 2
    assert peak[8] < 1.5 * peak[2] and peak[8] < 40 * tile * tile * 8 + 2048 * tile * 4 * 8


# --- row index ------------------------------------------------------------------------------

def test_row_index_equals_zip_with_index(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).select(F.col("id").alias("x"), F.md5(F.col("id").cast("string")).alias("_n")).repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    out = row_index(df, "i")
    want = {r[0].x: r[1] for r in df.rdd.zipWithIndex().collect()}
    assert {r.x: r.i for r in out.collect()} == want and out.columns == ["x", "_n", "i"]
    plan = plan_of(out)
    assert "Python" not in plan and "ExistingRDD" not in plan and "SinglePartition" not in plan
    assert row_index(df.limit(0), "i").count() == 0


# --- row-weighted bootstrap ------------------------------------------------------------------

def poisson(i, r, seed=42):
    u = int(hashlib.md5(f"{i}|{r}|{seed}".encode()).hexdigest()[:13], 16) / 2.0 ** 52
    return next((k for k, c in enumerate(B.POISSON1_CDF) if u < c), len(B.POISSON1_CDF))


def weighted_rows(seed=3, n=260):
    rng = random.Random(seed)
    out = []
    for m in ("m1", "m2"):
        for i in range(n):
            t = rng.randrange(4)
            w = [rng.randrange(1, 20) + (20 if k == t and rng.random() < .7 else 0) for k in range(4)]
            if i % 3 == 0:      # a third of all rows share one saturated score
                w = [0, 0, 0, 0]
                w[i % 4] = 1
            out.append((f"s{i}", LABELS[t], m, "p", *[x / sum(w) for x in w]))
    out += [("s1", None, "m1", "q", .1, .2, .3, .4), (None, "ASD", "m1", "q", .1, .2, .3, .4),
            ("s2", "ASD", "m1", "q", None, .2, .3, .4), ("s5", "ASD", "m3", "p", .7, .1, .1, .1)]
    return out


SCHEMA = "sample_id string, true_label string, model_name string, prompt_id string, " + ", ".join(f"prob_{x} double" for x in LABELS)


def brute_weighted(rows, r):
    out = {}
    for m in ("m1", "m2"):
        sub = [x for x in rows if x[2:4] == (m, "p")]
        w = np.array([poisson(x[0], r) for x in sub])
        p = np.array([x[4:] for x in sub])
        t = np.array([LABELS.index(x[1]) for x in sub])
        brier = (w[:, None] * (p - np.eye(4)[t]) ** 2).sum() / (w.sum() * 4)
        conf, ok = p.max(axis=1), p.argmax(axis=1) == t
        bins = np.clip(np.searchsorted([i * .1 for i in range(1, 10)], conf, side="right"), 0, 9)
        ece = sum(abs((w * conf)[bins == b].sum() - (w * ok)[bins == b].sum()) for b in range(10)) / w.sum()
        auc = []
        for k in range(4):
            P, Q = (t == k) * w, (t != k) * w
            s = p[:, k]
            above = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
            auc.append((P[:, None] * Q[None, :] * above).sum() / (P.sum() * Q.sum()))
        out[m] = (brier, ece, sum(auc) / 4)
    return out


def test_weighted_bootstrap_equals_brute_force(spark):
    rows = weighted_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = B.weighted_replicates(df, PROBS, C, n_bootstrap=25, block_size=10, n_ranges=9).collect()
    seen = {(r.model_name, r.prompt_id, r.replicate): r for r in got}
    assert len(seen) == len(got) and {k[0] for k in seen} == {"m1", "m2", "m3"}
    for r in range(25):
        for m, want in brute_weighted(rows, r).items():
            x = seen[m, "p", r]
            assert (x.brier_score, x.ece, x.roc_auc) == pytest.approx(want, abs=1e-12)
    # one row only: a replicate without its weight has no row, and no AUC ever
    assert {k[2] for k in seen if k[0] == "m3"} == {r for r in range(25) if poisson("s5", r)}
    assert all(x.roc_auc is None for k, x in seen.items() if k[0] == "m3")


def test_weights_are_those_of_the_cell_variant(spark):
    """Accuracy as a weighted metric of one's own equals the accuracy of ``poisson_replicates``."""
    er = eval_results(spark, SF).filter("predicted_label IS NOT NULL")
    own = B.WeightedMetric({"n": F.sum("w"), "ok": F.sum(F.col("w") * (F.col("true_idx") == F.col("guess")).cast("long"))},
                           F.col("ok") / F.col("n"))
    probs = {x: f"hot_{x}" for x in LABELS}
    er = er.withColumns({f"hot_{x}": (F.col("predicted_label") == x).cast("double") for x in LABELS})
    best = F.expr("CASE WHEN p0 = 1 THEN 0 WHEN p1 = 1 THEN 1 WHEN p2 = 1 THEN 2 ELSE 3 END")
    own.sums["ok"] = F.sum(F.col("w") * (F.col("true_idx") == best).cast("long"))
    a = B.weighted_replicates(er, probs, C, 20, metrics={"accuracy": own}, with_auc=False)
    b = B.poisson_replicates(er, LABELS, C, 20).select(*C, "replicate", "accuracy")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_weighted_intervals(spark):
    df = spark.createDataFrame(weighted_rows(), SCHEMA)
    out = {r.model_name: r for r in B.bootstrap_cis_weighted(df, PROBS, C, n_bootstrap=60).collect()}
    point = {m: v for m, v in [("m1", brute_point("m1")), ("m2", brute_point("m2"))]}
    for m, auc in point.items():
        assert out[m].roc_auc_ci_lower < auc < out[m].roc_auc_ci_upper
        assert out[m].brier_score_ci_lower < out[m].brier_score_ci_upper


def brute_point(m):
    sub = [x for x in weighted_rows() if x[2:4] == (m, "p")]
    total = 0
    for k, x in enumerate(LABELS):
        P = [r[4 + k] for r in sub if r[1] == x]
        Q = [r[4 + k] for r in sub if r[1] != x]
        total += sum((a > b) + .5 * (a == b) for a in P for b in Q) / (len(P) * len(Q))
    return total / 4


# --- calls: batches, errors, the cap, the log ---------------------------------------------------

class Noted:
    """Writes a line per call and open call into a folder; can be told to kill its worker once."""

    def __init__(self, name, folder, kill_at=None, wait=0.0, load_fails=False, bad="", batch=False):
        self.name, self.folder, self.kill_at, self.wait = name, folder, kill_at, wait
        self.load_fails, self.bad = load_fails, bad
        if batch:
            self.predict_batch = self._batch

    def note(self, what, text="x"):
        with open(os.path.join(self.folder, f"{what}-{os.getpid()}-{threading.get_ident()}"), "a") as f:
            f.write(text + "\n")

    def load(self):
        if self.load_fails:
            raise MemoryError("no room")

    def predict(self, content, prompt):
        began = time.time()
        time.sleep(self.wait)
        flag = os.path.join(self.folder, "killed")
        if self.kill_at is not None and not os.path.exists(flag) and lines(self.folder, "call") >= self.kill_at:
            open(flag, "w").close()
            os.kill(os.getpid(), signal.SIGKILL)
        self.note("call", f"{began} {time.time()}")
        if content is not None and self.bad and bytes(content).decode() == self.bad:
            raise RuntimeError("bad row")
        return {"raw_output": "ASD" if content is None else bytes(content).decode(), "latency_s": 0.0}

    def _batch(self, contents, prompts):
        self.note("batch", " ".join(str(len(c)) for c in contents))
        return [self.predict(c, p) for c, p in zip(contents, prompts)]


def lines(folder, what):
    return sum(len(open(os.path.join(folder, f)).readlines()) for f in os.listdir(folder) if f.startswith(what + "-"))


def test_batches_by_length_with_errors_by_row(spark, tmp_path):
    from scorebook.operators.inference import batch_inference
    texts = ["v" * n for n in (1, 30, 2, 31, 3, 32, 4, 33)] + ["boom"]
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sample_id string, t string").coalesce(1)
    df = df.withColumn("content", F.encode("t", "UTF-8")).withColumn("prompt_text", F.lit("q"))
    folder = str(tmp_path)
    out = {r.sample_id: r for r in batch_inference(
        df, lambda: Noted("m", folder, bad="boom", batch=True), keep_cols=["sample_id", "t"], batch_size=3,
        max_retries=0, with_calls=True).collect()}
    assert [out[f"s{i}"].raw_output for i in range(8)] == texts[:8]
    assert out["s8"].error.endswith("RuntimeError: bad row") and out["s8"].raw_output == ""
    seen = sorted(x.strip() for f in os.listdir(folder) if f.startswith("batch") for x in open(os.path.join(folder, f)))
    assert seen == ["1 2 3", "31 32 33", "4 4 30"]
    assert {out[s].call_rows for s in ("s0", "s2", "s3")} == {3} and out["s1"].call_rows == 1


def test_batches_equal_single_calls(spark):
    from scorebook.plans import registry as R
    cols = ["sample_id", "model_id", "prompt_id", "raw_output", "input_tokens", "predicted_label"]
    one, many = (sorted(map(tuple, R.QUERIES[q](spark, SF).select(*cols).collect())) for q in ("batch_inference", "batched_inference"))
    assert one == many and len(one) > 2000


def test_model_that_does_not_load_is_an_error_of_its_rows(spark, tmp_path):
    from scorebook.operators.inference import batch_inference
    df = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "good")], "sample_id string, model_id string") \
        .withColumn("prompt_text", F.lit("q"))
    folder = str(tmp_path)
    make = lambda m: Noted(m, folder, load_fails=m == "bad")      # noqa: E731
    out = {r.sample_id: r for r in batch_inference(df, make, content_col=None, model_col="model_id").collect()}
    assert out["1"].raw_output == out["3"].raw_output == "ASD" and out["1"].error is None
    assert out["2"].error == "RuntimeError: model did not load: MemoryError: no room"


def most_open(folder):
    spans = [tuple(map(float, x.split())) for f in os.listdir(folder) if f.startswith("call") for x in open(os.path.join(folder, f))]
    return max(sum(a <= t < b for a, b in spans) for t, _ in spans)


def test_cap_on_open_calls(spark, tmp_path):
    """Four slots: two calls at most are open with a cap of two, more without."""
    from scorebook.operators.inference import batch_inference
    df = spark.range(0, 40, 1, 8).select(F.col("id").cast("string").alias("sample_id"), F.lit("q").alias("prompt_text"))
    seen = {}
    for cap in (None, 2):
        folder = str(tmp_path / str(cap))
        os.makedirs(folder)
        batch_inference(df, lambda f=folder: Noted("m", f, wait=0.1), content_col=None, parallelism=cap,
                        barrier=cap is not None).write.format("noop").mode("overwrite").save()
        seen[cap] = most_open(folder)
        assert lines(folder, "call") == 40
    assert seen[2] <= 2 < seen[None]
    # a cap beyond the slots is no error
    assert batch_inference(df, lambda: Noted("m", folder), content_col=None, parallelism=99, barrier=True).count() == 40


def test_killed_run_repeats_no_logged_call(spark, tmp_path):
    from scorebook.plans.runner import run_experiment
    from scorebook.sources.config import models_frame, prompts_frame
    notes, path = str(tmp_path / "notes"), str(tmp_path / "results")
    os.makedirs(notes)
    samples = spark.createDataFrame([(f"s{i}", f"p{i}", "ASD") for i in range(60)], "sample_id string, image_path string, label string")
    models = models_frame(spark, [{"model_id": "m", "backend": "x"}])
    prompts = prompts_frame(spark, {"p1": "one", "p2": "two"})
    args = dict(base_delay_s=0.0, buckets=3, batch_rows=2, parallelism=2)
    with pytest.raises(Exception):
        run_experiment(spark, samples, models, prompts, lambda m: Noted(m, notes, kill_at=70), path, **args)
    at_kill = lines(notes, "call")
    written = spark.read.parquet(path)
    assert 0 < written.count() < 120 and at_kill >= 70
    assert written.groupBy("bucket").count().count() in (1, 2)      # whole buckets only
    out = run_experiment(spark, samples, models, prompts, lambda m: Noted(m, notes), path, **args)
    assert out.results.count() == 120 == out.results.select("sample_id", "prompt_id").distinct().count()
    # two tasks of two rows each can have lost what they had not logged yet
    assert 120 <= lines(notes, "call") <= 120 + 2 * 2
    before = lines(notes, "call")
    assert run_experiment(spark, samples, models, prompts, lambda m: Noted(m, notes), path, **args).results.count() == 120
    assert lines(notes, "call") == before


from scorebook._ship import ship  # noqa: E402

ship(__name__)
