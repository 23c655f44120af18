"""Operators 11 to 13 against brute force, the tokenizer's library and an exact round trip, and on
nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scorebook.llm import radix_resample, repair_shards, run_finder
from scorebook.llm.common import fresh_path

P = pytest.importorskip("public_tokenizers")

EXTRA = "id place digit block start n_tokens ids part nth rank score weight key slot period run".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
WORDS = "alpha beta gamma delta Eps zeta ETA the of l'eau été Ünder it's don't 42 x1 naïve".split()


def rows(seed=4):
    rng = random.Random(seed)
    some = " ".join(rng.choice(WORDS) for _ in range(60))
    loop = " ".join(rng.choice(WORDS) + str(k) for k in range(7))
    texts = [(1, some), (2, some), (3, None), (4, ""), (5, " \t\n"), (6, " ".join([loop] * 6)), (7, "x " * 400),
             (8, "no run here at all"), (9, some + "\n" + loop + " " + loop + " end"), (1, some), (None, some),
             (None, " ".join([loop] * 4)), (10, "y" * 60000), (11, "  ".join(rng.choice(WORDS) for _ in range(9000))),
             (12, "a　b\x85c <|endoftext|> d\x1ce \U0001F600 é́"), (-3, some), (1 << 40, some)]
    texts += [(100 + k, " ".join(rng.choice(WORDS[:3 + k % 9]) for _ in range(rng.randrange(90)))) for k in range(60)]
    return [(i, t, None, None, None, *EXTRA) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


# --- 11 -------------------------------------------------------------------------------

def brute_runs(w, least):
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                seen.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, k, q) for (s, k), q in seen.items())


def test_runs_equal_brute_force():
    rng = random.Random(8)
    for _ in range(1500):
        w, n, k = [], rng.randrange(100), rng.choice([1, 2, 4, 15])
        while len(w) < n:
            if w and rng.random() < .3:
                w += w[-rng.randrange(1, min(len(w), 14) + 1):] * rng.randrange(1, 4)
            else:
                w.append(rng.randrange(k))
        assert run_finder.runs_in(w, 2) == brute_runs(w, 2)
        for least in (12, 5, 4):
            assert run_finder.runs_of_words([str(x) for x in w], least) == brute_runs(w, least)


def brute_report(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, a = h // 10, h // 10 % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w, 12)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{k},{q}\n" for s, k, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def test_run_report(docs, none):
    short = [r for r in rows() if len(r[1] or "") < 5000]
    got = [tuple(r) for r in run_finder.run_report(docs).collect()]
    assert len(got) == len(rows())
    assert not Counter(brute_report(r[0], r[1]) for r in short) - Counter(got)
    assert any(r[1] for r in got) and run_finder.run_report(none).count() == 0


def test_runs_and_collapsed_texts(docs):
    listed = {(r.doc_id, r.start, r.length, r.period) for r in run_finder.document_runs(docs).collect()}
    assert (6, 0, 42, 7) in listed and (7, 0, 400, 1) in listed
    cut = {r.doc_id: r for r in run_finder.collapsed_texts(docs).collect()}
    loop = rows()[5][1].split()[:7]
    assert cut[6].text == " ".join(loop) and cut[6].n_dropped == 35
    assert cut[8].text == "no run here at all" and cut[3].text == ""


def test_long_period_runs():
    rng = random.Random(2)
    part = [rng.randrange(10 ** 6) for _ in range(4000)]
    assert run_finder.runs_in([-1] + part * 5 + [-2], 12) == [(1, 20000, 4000)]
    assert run_finder.runs_in([1] * 50000, 12) == [(0, 50000, 1)]


# --- 12 -------------------------------------------------------------------------------

def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    fib = [0, 1]
    a, b = [0], [0, 1]
    for _ in range(16):
        a, b = b, b + a
        fib = b
    cases = [np.array(fib), np.zeros(5000, int), np.tile(rng.integers(0, 900, 700), 9)]
    cases += [rng.integers(0, v, n) for n, v in ((0, 5), (1, 1), (2, 1), (3000, 2), (30000, 25))]
    for ids in cases:
        base = 1000
        left, right, length, symbols = repair_shards.compress(ids, base)
        table = repair_shards.rule_table(left, right, length, base)
        assert (repair_shards.expand(symbols, table) == ids).all()
        whole = [len(repair_shards.expand(np.array([base + r]), table)) for r in range(len(left))]
        assert whole == length.tolist()
        ends = repair_shards.symbol_ends(symbols, length, base)
        for _ in range(30):
            at, to = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            part = repair_shards.slice_of(symbols, left, right, length, base, ends, at, to - at)
            assert (part == ids[at:to]).all()
    assert len(repair_shards.compress(cases[2], 1000)[3]) < 1000


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_encoder_equals_library(library):
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        encode, top = repair_shards.make_encoder(f.read())
    assert top == 49408
    rng = random.Random(5)
    latin = [chr(c) for c in range(256)]
    pool = latin * 2 + ["'s", "'LL", "'re", "<|endoftext|>", "́", "　", "Σ ", "İ", " ", "Å", "ﬁ", "\U0001F600", *"  eE'"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randrange(70))) for p in (latin, pool) for _ in range(1500)]
    texts += [" " * 1_000_000 + "x", "z" * 50_000]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_files_are_encoded_whole(library):
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        encode, _ = repair_shards.make_encoder(f.read())
    from tokenizers import Tokenizer
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["It's  two\n words", "", "é <|endoftext|> x"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, none, library):
    path = fresh_path(spark, "test-token-files")
    got = [tuple(r) for r in repair_shards.token_report(docs, P.path("word_bpe_49k.json"), path, shard_tokens=2000).collect()]
    assert spark.read.parquet(f"{path}/shards").count() > 3
    ids = {}
    for r in rows():
        ids.setdefault(r[0], []).append(library.encode(r[1] or "", add_special_tokens=False).ids + [2])
    # equal ids stand in any order: only their texts' order is open
    start, want = 0, Counter()
    for doc_id in sorted(ids, key=lambda i: (i is None, i or 0)):
        for g in sorted((g for g in got if g[0] == doc_id), key=lambda g: g[1]):
            assert g[1] == start
            start += g[2]
        want.update((doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[doc_id])
    assert want == Counter((g[0], g[2], g[3]) for g in got)
    some = repair_shards.read_some(spark, path, spark.createDataFrame([(2,), (11,), (11,), (555,)], "doc_id long")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in some} == {2: ids[2][0], 11: ids[11][0]}
    assert {r.doc_id: r.start for r in some} == {g[0]: g[1] for g in got if g[0] in (2, 11)}
    empty = fresh_path(spark, "test-no-tokens")
    assert repair_shards.token_report(none, P.path("word_bpe_49k.json"), empty).count() == 0


# --- 13 -------------------------------------------------------------------------------

def brute_resample(docs_, target, percent=25, least=20, buckets=10_000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def feats(t):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]
    s = Counter(b for _, t in docs_ for b in feats(t)[1])
    t = Counter(b for x in target for b in feats(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs_:
        n, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    for k, r in enumerate(able):
        drawn[(r[0], *r[2:], k + 1 if k < percent * len(able) // 100 else None)] += 1
    return drawn + Counter((r[0], *r[2:], None) for r in out if r[1] < least)


def test_resample_equals_brute_force(spark, docs, none):
    target = spark.createDataFrame([("a", "alpha beta ETA beta"), ("b", None), ("c", "the été of l'eau")], "item_id string, text string")
    got = Counter(tuple(r) for r in radix_resample.resampled_documents(docs, target).collect())
    assert got == brute_resample([(r[0], r[1]) for r in rows()], ["alpha beta ETA beta", None, "the été of l'eau"])
    assert radix_resample.resampled_documents(none, target).count() == 0
    bare = Counter(tuple(r) for r in radix_resample.resampled_documents(docs, target.limit(0)).collect())
    assert bare == brute_resample([(r[0], r[1]) for r in rows()], [])


def test_resampled_rows_keep_their_columns(docs, spark):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    drawn = radix_resample.resampled_documents(docs, target)
    ids = {r.doc_id for r in drawn.collect() if r["rank"]}
    out = radix_resample.resampled_rows(docs, target)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ids


def test_radix_ranks(spark):
    rng = random.Random(3)
    big = [(1 << 63) - 1, -(1 << 63), 0, 5, None]
    data = [(rng.choice([-5, 0, 5, None, 70000]), rng.choice(big) if k % 3 else rng.randrange(-99, 99), k) for k in range(900)]
    data += [(7, 7, 900 + k) for k in range(400)]          # one key on a third of the rows
    df = spark.createDataFrame(data, "a long, b long, place_ int").repartition(5)
    got = radix_ranks_of(df, [("a", False), ("b", True)])
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0))
    assert [(r["a"], r["b"]) for r in got] == [r[:2] for r in want]
    assert [r["rank"] for r in got] == list(range(1, len(data) + 1))
    assert [r["rank"] for r in radix_ranks_of(df.filter("a = 7"), [("a", True)])] == list(range(1, 401))
    assert radix_ranks_of(df.limit(0), [("a", True)]) == []


def radix_ranks_of(df, keys):
    return sorted(radix_resample.radix_ranks(df, keys, block=64).collect(), key=lambda r: r["rank"])


# --- 3 --------------------------------------------------------------------------------

def test_token_counts_of_long_white_space_and_padded_files():
    import json

    from scorebook.llm import token_cache
    from tokenizers import Tokenizer
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        body = f.read()
    spec = json.loads(body)
    spec["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    texts = [" " * 1_000_000 + "x", "a" + "\n" * 5000 + "b c", "one two three four five", "é　d"]
    want = [len(Tokenizer.from_str(body.decode()).encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_cache.make_counter("json", body)(texts) == want
    assert token_cache.make_counter("json", json.dumps(spec).encode())(texts) == want
