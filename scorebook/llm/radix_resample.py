"""Operator 13, target-distribution importance resampling with a distributed LSD radix sort.

1. Features of a text are its runs of one and two words, hashed to ``BUCKETS`` buckets; each text's
   bucket numbers are stored once (two bytes a feature) and read by both passes below.
2. Bucket counts of the raw rows and of the target rows are summed per task, then per bucket; the
   gains of all buckets are one array of ``BUCKETS`` longs (bounded by that parameter, whatever
   the input), which goes with the tasks.
3. A text's weight is the floored mean of its features' gains, looked up in the array; its score
   adds a Gumbel number drawn from its id.  The highest scores are a sample without replacement.
4. Ranks come from a least-significant-digit radix sort over the composite key (score descending,
   id ascending).  Each pass is a stable counting sort: rows are counted per (block of places,
   digit), prefix sums over (digit, block) give each block's first place for a digit, and a row
   goes there plus its position among the block's rows of that digit.  Blocks hold ``BLOCK`` places,
   so no task sees more than that of one key, digit or score, however often it occurs; the digits
   cover the keys' ranges only.  The last places are the ranks.

Each pass is stored in the shared folder (id, score and place only), so a lost executor costs one
pass at most and no pass is planned twice.

Cases: null and empty texts have no feature, weight 0, and too few words to be drawn; equal scores
go by smaller id, null ids last; repeated rows are rows of their own, in any order among equals;
empty tables give empty results (no target rows: gains from the smoothing alone); extra columns do
not matter; texts of any length are read whole.  Ids are integers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook._ship import ship
from scorebook.llm.common import staged

ship(__name__)

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
DIGIT_BITS = 11
BLOCK = 1 << 16
#: Rows handed on at once.
BATCH_ROWS = 512
#: UTF-8 form of: digits, lower-case ASCII letters and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_buckets(text: bytes, n_buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each feature) of a UTF-8 text."""
    words = WORD.findall(text.lower())      # bytes.lower changes A-Z only
    single = list(map(zlib.crc32, words))
    double = map(zlib.crc32, [b" " + w for w in words[1:]], single)
    crc = np.array([*single, *double], dtype=np.uint32)
    return len(words), crc % np.uint32(n_buckets)


def hashed_features(rows: DataFrame, text_col: str, keep: Sequence[str] = (), n_buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns, n_words, n_features and the buckets as little-endian unsigned numbers of
    two bytes (four beyond 65,536 buckets)."""
    width = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                n_words, n_features, buckets = [], [], []
                for t in batch.column(len(keep)):
                    n, b = feature_buckets(t.as_py(), n_buckets)
                    n_words.append(n)
                    n_features.append(len(b))
                    buckets.append(b.astype(width).tobytes())
                made = [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(buckets, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *made],
                                                 names=[*keep, "n_words", "n_features", "buckets"])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")
    src = rows.select(*(F.col(f"`{c}`") for c in keep), text)
    kept = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)
    return src.mapInArrow(run, f"{kept}n_words long, n_features long, buckets binary")


def bucket_counts(features: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: one row per bucket that occurs; each task adds up its own counts first."""
    width = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), dtype=width), minlength=n_buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())],
                                         names=["bucket", "n"])
    per_task = features.select("buckets").mapInArrow(run, "bucket int, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gain_array(raw: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, from two tables of at most ``n_buckets`` counts."""
    def counts(features: DataFrame) -> np.ndarray:
        out = np.zeros(n_buckets, dtype=np.float64)
        for r in bucket_counts(features, n_buckets).collect():
            out[r["bucket"]] = r["n"]
        return out
    s, t = counts(raw), counts(target)
    all_s, all_t = float(s.sum()), float(t.sum())
    ratio = ((t + 1) * (all_s + n_buckets)) / ((s + 1) * (all_t + n_buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def with_weights(features: DataFrame, gains: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep``, n_words, n_features, weight: floored mean of the features' gains, 0 for none."""
    width = "<u2" if len(gains) <= 1 << 16 else "<u4"
    n_kept = len(keep) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for b in batch.column(n_kept):
                own = np.frombuffer(b.as_buffer(), dtype=width)
                weights.append(int(gains[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(weights, pa.int64())],
                                             names=[*keep, "n_words", "n_features", "weight"])
    src = features.select(*(F.col(f"`{c}`") for c in keep), "n_words", "n_features", "buckets")
    kept = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)
    return src.mapInArrow(run, f"{kept}n_words long, n_features long, weight long")


def gumbel_score(weight: Column, id_col: Column, seed: int = SEED) -> Column:
    """weight plus 1,000 times a Gumbel number from the first 32 bits of sha256(seed:id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def digit(key: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND((1 << bits) - 1).cast("int")


def stable_pass(rows: DataFrame, key: str, shift: int, bits: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """One counting-sort pass: ``rows`` with ``place`` changed to the place by this digit, rows of
    one digit in the order of their former places."""
    at = rows.select("*", digit(F.col(key), shift, bits).alias("digit"),
                     F.floor(F.col("place") / block).cast("long").alias("block"))
    counts = at.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per digit: at most 2 ** bits
    totals = counts.groupBy("digit").agg(F.sum("n").alias("of_digit"))
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("digit", F.coalesce(F.sum("of_digit").over(smaller), F.lit(0)).alias("first"))
    starts = (counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .join(first, "digit").select("digit", "block", (F.col("first") + F.col("before")).alias("start")))
    inside = Window.partitionBy("digit", "block").orderBy("place")
    placed = at.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["digit", "block"])
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns if c != "place"),
                         (F.col("start") + F.col("nth")).alias("place"))


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, bool]], rank: str = "rank",
                bits: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in the order of ``keys``: (integer column, ascending)
    pairs, most significant first; nulls come last either way.

    ``rows`` is stored first with a place for each row, dense enough that a block of places is a
    part of one file.  The keys' ranges give the digits: each key counts from its least value, as
    many keys as fit share one 63-bit number, and every number is cut into equal digits."""
    col = {c: F.col(f"`{c}`").cast("long") for c, _ in keys}
    placed = staged(rows.withColumn("place", F.monotonically_increasing_id()), "radix-rows")
    seen = placed.agg(*[f(col[c]).alias(f"{n}{i}") for i, (c, _) in enumerate(keys)
                        for n, f in (("lo", F.min), ("hi", F.max))],
                      *[F.count_if(col[c].isNull()).alias(f"none{i}") for i, (c, _) in enumerate(keys)]).first()
    fields: list[tuple[Column, int]] = []       # least significant first
    for i, (c, ascending) in reversed(list(enumerate(keys))):
        lo, hi, none = seen[f"lo{i}"], seen[f"hi{i}"], seen[f"none{i}"]
        width = 0 if lo is None else (hi - lo).bit_length()
        if width > 63:      # a longer way than a long can count: two halves of the bits, sign bit turned over
            bits_of = col[c].bitwiseXOR(F.lit(-(1 << 63)))
            bits_of = bits_of if ascending else F.bitwise_not(bits_of)
            fields += [(F.coalesce(bits_of.bitwiseAND((1 << 32) - 1), F.lit(0)), 32),
                       (F.coalesce(F.shiftrightunsigned(bits_of, 32), F.lit(0)), 32)]
        elif width:
            fields.append((F.coalesce(col[c] - F.lit(lo) if ascending else F.lit(hi) - col[c], F.lit(0)), width))
        if none:
            fields.append((col[c].isNull().cast("long"), 1))
    numbers: list[tuple[Column, int]] = []
    for value, width in fields:
        if numbers and numbers[-1][1] + width <= 63:
            low, used = numbers[-1]
            numbers[-1] = (F.shiftleft(value, used).bitwiseOR(low), used + width)
        else:
            numbers.append((value, width))
    numbers = numbers or [(F.lit(0).cast("long"), 1)]       # equal keys throughout: one pass closes the gaps
    done = placed.select("*", *[v.alias(f"_key{i}") for i, (v, _) in enumerate(numbers)])
    for i, (_, width) in enumerate(numbers):
        passes = -(-width // bits)
        each = -(-width // passes)
        for shift in range(0, width, each):
            done = staged(stable_pass(done, f"_key{i}", shift, each, block), "radix-pass")
    return done.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("place") + 1).alias(rank))


def scored_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs``, stored."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    raw = staged(hashed_features(src, "text", ["doc_id"], n_buckets), "resample-features")
    wanted = hashed_features(target, text_col, [], n_buckets)
    scored = with_weights(raw, gain_array(raw, wanted, n_buckets), ["doc_id"])
    return staged(scored.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed)), "resample-scores")


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        percent: int = PERCENT, least_words: int = LEAST_WORDS,
                        n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank: 1, 2, 3 ... for the ``percent`` per cent of the
    texts of ``least_words`` words or more with the highest scores, null for all others."""
    scored = scored_documents(docs, target, id_col, text_col, n_buckets, seed)
    able = F.col("n_words") >= least_words
    wanted = scored.filter(able).count() * percent // 100
    ranked = radix_ranks(scored.filter(able), [("score", False), ("doc_id", True)])
    drawn = F.when(F.col("rank") <= wanted, F.col("rank"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, drawn.alias("rank")).unionByName(
        scored.filter(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def resampled_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` whose id is drawn (all rows of a repeated id, if one of them is)."""
    drawn = resampled_documents(docs, target, id_col, text_col, percent, seed=seed)
    ids = drawn.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_drawn_id")), "left_semi")


def oracle_sql(percent: int = PERCENT, least_words: int = LEAST_WORDS, n_buckets: int = BUCKETS, seed: int = SEED) -> str:
    """DuckDB form.  crc32 is computed from its polynomial, byte by byte, for each distinct feature."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def words(table: str, key: str) -> str:
        return f"""SELECT {key} AS id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{pattern}') AS w FROM {table}"""

    def feats(src: str) -> str:
        return f"""SELECT r, unnest(w) AS f FROM {src}
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {src} WHERE len(w) > 1"""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH dw AS MATERIALIZED ({words('documents', 'doc_id')}),
bw AS MATERIALIZED ({words('benchmark', 'item_id')}),
df AS MATERIALIZED ({feats('dw')}),
bf AS MATERIALIZED ({feats('bw')}),
tab AS (SELECT list(v ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b] || range(8), lambda c, k: {step}) AS v FROM range(256) x(b)) y),
names AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf) u),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, octet_length(encode(f))),
       lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
       lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % {n_buckets} AS bucket FROM names, tab),
sc AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT b AS bucket, CAST(floor(1000 * ln(
    (CAST(coalesce(tc.n, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM df) AS DOUBLE) + {n_buckets})
    / ((CAST(coalesce(sc.n, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM bf) AS DOUBLE) + {n_buckets})))) AS BIGINT) AS gain
  FROM range({n_buckets}) x(b) LEFT JOIN sc ON sc.bucket = b LEFT JOIN tc ON tc.bucket = b),
weights AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS g FROM df JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT dw.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE CAST((g - ((g % n_features) + n_features) % n_features) // n_features AS BIGINT) END AS weight,
    CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(dw.id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM dw LEFT JOIN weights USING (r)),
total AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (
    PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    (SELECT count(*) FROM scored WHERE n_words >= {least_words}) * {percent} // 100 AS wanted FROM total)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN place <= wanted THEN place END AS rank FROM ranked"""
