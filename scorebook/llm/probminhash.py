"""Operator 7, near-duplicate documents by ProbMinHash.

A document is a weighted set: its shingles of five words with their counts.  Each shingle
sends a Poisson process of rate equal to its weight; every arrival falls into one of ``SLOTS``
slots, and a slot keeps the shingle of its earliest arrival.  Two documents agree in a slot
with the probability Jaccard similarity of their weights,

    J_P(a, b) = sum over common d of 1 / sum over d' of max(a_d' / a_d, b_d' / b_d),

which is the usual Jaccard similarity where all counts are one.  A shingle stops early when its
next arrival comes after the latest slot minimum of its document.

1. Equal word sequences are grouped; everything below is on one representative each.
2. Signatures are cut into ``BANDS`` bands of four slots; equal bands make candidates
   (a pair at 0.8 is missed with probability 5e-8).
3. In each bucket every member is compared with the smallest member; verified pairs link.
4. Buckets that still hold several components are compared once more across components, in
   blocks of at most ``BLOCK`` members and about ``BLOCK_WORDS`` words: pairs whose signatures agree
   enough (0.6 or more; a pair at 0.8 falls short with probability 1e-8) are verified where they
   are found, in the first band they share, unless links found before in the block join them
   already.  Only links leave a block, fewer than it has members.
5. Verification computes J_P on the shingles.  Components of the links are the classes.

No step lists all pairs of a bucket: a bucket of k copies makes k pairs in step 3, and step 4 gives
a spanning forest of each block's links, so memory and rows grow with the members.

Cases: null and blank texts have no shingles and are classes of their own; a text of one to
four words is one shingle; rows with equal words are one class; the class id is its smallest
document id (null only if all ids are null); an empty table gives an empty result; extra
columns do not matter.  Of equal rows (same id and words) one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorebook._ship import ship
from scorebook.llm.common import let, staged, thinned, unused, words_of
from scorebook.llm.components import connected_components

ship(__name__)

WORDS = 5
SLOTS = 128
BANDS = 32
BLOCK = 256
BLOCK_WORDS = 1 << 19
ESTIMATE = 0.6
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x):
    """Finaliser of splitmix64 on an array of uint64."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words, starts, ends):
    """(document index, hash) of the shingles of documents given as ranges of a word-hash array."""
    import numpy as np
    n = ends - starts
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.minimum(n, WORDS)[doc]
    h = np.full(len(doc), GOLDEN, np.uint64)
    for k in range(WORDS):
        has = size > k
        word = words[np.where(has, first + k, first)]
        h = np.where(has, mixed(h * np.uint64(MIX2) + word), h)
    return doc, h


def weighted(doc, h):
    """Distinct (document, hash) with counts, in order."""
    import numpy as np
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def signatures(doc, h, weight, n_docs: int):
    """uint32 array (documents, SLOTS): low bits of the shingle with each slot's first arrival."""
    import numpy as np
    least = np.full(n_docs * SLOTS, np.inf)
    owner = np.zeros(n_docs * SLOTS, np.uint32)
    time = np.zeros(len(h))
    step = 0
    while len(h):
        step = (step + GOLDEN) & 0xFFFFFFFFFFFFFFFF
        bits = mixed(h + np.uint64(step))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / weight
        slot = doc * SLOTS + (mixed(bits ^ np.uint64(MIX1)) >> np.uint64(57)).astype(np.int64)
        hit = np.flatnonzero(time < least[slot])
        np.minimum.at(least, slot[hit], time[hit])
        won = hit[time[hit] == least[slot[hit]]]
        owner[slot[won]] = (h[won] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        latest = least.reshape(n_docs, SLOTS).max(axis=1)
        live = time < latest[doc]
        doc, h, weight, time = doc[live], h[live], weight[live], time[live]
    return owner.reshape(n_docs, SLOTS)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """J_P of two weighted sets (sorted distinct hashes, weights)."""
    import numpy as np
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    common = hb[at] == ha
    x, y = wa[common], wb[at[common]]
    if not len(x):
        return 0.0
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], y[order]
    # for a term of ratio r, terms of ratio >= r count by a, the others by b scaled with r
    x_from = xs[::-1].cumsum()[::-1]
    y_before = ys.cumsum() - ys
    left = np.searchsorted(r, r, side="left")
    total = only_a + x_from[left] + r * (only_b + y_before[left])
    return float((xs / total).sum())


def _sign(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            lists = batch.column("hashes")
            words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            doc, h = shingle_hashes(words, offsets[:-1], offsets[1:])
            sig = signatures(*weighted(doc, h), len(lists))
            wide = sig.reshape(len(lists), BANDS, SLOTS // BANDS).astype(np.uint64)
            key = np.zeros(wide.shape[:2], np.uint64)
            for k in range(wide.shape[2]):
                key = mixed(key * np.uint64(MIX2) + wide[:, :, k] + np.uint64(GOLDEN))
            bands = pa.ListArray.from_arrays(np.arange(0, BANDS * (len(lists) + 1), BANDS, dtype=np.int32),
                                             pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "id", "k1", "k2")), bands,
                 pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(np.diff(offsets), pa.int64())],
                names=["uid", "id", "k1", "k2", "bands", "sig", "n_words"])


def _verify(threshold: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            sides = []
            for name in ("words_a", "words_b"):
                lists = batch.column(name)
                sides.append((lists.values.to_numpy(zero_copy_only=False).view(np.uint64),
                              lists.offsets.to_numpy().astype(np.int64)))
            near = []
            for i in range(batch.num_rows):
                pair = []
                for words, offsets in sides:
                    doc, h = shingle_hashes(words, offsets[i:i + 1], offsets[i + 1:i + 2])
                    pair.append(weighted(doc, h)[1:])
                near.append(probability_jaccard(*pair) >= threshold)
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)],
                                             names=["a", "b"])
    return run


def _root(up: dict, x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


def _across(threshold: float):
    """Links between different components within a block pair, as a spanning forest: pairs whose
    signatures agree enough and whose J_P reaches the threshold.

    Rows come grouped by (band, key, i, j); a group may go on in the next batch.
    """
    def pairs(table):
        import numpy as np
        uid, comp, side = (table.column(c).to_numpy() for c in ("uid", "comp", "block"))
        i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(uid), SLOTS)
        lists = table.column("hashes")
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        up, sets, links = {}, {}, []

        def shingles(at: int) -> tuple:
            if at not in sets:
                words = lists[at].values.to_numpy(zero_copy_only=False).view(np.uint64)
                doc, h = shingle_hashes(words, np.zeros(1, np.int64), np.full(1, len(words)))
                sets[at] = weighted(doc, h)[1:]
            return sets[at]
        for p in left.tolist():
            other = right[(comp[right] != comp[p]) & ((uid[right] > uid[p]) if i == j else True)]
            if not len(other):
                continue
            same = sig[other] == sig[p]
            bands = same.reshape(len(other), BANDS, SLOTS // BANDS).all(axis=2)
            # a pair belongs to the first band it shares; none here: the band's key clashed
            first = np.where(bands.any(axis=1), bands.argmax(axis=1), band)
            for q in other[(first == band) & (same.mean(axis=1) >= ESTIMATE)].tolist():
                a, b = _root(up, int(comp[p])), _root(up, int(comp[q]))
                if a != b and probability_jaccard(shingles(p), shingles(q)) >= threshold:
                    up[max(a, b)] = min(a, b)
                    links.append((int(uid[p]), int(uid[q])))
        return links

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def out(links: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)
        held, mark = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy() for c in ("band", "key", "i", "j")]
            new = np.zeros(batch.num_rows, bool)
            for m in marks:
                new[1:] |= m[1:] != m[:-1]
            new[0] = tuple(m[0] for m in marks) != mark
            mark = tuple(m[-1] for m in marks)
            cuts = np.flatnonzero(new).tolist()
            if not cuts:
                held.append(batch)
                continue
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]))
            if held and (links := pairs(pa.Table.from_batches(held).combine_chunks())):
                yield out(links)
            for lo, hi in zip(cuts, cuts[1:]):
                if links := pairs(pa.Table.from_batches([batch.slice(lo, hi - lo)]).combine_chunks()):
                    yield out(links)
            held = [batch.slice(cuts[-1])]
        if held and (links := pairs(pa.Table.from_batches(held).combine_chunks())):
            yield out(links)
    return run


def _keys(words: Column) -> list[Column]:
    """Two digests that identify a word sequence."""
    return [F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(7), words).alias("k2")]


def _contents(uids: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, content) of some representatives, stored; only their texts are moved."""
    need = uids.join(reps.select("uid", F.col("id").alias("rep_id"), "k1", "k2"), "uid")
    found = thinned(texts, "t1", need.select("k1")).join(
        need, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
        & F.col("text_id").eqNullSafe(F.col("rep_id"))).select("uid", "content")
    return staged(found.dropDuplicates(["uid"]), "candidate-texts")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of representatives whose J_P reaches the threshold."""
    found = _contents(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), reps, texts)
    both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")
    hashed = both.select("a", "b", *(F.transform(words_of(F.col(f"text_{s}")), lambda w: F.xxhash64(w)).alias(f"words_{s}")
                                     for s in "ab"))
    return staged(hashed.mapInArrow(_verify(threshold), "a long, b long"), "near-links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = 0.8) -> DataFrame:
    """(id, k1, k2, class_id, kept, n_words > 0): one row per document; k1, k2 digest its words."""
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
                       words_of(F.col(text_col)).alias("words"))
    hashed = slim.select("uid", "id", *_keys(F.col("words")), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    signed = staged(hashed.mapInArrow(
        _sign, "uid long, id long, k1 long, k2 long, bands array<bigint>, sig binary, n_words long"), "signatures")
    blank = F.struct(*(c for c in _keys(F.array().cast("array<string>"))))
    some = ~((F.col("k1") == blank["k1"]) & (F.col("k2") == blank["k2"]))

    # one representative of each word sequence: smallest id (nulls last), then row number
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("o"), "uid", "id")
    reps = staged(signed.filter(some).groupBy("k1", "k2").agg(F.min(order).alias("first")).select(
        "k1", "k2", F.col("first.uid").alias("uid"), F.col("first.id").alias("id")), "representatives")

    keyed = signed.select("uid", "bands", "n_words").join(reps.select("uid"), "uid", "left_semi").select(
        "uid", "n_words", F.posexplode("bands").alias("band", "key"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_words") / BLOCK_WORDS))
    buckets = keyed.groupBy("band", "key").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).filter("n > 1")
    members = staged(keyed.drop("n_words").join(buckets, ["band", "key"]).select(
        "band", "key", "blocks", "a", F.col("uid").alias("b")), "buckets")
    stars = staged(members.filter("a <> b").select("a", "b").distinct(), "stars")

    text = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("content"))
    texts = text.select("text_id", "content", words_of(F.col("content")).alias("w")).select(
        "text_id", "content", F.xxhash64("w").alias("t1"), F.xxhash64(F.lit(7), "w").alias("t2"))
    links = _verified(stars, reps, texts, threshold)

    comp = connected_components(links)
    placed = members.join(comp, F.col("b") == F.col("node"), "left").select(
        "band", "key", "blocks", "b", F.coalesce("component", "b").alias("comp"))
    placed = staged(placed, "placed")
    open_ = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    rows = staged(placed.join(open_.select("band", "key"), ["band", "key"], "left_semi"), "open-buckets")
    contents = _contents(rows.select(F.col("b").alias("uid")).distinct(), reps, texts)
    inside = contents.join(signed.select("uid", "sig"), "uid").select(
        F.col("uid").alias("b"), "sig", F.transform(words_of(F.col("content")), lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.join(inside, "b").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).withColumn(
        "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block",
                       F.col("b").alias("uid"), "comp", "sig", "hashes")
    # a number of partitions keeps them apart: few bytes of alike members are much to compare
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = rows.repartition(parts, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").mapInArrow(
        _across(threshold), "a long, b long")
    links = links.union(staged(across.distinct(), "across"))
    comp = connected_components(links)

    # class of every row: its word sequence, then the component of the representative
    named = reps.join(comp, F.col("uid") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("component", "uid").alias("class"))
    rows = signed.select("uid", "id", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "uid", "id", "k1", "k2", F.coalesce("class", "uid").alias("class"))
    rows = staged(rows, "classes")
    firsts = rows.groupBy("class").agg(F.min(order).alias("first"), F.min("id").alias("class_id")).select(
        "class", "class_id", F.col("first.uid").alias("first_uid"))
    return rows.join(firsts, "class").select("id", "k1", "k2", "class_id", (F.col("uid") == F.col("first_uid")).alias("kept"))


def class_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: id, ``class_id``, ``kept``."""
    return classes(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "kept")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are first of their class, columns as they came."""
    kept = classes(docs, id_col, text_col, threshold).filter("kept").select(
        F.col("id").alias("kept_id"), F.col("k1").alias("kept_k1"), F.col("k2").alias("kept_k2"))
    n1, n2, n3 = unused(docs, "words_key1", "words_key2", "turn")
    words = words_of(F.col(f"`{text_col}`"))
    keyed = let_keys(docs, words, n1, n2)
    joined = keyed.join(kept, (keyed[n1] == kept["kept_k1"]) & (keyed[n2] == kept["kept_k2"])
                        & keyed[f"`{id_col}`"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
    # a row that is there twice stays once; blank texts are classes of their own, so all of them stay
    turn = F.row_number().over(Window.partitionBy(n1, n2, F.col(f"`{id_col}`")).orderBy(F.lit(1)))
    return joined.withColumn(n3, turn).filter((F.col(n3) == 1) | (F.size(words) == 0)).select(
        *(F.col(f"`{c}`") for c in docs.columns))


def let_keys(docs: DataFrame, words: Column, n1: str, n2: str) -> DataFrame:
    both = let(words, lambda w: F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(7), w).alias("b")))
    return docs.withColumn(n1, both).withColumn(n2, F.col(f"{n1}.b")).withColumn(n1, F.col(f"{n1}.a"))
