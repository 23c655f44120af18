"""Operator 12, token-ID files compressed by Re-Pair grammars, with random access.

Texts are encoded by the tokenizer's own library, an end id follows each document, and documents
are written in ascending id order.  The file format is a folder of two Parquet tables:

* ``shards``: one row per shard of about ``SHARD_TOKENS`` ids (a document is never split):
  ``part``, ``nth`` (their order is the order of the ids), ``n_tokens``, ``ids`` and ``counts`` (its
  documents and their numbers of tokens), the grammar as ``left`` and
  ``right`` (symbols of each rule), ``length`` (ids that each rule expands to) and ``symbols``, the
  compressed sequence; unsigned 32-bit little-endian numbers.  Symbols below ``base`` are token
  ids, symbol ``base + r`` is rule r, whose two symbols come before it.
* ``documents``: doc_id, part, nth, ``at`` (ids before it in its shard), ``n_tokens``.

Re-Pair in rounds: the pairs of a shard are counted, those with at least a sixteenth of the count
of the most frequent one become rules at once, and their occurrences are replaced from left to
right without overlap; the bar falls likewise each round, and it ends when no pair occurs ``LEAST``
times, or such pairs are few.  A rule refers to earlier rounds
only, so a shard expands in as many steps as it had rounds, and a document alone by finding its
first symbol in the running sum of expansion lengths.

Documents go to the tasks by ranges of (id, row number), so equal ids in any number are spread as
well; a task cuts its range into shards as it goes and holds one.  The two tables are written by
Spark's committer: a lost executor's shards are written again, and readers see whole shards only.

Cases: null and empty texts have the end id alone; null ids come last; equal texts and repeated
rows are documents of their own; an empty table gives empty files; extra columns do not matter;
texts are never cut, padded or truncated.  Ids are integers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook._ship import ship

ship(__name__)

END_ID = 2
SHARD_TOKENS = 1 << 20
LEAST = 8
#: At the least count, a round that shortens a shard by less than one in LITTLE symbols is the last.
LITTLE = 32
#: How much the bar falls each round.
FALL = 16
#: Odd 64-bit factor of the pair hash.
FACTOR = 0x9E3779B97F4A7C15
#: Pieces after which a worker's encoder forgets all it knows, and characters of texts split at once.
MEMO, GROUP_CHARS = 400_000, 1 << 20
#: Rows handed on at once.
BATCH_ROWS = 512
SPACED = re.compile(r"[^ \t-\r]+")
# fixed value: the split pattern below (``words_only``) with the letters, numbers and spaces of
# lower-case Latin-1 spelt out
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
                         "|[^\t-\r \u0085\u00a0a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")
SHARD_SCHEMA = "part int, nth int, base long, n_tokens long, left binary, right binary, length binary, " \
               "symbols binary, ids array<long>, counts array<long>"


# --- tokens -----------------------------------------------------------------------------

def make_encoder(body: bytes) -> tuple[Callable[[list[str]], Iterator[bytes]], int]:
    """(function texts -> ids as the library gives them, ids below which all ids lie).  Ids are
    little-endian numbers of :func:`id_width` bytes.

    Where the file's pre-tokenizer drops white space and neither it nor the normaliser looks
    across a space, a text's ids are those of its pieces between spaces one after the other; each
    piece is encoded by the library once and remembered, also for later tasks of the same worker.
    Texts that hold the string of an added token, and all texts of other files, are encoded whole."""
    import json
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_scorebook_encoders", {})
    if body in kept:
        return kept[body]
    tok = tokenizers.Tokenizer.from_str(body.decode())
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(body)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), END_ID]) + 1
    width = id_width(top)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    local = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("content") == " "
                                                         and s.get("pattern") == {"Regex": r"\s+"}) for s in steps)
    # fixed value: the split pattern of lower-case word BPE files, whose matches never hold white space
    words_only = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
                  and first.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
    plain = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
    lowered = any(s.get("type") == "Lowercase" for s in steps)
    known: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype=width).tobytes()

    suffix = spec["model"].get("end_of_word_suffix")
    last = np.zeros(top, dtype=bool)        # ids that end a word
    if suffix:
        last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def learn(fresh: list[str]) -> None:
        for i in range(0, len(fresh), 500):
            group = fresh[i:i + 500]
            # spaces between them change nothing, and if each is one word its last id tells it from the next
            ids = np.array(tok.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype=width)
            ends = (np.flatnonzero(last[ids]) + 1) * ids.itemsize
            if len(ends) == len(group) and all(map(LATIN_PIECE.fullmatch, group)):
                ids, ends = ids.tobytes(), ends.tolist()
                known.update((p, ids[a:b]) for p, a, b in zip(group, [0, *ends], ends))
                continue
            made = tok.encode(group, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, dtype=width).tobytes()
            n = np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(group))
            ends = (np.cumsum(n) * np.dtype(width).itemsize).tolist()
            known.update((p, ids[a:b]) for p, a, b in zip(group, [0, *ends], ends))

    def pieces_of(text: str) -> list[str] | None:
        if any(a in text for a in added):
            return None
        try:        # Latin-1 holds no combining mark, so lower case is all that the normaliser changes
            text.encode("latin-1")
            return LATIN_PIECE.findall(text.lower()) if lowered else SPACED.findall(text)
        except UnicodeEncodeError:
            return SPACED.findall(text)

    def some(texts: list[str]) -> Iterator[bytes]:
        split = [pieces_of(t) for t in texts]
        if len(known) > MEMO:
            known.clear()
        found = [p and list(map(known.get, p)) for p in split]
        learn(list({piece for p, f in zip(split, found) if p and None in f
                    for piece, ids in zip(p, f) if ids is None}))
        for t, p, f in zip(texts, split, found):
            yield whole(t) if p is None else b"".join(map(known.__getitem__, p) if None in f else f)

    def encode(texts: list[str]) -> Iterator[bytes]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > GROUP_CHARS:
                yield from some(held)
                held, size = [], 0
        yield from some(held)

    kept[body] = (encode if local and words_only and plain else lambda texts: map(whole, texts)), top
    return kept[body]


def id_width(top: int) -> str:
    return "<u2" if top <= 1 << 16 else "<u4"


# --- grammar ----------------------------------------------------------------------------

def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, length of each rule, symbols) of a Re-Pair grammar of ``ids``.

    Counts by a hash of the pair bound the true ones from above, so only positions whose hash
    occurs often enough are sorted and counted exactly."""
    seq = ids.astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.ones(base, np.int64)          # expansion length by symbol
    top, bar = base, None
    slots = 1 << max(8, min(20, len(seq).bit_length()))
    shift = np.uint64(64 - (slots.bit_length() - 1))
    while len(seq) > 1:
        bits = int(top).bit_length()
        pair = (seq[:-1] << bits) | seq[1:]
        mixed = pair.view(np.uint64) * np.uint64(FACTOR)
        mixed >>= shift
        slot = mixed.view(np.int64)
        often = np.bincount(slot, minlength=slots)
        most = int(often.max())
        bar = max(least, min(bar or most, most) // FALL)
        if most < least:
            break
        near = np.flatnonzero((often >= bar)[slot])
        ordered = np.sort(pair[near])
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        chosen = ordered[edge[:-1][np.diff(edge) >= bar]]
        if not len(chosen):
            if bar == least:
                break
            continue
        own = pair[near]
        rule = np.searchsorted(chosen, own)
        rule[rule == len(chosen)] = 0
        right_one = chosen[rule] == own
        hit, rule = near[right_one], rule[right_one]
        # of neighbouring hits the first, third, ... are taken
        n = np.arange(len(hit))
        since = n - np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hit) > 1]), n, 0))
        hit, rule = hit[since % 2 == 0], rule[since % 2 == 0]
        used, number = np.unique(rule, return_inverse=True)      # rules that nothing was left for are not made
        seq[hit] = top + number
        stays = np.ones(len(seq), dtype=bool)
        stays[hit + 1] = False
        little = bar == least and len(hit) < len(seq) // LITTLE
        seq = seq[stays]
        a, b = chosen[used] >> bits, chosen[used] & ((1 << bits) - 1)
        left.append(a)
        right.append(b)
        size = np.concatenate([size, size[a] + size[b]])
        top += len(used)
        if little:
            break
    return (np.concatenate(left).astype("<u4"), np.concatenate(right).astype("<u4"),
            size[base:].astype("<u4"), seq.astype("<u4"))


def _opened_by(symbols: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Expansions of ``symbols`` one after the other, copied from ``flat``."""
    n = size[symbols]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first[symbols] - (ends - n), n) + np.arange(total)]


def rule_table(left: np.ndarray, right: np.ndarray, length: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """(flat, first, size): symbol s expands to ``flat[first[s]:first[s] + size[s]]``.  Rules are
    opened in stretches whose operands all come before the stretch."""
    size = np.concatenate([np.ones(base, np.int64), length.astype(np.int64)])
    first = np.concatenate([np.arange(base), base + np.cumsum(length.astype(np.int64)) - length])
    flat = np.arange(base, dtype=np.int64)
    latest = np.maximum(left, right).astype(np.int64) - base if len(left) else np.zeros(0, np.int64)
    highest = np.maximum.accumulate(latest) if len(latest) else latest
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(highest, i)))
        both = np.column_stack([left[i:j], right[i:j]]).astype(np.int64).ravel()
        flat = np.concatenate([flat, _opened_by(both, flat, first, size)])
        i = j
    return flat, first, size


def expand(symbols: np.ndarray, table: tuple[np.ndarray, ...]) -> np.ndarray:
    """The ids that ``symbols`` stand for, from a shard's :func:`rule_table`."""
    return _opened_by(symbols.astype(np.int64), *table).astype("<u4")


def symbol_ends(symbols: np.ndarray, length: np.ndarray, base: int) -> np.ndarray:
    """Running sum of the expansion lengths of a shard's symbols."""
    known = length[np.maximum(symbols.astype(np.int64) - base, 0)] if len(length) else np.ones(len(symbols))
    return np.cumsum(np.where(symbols >= base, known, 1).astype(np.int64))


def slice_of(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray, base: int,
             ends: np.ndarray, at: int, n: int) -> np.ndarray:
    """Ids ``at`` .. ``at + n`` of a shard: from the first symbol that reaches into the range, rules
    are opened down the grammar, those before the range passed over by their length."""
    a = int(np.searchsorted(ends, at, side="right"))
    skip, out = at - (int(ends[a - 1]) if a else 0), []
    while len(out) < n:
        todo = [int(symbols[a])]
        a += 1
        while todo and len(out) < n:
            s = todo.pop()
            size = 1 if s < base else int(length[s - base])
            if skip >= size:
                skip -= size
            elif s < base:
                out.append(s)
            else:
                todo += [int(right[s - base]), int(left[s - base])]
    return np.array(out, dtype="<u4")


# --- files ------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                      tasks: int | None = None) -> None:
    """Encode ``docs`` and write the two tables of the file format under ``path``.

    Texts are dealt to ``tasks`` ranges (default: as many as the scan has parts) and encoded there,
    so ids are neither shuffled nor stored before they are compressed."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        body = f.read()
    base = make_encoder(body)[1]
    end = np.array([end_id], dtype=id_width(base)).tobytes()
    order = [F.col("doc_id").asc_nulls_last(), F.col("slot")]
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                      F.monotonically_increasing_id().alias("slot"))
    parts = tasks or max(1, docs.select(f"`{id_col}`").rdd.getNumPartitions())
    ranged = src.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, nth = TaskContext.get().partitionId(), 0
        encode, _ = make_encoder(body)
        names: list = []
        chunks: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(chunks)
            left, right, length, symbols = compress(ids, base)
            row = [part, nth, base, len(ids), left.tobytes(), right.tobytes(), length.tobytes(), symbols.tobytes(),
                   list(names), [len(c) for c in chunks]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)],
                                              names=[f.split()[0] for f in SHARD_SCHEMA.split(", ")])
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    own = np.frombuffer(ids + end, dtype=id_width(base))
                    if chunks and held + len(own) > shard_tokens:
                        yield shard()
                        names, chunks, held, nth = [], [], 0, nth + 1
                    names.append(doc_id)
                    chunks.append(own)
                    held += len(own)
        if chunks:
            yield shard()
    ranged.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/shards")
    listed = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").select(
        "part", "nth", F.posexplode(F.arrays_zip("ids", "counts")).alias("k", "d"))
    inside = Window.partitionBy("part", "nth").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    listed.select(F.col("d.ids").alias("doc_id"), "part", "nth", "k",
                  F.coalesce(F.sum("d.counts").over(inside), F.lit(0)).alias("at"),
                  F.col("d.counts").alias("n_tokens")).write.parquet(f"{path}/documents")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, nth, first: ids before each shard.  Sums go up from shards to parts to groups of 1,024
    parts and down again, so no window holds more than one level's children."""
    shards = spark.read.parquet(f"{path}/shards").select("part", "nth", "n_tokens")
    group = F.floor(F.col("part") / 1024).cast("int").alias("grp")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    groups = parts.groupBy(group).agg(F.sum("n").alias("n"))

    def before(df: DataFrame, n: str, by: list[str], order: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)))
    top = before(groups, "n", [], "grp", "b0").select("grp", "b0")
    mid = before(parts.select("part", "n", group), "n", ["grp"], "part", "b1").select("part", "grp", "b1")
    low = before(shards, "n_tokens", ["part"], "nth", "b2").select("part", "nth", "b2")
    return (low.join(mid, "part").join(top, "grp")
            .select("part", "nth", (F.col("b0") + F.col("b1") + F.col("b2")).alias("first")))


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], dtype="<u4") for c in ("left", "right", "length", "symbols"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents from the files: doc_id, start, n_tokens, ids (unsigned 32-bit little-endian).

    One task opens a shard at a time; its documents are listed in the shard itself."""
    rows = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").drop("n_tokens").join(
        shard_starts(spark, path), ["part", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                left, right, length, symbols = _arrays(row)
                opened = expand(symbols, rule_table(left, right, length, row["base"]))
                at = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
                # one buffer with the places of the documents in it
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(at[:-1] + row["first"]), pa.array(row["counts"], pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()),
                                                                      pa.py_buffer(opened.tobytes())])],
                    names=["doc_id", "start", "n_tokens", "ids"])
    return rows.select("base", "left", "right", "length", "symbols", "ids", "counts", "first").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def read_some(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Random access: the documents whose id is in ``ids`` (one column); only the shards that hold
    them are opened, and of these only the symbols that reach into a document."""
    id_col, = ids.columns
    wanted = ids.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
    places = spark.read.parquet(f"{path}/documents").join(wanted, "doc_id", "left_semi")
    lists = (places.groupBy("part", "nth").agg(F.collect_list(F.struct("k", "doc_id", "at", "n_tokens")).alias("docs"))
             .join(shard_starts(spark, path), ["part", "nth"]))
    rows = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").drop("n_tokens", "ids", "counts").join(lists, ["part", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                left, right, length, symbols = _arrays(row)
                ends = symbol_ends(symbols, length, row["base"])
                docs = sorted(row["docs"], key=lambda d: d["k"])
                out = [slice_of(symbols, left, right, length, row["base"], ends, d["at"], d["n_tokens"]) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d["doc_id"] for d in docs], pa.int64()),
                     pa.array([row["first"] + d["at"] for d in docs], pa.int64()),
                     pa.array([len(x) for x in out], pa.int64()),
                     pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
    return rows.select("base", "left", "right", "length", "symbols", "docs", "first").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def token_report(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 (Spark's own crc32 of the
    ids' bytes)."""
    write_token_files(docs, tokenizer_path, path, id_col, text_col, shard_tokens=shard_tokens)
    return read_documents(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
