"""Operator 3, token counts with a digest cache.

The content of a text (null: empty) is its digest; a tokenizer's version is the digest of its
file and options.  Stored counts are joined on both digests; of the texts that miss, one per
digest is encoded and its count is appended to the cache, a Parquet table in a folder of the
caller's choice.  All documents then get their counts by a join with the cache.

Normalisation: exactly what the tokenizer's own normaliser would make equal; for tokenizers
without one (as the byte-level one here) the content is the text itself, so no count changes.

Cases: null and empty texts count 0 tokens; repeated texts are encoded once; texts are never
cut or padded; special strings inside texts are handled as the library does by default; an
empty table gives an empty result; extra columns do not matter.  Two writers that append the
same digest at once do no harm: the cache is read with one row per digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook._ship import ship
from scorebook.llm.common import staged


ship(__name__)

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
BATCH = 256
#: A run of white space that goes to the file's own library, with its text.
LONG_SPACE = re.compile(r"\s{1000}")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its kind and the options that change counts."""
    with open(path, "rb") as f:
        body = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{path.rsplit('.', 1)[-1]}:{body}:no-added-tokens".encode()).hexdigest()


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes -> rank of a plain byte-level BPE file, or None if the file is of another kind."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and spec.get("normalizer") is None
             and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    # the byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown}
    letter |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in merged]
    if any(b <= a for a, b in zip(ids, ids[1:])) or (ids and ids[0] < 256):
        return None     # merge order and ids differ: ranks would not be the ids
    return {bytes(letter[c] for c in piece): i for piece, i in vocab.items() if piece not in special}


def make_counter(kind: str, body: bytes) -> Callable[[list[str]], list[int]]:
    """Function texts -> token counts, as the library of that file kind counts them.

    For plain byte-level BPE files, Latin-1 texts go to a faster encoder of the same ranks and
    the same split pattern; on other texts the two libraries may class characters by different
    Unicode versions, so those go to the file's own library.
    """
    if kind == "model":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=body)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import json
    from tokenizers import Tokenizer
    slow = None

    def by_library(texts: list[str]) -> list[int]:
        nonlocal slow
        if slow is None:
            slow = Tokenizer.from_str(body.decode())
            slow.no_truncation()
            slow.no_padding()
        return [len(slow.encode(t, add_special_tokens=False).ids) for t in texts]

    spec = json.loads(body)
    ranks = byte_level_ranks(spec)
    if ranks is None:
        return by_library
    import tiktoken
    # fixed value: the split pattern of byte-level BPE files
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"))
                for t in spec.get("added_tokens", []))
    fast = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def count(texts: list[str]) -> list[int]:
        out = []
        for t in texts:
            if LONG_SPACE.search(t):        # too long a run for the faster encoder's matcher
                out += by_library([t])
                continue
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                out += by_library([t])
            else:
                out.append(len(fast.encode(t, allowed_special="all")) if plain else by_library([t])[0])
        return out

    return count


def _encode(kind: str, shared) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        counter = None
        for batch in batches:
            if counter is None:
                counter = make_counter(kind, shared.value)
            texts, counts = batch.column("content"), []
            for at in range(0, len(texts), BATCH):
                counts += counter(texts.slice(at, BATCH).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())],
                                             names=["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; no folder yet: none."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (n_tokens > limit).

    Encodes the distinct texts that the cache misses and appends their counts to it.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())     # one vocabulary file, a few MB
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), content.alias("content"),
                        F.unhex(F.sha2(content, 256)).alias("digest"))
    missing = keyed.select("digest", "content").join(
        read_cache(spark, cache_path, version).select("digest"), "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("content").alias("content"))
    new = distinct.mapInArrow(_encode(tokenizer_path.rsplit(".", 1)[-1], shared), "digest binary, n_tokens long")
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # stored, so that the join reads two plain exchanges and a frequent text's rows can be split
    counts = staged(read_cache(spark, cache_path, version), "token-counts")
    slim = keyed.select("id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
    return slim.join(counts, "digest", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
