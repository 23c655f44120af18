"""Operator 11, periodic run detection by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, at least ``max(MIN_LENGTH, 2 q)``
words long, that no neighbouring word extends keeping period q.  Per text:

1. every position of such a run lies in a window of ``MIN_LENGTH / 2`` words that stands twice or
   more in the text (the run without its last, and without its first q words cover it, and both
   are that long).  Hashed windows mark those positions; a collision only marks too many.  The
   marked stretches hold each run whole, and the rest of the text none;
2. a suffix automaton of the stretch gives the tree of its suffix links;
3. the words are appended one after the other.  An access of the link-cut tree at a word's prefix
   state recolours the path to the root with the new end; the path comes as segments of one
   former colour each.  A segment whose longest suffix has ``hi`` words, with the next one's
   ``lo``, and the former end ``d`` words back, is a square of period d ending here exactly if
   ``lo < d <= hi``, and every square of primitive root is found so;
4. squares of one period at successive ends are one run, from the first one's start.

Documents are independent: one pass, no shuffle; texts of any length are read whole, memory is
a few hundred bytes a word of the longest marked stretch.

Cases: null and empty texts have no words and no run; equal texts give equal results; repeated
rows come back each; an empty table gives an empty result; extra columns do not matter.  Ids are
integers; a null id leaves the text as it is where ids change it (``planted``).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook._ship import ship

ship(__name__)

MIN_LENGTH = 12
WORD = re.compile("[^\x20\x09-\x0D]+")
#: Odd 64-bit factor of the window hash.
FACTOR = 0x9E3779B97F4A7C15


def marked_stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """[from, to) stretches of positions in windows whose hash stands twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    mixed ^= mixed >> np.uint64(29)
    key = mixed[:n].copy()
    for k in range(1, window):
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key += mixed[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n + 1, dtype=np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    cover[:n] += twice[:n]
    cover[window:window + n] -= twice[:n]
    inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def suffix_automaton(seq: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest length, suffix link, state of each prefix); state 0 is the empty word."""
    step, length, link, prefix = [{}], [0], [-1], []
    last = 0
    for c in seq:
        state = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        prefix.append(state)
        last = state
    return length, link, prefix


class LastEnds:
    """Link-cut tree over the suffix links: where each state's words last ended.

    Node 0 stands for none (the empty word has no end of interest).  The nodes of one splay tree
    are a vertical path that one access coloured; the colour is kept at the splay tree's root.
    """

    def __init__(self, link: Sequence[int], length: Sequence[int]) -> None:
        n = len(link)
        self.up = [max(x, 0) for x in link]
        self.left = [0] * n
        self.right = [0] * n
        self.colour = [-1] * n
        self.length = length

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (p := up[top]) and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._lift(p if (left[g] == p) == (left[p] == x) else x)
            self._lift(x)

    def _lift(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x] = g
        up[p] = x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from ``state`` to the root; its former segments, longest first, as
        (former end, longest length)."""
        up, right, colour, length = self.up, self.right, self.colour, self.length
        seen, below, x = [], 0, state
        while x:
            self._splay(x)
            deeper = right[x]
            if deeper:
                colour[deeper] = colour[x]
            seen.append((colour[x], length[x]))
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
        self._splay(state)
        return seen


def runs_in(seq: Sequence[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``seq``, by start, then period."""
    length, link, prefix = suffix_automaton(seq)
    ends = LastEnds(link, length)
    found: list[list[int]] = []         # start, end, period
    latest: dict[int, list[int]] = {}
    for i, state in enumerate(prefix):
        path = ends.access(state, i)
        path.append((-1, 0))
        for (before, hi), (_, lo) in zip(path, path[1:]):
            d = i - before
            if before >= 0 and lo < d <= hi:
                run = latest.get(d)
                if run is not None and run[1] == i - 1:
                    run[1] = i
                else:
                    run = latest[d] = [i - 2 * d + 1, i, d]
                    found.append(run)
    return sorted((s, e - s + 1, d) for s, e, d in found if e - s + 1 >= min_length)


def runs_of_words(words: Sequence[str], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words."""
    n = len(words)
    if n < min_length:
        return []
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    out = []
    for a, b in marked_stretches(ids, (min_length + 1) // 2):
        if b - a >= min_length:
            out += [(a + s, k, d) for s, k, d in runs_in(ids[a:b].tolist(), min_length)]
    return sorted(out)


def kept_words(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words without those that some run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g] if runs else list(words)


def with_planted_run(doc_id: int | None, words: list[str]) -> list[str]:
    """The query's contract: one document in ten gets a periodic tail, placed by its id's crc32."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def _per_document(planted: bool, min_length: int):
    def words_and_runs(batch: pa.RecordBatch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = WORD.findall(text)
            if planted:
                words = with_planted_run(doc_id, words)
            yield doc_id, words, runs_of_words(words, min_length)
    return words_and_runs


def document_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, planted: bool = False) -> DataFrame:
    """One row per run: doc_id, start (word number), length, period."""
    each = _per_document(planted, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *r) for doc_id, _, runs in each(batch) for r in runs]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "period"])
    return _read(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_length: int = MIN_LENGTH, planted: bool = False) -> DataFrame:
    """doc_id, text with each run cut to its first period (words joined by one space; a text
    without a run as it came), n_dropped words."""
    each = _per_document(planted, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, dropped = [], [], []
            for (doc_id, words, runs), text in zip(each(batch), batch.column(1).to_pylist()):
                kept = kept_words(words, runs)
                ids.append(doc_id)
                texts.append(" ".join(kept) if runs or planted else text)
                dropped.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()),
                                              pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_dropped"])
    return _read(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_dropped long")


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, " \
         "runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_length: int = MIN_LENGTH, planted: bool = True) -> DataFrame:
    """One row per document: number of runs, the longest one (ties: smallest start, then period;
    no run: nulls) and digests of the run list and of the collapsed text."""
    each = _per_document(planted, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, words, runs in each(batch):
                best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                listed = "".join(f"{s},{k},{d}\n" for s, k, d in runs)
                rows.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                             hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                             names=[f.split()[0] for f in REPORT.split(", ")])
    return _read(docs, id_col, text_col).mapInArrow(run, REPORT)
