"""Poisson(1) draws from md5(id|replicate|seed), for blocks of ids and replicates at once.

The draws are those of ``poisson1_weight(uniform_from_key(...))``: the first 52 bits of the digest
against the cumulated shares.  A block's digests are computed by columns in numpy, since the digest
of a short key is one round of 32-bit arithmetic; the first 16 bits decide all but some 3 in 10,000
draws, the others and long keys go to ``hashlib``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

#: Digests computed at once: their columns stay in a core's cache.
AT_ONCE = 1 << 15
ONE_BLOCK = 55      # bytes of a key that fit one md5 block
UNCLEAR = 255


def _poisson1_cdf(max_k: int = 18) -> list[float]:
    """P(X <= k) for X ~ Poisson(1), k = 0..max_k (the tail beyond is < 1e-16)."""
    out, term, acc = [], math.exp(-1.0), 0.0
    for k in range(max_k + 1):
        if k > 0:
            term /= k
        acc += term
        out.append(acc)
    return out


POISSON1_CDF = _poisson1_cdf()
#: u < c for u = bits / 2 ** 52 is bits < the least whole number from c * 2 ** 52 on.
_LIMITS = np.array([math.ceil(c * 2 ** 52) for c in POISSON1_CDF], dtype=np.int64)
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1)
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_bits() -> np.ndarray:
    """Draw by the digest's first two bytes as they lie in a little-endian word."""
    top = np.arange(1 << 16, dtype=np.int64)
    low = np.searchsorted(_LIMITS, top << 36, side="right")
    high = np.searchsorted(_LIMITS, (top << 36) + ((1 << 36) - 1), side="right")
    draw = np.where(low == high, low, UNCLEAR).astype(np.uint8)
    word = np.arange(1 << 16)
    return draw[((word & 0xFF) << 8) | (word >> 8)]


_FIRST_BITS = _first_bits()


def _exact(key: bytes) -> int:
    bits = int(hashlib.md5(key).hexdigest()[:13], 16)
    return int(np.searchsorted(_LIMITS, bits, side="right"))


def _words(parts: Sequence[bytes], at: int, total: int) -> np.ndarray:
    """16 x n: the message words of byte strings of one length that begin at byte ``at``."""
    out = np.zeros((len(parts), 64), np.uint8)
    size = len(parts[0])
    out[:, at:at + size] = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), size)
    if at + size == total:
        out[:, total] = 0x80
        out[:, 56:58] = np.frombuffer((8 * total).to_bytes(2, "little"), np.uint8)
    return np.ascontiguousarray(out.view("<u4").T)


def _first_word(ids: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """First 32 bits of the md5 of every message ``ids[:, i] | reps[:, j]``, one block each."""
    shape = ids.shape[1], reps.shape[1]
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    # a word that only one side has is added along that side
    words = [reps[g][None, :] if not ids[g].any() else ids[g][:, None] if not reps[g].any()
             else ids[g][:, None] | reps[g][None, :] for g in range(16)]
    words = [w.reshape(-1)[0] if (w == w.reshape(-1)[0]).all() else w for w in words]
    for i in range(61):     # the first word of the digest is set by step 60
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (7 * i) % 16
        np.add(a, f, out=a)
        w = words[g]
        if isinstance(w, np.ndarray):
            np.add(a, w, out=a)
            w = 0
        np.add(a, np.uint32((_SINES[i] + int(w)) & 0xFFFFFFFF), out=a)
        s = int(_SHIFTS[i])
        np.left_shift(a, np.uint32(s), out=t)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])


def poisson_draws(ids: Sequence[str | None], first: int, last: int, seed: int) -> np.ndarray:
    """ids x replicates ``first`` .. ``last - 1``: the Poisson(1) draw of each, as bytes.

    The key is the id, the replicate and the seed joined by ``|``; a null id is left out of it."""
    heads = [b"" if i is None else i.encode() + b"|" for i in ids]
    tails = [f"{r}|{seed}".encode() for r in range(first, last)]
    out = np.empty((len(heads), len(tails)), np.uint8)
    rows_of: dict[int, list[int]] = {}
    for n, h in enumerate(heads):
        rows_of.setdefault(len(h), []).append(n)
    cols_of: dict[int, list[int]] = {}
    for n, t in enumerate(tails):
        cols_of.setdefault(len(t), []).append(n)
    for size, rows in rows_of.items():
        for more, cols in cols_of.items():
            if size + more > ONE_BLOCK:
                for i in rows:
                    out[i, cols] = [_exact(heads[i] + tails[j]) for j in cols]
                continue
            rep_words = _words([tails[j] for j in cols], size, size + more)
            step = max(1, AT_ONCE // len(cols))
            for s in range(0, len(rows), step):
                some = rows[s:s + step]
                id_words = _words([heads[i] for i in some], 0, -1) if size else np.zeros((16, len(some)), np.uint32)
                word = _first_word(id_words, rep_words)
                draw = _FIRST_BITS[word & np.uint32(0xFFFF)]
                for i, j in zip(*np.nonzero(draw == UNCLEAR)):
                    draw[i, j] = _exact(heads[some[i]] + tails[cols[j]])
                out[np.ix_(some, cols)] = draw
    return out


from scorebook._ship import ship  # noqa: E402

ship(__name__)
