"""Operator 1, sampled SentencePiece segmentations without replacement (Gumbel top-k).

A text's lattice has the characters of its normalised form as nodes and vocabulary pieces as
arcs; a segmentation is a path, with probability proportional to the product of its pieces'
weights.  Backward sums over the lattice give exact arc probabilities, so a segmentation can
be drawn piece by piece.  The k segmentations of largest perturbed score (log-probability plus
Gumbel noise) are k distinct draws without replacement.  They are found by an A-star search
over the lattice, without listing paths: a region is a path prefix and the arcs that may not
follow it; its best perturbed score is a Gumbel variable of the region's mass, cut at the score
of the region it was split from.  The search pops the region of largest score, draws its best
path, and splits the rest of the region along that path.

Inclusion: with kappa the (k + 1)-th largest perturbed score, a segmentation is among the k with
probability 1 - exp(-exp(log p - kappa)), the score of the usual unbiased estimators.

All noise is a digest of (seed, row key, draw, place), so equal rows get equal samples whatever
the partitioning.

No piece spans two characters that are neighbours in no piece; there the lattice is cut into
units without changing the distribution, and equal units share their sums within a task.

Weights: a unigram model's scores are log-probabilities.  A BPE model has only merge ranks as
scores; there a piece weighs 1 / (2 + rank).  A character that is no piece is spelled by
its byte pieces (or the unknown piece), as the library does.

Cases: null and empty texts have the one empty segmentation; a text with fewer than k
segmentations gives all of them, with inclusion 1; a null key is a key like any other; equal
rows give equal results; texts are never cut; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook._ship import ship

ship(__name__)

SCHEMA = ("id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double, "
          "round_trip boolean")
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACE = "▁"
CACHED_UNITS = 400_000      # units whose sums a task holds at once
ROWS = 128                  # texts worked on together
#: Noise has 53 bits, so no draw reaches regions whose prefix has a probability below e^-100.
DEEP = 100.0


def uniform(key, draw: int, place):
    """Numbers in (0, 1) from uint64 keys, a draw number and uint64 places."""
    import numpy as np
    x = place * np.uint64(MIX2)
    x += key + np.uint64((draw * MIX1 + GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, MIX1), (27, MIX2)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0 ** -53
    return out


class Vocabulary:
    """Pieces of a model: digests of all their prefixes, log-weights, bytes for decoding."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        text = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i)
                                             or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        score = np.array([self.sp.get_score(i) for i in range(n)])
        whole = all(float(score[i]).is_integer() for i in plain)
        self.log_weight = np.zeros(n)
        if whole:       # merge ranks
            self.log_weight[plain] = -np.log(2.0 + np.arange(len(plain)))
        else:
            self.log_weight[plain] = score[plain]
        self.spell_weight = float(self.log_weight[plain].min()) - 10.0
        self.byte_id = {}
        self.decoded = [b""] * n
        for i in plain:
            self.decoded[i] = text[i].replace(SPACE, " ").encode()
        for i in range(n):
            if self.sp.is_byte(i):
                self.byte_id[int(text[i][1:-1], 16)] = i
                self.decoded[i] = bytes([int(text[i][1:-1], 16)])
        self.unknown = self.sp.unk_id()
        # prefixes: digest -> piece id, or -1 if the prefix is no piece
        known: dict[int, int] = {}
        base = GOLDEN | 1
        for i in plain:
            h = 0
            for c in text[i]:
                h = (h * base + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, -1)
            known[h] = i
        self.base = np.uint64(base)
        known = {h * MIX1 & 0xFFFFFFFFFFFFFFFF: i for h, i in known.items()}
        self.keys = np.array(sorted(known), np.uint64)
        self.keys = np.append(self.keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.piece = np.array([*(known[k] for k in sorted(known)), -1], np.int64)
        self.bucket = np.searchsorted(self.keys, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        # neighbours inside pieces
        chars = sorted({c for i in plain if len(text[i]) > 1 for c in text[i]})
        self.char_no = np.zeros(0x110000, np.int32)
        for j, c in enumerate(chars):
            self.char_no[ord(c)] = j + 1
        self.near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for i in plain:
            c = self.char_no[np.frombuffer(text[i].encode("utf-32-le"), np.uint32)]
            self.near[c[:-1], c[1:]] = True

    def look_up(self, h):
        """(found, piece or -1) per digest: a table by the first bits, then the keys in order."""
        import numpy as np
        h = h * np.uint64(MIX1)
        at = self.bucket[(h >> np.uint64(46)).astype(np.int64)]
        low = np.flatnonzero(self.keys[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < h[low]]
        return self.keys[at] == h, self.piece[at]

    def spell(self, char: int) -> list[int]:
        if len(self.byte_id) == 256:
            return [self.byte_id[b] for b in chr(char).encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def spelled(self, chars):
        """The one piece that spells a character, or -1 - character if it takes several."""
        import numpy as np
        if len(self.byte_id) < 256:
            return np.full(len(chars), self.unknown)
        table = np.array([self.byte_id[b] for b in range(128)])
        return np.where(chars < 128, table[np.minimum(chars, 127)], -1 - chars)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids))


class Growing:
    """Arrays that grow at the end, with room to spare so that growing is cheap."""

    def __init__(self, **empty):
        self.room = dict(empty)
        self.view(**{k: len(v) for k, v in empty.items()})

    def view(self, **sizes):
        for k, n in sizes.items():
            setattr(self, k, self.room[k][:n])

    def grow(self, **more):
        import numpy as np
        for k, values in more.items():
            n = len(getattr(self, k))
            if n + len(values) > len(self.room[k]):
                wider = np.empty(2 * (n + len(values)), self.room[k].dtype)
                wider[:n] = self.room[k][:n]
                self.room[k] = wider
            self.room[k][n:n + len(values)] = values
            self.view(**{k: n + len(values)})


class Lattices(Growing):
    """Arcs of units: per node (unit, place) its arcs by falling probability."""

    def __init__(self, vocab: Vocabulary):
        import numpy as np
        self.v = vocab
        self.unit: dict[str, int] = {}
        super().__init__(
            first_node=np.zeros(0, np.int64),       # by unit
            length=np.zeros(0, np.int64),
            only=np.zeros(0, bool),                 # by unit: it has one segmentation
            ptr=np.zeros(1, np.int64),              # by node, into the arcs
            step=np.zeros(0, np.int16),             # by arc: characters it spans
            piece=np.zeros(0, np.int32),            # piece, or -1 - code point to be spelled
            log_p=np.zeros(0), upto=np.zeros(0),    # its probability, and cumulated within the node
            rest=np.zeros(0))                       # log-probability of the arcs beside it

    def units(self, parts: list[str]):
        """Numbers of the units, new ones added."""
        import numpy as np
        if len(self.unit) > CACHED_UNITS:
            self.__init__(self.v)
        get = self.unit.get
        found = [get(p, -1) for p in parts]
        if -1 in found:
            new = list(dict.fromkeys(p for p, f in zip(parts, found) if f < 0))
            self._add(new)
            found = [f if f >= 0 else get(p) for p, f in zip(parts, found)]
        return np.array(found, np.int64)

    def _add(self, new: list[str]) -> None:
        import numpy as np
        length = np.array([len(p) for p in new], np.int64)
        cps = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        end = np.repeat(np.cumsum(length), length)          # end of each character's unit
        at = np.arange(len(cps))
        starts, steps, pieces = [], [], []
        live, h, n = at, np.zeros(len(cps), np.uint64), 0
        while len(live):
            n += 1
            h = h * self.v.base + cps[live + n - 1] + np.uint64(1)
            found, piece = self.v.look_up(h)
            hit = found & (piece >= 0)
            starts.append(live[hit])
            steps.append(np.full(hit.sum(), n))
            pieces.append(piece[hit])
            if n == 1:      # characters that are no piece are spelled
                odd = ~hit
                starts.append(live[odd])
                steps.append(np.ones(odd.sum(), np.int64))
                pieces.append(self.v.spelled(cps[live[odd]].astype(np.int64)))
            go = found & (live + n < end[live])
            live, h = live[go], h[go]
        start, step, piece = (np.concatenate(x).astype(np.int64) for x in (starts, steps, pieces))
        odd_arc = np.zeros(len(start), bool)
        odd_arc[len(starts[0]):len(starts[0]) + len(starts[1])] = True
        weight = np.where(odd_arc, self.v.spell_weight, self.v.log_weight[np.maximum(piece, 0)])
        # backward sums, by distance from the unit's end; a node's arcs stand together
        left = end[start] - start
        order = np.lexsort((start, left))
        start, step, piece, weight, left = start[order], step[order], piece[order], weight[order], left[order]
        beta = np.zeros(len(cps) + 1)                        # of a character as a start
        value = np.zeros(len(start))
        head = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        levels = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        for lo, hi in zip(levels, np.r_[levels[1:], len(left)]):
            s = slice(lo, hi)
            last = step[s] == left[s]
            v = weight[s] + np.where(last, 0.0, beta[np.minimum(start[s] + step[s], len(cps))])
            value[s] = v
            heads = head[np.searchsorted(head, lo):np.searchsorted(head, hi)] - lo
            top = np.maximum.reduceat(v, heads)
            wide = np.repeat(top, np.diff(np.r_[heads, hi - lo]))
            beta[start[lo:hi][heads]] = top + np.log(np.add.reduceat(np.exp(v - wide), heads))
        log_p = value - beta[start]
        order = np.lexsort((-log_p, start))
        start, step, piece, log_p = start[order], step[order], piece[order], log_p[order]
        counts = np.bincount(start, minlength=len(cps))
        ptr = np.r_[0, np.cumsum(counts)]
        total = np.r_[0.0, np.cumsum(np.exp(log_p))]
        upto = total[1:] - total[ptr[:-1]][start]
        upto[ptr[1:] - 1] = 2.0                              # the last arc takes what is left
        first = len(self.ptr) - 1
        self.unit.update(zip(new, range(len(self.unit), len(self.unit) + len(new))))
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(np.exp(log_p), 1.0))
        rest[(counts[start] == 1) | (log_p > -1e-13)] = -np.inf      # nothing stands beside the arc
        self.grow(first_node=first + np.cumsum(length) - length, length=length,
                  only=np.add.reduceat(counts > 1, np.cumsum(length) - length) == 0,
                  ptr=self.ptr[-1] + ptr[1:], step=step, piece=piece, log_p=log_p, upto=upto, rest=rest)

    def draw(self, unit, key, place, number: int):
        """One path through each unit: (arcs in order, arcs per unit, places of the arcs)."""
        import numpy as np
        node, left = self.first_node[unit].copy(), self.length[unit].copy()
        who, at = np.arange(len(unit)), place.copy()
        key = key.copy()
        rounds = []
        while len(who):
            arc = self.ptr[node]
            choice = np.flatnonzero(~self.only[unit[who]])
            u = uniform(key[choice], number, at[choice].astype(np.uint64))
            off = np.flatnonzero(u > self.upto[arc[choice]])
            more, u = choice[off], u[off]
            while len(more):
                arc[more] += 1
                off = np.flatnonzero(u > self.upto[arc[more]])
                more, u = more[off], u[off]
            rounds.append((who, arc, at))
            n = self.step[arc]
            go = np.flatnonzero(left > n)
            n = n[go]
            who, node, left, at, key = who[go], node[go] + n, left[go] - n, at[go] + n, key[go]
        n_arcs = np.zeros(len(unit), np.int64)
        for who, _, _ in rounds:
            n_arcs[who] += 1
        offset = np.cumsum(n_arcs) - n_arcs
        arcs, places = np.zeros(n_arcs.sum(), np.int64), np.zeros(n_arcs.sum(), np.int64)
        for k, (who, arc, at) in enumerate(rounds):
            arcs[offset[who] + k], places[offset[who] + k] = arc, at
        return arcs, n_arcs, places


class Path:
    """One segmentation and its open regions: per arc the best perturbed score beside it."""

    def __init__(self, lat: Lattices, arcs, places, score: float, key, number: int, split_from: int):
        import numpy as np
        self.arcs, self.places, self.score = arcs, places, score
        log_p = lat.log_p[arcs]
        self.log_prob = float(log_p.sum())
        self.without: dict[int, list[int]] = {}
        # regions behind a prefix of probability below e^-DEEP are left unopened
        before, n = np.zeros(0), 256
        while True:
            before = np.cumsum(log_p[:n]) - log_p[:n]
            if n >= len(log_p) or before[-1] < -DEEP:
                break
            n *= 4
        self.before = before
        mass = before + lat.rest[arcs[:n]]
        noise = np.log(-np.log(uniform(key, 1000 + number, places[:n].astype(np.uint64))))
        self.best = -np.logaddexp(-score, noise - mass)
        self.best[mass == -np.inf] = -np.inf
        self.best[:split_from] = -np.inf


def top_paths(lat: Lattices, unit, key, draws, lengths_before, k: int):
    """The k paths of one text of largest perturbed score, and kappa.

    ``draws``: k independent paths as (arcs, arcs per unit, places); ``lengths_before``: place of each unit.
    """
    import numpy as np
    gumbel = -np.log(-np.log(uniform(key, 999, np.zeros(1, np.uint64))))
    paths = [Path(lat, draws[0][0], draws[0][2], float(gumbel[0]), key, 0, 0)]
    while True:
        at = [int(p.best.argmax()) if len(p.best) else -1 for p in paths]
        best = [p.best[i] if i >= 0 else -np.inf for p, i in zip(paths, at)]
        which = int(np.argmax(best))
        kappa = float(best[which])
        if len(paths) == k or kappa == -np.inf:
            return paths, kappa
        parent, t, q = paths[which], at[which], len(paths)
        place = int(parent.places[t])
        u_no = int(np.searchsorted(lengths_before, place, side="right")) - 1
        base, end = int(lengths_before[u_no]), int(lengths_before[u_no] + lat.length[unit[u_no]])
        first = int(lat.first_node[unit[u_no]])
        out = parent.without.setdefault(t, [int(parent.arcs[t])])
        node = first + place - base
        free = [a for a in range(int(lat.ptr[node]), int(lat.ptr[node + 1])) if a not in out]
        p = np.exp(lat.log_p[free])
        cut = np.cumsum(p) / p.sum()
        x = float(uniform(key, 2000 + q, np.array([place], np.uint64))[0])
        arc = free[min(int(np.searchsorted(cut, x)), len(free) - 1)]
        tail, tail_at = [arc], [place]
        place += int(lat.step[arc])
        while place < end:      # the rest of the unit
            node = first + place - base
            lo = int(lat.ptr[node])
            x = float(uniform(key, 2000 + q, np.array([place], np.uint64))[0])
            while x > lat.upto[lo]:
                lo += 1
            tail.append(lo)
            tail_at.append(place)
            place += int(lat.step[lo])
        arcs, n_arcs, places = draws[q]
        rest = int(n_arcs[:u_no + 1].sum())
        paths.append(Path(lat, np.concatenate([parent.arcs[:t], tail, arcs[rest:]]),
                          np.concatenate([parent.places[:t], tail_at, places[rest:]]), kappa, key, q, t + 1))
        # what is left of the region
        out.append(arc)
        free = [a for a in free if a != arc]
        if free:
            mass = parent.before[t] + np.log(np.exp(lat.log_p[free]).sum())
            noise = -np.log(uniform(key, 3000 + q, np.array([parent.places[t]], np.uint64)))[0]
            parent.best[t] = -np.logaddexp(-kappa, np.log(noise) - mass)
        else:
            parent.best[t] = -np.inf


def piece_ids(lat: Lattices, arcs):
    import numpy as np
    ids = lat.piece[arcs]
    if len(ids) and ids.min() < 0:
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i >= 0 else lat.v.spell(-1 - i)
        return np.array(out, np.int32)
    return ids


def sample_texts(lat: Lattices, texts: list[str], keys, k: int):
    """Per text a list of (ids, log-probability, perturbed score, inclusion, decodes to the text)."""
    import numpy as np
    norms = lat.v.sp.normalize(texts)
    sizes = np.array([len(n) for n in norms], np.int64)
    whole = "".join(norms)
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_at = np.cumsum(sizes) - sizes
    if len(cps):
        no = lat.v.char_no[cps]
        cut = np.ones(len(cps), bool)
        cut[1:] = ~lat.v.near[no[:-1], no[1:]]
        cut[text_at[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        edges = [*starts.tolist(), len(whole)]
        unit = lat.units([whole[a:b] for a, b in zip(edges, edges[1:])])
    else:
        starts = unit = np.zeros(0, np.int64)
    text_of = np.searchsorted(text_at + sizes, starts, side="right")
    place = starts - text_at[text_of] if len(starts) else starts
    draws = [lat.draw(unit, keys[text_of], place, r) for r in range(k)]
    first_unit = np.searchsorted(text_of, np.arange(len(texts) + 1))
    arc_at = [np.r_[0, np.cumsum(n)] for _, n, _ in draws]
    out = []
    for i, norm in enumerate(norms):
        lo, hi = first_unit[i], first_unit[i + 1]
        own = []
        for (arcs, n, places), at in zip(draws, arc_at):
            s = slice(at[lo], at[hi])
            own.append((arcs[s], n[lo:hi], places[s]))
        paths, kappa = top_paths(lat, unit[lo:hi], keys[i:i + 1], own, place[lo:hi], k)
        want = norm.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        rows = []
        for p in paths:
            ids = piece_ids(lat, p.arcs)
            inclusion = 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(700.0, p.log_prob - kappa))))
            rows.append((ids, p.log_prob, p.score, inclusion, lat.v.decode(ids.tolist()) == want))
        out.append(rows)
    return out


def _run(shared, k: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        lat = None
        schema = pa.schema([("id", pa.int64()), ("rank", pa.int32()), ("ids", pa.list_(pa.int32())),
                            ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()),
                            ("round_trip", pa.bool_())])
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if lat is None:
                    lat = Lattices(Vocabulary(shared.value))
                keys = batch.column("key").to_numpy().view(np.uint64)
                found = sample_texts(lat, batch.column("content").to_pylist(), keys, k)
                n = [len(rows) for rows in found]
                flat = [r for rows in found for r in rows]
                ids = np.concatenate([r[0] for r in flat]) if flat else np.zeros(0, np.int32)
                offsets = np.r_[0, np.cumsum([len(r[0]) for r in flat])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), n))),
                    pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32)) if n else pa.array([], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                    *(pa.array([r[c] for r in flat], t) for c, t in ((1, pa.float64()), (2, pa.float64()), (3, pa.float64()), (4, pa.bool_())))],
                    schema=schema)
    return run


def sample_segmentations(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                         k: int = 2, seed: int = 1) -> DataFrame:
    """Up to ``k`` rows a document, by falling perturbed score: id, ``rank``, ``ids`` (pieces),
    ``log_prob``, ``perturbed``, ``inclusion`` and ``round_trip`` (the pieces decode to the text)."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())    # one model file, under a MB
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    return slim.mapInArrow(_run(shared, k), SCHEMA).withColumnRenamed("id", id_col)


def segmentation_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                        k: int = 2, seed: int = 1) -> DataFrame:
    """The samples with a digest in place of their pieces."""
    return sample_segmentations(docs, model_path, id_col, text_col, k, seed).select(
        id_col, "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("pieces_digest"),
        "log_prob", "perturbed", "inclusion", "round_trip")
