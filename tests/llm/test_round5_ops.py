"""Operator 10: keys of two neighbouring tokens, their exactness, and the tables it leaves behind."""

import os
import random
from collections import Counter

import pytest

from scorebook.llm import line_join
from scorebook.llm.common import shared_dir


def removed(spark, lines, limits):
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in line_join.line_report(d, limits=limits).collect() if r.n_removed}


def brute(lines, num, den):
    sets = [set(ln.split()) for ln in lines]
    return {j for j, b in enumerate(sets) if any(den * len(a & b) >= num * len(a | b) for a in sets[:j])}


def test_op10_unlike_lines_share_few_keys(spark, monkeypatch):
    """A thousand words make all lines, so many share a rare word by chance; hardly any share two in a row."""
    rng = random.Random(51)
    lines = [" ".join(rng.sample([f"w{i}" for i in range(1000)], 20)) for _ in range(300)]
    rows, plain = [], line_join.staged

    def staged(df, own):
        out = plain(df, own)
        if own == "shared-keys":
            rows.append(out.count())
        return out
    monkeypatch.setattr(line_join, "staged", staged)
    before = set(os.listdir(f"{shared_dir(spark)}/scorebook-llm")) if os.path.isdir(f"{shared_dir(spark)}/scorebook-llm") else set()
    assert removed(spark, lines, line_join.ALL_LINES) == brute(lines, 4, 5)
    count = Counter(w for ln in lines for w in ln.split())
    heads = Counter(w for ln in lines for w in sorted(ln.split(), key=lambda w: (count[w], w))[:5])
    single = sum(n * (n - 1) // 2 for n in heads.values())      # rows that a join on single prefix tokens makes
    assert len(rows) == line_join.ROUNDS and 5 * sum(rows) < single
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(f"{shared_dir(spark)}/scorebook-llm")) - before}
    assert left <= {"later-lines", "line-verdicts"}


@pytest.mark.parametrize("num, den", [(4, 5), (3, 5), (1, 2)])
def test_op10_thresholds_against_all_pairs(spark, num, den):
    """Lines at and just below the threshold: words taken out, put in and exchanged."""
    rng = random.Random(num * 10 + den)
    words = [f"w{i}" for i in range(400)]
    lines = []
    for _ in range(30):
        base = rng.sample(words, rng.randrange(1, 30))
        lines.append(" ".join(base))
        for _ in range(4):
            out, new = rng.randrange(0, len(base) // 3 + 1), rng.randrange(0, len(base) // 3 + 2)
            w = rng.sample(base, len(base) - out) + rng.sample(words, new)
            lines.append(" ".join(w))
    rng.shuffle(lines)
    assert removed(spark, lines, line_join.LineLimits(num, den, 1)) == brute(lines, num, den)
