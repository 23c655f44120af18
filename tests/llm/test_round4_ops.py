"""Operators 5, 7 and 10 on alike groups: rows that leave a step grow with the members, not their pairs."""

import random

from scorebook.llm import host_rules, line_join, probminhash


def counted(monkeypatch, module, name):
    """Row counts of the tables that ``module`` stores under ``name``."""
    seen, plain = [], module.staged

    def staged(df, own):
        out = plain(df, own)
        if own == name:
            seen.append(out.count())
        return out
    monkeypatch.setattr(module, "staged", staged)
    return seen


def alike(rng, k, n, changed):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    out = [list(base) for _ in range(k)]
    for i, w in enumerate(out):
        for p in rng.sample(range(n), changed):
            w[p] = f"v{i}x{p}"
    return [" ".join(w) for w in out]


def test_op10_alike_lines_make_no_pair_list(spark, monkeypatch):
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30))]
    for i in range(60):
        w = lines[0].split()
        w[i % 30] = f"v{i}"
        lines.append(" ".join(w))
    d = spark.createDataFrame([(i, ln) for i, ln in enumerate(lines)], "doc_id long, text string").repartition(3)
    pairs = counted(monkeypatch, line_join, "line-pairs")
    got = {r.doc_id: r.removed for r in line_join.line_report(d, limits=line_join.ALL_LINES).collect()}
    assert got == {i: "0" if i else "" for i in range(61)}
    assert len(pairs) == 1 and pairs[0] <= 60


def test_op7_alike_texts_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """In blocks of 16, so links are also found between blocks."""
    rng = random.Random(4)
    monkeypatch.setattr(probminhash, "BLOCK", 16)
    texts = alike(rng, 40, 200, 4)          # similarity of two: about 0.7
    texts += [t + " end" for t in texts[:5]]        # and five links
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    links = counted(monkeypatch, probminhash, "across")
    got = {r.doc_id: r.class_id for r in probminhash.class_report(d).collect()}
    assert got == {i: i if i < 40 else i - 40 for i in range(45)}
    assert len(links) == 1 and links[0] <= 45


def test_op5_texts_are_measured_once(spark, monkeypatch):
    calls, plain = [], host_rules.quality
    monkeypatch.setattr(host_rules, "quality", lambda text: calls.append(1) or plain(text))
    rows = [(i, "one two three four " * (i % 3) + " ".join(f"a{i}b{k}" for k in range(30 * (i % 2))), f"h{i % 4}", "x")
            for i in range(60)] + [(None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, quality_of_text string").repartition(3)
    got = host_rules.keep_good(d)
    assert len(calls) == 1 and got.columns == d.columns
    want = {r.doc_id for r in host_rules.judge_documents(d).collect() if r.kept}
    assert {tuple(r) for r in got.collect()} == {r for r in rows if r[0] in want} and want
