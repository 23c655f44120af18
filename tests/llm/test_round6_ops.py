"""Operator 10: rows that leave the key join, words of a line by a plain split, and bits looked up in numbers."""

import random

from pyspark.sql import functions as F

from scorebook.llm import common, line_join


def brute(lines):
    sets = [set(ln.split()) for ln in lines]
    return {j for j, b in enumerate(sets) if any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:j])}


def test_op10_unlike_lines_do_not_leave_the_join(spark, monkeypatch):
    """Sixty words make all lines, so most share keys; lines are of 30 words, and of 70 out of 140."""
    rng = random.Random(61)
    lines = [" ".join(rng.sample([f"w{i}" for i in range(60)], 30)) for _ in range(120)]
    lines += [" ".join(rng.sample([f"v{i}" for i in range(140)], 70)) for _ in range(60)]
    lines += [" ".join([*ln.split()[1:], "new"]) for ln in lines[::20]]
    rows, plain = [], line_join.staged

    def staged(df, own):
        out = plain(df, own)
        if own == "shared-keys":
            rows.append(out.count())
        return out
    monkeypatch.setattr(line_join, "staged", staged)
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in line_join.line_report(d, limits=line_join.ALL_LINES).collect() if r.n_removed}
    assert got == brute(lines) and len(got) == 9
    assert sum(rows) < 200


def test_op10_words_by_a_plain_split(spark):
    odd = ["a b c", "a", " a b", "a b ", "a  b", "a\tb", "a \x0b b", "a\x0cb c", "a b\r", "\ta", "  a", "a b c", "x" * 300 + " y"]
    d = spark.createDataFrame([(i, ln) for i, ln in enumerate(odd)], "i long, line string")
    for r in d.select("line", line_join._quick_words(F.col("line")).alias("quick"), common.words_of(F.col("line")).alias("words")).collect():
        assert r.quick == r.words, r.line


def test_bits_looked_up_in_numbers(spark):
    rng = random.Random(62)
    at = sorted({0, 7, 8, 63, 64, 32767, *(rng.randrange(32768) for _ in range(3000))})
    bits = spark.createDataFrame([(i,) for i in at], "i long").agg(F.bitmap_construct_agg("i").alias("b"))
    found = spark.range(32768).crossJoin(bits.select("b", common.bit_words(F.col("b")).alias("w"))).filter(
        common.has_bit_in(F.col("w"), F.col("id"))).select("id").collect()
    assert sorted(r.id for r in found) == at


def test_op10_settled_lines_are_paired_with_later_ones_only(spark):
    base = [f"word{i}" for i in range(40)]
    lines = [" ".join([*base[:39], f"v{i}"]) for i in range(30)]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    table = line_join.distinct_lines(d, "doc_id", "text", line_join.ALL_LINES)
    ranks = sorted((r["first"], r["lid"]) for r in table.select("first", "lid").collect())

    def rows(open_line):
        settled = table.filter(F.col("lid") != open_line).select("lid")
        return [(r.a, r.b) for t in line_join.shared_keys(table, line_join.ALL_LINES, settled) for r in t.collect()]
    assert rows(ranks[0][1]) == []
    last = rows(ranks[-1][1])
    assert {b for _, b in last} == {ranks[-1][1]} and len({a for a, _ in last}) == 29
