"""Operator 10, near-duplicate lines by an exact set-similarity join [native].

A line's token set is the set of its words.  Two lines match if the Jaccard similarity of
their token sets is at least ``num / den`` (4/5).  Lines rank by (document id, line number);
every line that matches an earlier line is removed.

1. Tokens are ordered by length, longest first; ties are ordered by the digest.  Any fixed order is
   exact; this one puts frequent tokens last, as these are short, and takes no pass over the texts.
2. Equal lines are grouped by a 128-bit digest; a group keeps its first rank, its size |x|, a
   word of 64 bits and its keys.  A bit of the word is one if an odd number of tokens falls on it, so
   lines differ in as many tokens as in bits, at least.  No text is moved for this.
   A key is a token together with the one before it (the first token stands alone), in the order
   of the tokens.  Of o shared tokens each has its key in both lines unless a token of
   one line only stands right before it, so lines that share o tokens share o - (|x| - o) - (|y| - o)
   keys at least: for t > 1/2 the first |x| + 1 - ceil((2t - 1) |x|) keys (the prefix) of matching
   lines have one in common.  Two words select far better than one: few lines share a key by chance.
   For t <= 1/2 keys are single tokens and the prefix is the first |x| - ceil(t |x|) + 1.
3. Before any pair is listed, lines are grouped by their first three keys, and each
   is verified with one earlier line, the first of a group.  Lines that match are settled: they
   are not looked at again as the later side, so a cluster of k alike lines makes k pairs.
4. Prefix keys join under the filters on length (t |y| <= |x|) and on differing bits, for pairs with a line
   not yet settled, one share of the keys after the other.  What leaves the join is nearly always alike.
   Per pair the shared prefix keys are counted: with all keys of the larger rest they must suffice
   for the keys that a match shares.
5. Candidates are verified on the words themselves.  Texts come from another read of the documents; a
   runtime filter of at most 8 MB keeps other lines out of the shuffle.

Distinct lines are numbered in any order; which line of a pair is the later one is read from the ranks;
the join leaves out what a rounded rank already tells.
Stored tables are deleted as soon as the next step has read them.

The prefix join's longest lists belong to keys that many lines share; adaptive skew splitting divides such a key, and no list is collected into a row.

Cases: null and empty texts have no lines to remove; lines of fewer than ``least`` distinct
words are never removed nor matched; a null id ranks after all ids; rows with equal id and
text get equal decisions; an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorebook.llm.common import SPACES, bit_words, has_bit_in, let, released, staged, thinned, unused, words_of

#: Shares in which the prefix keys are joined.
ROUNDS = 2
#: Lines of more tokens than this have 128 bits.
WIDE = 64


@dataclass(frozen=True)
class LineLimits:
    """``num / den``: least Jaccard similarity.  ``least``: distinct words a line needs to take part."""

    num: int = 4
    den: int = 5
    least: int = 5


#: Every line with a word takes part: the limits of the query and of the pipeline.
ALL_LINES = LineLimits(least=1)


def _rank(id_col: str, line: Column) -> Column:
    """Order of lines as one number: id, then line number; null ids last."""
    return (F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(str(10 ** 19)).cast("decimal(20,0)"))
            * F.lit(10 ** 10).cast("decimal(11,0)") + line.cast("decimal(10,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text digest, number, line) of the lines that hold a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"),
                       F.posexplode(F.split(text, "\n")).alias("no", "line")).filter(
        F.btrim("line", F.lit(SPACES)) != "")


def _tokens(line: Column) -> Column:
    return F.array_distinct(_quick_words(line))


def _quick_words(line: Column) -> Column:
    """The words of a line that is not blank; one plain split where single spaces stand between them."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for space in SPACES.strip(" "):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, words_of(line)).otherwise(F.split(line, " "))


def _ordered(line: Column) -> Column:
    """Distinct tokens of a line, longest first, as numbers: 7 bits of length (longer ones go last), 57 of digest."""
    def number(w: Column) -> Column:
        return F.shiftleft(F.octet_length(w).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 7))
    return F.sort_array(F.array_distinct(F.transform(_quick_words(line), number)), asc=False)


def _flipped(tokens: Column, one: Callable[[Column], Column]) -> Column:
    """64 bits; each token flips the bit that its digest falls on, or leaves it if ``one`` is 0."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(
        F.call_function("shiftleft", one(t), F.hash(t))))     # shifts count modulo 64


def _parities(tokens: Column) -> list[Column]:
    """Whether an odd number of tokens falls on each of 64 bits, and for lines of more than ``WIDE`` tokens
    the same for half of the tokens, which makes it 128 bits."""
    half = _flipped(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1).cast("long")))
    return [_flipped(tokens, lambda t: F.lit(1).cast("long")).alias("bits"),
            F.when(F.size(tokens) > WIDE, half).otherwise(F.lit(0).cast("long")).alias("half")]


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _paired(limits: LineLimits) -> bool:
    return 2 * limits.num > limits.den


def _prefix_size(n: Column, limits: LineLimits) -> Column:
    if _paired(limits):
        return n + 1 - _ceil_div(n * (2 * limits.num - limits.den), limits.den)
    return n - _ceil_div(n * limits.num, limits.den) + 1


def _needed(n: Column, limits: LineLimits) -> Column:
    """Overlap that Jaccard >= t needs: t / (1 + t) of both sizes."""
    return F.ceil(n * limits.num / F.lit(float(limits.num + limits.den)) - 1e-9)


def _needed_keys(n: Column, limits: LineLimits) -> Column:
    """Keys that lines of ``n`` tokens together share if they match (see step 2)."""
    return 3 * _needed(n, limits) - n if _paired(limits) else _needed(n, limits)


def _keys(tok: Column, limits: LineLimits) -> Column:
    """The prefix: 32 bits of a key will do in the join, as a clash adds a candidate, which does not pass step 5."""
    heads = F.slice(tok, 1, F.greatest(F.lit(0), _prefix_size(F.size(tok), limits)))
    if _paired(limits):
        return F.transform(heads, lambda t, i: F.hash(F.get(tok, i - 1), t))
    return F.transform(heads, lambda t: F.hash(t))


def _alike_size(nx: Column, ny: Column, limits: LineLimits) -> Column:
    """Length filter."""
    return (nx * limits.num <= ny * limits.den) & (ny * limits.num <= nx * limits.den)


def _may_match(x: str, y: str, limits: LineLimits) -> Column:
    """Length and bit filter for two lines given as table or struct names: each token of one line only
    flips one bit."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits"))
    half = F.col(f"{x}.half").bitwiseXOR(F.col(f"{y}.half"))
    alone = F.when(F.least(nx, ny) > WIDE, F.bit_count(half) + F.bit_count(bits.bitwiseXOR(half))).otherwise(F.bit_count(bits))
    return _alike_size(nx, ny, limits) & (alone <= nx + ny - 2 * _needed(nx + ny, limits))


def _digests(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, limits: LineLimits) -> DataFrame:
    """(lid, k1, k2, first rank, copies, n, bits, half, prefix) of all distinct lines that take part,
    stored; ``lid`` is any number of its own."""
    def shape(tok: Column) -> Column:
        return F.struct(F.size(tok).alias("n"), *_parities(tok), _keys(tok, limits).alias("prefix"))
    lines = _lines(docs, id_col, text_col).select(
        *_digests(F.col("line")), _rank("id", F.col("no")).alias("rank"), let(_ordered(F.col("line")), shape).alias("s"))
    # short lines go after the grouping: a filter before it would work the tokens out twice
    return staged(lines.groupBy("k1", "k2").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("s").alias("s")).filter(
        F.col("s.n") >= limits.least).select(
        F.monotonically_increasing_id().alias("lid"), "k1", "k2", "first", "copies", "s.n", "s.bits", "s.half", "s.prefix"), "lines")


def first_guesses(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """(a, b): at most one earlier line for each line, the first of those with one of its first three
    keys that passes the filters.  No pair is listed for it."""
    rows = lines.select(F.explode(F.slice("prefix", 1, 3)).alias("key"), F.struct("first", "lid", "n", "bits", "half").alias("y"))
    found = rows.withColumn("x", F.min("y").over(Window.partitionBy("key"))).filter(
        (F.col("x.lid") != F.col("y.lid")) & _may_match("x", "y", limits))
    votes = found.groupBy(F.col("y.lid").alias("b"), F.col("x.lid").alias("a")).agg(F.count(F.lit(1)).alias("both"))
    return _best(votes)


def _best(pairs: DataFrame) -> DataFrame:
    """(a, b): the earlier line with most keys in common."""
    return pairs.groupBy("b").agg(F.max(F.struct("both", (-F.col("a")).alias("a"))).alias("top")).select(
        (-F.col("top.a")).alias("a"), "b")


def shared_keys(lines: DataFrame, limits: LineLimits, settled: DataFrame | None = None) -> list[DataFrame]:
    """(a, b, least), stored: a row for each prefix key that two lines share which pass the filters, with the
    number of such rows a match needs.  Lines in ``settled`` (lid) are paired with later ones that
    are not, only.  The keys are
    joined in ``ROUNDS`` shares, so only one share of them is on disk at a time."""
    # a settled line's number is below zero, so both sides of the join read one exchange
    mark = F.col("lid")
    if settled is not None:
        bits = settled.groupBy(F.bitmap_bucket_number("lid").alias("bucket")).agg(
            bit_words(F.bitmap_construct_agg(F.bitmap_bit_position("lid"))).alias("done"))
        # one bit a line: at 100 million lines some 13 MB
        lines = lines.join(F.broadcast(bits), F.bitmap_bucket_number("lid") == F.col("bucket"), "left")
        mark = F.when(has_bit_in(F.col("done"), F.bitmap_bit_position("lid")), -F.col("lid") - 1).otherwise(F.col("lid"))
    na, nb = F.col("x.n"), F.col("y.n")
    rest = F.greatest(*(n - _prefix_size(n, limits) for n in (na, nb)))
    a = F.when(F.col("x.mark") < 0, -F.col("x.mark") - 1).otherwise(F.col("x.mark"))
    # y is never settled, and a pair comes once; said of both sides together, or the filter would part their exchange.
    # A settled x that is the later one for certain is of no use: a rounded rank is enough to know most of them
    once = F.when(F.col("x.mark") < 0, (F.col("y.mark") >= 0) & (F.col("x.about") <= F.col("y.about"))).otherwise(
        F.col("x.mark") < F.col("y.mark"))

    def joined(share: int) -> DataFrame:
        # never null, and no lambda: a null check on one side or a variable's number would keep the sides
        # from reading one exchange
        posts = lines.select(F.coalesce(mark, F.lit(0).cast("long")).alias("mark"), F.col("first").cast("float").alias("about"),
                             "n", "bits", "half", F.explode("prefix").alias("key")).filter(
            F.pmod("key", F.lit(ROUNDS)) == share)
        x, y = posts.alias("x"), posts.alias("y")
        return x.join(y, (F.col("x.key") == F.col("y.key")) & once & _may_match("x", "y", limits)).select(
            a.alias("a"), F.col("y.mark").alias("b"), (_needed_keys(na + nb, limits) - rest).cast("int").alias("least"))
    return [staged(joined(i), "shared-keys") for i in range(ROUNDS)]


def candidate_pairs(shared: list[DataFrame]) -> DataFrame:
    """(a, b): numbers of two lines that pass all filters."""
    rows = shared[0]
    for more in shared[1:]:
        rows = rows.union(more)
    return rows.groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("both")).filter(
        F.col("both") >= F.col("least")).select("a", "b")


def _texts(docs: DataFrame, lines: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(lid, first, line) of the wanted lines, stored.  A line's text is that of its first rank."""
    want = staged(lines.select("lid", "k1", "k2", "first").join(ids, "lid", "left_semi"), "wanted-lines")
    rows = _lines(docs, id_col, text_col).select("id", "no", "line", _digests(F.col("line"))[0])
    rows = thinned(rows, "k1", want.select("k1"), quick=True)
    rows = rows.select(F.col("k1").alias("t1"), _digests(F.col("line"))[1].alias("t2"), _rank("id", F.col("no")).alias("rank"), "line")
    found = want.join(rows, F.col("k1") == F.col("t1")).filter((F.col("k2") == F.col("t2")) & (F.col("rank") == F.col("first")))
    texts = staged(found.select("lid", "first", "line").dropDuplicates(["lid"]), "line-texts")
    released(want)
    return texts


def _words_match(x: Column, y: Column, limits: LineLimits) -> Column:
    """Whether the token sets of two lines are alike.  One value, as a filter that names a part of it twice
    works the words out twice."""
    return let(F.struct(_tokens(x).alias("x"), _tokens(y).alias("y")), lambda t: let(
        F.size(F.array_intersect(t["x"], t["y"])),
        lambda i: i * limits.den >= (F.size(t["x"]) + F.size(t["y"]) - i) * limits.num))


def _later(pairs: DataFrame, texts: DataFrame, limits: LineLimits) -> DataFrame:
    """Number of the later line of each pair (a, b) whose words match."""
    both = pairs.select("a", "b").join(texts.toDF("a", "first_a", "line_a"), "a").join(texts.toDF("b", "first_b", "line_b"), "b")
    later = F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a"))
    checked = both.filter(_words_match(F.col("line_a"), F.col("line_b"), limits))
    return staged(checked.select(later.alias("lid")).distinct(), "later-lines")


def matching_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, limits: LineLimits) -> DataFrame:
    """Numbers of the distinct lines that match an earlier line."""
    guesses = staged(first_guesses(lines, limits), "line-guesses")
    texts = _texts(docs, lines, _numbers(guesses), id_col, text_col)
    settled = _later(guesses, texts, limits)
    released(texts)
    shared = shared_keys(lines, limits, settled)
    known = guesses.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    pairs = staged(candidate_pairs(shared).join(
        known, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti"), "line-pairs")
    released(guesses, *shared)
    texts = _texts(docs, lines, _numbers(pairs), id_col, text_col)
    rest = _later(pairs, texts, limits)
    released(texts, pairs)
    return settled.union(rest).distinct()


def _numbers(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  limits: LineLimits = LineLimits()) -> DataFrame:
    """(id, h, removed): numbers of the removed lines of each text that loses some."""
    lines = distinct_lines(docs, id_col, text_col, limits)
    late = matching_lines(docs, lines, id_col, text_col, limits).withColumn("late", F.lit(True))
    # only lines with copies or an earlier match can go
    verdict = staged(lines.select("lid", "k1", "k2", "first", "copies").join(late, "lid", "left").filter(
        F.col("late") | (F.col("copies") > 1)).select("k1", "k2", "first", F.coalesce("late", F.lit(False)).alias("late")), "line-verdicts")
    released(lines)
    all_lines = _lines(docs, id_col, text_col).select("id", "h", "no", "line", _digests(F.col("line"))[0])
    all_lines = thinned(all_lines, "k1", verdict.select("k1"), quick=True)
    all_lines = all_lines.select("id", "h", "no", _rank("id", F.col("no")).alias("rank"), "k1", _digests(F.col("line"))[1])
    gone = all_lines.join(verdict, ["k1", "k2"]).filter(F.col("late") | (F.col("rank") > F.col("first")))
    return gone.groupBy("id", "h").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 limits: LineLimits = LineLimits()) -> DataFrame:
    """``docs`` with the removed lines taken out of the text, other columns as they came, and
    one more column ``removed`` (line numbers, null if none)."""
    gone = removed_lines(docs, id_col, text_col, limits).toDF("gone_id", "gone_h", "gone")
    box, = unused(docs, "removed")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    joined = docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text) == gone["gone_h"]), "left")
    rest = let(gone["gone"], lambda g: F.array_join(F.filter(
        F.split(text, "\n"), lambda x, i: ~F.array_contains(g, i)), "\n"))
    new = F.when(gone["gone"].isNull(), docs[f"`{text_col}`"]).otherwise(rest)
    return joined.select(*(new.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns),
                         gone["gone"].alias(box))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per document: id, lines, removed lines (count and comma-joined numbers)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"),
                       F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    gone = removed_lines(docs, id_col, text_col, limits).toDF("gone_id", "gone_h", "gone")
    joined = slim.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    return joined.select(F.col("id").alias(id_col), "n_lines",
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))
