"""Operator 4, substring dedup by hashing lines, paragraphs, sentences or clauses.

Texts are cut into units (lines; paragraphs between blank lines; sentences or clauses within
lines).  A unit's content is its
words joined by single spaces, in lower case if asked for; its digest has 128 bits.  Digests
are grouped over all documents; of equal units the one with the earliest rank (document id,
then offset) stays and the rest is removed.  Every removed unit keeps its offsets in the
original text (code points, end exclusive, without the line break).

``passage_report`` does this for all kinds at once: units of each kind are held against those of
the same kind, in one grouping, and what any kind removes is removed.  So a passage inside
otherwise different lines goes as far as whole sentences or clauses of it are equal.

Spark's aggregation combines copies before the shuffle, so a unit that a third of all documents
share arrives as one row a task; the join back touches only units with copies, and a frequent
one is split by adaptive skew handling.

Cases: null and empty texts have no units; blank units and units of fewer than ``least`` words
are never removed; a null id ranks last; rows with equal id and text get equal decisions (a
repeated row keeps what the first keeps); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import let, staged, unused, words_of

#: What ends a unit.
BREAKS = {"line": r"\n", "paragraph": r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*",
          "sentence": r"\n|(?<=[.!?])[\x20\x09\x0B-\x0D]+", "clause": r"\n|(?<=[.!?,;:])[\x20\x09\x0B-\x0D]+"}
KINDS = tuple(BREAKS)
LEAST = 5


def _before(numbers: Column) -> Column:
    """Sums of the numbers before each place (quadratic: for short arrays)."""
    return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                       lambda acc, x: F.struct((acc["at"] + x).alias("at"),
                                               F.array_append(acc["out"], acc["at"]).alias("out")),
                       lambda acc: acc["out"])


def running(numbers: Column, block: int = 256) -> Column:
    """Sums of the numbers before each place, block by block, so long arrays stay cheap."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")),
                      lambda b: F.slice(numbers, b * block + 1, block))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return F.flatten(F.zip_with(blocks, _before(sums), lambda x, o: F.transform(_before(x), lambda y: y + o)))
    return let(cut, joined)


def units(text: Column, kind: str) -> Column:
    """Array of (unit, start, end) of a text, in order."""
    whole = F.coalesce(text, F.lit(""))
    if kind == "line":
        parts = F.transform(F.split(whole, BREAKS[kind]), lambda u: F.struct(
            u.alias("unit"), F.length(u).alias("n"), F.lit(1).alias("gap")))
    else:
        def paired(both: Column) -> Column:
            return F.transform(both["units"], lambda u, i: F.struct(
                u.alias("unit"), F.length(u).alias("n"),
                F.coalesce(F.length(F.get(both["gaps"], i)), F.lit(0)).alias("gap")))
        parts = let(F.struct(F.split(whole, BREAKS[kind]).alias("units"),
                             F.regexp_extract_all(whole, F.lit(BREAKS[kind]), 0).alias("gaps")), paired)

    def starts(p: Column) -> Column:
        lengths = F.transform(p, lambda x: x["n"] + x["gap"])
        return F.zip_with(p, let(lengths, running), lambda x, s: F.struct(
            x["unit"].alias("unit"), s.alias("start"), (s + x["n"]).alias("end")))
    return let(parts, starts)


def _rank(id_col: Column, start: Column) -> Column:
    return (F.coalesce(id_col.cast("decimal(20,0)"), F.lit(str(10 ** 19)).cast("decimal(20,0)"))
            * F.lit(10 ** 10).cast("decimal(11,0)") + start.cast("decimal(10,0)")).cast("decimal(38,0)")


def unit_table(docs: DataFrame, id_col: str, text_col: str, kind: str, least: int, fold_case: bool) -> DataFrame:
    """(id, h, start, end, rank, two digests) of all units that take part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"),
                      F.inline(units(text, kind)))
    words = words_of(F.lower("unit") if fold_case else F.col("unit"))
    sized = cut.select("id", "h", "start", "end", words.alias("words")).filter(F.size("words") >= least)
    content = F.array_join("words", " ")
    return sized.select("id", "h", "start", "end", _rank(F.col("id"), F.col("start")).alias("rank"),
                        F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(7), content).alias("k2"))


def removed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line",
                  least: int = LEAST, fold_case: bool = True) -> DataFrame:
    """(id, h, start, end) of every unit with an earlier equal one."""
    table = unit_table(docs, id_col, text_col, kind, least, fold_case)
    first = table.groupBy("k1", "k2").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # stored, so that the join reads two plain exchanges and a frequent unit's rows can be split
    first = staged(first.drop("n"), "first-units")
    return table.join(first, ["k1", "k2"]).filter(F.col("rank") > F.col("first")).select(
        "id", "h", "start", "end")


def _per_text(gone: DataFrame) -> DataFrame:
    return gone.groupBy(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line",
                 least: int = LEAST, fold_case: bool = True) -> DataFrame:
    """``docs`` with repeated units cut out of the text (the break after a unit goes with it)
    and one more column ``removed``: (start, end) spans in the original text, null if none."""
    gone = _per_text(removed_units(docs, id_col, text_col, kind, least, fold_case))
    box, = unused(docs, "removed")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    joined = docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text) == gone["gone_h"]), "left")
    glue = "\n" if kind == "line" else "\n\n"
    rest = let(gone["gone"]["start"], lambda g: F.array_join(F.transform(F.filter(
        units(text, kind), lambda u: ~F.array_contains(g, u["start"])), lambda u: u["unit"]), glue))
    new = F.when(gone["gone"].isNull(), docs[f"`{text_col}`"]).otherwise(rest)
    return joined.select(*(new.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns),
                         gone["gone"].alias(box))


def unit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line",
                least: int = LEAST, fold_case: bool = True) -> DataFrame:
    """One row per document: id, units removed, characters removed, spans ``start:end`` by start."""
    gone = _per_text(removed_units(docs, id_col, text_col, kind, least, fold_case))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n_chars"))
    joined = slim.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    none = F.coalesce(F.col("gone"), F.array().cast("array<struct<start:int,end:int>>"))
    return joined.select(
        F.col("id").alias(id_col), "n_chars", F.size(none).cast("long").alias("n_removed"),
        F.aggregate(none, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("chars_removed"),
        F.array_join(F.transform(none, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))),
                     ",").alias("removed_spans"))


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS,
                     least: int = LEAST, fold_case: bool = True) -> DataFrame:
    """(id, h, start, end, kind) of every unit with an earlier equal one of its kind; ``kind`` is its place in ``kinds``."""
    tables = [unit_table(docs, id_col, text_col, k, least, fold_case).drop("rank").withColumn("kind", F.lit(i))
              for i, k in enumerate(kinds)]
    table = tables[0]
    for more in tables[1:]:
        table = table.union(more)
    table = staged(table, "units")
    rank = _rank(F.col("id"), F.col("start"))
    first = staged(table.groupBy("kind", "k1", "k2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1").drop("n"), "first-units")
    return table.join(first, ["kind", "k1", "k2"]).filter(rank > F.col("first")).select("id", "h", "start", "end", "kind")


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS,
                   least: int = LEAST, fold_case: bool = True) -> DataFrame:
    """One row per document: id, units removed, characters they cover, spans ``kind:start:end`` by start."""
    gone = removed_passages(docs, id_col, text_col, kinds, least, fold_case).groupBy(
        F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n_chars"))
    joined = slim.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    none = F.coalesce(F.col("gone"), F.array().cast("array<struct<start:int,end:int,kind:int>>"))
    # spans of different kinds overlap: a character counts once
    covered = F.aggregate(none, F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["at"], s["start"]))).alias("sum")), lambda a: a["sum"])
    names = F.array(*(F.lit(k) for k in kinds))
    return joined.select(
        F.col("id").alias(id_col), "n_chars", F.size(none).cast("long").alias("n_removed"), covered.alias("chars_removed"),
        F.array_join(F.transform(none, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed_spans"))


def oracle_sql() -> str:
    """DuckDB SQL of the query (lines, lower case, least words)."""
    ws = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT k, doc_id, unnest(string_split(t, chr(10))) AS u, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
o AS (SELECT *, (sum(length(u) + 1) OVER (PARTITION BY k ORDER BY i) - length(u) - 1)::bigint AS s FROM l),
n AS (SELECT *, s + length(u) AS e, regexp_extract_all(lower(u), '{ws}') AS w FROM o),
f AS (SELECT *, min((doc_id::hugeint * 10000000000 + s)) OVER (PARTITION BY array_to_string(w, ' ')) AS first
      FROM n WHERE len(w) >= {LEAST}),
g AS (SELECT k, count(*) AS c, sum(e - s) AS x, string_agg(s || ':' || e, ',' ORDER BY s) AS spans
      FROM f WHERE doc_id::hugeint * 10000000000 + s > first GROUP BY k)
SELECT doc_id, length(t)::bigint AS n_chars, coalesce(c, 0)::bigint AS n_removed, coalesce(x, 0)::bigint AS chars_removed,
       coalesce(spans, '') AS removed_spans FROM d LEFT JOIN g ON g.k = d.k"""
