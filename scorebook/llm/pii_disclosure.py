"""Operator 2, personal data with information-theoretic sanitisation [native].

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by pattern.  Their
values are the protected entities.  Terms of a document that holds an entity (all its words
outside the base spans, wherever they stand) may give it away even when it is cut out; the
corpus tells how strongly:

    IC(c) = -log2 p(c)                       information of the entity
    PMI(c; t) = log2 p(c, t) / (p(c) p(t))   what the term reveals of it

with p over documents: p(c), p(t) from all documents that hold c or t, p(c, t) from those that
hold both, smoothed towards independence by ``prior`` documents in which p(c, t) = p(c) p(t).
Entities count from one document on.  A term discloses c if PMI(c; t) >= share * IC(c).  In
documents that hold c, every occurrence of such a term is a span too: of kind ``drop`` (removed)
if PMI reaches ``drop_share`` * IC(c), else ``mask`` (generalised to its class: a number or a word).

Patterns run in linear time: possessive loops give the same matches as the plain patterns,
because nothing follows the loops that backtracking could help, and a match may only begin
where a run of its characters begins or where the match before ended.

PMI grows with p(c, t), which is at most the smaller of p(c) and p(t).  Pairs that fall short
even so are left out before they are counted; that loses no term, and a rare entity is joined
with rare terms only.

Every document is read three times (patterns and terms; counts of the terms; result).

Cases: a null text is empty; documents without entities are left alone; an entity in every
document has no information and no disclosing terms; a word that a base span cuts is no term;
equal rows count as documents of their own and get equal spans; an empty table gives an empty
result; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import let, staged
from scorebook.llm.unit_dedup import running

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the plain patterns of the contract, without their quadratic cases.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match has; texts without it skip the pattern.
MARK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])?+"
#: A word; in a text whose spans are NULs, one that no span cuts.
WORD = r"(?<![\p{L}\p{N}\x00])[\p{L}\p{N}]++(?!\x00)"
PLACE = {"drop": "", "number": "[number]", "word": "[word]"}


@dataclass(frozen=True)
class Disclosure:
    """``prior``: documents' weight of independence in p(c, t).
    ``share``, ``drop_share``: parts of the entity's information from which a term is masked or removed."""

    prior: float = 1.0
    share: float = 0.8
    drop_share: float = 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), let(digits, _luhn)).otherwise(F.lit(False))


SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Valid matches of one kind in a text: (start, end, kind's place, value)."""
    pattern, place = PATTERNS[kind], F.lit(KINDS.index(kind))

    def placed(both: Column) -> Column:
        # what lies between matches, and the matches, give the offsets
        sizes = F.transform(both["hits"], lambda h, i: F.length(F.get(both["gaps"], i)) + F.length(h))
        return F.zip_with(both["hits"], let(sizes, lambda s: F.zip_with(s, running(s), lambda x, b: x + b)),
                          lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"),
                                                place.alias("kind"), h.alias("value")))
    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"),
                         F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")),
                lambda both: F.when(F.size(both["hits"]) > 0, placed(both)).otherwise(F.array().cast(SPAN)))
    found = F.filter(found, lambda s: _valid(kind, s["value"]))
    may = F.contains(text, F.lit(MARK[kind])) if MARK[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
    return F.when(may, found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then kind in listed order."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.transform(
        F.concat(*(spans_of(whole, k) for k in KINDS)),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                           s["value"].alias("value"))))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a NUL for each character of the spans, at the same offsets; a NUL of its own becomes a space."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        gone = F.greatest(F.lit(0), s["end"] - F.greatest(acc["at"], s["start"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(
            acc["out"], F.concat(F.translate(kept, "\0", " "), F.repeat(F.lit("\0"), gone))).alias("out"))
    cut = F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.translate(F.substring(text, acc["at"] + 1, F.length(text)), "\0", " ")))
    return F.when(F.size(spans) > 0, cut).otherwise(F.translate(text, "\0", " "))


def _terms(blanked: Column) -> Column:
    """Distinct words, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blanked, F.lit(WORD), 0), lambda w: F.lower(w)))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, rule: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(entity, term, pmi, ic) of the terms that disclose an entity, and (uid, entity, term) of the
    documents' pairs that were counted.

    ``found``: stored rows of the documents with entities: ``uid``, ``entities`` and ``terms``.
    Counts run over all documents.
    """
    n = float(docs.count())
    held = found.select("uid", F.explode("entities").alias("entity"))
    n_entity = staged(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entity-counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = docs.select(text.alias("text")).filter(F.size(base_spans(F.col("text"))) == 0)
    every = others.select(F.explode(_terms(_blanked(F.col("text"), F.array().cast(SPAN)))).alias("term"), F.lit(0).alias("near"))
    every = every.union(found.select(F.explode("terms"), F.lit(1)))
    n_term = staged(every.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"), F.max("near").alias("near")).filter(
        "near = 1").drop("near"), "term-counts")
    ic = F.log2(F.lit(n) / F.col("n_entity"))

    def pmi(both: Column) -> Column:
        alone = F.col("n_entity") * F.col("n_term").cast("double")
        return F.log2((both + rule.prior * alone / (n * n)) * (n * n) / ((n + rule.prior) * alone))

    def telling(both: Column) -> Column:
        return (ic > 0) & (pmi(both) >= rule.share * ic)
    held = staged(held.join(n_entity, "entity"), "document-entities")
    words = staged(found.select("uid", F.explode("terms").alias("term")).join(n_term, "term"), "document-terms")
    pairs = staged(held.join(words, "uid").filter(telling(F.least("n_entity", "n_term"))), "entity-terms")
    counted = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_pair"))
    scored = counted.filter(telling(F.col("n_pair"))).select("entity", "term", pmi(F.col("n_pair")).alias("pmi"), ic.alias("ic"))
    return staged(scored, "disclosing"), pairs.select("uid", "entity", "term")


def _term_spans(text: Column, base: Column, drops: Column, masks: Column) -> Column:
    """Occurrences of the terms in a text, as spans of kind 4 (drop) or 5 (mask)."""
    def placed(both: Column) -> Column:
        sizes = F.transform(both["hits"], lambda h, i: F.length(F.get(both["gaps"], i)) + F.length(h))
        return F.zip_with(both["hits"], let(sizes, lambda s: F.zip_with(s, running(s), lambda x, b: x + b)),
                          lambda h, e: F.struct((e - F.length(h)).alias("start"),
                                                F.when(F.array_contains(drops, F.lower(h)), 4).when(
                                                    F.array_contains(masks, F.lower(h)), 5).alias("kind"),
                                                e.alias("end"), h.alias("value")))
    all_ = let(_blanked(text, base), lambda t: let(
        F.struct(F.split(t, WORD, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(WORD), 0).alias("hits")), placed))
    return F.filter(all_, lambda s: s["kind"].isNotNull())


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, "drop", "mask")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities and dropped terms cut out and masked terms replaced by their class;
    where spans overlap, the first one decides and the others cut what is left of them."""
    def put(s: Column) -> Column:
        return F.when(s["kind"] == 5, F.when(s["value"].rlike("^[0-9]"), F.lit(PLACE["number"])).otherwise(
            F.lit(PLACE["word"]))).when(s["kind"] == 4, F.lit(PLACE["drop"])).otherwise(
            F.concat(F.lit("["), F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"]), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(
            acc["out"], F.concat(kept, F.when(fresh, put(s)).otherwise(F.lit("")))).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: id, ``base`` and ``spans`` (arrays), ``text`` (sanitised).

    Rows are known by id and text digest, so equal rows get equal results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    box = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("text"))
    based = box.withColumn("base", base_spans(F.col("text")))
    found = staged(based.filter(F.size("base") > 0).select(
        "uid", "id", F.xxhash64("text").alias("h"), "base", _entities(F.col("base")).alias("entities"),
        _terms(_blanked(F.col("text"), F.col("base"))).alias("terms")), "entities")
    telling, pairs = disclosing_terms(found, docs, text_col, rule)
    telling = telling.select("entity", "term", (F.col("pmi") >= rule.drop_share * F.col("ic")).alias("drop"))
    # a document's terms: its own that disclose its own entities; equal rows have equal ones
    own = pairs.join(telling, ["entity", "term"]).groupBy("uid").agg(
        F.collect_set(F.when(F.col("drop"), F.col("term"))).alias("drops"),
        F.collect_set(F.when(~F.col("drop"), F.col("term"))).alias("masks"))
    known = found.select("uid", "id", "h", "base").join(own, "uid", "left").groupBy(
        F.col("id").alias("known_id"), F.col("h").alias("known_h")).agg(
        F.first("base").alias("base"), F.first("drops").alias("drops"), F.first("masks").alias("masks"))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    joined = keyed.join(known, F.col("id").eqNullSafe(F.col("known_id")) & (F.col("h") == F.col("known_h")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    base_col = F.coalesce("base", none)
    extra = F.when(F.size(F.coalesce("drops", F.array())) + F.size(F.coalesce("masks", F.array())) > 0,
                   _term_spans(F.col("text"), base_col, F.col("drops"), F.col("masks"))).otherwise(none)
    spans = F.array_sort(F.concat(base_col, extra))
    return joined.select(F.col("id").alias(id_col), base_col.alias("base"), spans.alias("spans"), F.col("text").alias("original")
                         ).select(id_col, "base", "spans", F.when(F.size("spans") == 0, F.col("original")).otherwise(
                             sanitised(F.col("original"), F.col("spans"))).alias("text"))


def disclosure_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: id, counts per kind, digest of the base spans, all spans, digest of the text."""
    out = sanitise(docs, id_col, text_col, rule)

    def of_kind(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    kinds = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(id_col, *kinds, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                      span_text(F.col("spans")).alias("spans"), F.sha2("text", 256).alias("text_sha256"))
