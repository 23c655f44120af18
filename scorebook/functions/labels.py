"""Free-text model answer -> class label, as native Column expressions.

The parser is compiled once from a :class:`LabelSpec` into regexes and literal maps;
no Python runs per row.  Branches, first success wins:

1. the whole stripped answer equals a label (case-insensitive);
2. ``DIAGNOSIS: <words>``: the first such match; its capture (which runs over spaces
   and line breaks) must equal a label or alias as a whole;
3. the first ``{...}`` without inner braces parsed as a JSON object; keys tried in
   priority order, each value must equal a label or alias (last duplicate key wins;
   single quotes are not JSON);
4. any alias of a label as whole words, labels tried in label order;
5. (strict mode only) the last bare label in the text.

``compat`` mode reproduces the order above exactly, including the capture that runs
across a line break and the unreachable branch 5; ``strict`` stops the branch-2
capture at the end of the line and tries branch 5 before branch 4.

Character classes are spelled out so that they mean the same thing in Java regexes
and in other engines: whitespace is exactly the set of characters Python's
``str.strip`` removes, and a word character is a letter, a digit or ``_``.  Whole-word
tests consume the neighbouring character instead of using ``\\b``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.config import LabelSpec

# --- fixed values: character classes ------------------------------------------------
# whitespace removed by str.strip(): \t \n \v \f \r, U+001C..U+001F, space, U+0085,
# U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
WS_IN = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# whitespace that does not end a line (strict mode capture)
HWS_IN = r"\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
W_IN = r"\p{L}\p{N}_"
# the same whitespace characters as a plain string, for trim()
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
# -------------------------------------------------------------------------------------

WS = f"[{WS_IN}]"
W = f"[{W_IN}]"
NOT_W = f"[^{W_IN}]"
STRIP_RE = f"^{WS}+|{WS}+\\z"
JSON_RE = r"\{[^{}]*\}"


def diagnosis_re(strict: bool = False) -> str:
    body = f"[{W_IN}{HWS_IN}]*" if strict else f"[{W_IN}{WS_IN}]*"
    sep = f"[{HWS_IN}]*" if strict else f"{WS}*"
    return f"DIAGNOSIS{sep}:{sep}({W}{body})"


def escape_literal(text: str) -> str:
    """Backslash-escape ASCII punctuation so the alias matches literally."""
    return "".join("\\" + ch if (ord(ch) < 128 and not ch.isalnum() and ch != " ") else ch
                   for ch in text)


def whole_words_re(alternatives: Sequence[str]) -> str:
    alt = "|".join(escape_literal(a) for a in alternatives)
    return f"(?:^|{NOT_W})(?:{alt})(?:{NOT_W}|\\z)"


def alias_table(spec: LabelSpec) -> dict[str, str]:
    """lower-case key -> label; a key claimed by two labels goes to the earlier one."""
    table: dict[str, str] = {}
    for label in spec.labels:
        for key in [label.lower(), *spec.aliases.get(label, [])]:
            table.setdefault(key.lower(), label)
    return table


def strip_ws(col: Column) -> Column:
    """L0 strip: remove the whitespace set from both ends.  ``trim`` with an explicit
    character set is linear; a regex form such as ``ws+$`` rescans every internal
    whitespace run and becomes quadratic on long runs."""
    return F.trim(col, F.lit(WS_CHARS))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    expr = None
    for k, label in table.items():
        expr = F.when(key == k, F.lit(label)) if expr is None else expr.when(key == k, F.lit(label))
    return expr if expr is not None else F.lit(None).cast("string")


def _guarded_lookup(key: Column, table: dict[str, str]) -> Column:
    """Lookup of ``lower(key)``, skipped (null) when ``key`` is longer than every table
    key: no match is possible, and lower-casing a whole document is avoided."""
    longest = max((len(k) for k in table), default=0)
    return F.when(F.length(key) <= F.lit(longest), _lookup(F.lower(key), table))


def match_alias(col: Column, spec: LabelSpec) -> Column:
    """Trimmed, lower-cased equality with a label or one of its aliases."""
    return _guarded_lookup(strip_ws(col), alias_table(spec))


def branch_exact(s: Column, spec: LabelSpec) -> Column:
    """L1: the whole stripped answer equals a label, case-insensitively."""
    table: dict[str, str] = {}
    for label in spec.labels:
        table.setdefault(label.lower(), label)
    return _guarded_lookup(s, table)


def branch_diagnosis(s: Column, spec: LabelSpec, strict: bool = False) -> Column:
    """L2: first ``DIAGNOSIS: <words>`` match; the whole capture must be a label or alias."""
    cap = F.regexp_extract(s, "(?iu)" + diagnosis_re(strict), 1)
    return F.when(cap != "", match_alias(cap, spec))


def _key_is(key: str):
    return lambda e: e["key"] == F.lit(key)


def branch_json(s: Column, spec: LabelSpec) -> Column:
    """L3: first brace pair without inner braces as a JSON object; keys in priority order."""
    js = F.regexp_extract(s, JSON_RE, 0)
    obj = F.from_json(js, "map<string,string>", {"allowSingleQuotes": "false"})
    picks = []
    for key in spec.json_keys:
        # last entry with this key: a repeated key keeps its final value
        entry = F.try_element_at(F.filter(F.map_entries(obj), _key_is(key)), F.lit(-1))
        picks.append(match_alias(entry["value"], spec))
    return F.when(js != "", F.coalesce(*picks))


def branch_alias(s: Column, spec: LabelSpec) -> Column:
    """L4: first label, in label order, with any alias present as whole words (one
    alternation regex per label)."""
    expr = None
    for label in spec.labels:
        words = [label.lower(), *spec.aliases.get(label, [])]
        hit = s.rlike("(?iu)" + whole_words_re(words))
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr


def branch_last_label(s: Column, spec: LabelSpec) -> Column:
    """Last bare label in the text (reachable in ``strict`` mode only)."""
    alt = "|".join(escape_literal(x) for x in spec.labels)
    found = F.regexp_extract_all(s, F.lit(f"(?iu)(?:^|{NOT_W})({alt})(?={NOT_W}|\\z)"), F.lit(1))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    return _lookup(F.lower(last), {x.lower(): x for x in spec.labels})


def label_from_stripped(s: Column, spec: LabelSpec, mode: str = "compat") -> Column:
    """Coalesce of the branches over an already stripped answer (lazy: stops at the
    first branch that yields a label)."""
    if mode not in ("compat", "strict"):
        raise ValueError("mode must be 'compat' or 'strict'")
    strict = mode == "strict"
    branches = [branch_exact(s, spec), branch_diagnosis(s, spec, strict), branch_json(s, spec)]
    if strict:
        branches += [branch_last_label(s, spec), branch_alias(s, spec)]
    else:
        branches += [branch_alias(s, spec), branch_last_label(s, spec)]
    return F.coalesce(*branches)


def parse_labels(df: DataFrame, text_col: str = "raw_output",
                 out_col: str = "predicted_label", spec: LabelSpec | None = None,
                 mode: str = "compat", with_branch: bool = False) -> DataFrame:
    """Add ``out_col`` (label or null) and ``parse_success`` (P16) to ``df``.

    The stripped answer is computed once in its own projection; ``with_branch`` adds
    ``parse_branch`` (1-5, 0 = nothing found), which evaluates every branch.
    """
    spec = spec or LabelSpec()
    tmp = "__stripped"
    raw = F.col(text_col)
    staged = df.withColumn(tmp, F.when(raw.isNotNull() & (raw != ""), strip_ws(raw)))
    s = F.col(tmp)
    if not with_branch:
        out = staged.withColumn(out_col, label_from_stripped(s, spec, mode))
    else:
        strict = mode == "strict"
        names = ["b1", "b2", "b3", "b4", "b5"]
        exprs = [branch_exact(s, spec), branch_diagnosis(s, spec, strict), branch_json(s, spec),
                 branch_alias(s, spec), branch_last_label(s, spec)]
        order = [0, 1, 2, 4, 3] if strict else [0, 1, 2, 3, 4]
        staged = staged.withColumns({f"__{n}": e for n, e in zip(names, exprs)})
        cols = [F.col(f"__{names[i]}") for i in order]
        branch = None
        for i in order:
            c = F.col(f"__{names[i]}").isNotNull()
            branch = F.when(c, F.lit(i + 1)) if branch is None else branch.when(c, F.lit(i + 1))
        out = (staged.withColumn(out_col, F.coalesce(*cols))
                     .withColumn("parse_branch", branch.otherwise(F.lit(0)))
                     .drop(*[f"__{n}" for n in names]))
    return out.withColumn("parse_success", F.col(out_col).isNotNull()).drop(tmp)
