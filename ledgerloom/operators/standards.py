"""References to standards, rules and schemes in text, with the section they stand in.

A text is cut into words, numbers and signs, and each kind of reference is a small rule over
these tokens. Rules run in Arrow batches, and only on texts that hold a trigger; aliases of
schemes, headings, phases and passages are array functions of the same row. No join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import ACCENTED, UNACCENTED, collapse, fold
from ledgerloom.operators.skew import skew_rank
from ledgerloom.operators.spans import find_spans, window_around

# --- fixed values: words of references, and widths ---------------------------------------------
BODIES = {"lvs", "en", "iso", "iec"}
UNIONS = {"eu", "ec", "eec", "es", "ek", "eek"}
NUMBER_WORDS = {"nr", "no"}
EVIDENCE_CHARS, MAX_EVIDENCE, MEANING_CHARS = 150, 4, 70
CLAUSE_CHARS, LABEL_CHARS = 80, 20
# ----------------------------------------------------------------------------------------------

#: without one of these in it a text holds no reference
_TRIGGER = r"(?iu)\b(?:lvs|en|iso|iec)[\s\p{Z}/0-9]|ministru kabineta|[0-9]/[0-9]|turpm"
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
_FOLD = str.maketrans(ACCENTED, UNACCENTED)


@dataclass(frozen=True)
class Catalog:
    """Schemes with their folded aliases, markers of sections, cues of self-defined schemes: the caller's data."""

    schemes: dict[str, list[str]] = field(default_factory=dict)
    markers: dict[str, list[str]] = field(default_factory=dict)
    cues: list[str] = field(default_factory=list)


class Token(NamedTuple):
    text: str
    start: int
    stop: int


class Reference(NamedTuple):
    category: str
    name: str
    start: int
    stop: int


class TokenText:
    """A text as tokens, with what the rules ask: does a token touch the next one, does a word end here."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [Token(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def word(self, i: int) -> str:
        return self.tokens[i].text.lower() if 0 <= i < len(self.tokens) else ""

    def number(self, i: int, least: int, most: int) -> bool:
        return self.word(i).isdecimal() and least <= len(self.word(i)) <= most

    def touches(self, i: int) -> bool:
        """Token i stands right after token i - 1."""
        return 0 < i < len(self.tokens) and self.tokens[i].start == self.tokens[i - 1].stop

    def begins(self, i: int) -> bool:
        return not (self.touches(i) and self._wordlike(i - 1))

    def ends(self, i: int) -> bool:
        return not (self.touches(i + 1) and self._wordlike(i + 1))

    def _wordlike(self, i: int) -> bool:
        return self.word(i)[:1].isalnum() or self.word(i) == "_"

    def sign(self, i: int, sign: str) -> bool:
        return self.word(i) == sign and self.touches(i)

    def made(self, category: str, name: str, first: int, last: int) -> Reference:
        return Reference(category, name, self.tokens[first].start, self.tokens[last].stop)


def standard_at(t: TokenText, i: int) -> tuple[Reference, int] | None:
    """Bodies, then a number of 3-5 digits with an optional part and year: ``(reference, last token)``."""
    if t.word(i) not in BODIES or not t.begins(i):
        return None
    j = i
    while t.word(j) in BODIES and (j == i or not t.touches(j)):
        joint = t.word(j) == "iso" and t.sign(j + 1, "/") and t.word(j + 2) == "iec" and t.touches(j + 2)
        j += 3 if joint else 1
    if not (t.number(j, 3, 5) and t.ends(j)):
        return None
    last = j
    if t.sign(last + 1, "-") and t.touches(last + 2) and t.number(last + 2, 1, 3) and t.ends(last + 2):
        last += 2
    year = last + 2
    if t.sign(last + 1, ":") and t.number(year, 4, 4) and t.tokens[year].start - t.tokens[last + 1].stop <= 1 and t.ends(year):
        last = year
    whole = t.text[t.tokens[i].start : t.tokens[last].stop]
    return t.made("standard", " ".join(whole.split()).upper(), i, last), last


def national_at(t: TokenText, i: int) -> tuple[Reference, int] | None:
    """A government's rules with their number, inside one clause."""
    if t.word(i) != "ministru" or t.word(i + 1) != "kabineta" or t.tokens[i + 1].start != t.tokens[i].stop + 1:
        return None
    begin = t.tokens[i + 1].stop
    for k in range(i + 2, len(t.tokens)):
        at = t.word(k).find("noteikum")
        gap = t.text[begin : t.tokens[k].start + max(at, 0)]
        if len(gap) > CLAUSE_CHARS or "\n" in gap or ";" in gap:
            return None
        if at >= 0 and t.word(k + 1) == "nr":
            digits = k + 3 if t.sign(k + 2, ".") else k + 2
            if t.number(digits, 1, 1000) and t.tokens[digits].start - t.tokens[digits - 1].stop <= 1:
                return t.made("regulation", f"Ministru kabineta noteikumi Nr. {t.tokens[digits].text}", i, digits), digits
        if t.word(k) == "." and not (t.touches(k) and t.word(k - 1).isdecimal() and not t.touches(k + 1)):
            return None  # a full stop ends the clause, one after a figure doesn't
    return None


def _union_in_brackets(t: TokenText, i: int) -> bool:
    return t.word(i) == "(" and t.touches(i + 1) and t.word(i + 1) in UNIONS and t.sign(i + 2, ")")


def _numbered(t: TokenText, i: int) -> int:
    """The token after an optional ``Nr.`` or ``No.``"""
    return i + 1 + (t.word(i + 1) == ".") if t.word(i) in NUMBER_WORDS else i


def _pair(t: TokenText, i: int) -> bool:
    """Two figures with a slash between them, the first of at most four digits."""
    return t.number(i, 1, 4) and t.sign(i + 1, "/") and t.touches(i + 2) and t.number(i + 2, 1, 1000)


def _union_after(t: TokenText, i: int) -> bool:
    return t.sign(i, "/") and t.touches(i + 1) and t.word(i + 1) in UNIONS and t.ends(i + 1)


def typed_act_at(t: TokenText, i: int) -> tuple[Reference, int] | None:
    """An act whose kind is named, then its number."""
    folded = t.word(i).translate(_FOLD)
    kind = "directive" if folded.startswith(("direktiv", "directive")) else "regulation" if folded.startswith("regul") else ""
    if not kind or not t.begins(i) or t.touches(i + 1):
        return None
    j = _numbered(t, i + 4 if _union_in_brackets(t, i + 1) else i + 1)
    if not (_pair(t, j) and t.number(j + 2, 1, 4) and t.ends(j + 2)):
        return None
    last = j + 4 if _union_after(t, j + 3) else j + 2
    return t.made(kind, f"EU {kind} {t.tokens[j].text}/{t.tokens[j + 2].text}", i, last), last


def bare_acts(t: TokenText) -> Iterator[Reference]:
    """Acts known by number and union only, the union first and then the union last."""
    for i in range(len(t.tokens)):
        j = _numbered(t, i + 3)
        if _union_in_brackets(t, i) and _pair(t, j):
            second = t.tokens[j + 2].text[:4]
            yield Reference("legal_act", f"EU act {t.tokens[j].text}/{second}", t.tokens[i].start, t.tokens[j + 2].start + len(second))
    for i in range(len(t.tokens)):
        if t.number(i, 1, 1000) and t.sign(i + 1, "/") and t.touches(i + 2) and t.number(i + 2, 1, 4) and _union_after(t, i + 3):
            first = t.tokens[i].text[-4:]
            yield Reference("legal_act", f"EU act {first}/{t.tokens[i + 2].text}", t.tokens[i].stop - len(first), t.tokens[i + 4].stop)


def defined_terms_of(t: TokenText, cues: list[str]) -> Iterator[Reference]:
    """All uses of abbreviations that the text defines in brackets after wording that holds a cue."""
    for i in range(len(t.tokens)):
        word = t.word(i + 1)
        if t.word(i) != "(" or not word.startswith(("turpmāk", "turpmak")) or t.tokens[i + 1].text[:1].isupper():
            continue
        close = next((k for k in range(i + 2, len(t.tokens)) if t.word(k) == ")"), None)
        if close is None:
            continue
        last = t.tokens[close - 1]
        capitals = len(last.text) - len(last.text.rstrip("".join({c for c in last.text if c.isupper()})))
        term = last.text[len(last.text) - min(capitals, 6) :] if last.text.isalpha() else ""
        if len(term) < 2 or last.stop - len(term) - (t.tokens[i + 1].start + 7) > LABEL_CHARS:
            continue
        meaning = t.text[max(0, t.tokens[i].start - MEANING_CHARS) : t.tokens[i].start].lower().translate(_FOLD)
        if any(c in meaning for c in cues):
            yield from (t.made("defined_scheme", term, k, k) for k, x in enumerate(t.tokens) if x.text == term and t.begins(k) and t.ends(k))


def references_in(text: str, cues: list[str]) -> list[Reference]:
    """All references of a text but catalog schemes; a bare act counts only outside named and earlier ones."""
    t = TokenText(text)
    out: list[Reference] = []
    for rule in (standard_at, national_at, typed_act_at):
        i = 0
        while i < len(t.tokens):
            found = rule(t, i)
            if found is not None:
                out.append(found[0])
            i = found[1] + 1 if found is not None else i + 1
    acts = [r for r in out if r.name.startswith("EU ")]
    for r in bare_acts(t):
        if not any(r.start < a.stop and r.stop > a.start for a in acts):
            acts.append(r)
            out.append(r)
    return out + list(defined_terms_of(t, cues))


def _stem(words: str) -> str:
    return r"(?<![\p{L}\p{N}_])" + r"[\s\p{Z}]+".join(words.split())


def _tagged(spans: Column, category: str, name: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), s["start"].alias("start"), s["stop"].alias("stop")))


def heading_spans(text: Column, catalog: Catalog) -> Column:
    """Array of ``at, phase`` of all section markers."""
    parts = []
    for phase, stems in catalog.markers.items():
        spans = find_spans(fold(text), "|".join(_stem(s) for s in stems))
        parts.append(_headings(spans, phase))
    return F.concat(*parts) if parts else F.array().cast("array<struct<at:int,phase:string>>")


def _headings(spans: Column, phase: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(phase).alias("phase")))


def table_text(text: Column, tables: Column) -> Column:
    """A text with the cells of its tables (array of tables of rows of cells) after it: what stands only in a table is found too."""
    cells = F.filter(F.flatten(F.flatten(tables)), lambda c: c.isNotNull() & (c != ""))
    return F.when(F.size(cells) > 0, F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.array_join(cells, " "))).otherwise(text)


def find_references(df: DataFrame, keys: list[str], text: str, catalog: Catalog | None = None) -> DataFrame:
    """``keys, category, name, start, phase, passage`` of every reference in every text.

    ``phase`` is that of the nearest marker at or before it (of two at one place the
    alphabetically last), else ``unknown``. Null and empty texts have none. An alias that
    matches twice in one place counts once for each alias.
    """
    catalog = catalog or Catalog()

    @F.pandas_udf("array<struct<category:string,name:string,start:int,stop:int>>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [] if x is None else [r._asdict() for r in references_in(x, catalog.cues)])

    t = F.col("_t")
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t"))
    found = [read(F.when(t.rlike(_TRIGGER), t))]
    for name, aliases in catalog.schemes.items():
        found += [_tagged(find_spans(fold(t), _stem(a)), "scheme", name) for a in aliases]
    rows = rows.select(*keys, "_t", F.concat(*found).alias("_refs"), heading_spans(t, catalog).alias("_heads"))

    def place(r: Column) -> Column:
        before = F.filter("_heads", lambda h: h["at"] <= r["start"])
        phase = F.coalesce(F.array_max(before)["phase"], F.lit("unknown"))
        return F.struct(r["category"].alias("category"), r["name"].alias("name"), r["start"].alias("start"), phase.alias("phase"), collapse(window_around(F.col("_t"), r["start"], r["stop"], EVIDENCE_CHARS)).alias("passage"))

    return rows.select(*keys, F.explode(F.transform("_refs", place)).alias("_r")).select(*keys, "_r.*")


def rollup_references(refs: DataFrame, group: list[str], order: str) -> DataFrame:
    """One row per group and name: count, category first seen, phases as first seen, four passages evenly spread.

    ``order`` is a whole number that orders the texts. Which occurrences are kept is found from
    ranks counted in range buckets, so the passages of a name never meet in one task; what is
    gathered is the phases of a name and at most MAX_EVIDENCE passages.
    """
    keys = [*group, "name"]
    at = F.col(order).cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.col("start")
    rows = refs.select(*keys, "category", "phase", "passage", at.cast("decimal(38,0)").alias("_at"))
    head = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("_at", "category"))["category"].alias("category"))
    phases = rows.groupBy(*keys, "phase").agg(F.min("_at").alias("at")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "phase"))).alias("p"))
    i, n = F.col("rank") - 1, F.col("group_size")
    picked = [i == F.floor(F.lit(j) * (n - 1) / (MAX_EVIDENCE - 1)) for j in range(MAX_EVIDENCE)]
    kept = skew_rank(rows.select(*keys, "passage", "_at"), keys, "_at").where((n <= MAX_EVIDENCE) | picked[0] | picked[1] | picked[2] | picked[3])
    texts = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "passage"))).alias("e"))
    both = head.join(phases, keys).join(texts, keys)
    return both.select(*keys, "category", "n", F.transform("p", lambda x: x["phase"]).alias("phases"), F.transform("e", lambda x: x["passage"]).alias("evidence"))
