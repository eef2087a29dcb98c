"""One spelling for text that looks the same: widths, accents, blanks, invisible and look-alike characters.

A transducer over grapheme clusters, compiled once: a table gives every irregular cluster (a
letter with its combining accents, a blank, an invisible character) its reading in each script,
composed beforehand and checked for conflicts. One pass from left to right takes the longest
cluster that the table knows. What a look-alike stands for depends on the rest of its word, so
the output of a word is held back until its end: it is written in the one script in which all
its clusters can be read, or as it stood. Codes get plain digits and hyphens in the same pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: characters by kind --------------------------------------------------------
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
BLANKS = "               　"
DASHES = "‐‑‒–—―−﹘﹣－"
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw", strict=True))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "ABEZHIKMNOPTYXovi", strict=True))
DIGIT_LOOKS = dict(zip("ОоΟοЗІӀΙ", "00003111", strict=True))
ARMENIAN_AS_LATIN = dict(zip("հոսօցյՕՏԼՍ", "hnuogjOSLU", strict=True))
ALWAYS_LATIN = {"\u212a": "K", "\u0261": "g"}
# ----------------------------------------------------------------------------------------------

MARKS = "".join(map(chr, range(0x300, 0x370)))
DROP, BLANK, SIGN, DASH, DIGIT, LETTER = "drop", "blank", "sign", "dash", "digit", "letter"


class Reading(NamedTuple):
    """What a cluster is: its kind, its own script, its regular form in each script, its look as a digit of a code."""

    kind: str
    script: str
    forms: dict[str, str]
    digit: str = ""
    accented: bool = False


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def compile_table() -> dict[str, Reading]:
    """All irregular clusters with their readings; ValueError where the table contradicts itself.

    Bases come by rule: letters that look like Latin ones (and back, for words in other
    scripts), widths and typefaces by their compatibility forms. Every base is then composed
    with each combining accent that its regular form can take, and so are composed letters
    whose base is a look-alike.
    """
    table: dict[str, Reading] = {}

    def add(source: str, reading: Reading) -> None:
        old = table.setdefault(source, reading)
        if any(old.forms.get(k, v) != v for k, v in reading.forms.items()):
            raise ValueError(f"two targets for {source!r}")
        if old is not reading:
            table[source] = old._replace(forms=old.forms | reading.forms, digit=old.digit or reading.digit)

    for ch in INVISIBLE:
        add(ch, Reading(DROP, "", {"": ""}))
    for ch in BLANKS:
        add(ch, Reading(BLANK, "", {"": " "}))
    for ch in DASHES:
        add(ch, Reading(DASH, "", {"": ch if ch != "\uff0d" else "-"}))
    letters: dict[str, dict[str, str]] = {}
    for source in (CYRILLIC_AS_LATIN, GREEK_AS_LATIN, ARMENIAN_AS_LATIN):
        for a, b in source.items():
            letters.setdefault(a, {})["LATIN"] = b
            if source is not ARMENIAN_AS_LATIN:
                letters.setdefault(b, {})[_script(a)] = a
    for a, b in ALWAYS_LATIN.items():
        letters[a] = {**letters.get(b, {}), "LATIN": b}
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        a, b = chr(code), unicodedata.normalize("NFKC", chr(code))
        if len(b) == 1 and b.isascii() and not (code >= 0x1D400 and not b.isalnum()):
            if b.isalpha():
                letters[a] = {**letters.get(b, {}), "LATIN": b}
            elif b.isdigit():
                add(a, Reading(DIGIT, "", {"": b}, b))
            elif a not in DASHES:
                add(a, Reading(SIGN, "", {"": b}))
    for a, forms in list(letters.items()):
        own = "LATIN" if a in ALWAYS_LATIN or ord(a) >= 0xFF00 else _script(a)
        forms = {own: a, **forms} if own != "LATIN" or a.isascii() else forms
        letters[a] = forms
        add(a, Reading(LETTER, own, forms, DIGIT_LOOKS.get(a, "")))
    takes: dict[str, set[str]] = {}  # the accents that each letter is composed with
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2:
            takes.setdefault(parts[0], set()).add(parts[1])
    bases = {**letters, **{c: {"LATIN": c} for c in map(chr, range(0x41, 0x7B)) if c.isalpha() and c not in letters}}
    for a, forms in bases.items():
        own = table[a].script if a in table else "LATIN"
        for mark in sorted(set().union(*(takes.get(v, ()) for v in forms.values()))):
            composed = {k: unicodedata.normalize("NFC", v + mark) for k, v in forms.items()}
            if mark in MARKS:
                add(a + mark, Reading(LETTER, own, composed, accented=True))
                whole = unicodedata.normalize("NFC", a + mark)
                if len(whole) == 1 and own != "LATIN":
                    add(whole, Reading(LETTER, own, {own: whole, **{k: v for k, v in composed.items() if k != own}}))
    check(table)
    return table


def check(table: dict[str, Reading]) -> None:
    """ValueError where a regular form is itself irregular, or a longer cluster disagrees with a shorter one and its accents."""
    for source, r in table.items():
        for script, form in r.forms.items():
            if r.kind == LETTER:
                again = table.get(form)
                if again is not None and (again.script != script or again.forms.get(script, form) != form):
                    raise ValueError(f"the form {form!r} of {source!r} isn't regular")
                for k in range(1, len(source)):
                    short = table.get(source[:k])
                    if short is not None and script in short.forms and unicodedata.normalize("NFC", short.forms[script] + source[k:]) != form:
                        raise ValueError(f"{source!r} disagrees with {source[:k]!r}")
            elif form and form in table and table[form].forms.get("") != form:
                raise ValueError(f"the form {form!r} of {source!r} isn't regular")


def _class(chars: set[str]) -> str:
    """A character class written in ranges: listed one by one, characters beyond the first plane make it slow."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out) + "]"


class Transducer:
    """The compiled table: one pass over a text, longest cluster first, words held back until their end."""

    def __init__(self, table: dict[str, Reading]) -> None:
        self.table = table
        self.kept: dict[str, Reading] = {}
        single = {k for k, r in table.items() if len(k) == 1 and not k.isascii() and not (r.kind == DASH and k in DASHES[:-1])}
        dashes = "".join(DASHES)
        self.suspect = re.compile(f"{_class(single | set(MARKS) | set(map(chr, range(0x370, 0x530))))}|[0-9][{INVISIBLE}]*[{dashes}]")
        join = f"{MARKS}{INVISIBLE}"
        self.joined, self.dashes = set(join), set(DASHES) | {"-"}
        self.cluster = re.compile(f"[{INVISIBLE}]|[^\\W_][{join}]*|.", re.DOTALL)
        self.run = re.compile(f"(?:[\\w{join}]|[-{dashes}](?=[{join}]*[^\\W_]))+|.", re.DOTALL)
        self.code = re.compile("(?<![dlw])[dl]{8}-[dl](?![dlw])")

    def read(self, cluster: str) -> Reading:
        """The reading of a letter or digit with what is joined to it: the longest part that the table knows, then the accents left."""
        found = self.table.get(cluster) or self.kept.get(cluster)
        if found is None:
            plain = "".join(c for c in cluster if c not in INVISIBLE)
            found = self.table.get(plain)
            for k in range(len(plain) - 1, 0, -1) if found is None else ():
                if (short := self.table.get(plain[:k])) is not None:
                    rest = plain[k:]
                    found = short._replace(forms={s: unicodedata.normalize("NFC", f + rest) for s, f in short.forms.items()}, digit="", accented=bool(rest) or short.accented)
                    break
            if found is None:
                c = plain[:1]
                script = _script(c) if c else ""
                whole = unicodedata.normalize("NFC", plain) if script in ("LATIN", "CYRILLIC", "GREEK") else plain
                kind = DROP if not c else LETTER if c.isalpha() else DIGIT if c.isdecimal() else SIGN
                found = Reading(kind, script, {script: whole}, c if c.isascii() and c.isdigit() else "", len(plain) > 1)
            if len(self.kept) < 100_000:
                self.kept[cluster] = found
        return found

    def __call__(self, text: str) -> str:
        """Only runs of words that hold something irregular are read; the search goes on behind each."""
        found = self.suspect.search(text)
        if found is None:
            return text
        out, done = [], 0
        while found is not None:
            start = self._begin(text, found.start(), done)
            stop = self.run.match(text, start).end()
            out += (text[done:start], self._run(text[start:stop]))
            done = stop
            found = self.suspect.search(text, done)
        out.append(text[done:])
        return "".join(out)

    def _begin(self, text: str, at: int, least: int) -> int:
        """Where the run of word characters, joined accents and dashes that holds a place begins."""
        if not self._solid(text[at]) and text[at] not in self.dashes:
            return at
        while at > least:
            c = text[at - 1]
            if not self._solid(c) and not (c in self.dashes and self._solid(text[at])):
                break
            at -= 1
        return at

    def _solid(self, c: str) -> bool:
        return c.isalnum() or c == "_" or c in self.joined

    def _run(self, whole: str) -> str:
        if len(whole) == 1 and not whole.isalnum():
            r = self.table.get(whole)
            return whole if r is None or r.kind == DASH and whole in DASHES[:-1] else r.forms[""]
        readings: list[tuple[str, Reading]] = []
        for c in self.cluster.findall(whole):
            r = self.read(c)
            if r.kind != DROP:
                readings.append((c, r))
        kinds = "".join("-" if r.kind == DASH or c == "-" else "d" if r.digit and r.kind == DIGIT else "l" if r.digit else "w" for c, r in readings)
        codes: dict[int, str] = {}
        for found in self.code.finditer(kinds):
            if "d" in found[0]:
                codes |= {i: "-" if kinds[i] == "-" else readings[i][1].digit for i in range(*found.span())}
        out: list[str] = []
        word: list[Reading] = []
        for i, (c, r) in enumerate(readings):
            if i not in codes and r.kind == LETTER:
                word.append(r)
                continue
            out += self._word(word)
            word = []
            out.append(codes[i] if i in codes else r.forms.get(r.script, c))
        return "".join(out + self._word(word))

    @staticmethod
    def _word(word: list[Reading]) -> list[str]:
        """A word in the one script that all its clusters can be read in; a lone foreign one only if it carries accents that its script doesn't write."""
        scripts = {r.script for r in word}
        target = None
        if len(scripts) > 1:
            target = next((s for s in ("LATIN", *sorted(scripts - {"LATIN"})) if s in scripts and all(s in r.forms for r in word)), None)
        elif word and scripts != {"LATIN"} and any(r.accented for r in word) and all("LATIN" in r.forms for r in word):
            target = "LATIN"
        return [r.forms[target if target is not None else r.script] for r in word]


TABLE = compile_table()
regular_text = Transducer(TABLE)
regular_text.__doc__ = "The one consistent form of a text; what looks different or is of another script stays."


def regular_items(states: DataFrame, state_id: str = "state_id", text: str = "documents_text", candidates: str = "candidates", changed_only: bool = False) -> DataFrame:
    """``state_id, field_name, item_no, plain_text, changed`` for every candidate code and line.

    Items count from 1 in the order given, blank ones included. Null texts, candidate lists and
    codes have no items; a null code keeps its place. Re-delivered states give the same rows
    again. Only the named columns are read. With ``changed_only`` regular items don't come out.
    """
    codes = F.transform(F.col(candidates), lambda c: c["code"])
    rows = states.select(F.col(state_id).alias("id"), F.col(text).alias("text"), codes.alias("codes"))
    kind = states.schema[state_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, whole, listed in zip(batch["id"], batch["text"], batch["codes"], strict=True):
                if listed is not None:
                    for n, code in enumerate(listed, 1):
                        if code is not None:
                            new = regular_text(code)
                            if new != code or not changed_only:
                                out.append((i, "candidates", n, new, new != code))
                if whole is not None:
                    for n, line in enumerate(whole.split("\n"), 1):
                        new = regular_text(line)
                        if new != line or not changed_only:
                            out.append((i, "documents_text", n, new, new != line))
            yield pd.DataFrame(out, columns=["id", "field_name", "item_no", "plain_text", "changed"])

    schema = f"id {kind}, field_name string, item_no int, plain_text string, changed boolean"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", state_id)
