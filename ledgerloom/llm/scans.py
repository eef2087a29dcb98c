"""Scanned pages into continuous readable paragraphs.

Three averaged perceptrons, all trained here from the scans themselves:

* a character editor, which predicts for every character of a word to keep it, delete it,
  replace it (by one or two characters) or insert a lost one before it. Its examples are pairs
  of a rare word and a much more frequent one that differ in one span of at most two characters;
  only spans that many pairs share are confusions.
* a line-join model, which tells a word broken at the line's end from a word's own hyphen.
* a furniture model, which tells running headers and footers by shape and position on the page.
  Its examples are lines that the pages of a file repeat at their edges.

Counts cover all pages. Every different word is judged once, with its exact count, in a
distributed pass; the repairs it finds reach the pages by broadcast while they are few (checked)
and by a join beyond that, with the same result. An edit counts only if it leads to a much more
frequent word (the exact check) that is established: it makes up at least 1 / SHARE of all
words, so at most SHARE words are ever broadcast, whatever the size. A word is searched with at
most three confusions at once and a beam of 12 readings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.homoglyphs import regular_text
from ledgerloom.llm.perceptron import AveragedPerceptron
from ledgerloom.operators.skew import hot_join
from ledgerloom.session import cut

SHARE = 2_000_000  # an established word makes up at least one in so many
PREFIX_SHARE = 50_000  # the same for words whose beginnings and ends are known
REPAIRS = 500_000  # repairs that are broadcast; more are joined
TRAIN_WORDS = 20_000  # most frequent words used to find confusions
TRAIN_LINES = 20_000  # lines used to train the furniture model
RATIO = 8  # a word is a misreading only of a word at least so many times as frequent
ZONE = 2  # written lines at either edge of a page where furniture may stand

# --- fixed values -----------------------------------------------------------------------------
BREAK_HYPHENS = "-‐­¬‑"
SOURCE_LINE = "Source file: "
DIGIT_LOOKALIKES = dict(zip("lIOoSBZzbgqi", "110058226991", strict=True))
LETTER_LOOKALIKES = dict(zip("0123456789", "oizeasbtbg", strict=True))
PAGE_WORDS = r"page|lpp\.?|lapa|seite|pag\."
OF_WORDS = r"of|no|von|/"
# ----------------------------------------------------------------------------------------------

_LEX = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_D = r"[0-9lIO]{1,4}"
_PAGE_LINE = re.compile(rf"^\W*(?:(?:{PAGE_WORDS})\W*)?({_D})\W*(?:(?:{OF_WORDS})\W*({_D})\W*)?(?:(?:{PAGE_WORDS})\W*)?$", re.I)
_BARE = re.compile(r"^[0-9lIO]{1,4}$")
_LOOKS = "".join(DIGIT_LOOKALIKES)
_NUMBERLIKE = re.compile(rf"^[0-9{_LOOKS}]*[0-9][0-9{_LOOKS}]*$")
_LINE_END = re.compile(rf"([^\W_]+)([{BREAK_HYPHENS}])$")
_LINE_START = re.compile(r"\s*([^\W_]+)")
_LONE_DIGIT = re.compile(r"(?<=[0-9][ .,/])[lIOoSB](?![^\W_])|\b[lIOoSB](?=[ .,/][0-9])")
_TO_DIGITS, _TO_LETTERS = str.maketrans(DIGIT_LOOKALIKES), str.maketrans(LETTER_LOOKALIKES)
_HEAD_NUMBER = re.compile(r"\s{2,}\S{1,5}$")


def shape_key(line: str) -> str:
    """A line without case, spacing and a number at its end: what repeats from page to page."""
    return " ".join(_HEAD_NUMBER.sub("", line.strip()).lower().split())


def page_number(line: str) -> tuple[int, str] | None:
    """``(number, style)`` of a line that is nothing but a page's number."""
    s = line.strip()
    m = _PAGE_LINE.match(s)
    framed = not s[:1].isalnum() and not s[-1:].isalnum()  # then a misread digit is a number too
    if not m or not (framed or any(c.isdigit() for c in s)) or len(s) > 24:
        return None
    n = int(m[1].translate(str.maketrans("lIO", "110")))
    if m[2] and n > int(m[2].translate(str.maketrans("lIO", "110"))):
        return None
    if re.fullmatch(r"[0-9]+[-.,][0-9]+", s) or re.fullmatch(r"[0-9]+\.", s):
        return None
    return n, "bare" if _BARE.match(s) else "of" if m[2] else "marked"


# --- the character editor ---------------------------------------------------------------------


def find_confusions(counts: dict[str, int], least: int = 3) -> tuple[list[tuple[str, str, int, str, str]], set[tuple[str, str]]]:
    """Pairs ``(misread, true, position, span read, true span)`` and the spans that recur.

    A pair differs in one span of 1-2 characters on either side, or lacks one character inside
    the word, and its true word is RATIO times as frequent. Spans with less than ``least``
    different pairs are chance.
    """
    frequent = [w for w, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:TRAIN_WORDS] if len(w) >= 4 and w.isalpha()]
    frequent = [w for w in frequent if counts[w] >= 2 * RATIO]
    holes: dict[tuple[str, str], list[str]] = defaultdict(list)
    for w in frequent:
        for b in (1, 2):
            for i in range(len(w) - b + 1):
                holes[w[:i], w[i + b :]].append(w)
    options: dict[str, list[tuple[str, int, str, str]]] = {}
    for x, n in counts.items():
        if len(x) < 4:
            continue
        for a in (0, 1, 2):
            for i in range(1 if a == 0 else 0, len(x) - a + (0 if a == 0 else 1)):
                for v in holes.get((x[:i], x[i + a :]), ()):
                    if v != x and counts[v] >= RATIO * n:
                        read, true = x[i : i + a], v[i : len(v) - (len(x) - i - a)]
                        if not read and len(true) == 1 and true != x[i - 1] or read and read[0] != true[0] and read[-1] != true[-1]:  # else a shorter span says the same
                            options.setdefault(x, []).append((v, i, read, true))
    support: Counter = Counter()
    for _ in range(2):  # first by the commonest word, then by the commonest span
        best = {x: max(o, key=lambda p: (support[p[2], p[3]], counts[p[0]], p)) for x, o in options.items()}
        support = Counter((p[2], p[3]) for p in best.values())
    # a confusion is wide-spread; inflected words differ in one letter either way as often
    least = max(least, round(0.004 * len(best)))
    kept = {s for s, n in support.items() if n >= least and (len(s[0]) + len(s[1]) > 2 or n >= 2 * support.get((s[1], s[0]), 0))}
    return [(x, *p) for x, p in best.items() if (p[2], p[3]) in kept], kept


def char_features(word: str, i: int, before: str) -> list[str]:
    w = f"^^{word}$$"
    j = i + 2
    c = w[j]
    kinds = "d" if any(ch.isdigit() for ch in word) else "", "a" if any(ch.isalpha() for ch in word) else ""
    return ["b", f"0{c}", f"1{w[j - 1]}{c}", f"2{c}{w[j + 1]}", f"3{w[j - 1]}{c}{w[j + 1]}", f"4{w[j - 2]}{w[j - 1]}{c}", f"5{c}{w[j + 1]}{w[j + 2]}", f"6{before}{c}", f"7{c}{kinds}"]


def train_editor(counts: dict[str, int]) -> tuple[AveragedPerceptron, set[tuple[str, str]]]:
    pairs, spans = find_confusions(counts)
    wrong = {p[0] for p in pairs}
    clean = [w for w in sorted(counts, key=lambda w: (-counts[w], w))[: max(2000, len(pairs))] if w not in wrong]
    examples: list[tuple[list[str], str]] = []

    def add(word: str, ops: list[str]) -> None:
        before = "K"
        for i, op in enumerate(ops):
            examples.append((char_features(word, i, before), op))
            before = op

    for x, _, i, read, true in pairs:
        ops = ["K"] * len(x)
        if read:
            ops[i : i + len(read)] = [f"R{true}", "D"][: len(read)]
        else:
            ops[i] = f"I{true}"
        add(x, ops)
    for w in clean:
        add(w, ["K"] * len(w))
    classes = ["K", "D", *sorted({f"R{t}" if r else f"I{t}" for r, t in spans})]
    return AveragedPerceptron(classes).train(examples), spans


def edits(word: str, model: AveragedPerceptron, spans: set[tuple[str, str]], beam: int = 12) -> list[tuple[float, str, list[int]]]:
    """Likely readings ``(score, word, changed positions)``, best first; only known confusions."""
    states: list[tuple[float, str, str, tuple[int, ...]]] = [(0.0, "", "K", ())]
    for i, c in enumerate(word):
        following: list[tuple[float, str, str, tuple[int, ...]]] = []
        scored: dict[str, dict[str, float]] = {}  # the features see only the operation before
        for score, done, before, at in states:
            s = scored.get(before)
            if s is None:
                s = scored[before] = model.scores(char_features(word, i, before))
            options = [("K", c)]
            if before.startswith("R") and i and (word[i - 1 : i + 1], before[1:]) in spans:
                options.append(("D", ""))
            options += [(f"R{t}", t) if r else (f"I{t}", t + c) for r, t in spans if r == c or r == word[i : i + 2] or not r and i]
            pending = before.startswith("R") and (word[i - 1], before[1:]) not in spans
            for op, text in options:
                if pending and op != "D":
                    continue
                following.append((score + s.get(op, 0.0), done + text, op, (*at, i) if op != "K" else at))
        states = sorted(following, key=lambda x: -x[0])[:beam]
    out = [(sc, t, list(at)) for sc, t, before, at in states if at and not (before.startswith("R") and (word[-1:], before[1:]) not in spans)]
    return out


# --- the model as a whole ---------------------------------------------------------------------


@dataclass
class ScanModel:
    """``counts`` holds the established words, ``repairs`` the misread ones with ``(right word, changed positions)``."""

    counts: dict[str, int]
    hyphenated: dict[str, int]
    editor: AveragedPerceptron
    spans: set[tuple[str, str]]
    joiner: AveragedPerceptron
    furniture: AveragedPerceptron | None = None
    lefts: set[str] = field(default_factory=set)
    starts: dict[str, int] = field(default_factory=dict)
    ends: dict[str, int] = field(default_factory=dict)
    repairs: dict[str, tuple[str, list[int]]] = field(default_factory=dict)
    cache: dict[str, tuple[str, list[int]] | None] = field(default_factory=dict)

    def repair(self, word: str, part: str = "whole") -> tuple[str, list[int]] | None:
        """``(right word, changed positions)`` of a misread word, or None. part: whole, start or end of a word."""
        if part == "whole":
            if not word.isalpha() and any(c.isdigit() for c in word) and _NUMBERLIKE.match(word) and len(word) < 12 and sum(c.isdigit() for c in word) * 2 >= len(word):
                at = [i for i, c in enumerate(word) if not c.isdigit()]
                return (word.translate(_TO_DIGITS), at) if at else None
            low = word.lower()
            return self.repairs.get(low) if len(low) == len(word) else None
        key = f"{part[0]}{word}"
        if key not in self.cache:
            if len(self.cache) > 300_000:
                self.cache.clear()
            table = self.starts if part == "start" else self.ends
            self.cache[key] = self.judge(word.lower(), table.get(word.lower(), 0), part) if len(word.lower()) == len(word) else None
        return self.cache[key]

    def judge(self, low: str, n: int, part: str = "whole") -> tuple[str, list[int]] | None:
        """The repair of a lower-case word (or part) that occurs ``n`` times; under three times counts as never."""
        table = {"whole": self.counts, "start": self.starts, "end": self.ends}[part]
        mixed = any(c.isdigit() for c in low)
        if mixed and not any(c.isalpha() for c in low) or len(low) < (3 if part == "whole" else 4):
            return None
        n = n if n >= 3 else 0
        least = max(RATIO * n, RATIO)
        if not mixed and not self._reachable(low, table, least):
            return None
        readings = edits(low, self.editor, self.spans)
        for score, text, at in readings:
            if table.get(text, 0) >= least and (n == 0 or part == "whole") and len(text) > 1:
                return text, at
            if mixed and score > 0 and not any(c.isdigit() for c in text) and part == "whole":
                return text, at
        if mixed and not low[:1].isdigit() and not low[-1:].isdigit() and sum(c.isdigit() for c in low) == 1 and len(low) > 3:
            at = [i for i, c in enumerate(low) if c.isdigit()]
            plain = next((t for _, t, where in readings if where == at and not any(c.isdigit() for c in t)), None)
            return plain if plain is not None else low.translate(_TO_LETTERS), at
        return None

    def _reachable(self, word: str, table: dict[str, int], least: int) -> bool:
        """Whether up to three known confusions lead to a word frequent enough; spares most words the editor."""
        options = []
        for read, true in self.spans:
            if not read:
                options += [(i, i, true) for i in range(1, len(word))]
                continue
            i = word.find(read)
            while i >= 0:
                options.append((i, i + len(read), true))
                i = word.find(read, i + 1)
        if len(options) > 16:
            return True
        options.sort()
        for k in range(1, 4):
            for chosen in combinations(options, k):
                out, at = "", 0
                for a, b, true in chosen:
                    if a < at:
                        break
                    out += word[at:a] + true
                    at = b
                else:
                    if table.get(out + word[at:], 0) >= least:
                        return True
        return False

    def joins(self, left: str, hyphen: str, right: str) -> bool:
        """Whether a line's end only broke the word; False for the word's own hyphen."""
        return self.joiner.predict(self._join_features(left, hyphen, right)) == "J"

    def _join_features(self, left: str, hyphen: str, right: str) -> list[str]:
        left, right = left.lower(), right.lower()
        return join_features(left, hyphen, right, self.counts, self.hyphenated, self.lefts)


def join_features(left: str, hyphen: str, right: str, counts: dict[str, int], hyphenated: dict[str, int], lefts: set[str]) -> list[str]:
    own = f"{left}-{right}" in hyphenated if right else left in lefts
    joined = counts.get(left + right, 0) > 0 if right else False
    return ["b", f"h{hyphen == '-'}", f"o{own}", f"j{joined}", f"oj{own}{joined}", f"ho{hyphen == '-'}{own}", f"l{left in lefts}{own}"]


def train_joiner(counts: dict[str, int], hyphenated: dict[str, int], lefts: set[str]) -> AveragedPerceptron:
    """Examples: frequent words cut in two, and frequent hyphenated words cut at their hyphen."""
    examples = []
    for k, w in enumerate(w for w in sorted(counts, key=lambda w: (-counts[w], w))[:2000] if len(w) > 4 and w.isalpha()):
        cut_at = 2 + k % (len(w) - 3)
        for h in ("-", "‐"):
            examples.append((join_features(w[:cut_at], h, w[cut_at:], counts, hyphenated, lefts), "J"))
            examples.append((join_features(w[:cut_at], h, "", counts, hyphenated, lefts), "J"))
    for w in hyphenated:
        a, _, b = w.partition("-")
        repeats = 1 + 1000 // max(1, len(hyphenated))
        examples += [(join_features(a, "-", b, counts, hyphenated, lefts), "K"), (join_features(a, "-", "", counts, hyphenated, lefts), "K")] * repeats
    return AveragedPerceptron(["J", "K"]).train(examples, epochs=3)


def line_features(line: str, place: str) -> list[str]:
    """Shape of a line, with its place on the page where that is known (t0, t1, b0, b1, m)."""
    s = line.strip()
    words = re.sub(r"[0-9]+", "#", shape_key(s)).split()
    out = ["b", f"n{min(len(words), 9)}", f"e{s[-1:] if not s[-1:].isalnum() else 'a'}", f"u{s[:1].isupper()}", f"U{s.isupper()}", f"t{bool(_HEAD_NUMBER.search(s))}", f"L{min(len(s) // 10, 9)}"]
    forms = ["#" if not w.isalpha() and any(c.isdigit() for c in w) else "A" if w.isupper() and len(w) <= 4 else w.lower() for w in _HEAD_NUMBER.sub("", s).split()]
    out += [f"w{w}" for w in set(words)] + [f"f{a}_{b}" for a, b in zip(forms, forms[1:], strict=False)]
    out += [f"s{'/' in s}{any('#' in w for w in words)}", f"1{words[0] if words else ''}", f"9{words[-1] if words else ''}"]
    if place:
        out += [f"p{place}", f"pn{place}{min(len(words), 6)}", f"pe{place}{s[-1:] if not s[-1:].isalnum() else 'a'}"]
    return out


def _places(lines: list[str]) -> dict[int, str]:
    """Line index -> place, of the written lines at the edges of a page."""
    written = [i for i, x in enumerate(lines) if x.strip()]
    out = {i: f"b{k}" for k, i in enumerate(reversed(written[-ZONE:]))}
    return out | {i: f"t{k}" for k, i in enumerate(written[:ZONE])}


def body_findings(lines: list[str], skip: set[int], model: ScanModel) -> list[tuple[int, str]]:
    """``(line index, kind)`` of broken and misread body lines; ``skip`` holds the furniture."""
    found: set[tuple[int, str]] = set()
    body = [i for i, x in enumerate(lines) if x.strip() and i not in skip]
    text = {i: lines[i].rstrip() for i in body}
    whole = "\n".join(text.values())
    if regular_text(whole) != whole:
        # letters that only look alike are another problem: they are made regular before reading
        text = {i: regular_text(t) + ("­" if t[-1:] == "­" else "") for i, t in text.items()}
        whole = "\n".join(text.values())
    # every word is judged once a page; most pages' lines need no further look
    suspects = {w for w in set(_LEX.findall(whole)) if model.repair(w)}
    lone = _LONE_DIGIT.search(whole) is not None
    joined_right: dict[int, int] = {}
    for k, i in enumerate(body):
        line = text[i]
        end = len(line)
        m = _LINE_END.search(line) if line[-1] in BREAK_HYPHENS else None
        if m:
            nxt = body[k + 1] if k + 1 < len(body) else None
            r = _LINE_START.match(text[nxt]) if nxt is not None else None
            right = r[1] if r else ""
            if right and not (right[0].islower() or right[0].isdigit() or m[1].isupper()):
                right = ""
            broken = model.joins(m[1], m[2], right)
            if not broken and right and f"{m[1]}-{right}".lower() not in model.hyphenated:
                fix = model.repair(m[1] + right)
                broken = fix is not None and model.counts.get(fix[0], 0) > 0
            if broken:
                found.add((i, "hyphen"))
                end = m.start(1)
                if right:
                    joined_right[nxt] = r.end(1)
                    if fix := model.repair(m[1] + right):
                        for at in fix[1]:
                            found.add((i if at < len(m[1]) else nxt, "misread"))
                elif model.repair(m[1], "start"):
                    found.add((i, "misread"))
        start = joined_right.get(i, 0)
        if lone and _LONE_DIGIT.search(line):
            found.add((i, "misread"))
        if k == 0 and line.lstrip()[:1].islower():  # the page may begin inside a word
            w = _LEX.search(line)
            if w and w.end() <= end and w[0].lower() not in model.counts:
                if model.repair(w[0], "end"):
                    found.add((i, "misread"))
                start = w.end()
        if any(w in line for w in suspects) and not suspects.isdisjoint(_LEX.findall(line, start, end)):
            found.add((i, "misread"))
    return sorted(found)


def _alike(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 3 and a[:3] == b[:3] and SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.88


def section_furniture(lines: list[str], model: ScanModel) -> dict[int, str]:
    """Furniture of pages that follow one another without marked page ends."""
    out: dict[int, str] = {}
    bare: list[tuple[int, int]] = []
    stripped = [x.strip() for x in lines]
    places, times = _places(lines), Counter(x.lower() for x in stripped if 0 < len(x) < 90)
    for i, s in enumerate(stripped):
        if not s:
            continue
        number = page_number(s) if len(s) <= 24 else None
        if number is None:
            # worth a look: at an edge, repeated, or neither begun nor ended like a running text
            odd = not s[0].islower() and s[-1] not in ".,;:-"
            if model.furniture is not None and len(s) < 90 and (odd or i in places or times[s.lower()] > 1) and model.furniture.predict(line_features(s, "")) == "F":
                out[i] = "header"
        elif number[1] == "bare":
            bare.append((i, number[0]))
        else:
            out[i] = "page_number"
    known = {shape_key(lines[i]) for i in out if out[i] == "header"}
    starts = {k[:3] for k in known}
    for i, line in enumerate(lines) if known else ():  # a header that was misread on this page
        if i not in out and 8 <= len(stripped[i]) < 90 and stripped[i][:3].lower() in starts and any(_alike(shape_key(line), k) for k in known):
            out[i] = "header"
    # bare numbers: the longest run that counts up by one, a page's length apart
    best: list[int] = []
    chains: dict[int, list[int]] = {}
    for i, n in bare:
        options = [chains[j] for j, m in bare if j < i - 5 and m == n - 1 and j in chains]
        chains[i] = [*max(options, key=len, default=[]), i]
        if len(chains[i]) > len(best):
            best = chains[i]
    if len(best) > 1:
        out.update(dict.fromkeys(best, "page_number"))
    else:  # a lone one: where it interrupts a sentence, or closes the last page
        for i, _ in bare:
            above = next((lines[j].strip() for j in range(i - 1, -1, -1) if lines[j].strip() and j not in out), "")
            below = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip() and j not in out), "")
            if above and below and above[-1] not in ".:;!?" and below[:1].islower() and len(above) > 30:
                out[i] = "page_number"
    return out


def _sections(text: str) -> Iterator[tuple[int, list[str]]]:
    """``(index of its first line, lines)`` of each file joined in a text."""
    lines, start = text.split("\n"), 0
    for i, line in enumerate([*lines, SOURCE_LINE]):
        if line.startswith(SOURCE_LINE):
            if i > start:
                yield start, lines[start:i]
            start = i + 1


def is_scan(lines: list[str]) -> bool:
    """A scan has lines wrapped at one width: paragraphs go on from line to line."""
    wrapped = sum(bool(a.strip()) and bool(b.strip()) and a.rstrip()[-1:] not in ".:;!?" and b[:1].islower() for a, b in zip(lines, lines[1:], strict=False))
    return wrapped >= 2 or any(re.search(rf"[^\W\d_][{BREAK_HYPHENS}]$", x) for x in lines)


def page_findings(lines: list[str], model: ScanModel) -> tuple[dict[int, str], dict[int, int]]:
    """``(furniture, bare)`` of one page: furniture by line index, and bare numbers at the edges."""
    furniture: dict[int, str] = {}
    bare: dict[int, int] = {}
    for i, place in _places(lines).items():
        number = page_number(lines[i])
        if number is None:
            if model.furniture is not None and model.furniture.predict(line_features(lines[i], place)) == "F":
                furniture[i] = "header"
        elif number[1] == "bare":
            bare[i] = number[0]
        else:
            furniture[i] = "page_number"
    if "page_number" in furniture.values():  # a page has one number; the bare one is a cell of a table
        bare = {}
    return furniture, bare


def _cased(right: str, read: str) -> str:
    if read.isupper() and len(read) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if read[:1].isupper() else right


def readable(lines: list[str], furniture: set[int], model: ScanModel) -> list[str]:
    """The paragraphs of a page or section: furniture gone, broken words joined, misread words repaired."""
    broken = {i for i, kind in body_findings(lines, furniture, model) if kind == "hyphen"}
    paragraphs: list[str] = [""]
    glue = ""
    for i, line in enumerate(lines):
        if i in furniture:
            continue
        text = line.strip()
        if not text:
            # a page's edge doesn't end a paragraph: the break counts only after a full stop
            if paragraphs[-1] and not glue and paragraphs[-1][-1] in ".:;!?" or paragraphs[-1] and len(paragraphs[-1]) < 60:
                paragraphs.append("")
            continue
        if paragraphs[-1] and not glue:
            paragraphs[-1] += " "
        paragraphs[-1] += text.rstrip(BREAK_HYPHENS) if i in broken else text
        glue = "join" if i in broken or text[-1] == "-" else ""

    def right(m: re.Match) -> str:
        fix = model.repair(m[0])
        return m[0] if fix is None else _cased(fix[0], m[0])

    return [_LONE_DIGIT.sub(lambda m: m[0].translate(_TO_DIGITS), _LEX.sub(right, p)) for p in paragraphs if p]


def _pages(pages: DataFrame, states: DataFrame) -> DataFrame:
    """Both tables in one shape: ``rec_table, rec_id, file, named, page_no, text``; null texts leave."""
    file = F.xxhash64(F.coalesce(F.col("eis_id"), F.lit("")), F.coalesce(F.col("name"), F.lit("")))
    a = pages.select(F.lit("ocr_pages").alias("rec_table"), F.col("page_id").alias("rec_id"), file.alias("file"), (F.col("eis_id").isNotNull() & F.col("name").isNotNull()).alias("named"), "page_no", "text")
    b = states.select(F.lit("run_states").alias("rec_table"), F.col("state_id").alias("rec_id"), F.lit(None).cast("long").alias("file"), F.lit(False).alias("named"), F.lit(None).cast("int").alias("page_no"), F.col("documents_text").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull())


def _broken_words(text: str) -> Iterator[str]:
    """Words that a line's end may have broken, put together: with the first word of each of the next lines, as furniture may stand between."""
    if not any(h in text for h in BREAK_HYPHENS):
        return
    lines = [x for x in text.split("\n") if x.strip()]
    for k, line in enumerate(lines):
        if line.rstrip()[-1:] in BREAK_HYPHENS and (m := _LINE_END.search(line.rstrip())):
            for below in lines[k + 1 : k + 6]:
                if r := _LINE_START.match(below):
                    yield (m[1] + r[1]).lower()


def _word_counts(rows: DataFrame) -> DataFrame:
    """``hyphen, word, n``: all words over all lines inside pages, and hyphenated ones; words that only a line's end makes have n 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens: Counter = Counter()
            words: Counter = Counter()
            for kind, text in zip(batch["rec_table"], batch["text"], strict=True):
                whole = regular_text(text)
                words.update(dict.fromkeys(_broken_words(text), 0))
                if whole != text:
                    words.update(dict.fromkeys(_broken_words(whole), 0))
                if kind == "ocr_pages":  # without the edges, where furniture repeats its words
                    lines = whole.split("\n")
                    inside = [i for i, x in enumerate(text.split("\n")) if x.strip()][ZONE:-ZONE]
                    edge = set(range(len(lines))).difference(inside)
                    for t in _TOKEN.findall("\n".join([lines[i] for i in edge]).lower()):
                        tokens.setdefault(t, 0)
                    whole = "\n".join([lines[i] for i in inside])
                tokens.update(_TOKEN.findall(whole.lower()))
            pairs: Counter = Counter()
            for token, n in tokens.items():
                parts = token.split("-")
                for w in parts:
                    words[w] += n
                if len(parts) == 2 and parts[0].isalpha() and parts[1].isalpha():
                    pairs[token] += n
            out = [(False, w, n) for w, n in words.items()] + [(True, w, n) for w, n in pairs.items() if n]
            yield pd.DataFrame(out, columns=["hyphen", "word", "n"])

    return cut(rows.select("rec_table", "text").mapInPandas(count, "hyphen boolean, word string, n long").groupBy("hyphen", "word").agg(F.sum("n").alias("n")))


def _established(counted: DataFrame) -> tuple[dict[str, int], dict[str, int], int]:
    """Counts of established words (at most SHARE) and of hyphenated ones (at most 20,000), and of all words."""
    total = counted.where("NOT hyphen AND n >= 3").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = counted.where("NOT hyphen").where(F.col("n") >= max(3, total / SHARE)).select("word", "n").toPandas()
    # a hyphenated word is established when it makes up a share of the text
    pairs = counted.where("hyphen").where(F.col("n") >= max(3, total // 20_000)).select("word", "n").toPandas()
    return dict(zip(top["word"], top["n"], strict=True)), dict(zip(pairs["word"], pairs["n"], strict=True)), total


def _furniture_examples(rows: DataFrame) -> list[tuple[list[str], str]]:
    """Lines that three or more pages of a file share at their edges, and lines from inside pages.

    The lines from inside are shown at all places in turn, so that place alone proves nothing.
    At most TRAIN_LINES lines are taken, in the order of a hash.
    """

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, page, text in zip(batch["file"], batch["page_no"], batch["text"], strict=True):
                lines = text.split("\n")
                places = _places(lines)
                for i in places:
                    if page_number(lines[i]) is None:
                        out.append((file, shape_key(lines[i]), page, lines[i], places[i]))
                inside = [x for i, x in enumerate(lines) if x.strip() and i not in places and page_number(x) is None]
                for k in {zlib.crc32(text.encode("utf-8", "replace")) % len(inside), len(inside) // 2} if inside else ():
                    out.append((file, None, page, inside[k], "m"))
            yield pd.DataFrame(out, columns=["file", "key", "page_no", "line", "place"])

    lines = rows.where("rec_table = 'ocr_pages'").select("file", "page_no", "text").mapInPandas(lines_of, "file long, key string, page_no int, line string, place string")
    repeated = lines.where("place <> 'm'").groupBy("file", "key", "page_no").agg(F.min(F.struct("line", "place")).alias("x")).groupBy("file", "key").agg(F.count("*").alias("n"), F.min("x").alias("x"))
    yes = repeated.where("n >= 3").orderBy(F.xxhash64("file", "key"), "key").limit(TRAIN_LINES // 3).select("x.*").toPandas()
    no = lines.where("place = 'm'").orderBy(F.xxhash64("file", "page_no", "line"), "line").limit(TRAIN_LINES * 2 // 3).select("line").toPandas()
    out = []
    for line, place in zip(yes["line"], yes["place"], strict=True):
        out += [(line_features(line, place), "F"), (line_features(line, ""), "F")]
    for k, line in enumerate(no["line"]):
        out += [(line_features(line, ("t0", "t1", "b0", "b1")[k % 4]), "B"), (line_features(line, ""), "B")]
    return out


def train_scan_model(rows: DataFrame) -> tuple[ScanModel, DataFrame]:
    """The model without repairs, and the repairs of all words: ``word, n, fix, at``."""
    counted = _word_counts(rows)
    counts, hyphenated, total = _established(counted)
    editor, spans = train_editor(counts)
    lefts = {w.partition("-")[0] for w in hyphenated}
    examples = _furniture_examples(rows)
    furniture = AveragedPerceptron(["B", "F"]).train(examples, epochs=4) if any(y == "F" for _, y in examples) else None
    model = ScanModel(counts, hyphenated, editor, spans, train_joiner(counts, hyphenated, lefts), furniture, lefts)
    for w, n in counts.items():
        if n >= max(3, total // PREFIX_SHARE) and w.isalpha():
            for k in range(2, len(w)):
                model.starts[w[:k]] = model.starts.get(w[:k], 0) + n
                model.ends[w[k:]] = model.ends.get(w[k:], 0) + n
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for w, n in zip(batch["word"], batch["n"], strict=True):
                if (fix := model.judge(w, n)) is not None:
                    out.append((w, max(1, n), *fix))
            yield pd.DataFrame(out, columns=["word", "n", "fix", "at"])

    words = counted.where("NOT hyphen").select("word", "n").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return model, cut(words.mapInPandas(judge, "word string, n long, fix string, at array<int>"))


def _with_repairs(rows: DataFrame, model: ScanModel, repairs: DataFrame) -> DataFrame:
    """``rows`` with ``fixes``: null where the model, which is then complete, holds all repairs, else those of the row's own words."""
    if repairs.limit(REPAIRS + 1).count() <= REPAIRS:
        model.repairs = {r["word"]: (r["fix"], list(r["at"])) for r in repairs.toLocalIterator()}
        return rows.withColumn("fixes", F.lit(None).cast("array<struct<word:string,fix:string,at:array<int>>>"))
    held = cut(rows.withColumn("_uid", F.monotonically_increasing_id()))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, text in zip(batch["_uid"], batch["text"], strict=True):
                both = text + "\n" + regular_text(text)
                out += [(uid, w) for w in {w for t in _TOKEN.findall(both.lower()) for w in t.split("-")} | set(_broken_words(both))]
            yield pd.DataFrame(out, columns=["_uid", "word"])

    own = cut(held.select("_uid", "text").mapInPandas(words, "_uid long, word string"))
    found = hot_join(own, repairs.select("word", "n", F.struct("word", "fix", "at").alias("x")), "word", "n", own.count())
    each = found.groupBy("_uid").agg(F.collect_list("x").alias("fixes"))  # as wide as one text
    return held.join(each, "_uid", "left").drop("_uid").withColumn("fixes", F.coalesce("fixes", F.array().cast("array<struct<word:string,fix:string,at:array<int>>>")))


def _use(model: ScanModel, fixes) -> ScanModel:  # noqa: ANN001
    """The model for one row: its own repairs where they came by join."""
    if fixes is not None:
        model.repairs = {x["word"]: (x["fix"], list(map(int, x["at"]))) for x in fixes}
    return model


def _page_numbers(bare: DataFrame) -> DataFrame:
    """The rows of ``bare`` (``file, page_no, distance`` and more) that are page numbers: distance 0, or one that two pages of the file keep."""
    keyed = bare.withColumn("place_key", F.xxhash64("file", "distance"))
    kept = keyed.groupBy("place_key", "page_no").agg(F.count("*").alias("n")).groupBy("place_key").agg(F.sum("n").alias("n"), F.count("*").alias("n_pages"))
    several = hot_join(keyed.where("distance <> 0"), cut(kept.where("n_pages > 1").select("place_key", "n")), "place_key", "n", keyed.count())
    return bare.where("distance = 0").unionByName(several.select(bare.columns))


def _laid_out(rows: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """``rec_id, page_no, text, skip, before, after`` of the scanned pages.

    ``skip`` holds the lines (from 0) that are furniture or page numbers; ``before`` is the last
    body line of the page before in the same file, ``after`` the first one of the next page.
    Where a page comes twice, its neighbours see the one with the lowest rec_id. Pages without
    file name or page number have no neighbours.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            furniture, bare = [], []
            for page, text in zip(batch["page_no"], batch["text"], strict=True):
                f, b = page_findings(text.split("\n"), model)
                furniture.append(sorted(f))
                bare.append([] if pd.isna(page) else [{"line_no": i, "distance": n - int(page)} for i, n in b.items()])
            yield batch.assign(page_no=batch["page_no"].astype("Int32"), furniture=furniture, bare=bare)

    fields = ["rec_id", "file", "named", "page_no", "text", "fixes"]
    schema = "rec_id long, file long, named boolean, page_no int, text string, fixes array<struct<word:string,fix:string,at:array<int>>>, furniture array<int>, bare array<struct<line_no:int,distance:int>>"
    looked = cut(rows.where("rec_table = 'ocr_pages'").select(fields).mapInPandas(look, schema).withColumn("body", F.xxhash64("text")))
    bare = looked.select("rec_id", "body", "file", "page_no", F.inline("bare"))
    own = ["rec_id", "page_no", "body"]
    numbers = _page_numbers(bare).groupBy(*own).agg(F.collect_set("line_no").alias("numbers"))
    placed = looked.join(numbers, own, "left").withColumn("skip", F.when(F.col("numbers").isNull(), F.col("furniture")).otherwise(F.array_union("furniture", "numbers")))
    body = F.filter(F.split("text", "\n", -1), lambda x, i: x.rlike(r"(?U)\S") & ~F.array_contains("skip", i))
    placed = cut(placed.withColumn("_b", body).select(*own, "file", "named", "text", "fixes", "skip", F.get("_b", F.lit(0)).alias("first"), F.get("_b", F.size("_b") - 1).alias("last")))
    edges = placed.where("named AND page_no IS NOT NULL").groupBy("file", "page_no").agg(F.count("*").alias("n"), F.min(F.struct("rec_id", "body", "first", "last")).alias("e"))
    file = placed.where("NOT named OR page_no IS NULL").select("rec_id", "page_no", "text", "fixes", "skip", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    # one row per page meets its two neighbours; copies of a page then meet that row
    here = edges.select("file", "page_no", "n", F.col("e.first").alias("first"), F.col("e.last").alias("last"))
    near = here.select("file", "page_no", "n")
    near = near.join(here.select("file", (F.col("page_no") + 1).alias("page_no"), F.col("last").alias("before")), ["file", "page_no"], "left")
    near = near.join(here.select("file", (F.col("page_no") - 1).alias("page_no"), F.col("first").alias("after")), ["file", "page_no"], "left")
    key = F.xxhash64("file", "page_no").alias("page_key")
    near = cut(near.select(key, "n", "before", "after"))
    known = placed.where("named AND page_no IS NOT NULL").select("rec_id", "page_no", "text", "fixes", "skip", key)
    return hot_join(known, near, "page_key", "n", placed.count(), "left").select(file.columns).unionByName(file)


def _carried(last: str | None, first: str | None, model: ScanModel) -> str:
    """What the next page begins with that completes a word broken at the end of this one; '' if nothing does."""
    if not last or not first or last.rstrip()[-1:] not in BREAK_HYPHENS:
        return ""
    m = _LINE_START.match(first)
    if m is None or not (m[1][0].islower() or m[1][0].isdigit() or m[1].isupper()) or (0, "hyphen") not in body_findings([last, first], set(), model):
        return ""
    return first.split()[0]


def scan_findings(pages: DataFrame, states: DataFrame) -> DataFrame:
    """``rec_table, rec_id, line_no, kind`` of all faults of scanned pages and of scanned parts of states.

    Kinds are header, page_number, hyphen and misread. Null and empty texts have no faults.
    Pages that come twice are each read. Bare numbers at a page's edge are page numbers if they
    equal the page's number, or keep one distance to it on two pages of the file or more.
    """
    rows = _pages(pages, states)
    model, repairs = train_scan_model(rows)
    rows = _with_repairs(rows, model, repairs)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out: list[tuple] = []
            for kind, rec, file, page, text, fixes in zip(batch["rec_table"], batch["rec_id"], batch["file"], batch["page_no"], batch["text"], batch["fixes"], strict=True):
                _use(model, fixes)
                if kind == "ocr_pages":
                    lines = text.split("\n")
                    furniture, bare = page_findings(lines, model)
                    faults = [*furniture.items(), *body_findings(lines, {*furniture, *bare}, model)]
                    out += [(kind, rec, i + 1, k, None, None, None) for i, k in faults]
                    if not pd.isna(page):
                        out += [(kind, rec, i + 1, "bare", file, int(page), n - int(page)) for i, n in bare.items()]
                    continue
                for first, lines in _sections(text):
                    if is_scan(lines):
                        furniture = section_furniture(lines, model)
                        faults = [*furniture.items(), *body_findings(lines, set(furniture), model)]
                        out += [(kind, rec, first + i + 1, k, None, None, None) for i, k in faults]
            frame = pd.DataFrame(out, columns=["rec_table", "rec_id", "line_no", "kind", "file", "page_no", "distance"])
            yield frame.astype({"file": "Int64", "page_no": "Int32", "distance": "Int32"})

    found = cut(rows.mapInPandas(run, "rec_table string, rec_id long, line_no int, kind string, file long, page_no int, distance int"))
    columns = ["rec_table", "rec_id", "line_no", "kind"]
    numbers = _page_numbers(found.where("kind = 'bare'")).select(columns).withColumn("kind", F.lit("page_number"))
    return found.where("kind <> 'bare'").select(columns).unionByName(numbers).distinct()


def repair_scans(pages: DataFrame, states: DataFrame) -> DataFrame:
    """``rec_table, rec_id, text``: the readable paragraphs of each page and state, blank lines between.

    Parts of a state that are no scans stay as they are, file lines included. Null texts give
    null, empty ones ''. The same bare numbers leave as in ``scan_findings``. A word broken at a
    page's end is joined there, and the next page begins after it; the rest of a paragraph that
    goes on over a page stays in the row of its page.
    """
    rows = _pages(pages, states)
    model, repairs = train_scan_model(rows)
    rows = _with_repairs(rows, model, repairs)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for text, skip, before, after, fixes in zip(batch["text"], batch["skip"], batch["before"], batch["after"], batch["fixes"], strict=True):
                _use(model, fixes)
                lines, skip = text.split("\n"), set(map(int, skip))
                body = [i for i, x in enumerate(lines) if x.strip() and i not in skip]
                if body:
                    first, last = lines[body[0]], lines[body[-1]]
                    if word := _carried(last, after, model):
                        lines.insert(body[-1] + 1, word)
                        skip = {i + (i > body[-1]) for i in skip}
                    if word := _carried(before, first, model):
                        lines[body[0]] = lines[body[0]].lstrip()[len(word) :]
                out.append("\n\n".join(readable(lines, skip, model)))
            yield pd.DataFrame({"rec_table": "ocr_pages", "rec_id": batch["rec_id"], "text": out})

    def read_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for text, fixes in zip(batch["text"], batch["fixes"], strict=True):
                _use(model, fixes)
                lines = text.split("\n")
                done, parts = 0, []
                for first, own in _sections(text):
                    parts += lines[done:first]
                    parts += "\n\n".join(readable(own, set(section_furniture(own, model)), model)).split("\n") if is_scan(own) else own
                    done = first + len(own)
                out.append("\n".join([*parts, *lines[done:]]))
            yield pd.DataFrame({"rec_table": "run_states", "rec_id": batch["rec_id"], "text": out})

    schema = "rec_table string, rec_id long, text string"
    laid = _laid_out(rows, shared).select("rec_id", "text", "skip", "before", "after", "fixes")
    return laid.mapInPandas(read_pages, schema).unionByName(rows.where("rec_table = 'run_states'").select("rec_id", "text", "fixes").mapInPandas(read_states, schema))
