"""Several values packed in one field: one row per value with its position.

A cell falls into pieces wherever the field's grammar leaves no choice: at hard separators and
around quoted spans, which are atoms. Plain cells are cut by the JVM; only cells with quotes or
brackets are walked in Python. A piece without soft boundaries is a value for certain. Every
other piece is a lattice of atoms whose boundaries are decided by expectation-maximisation over
the whole column: the counts of certain values seed the frequencies, each round adds the values
expected in the open pieces, and Viterbi takes the most likely path.

Counts are exact: values are grouped, and looked up by a join of distinct open pieces with them.
What reaches the driver is one table of character-class bigrams (at most CLASSES squared).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import hot_join
from ledgerloom.session import cut


@dataclass(frozen=True)
class Grammar:
    """How separators of a field split outside quotes.

    hard: always. soft: the lattice decides; a run of blanks is one boundary. comma: "hard",
    "decimal" (not between two digits), "quoted" (only between two quoted values) or "never".
    """

    hard: str = ";|\n\r\t"
    soft: str = ""
    comma: str = "hard"


GRAMMARS = {
    "additional_cpv_extracted": Grammar(hard=";|\n\r\t/", soft=" ", comma="hard"),
    "weights_truth": Grammar(hard=";|\n\r\t/", soft=" ", comma="decimal"),
    "criteria_names_extracted": Grammar(hard=";|\n\r\t", soft="", comma="quoted"),
}

NOVEL = 0.1  # share of values that the spelling accounts for, not the counts
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]_{|}"  # classes of their own; other signs share one
CLASSES = len(SIGNS) + 6
_BLANK = " \t\r\n\f\v  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
_NEXT = re.compile(f"[{_BLANK}]*(.?)", re.DOTALL)
_RUN = re.compile(f"[{_BLANK}]+")
_AROUND_DASH = re.compile(r"\s*[-–—‐‑−]\s*")


def json_list(cell: str) -> list[str] | None:
    """The values of a bracketed list, or None where the cell is none."""
    s = cell.strip(_BLANK)
    if not (s.startswith("[") and s.endswith("]")):
        return None
    try:
        values = json.loads(s)
    except (ValueError, RecursionError):
        return None
    texts = ["" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values]
    return [t for t in (x.strip(_BLANK) for x in texts) if t]


# --- from cells to pieces ---------------------------------------------------------------------


def pieces_of(cell: str, grammar: Grammar) -> list[tuple[str, bool]]:
    """``(text, open)`` of the pieces of a cell; an open piece holds soft boundaries.

    A quote opens only at the start of a slot or atom and closes before a separator or the end;
    any other quote is a character.
    """
    listed = json_list(cell)
    if listed is not None:
        return [(t, False) for t in listed]
    out: list[tuple[str, bool]] = []
    n, i, start = len(cell), 0, 0  # start of the plain text that is not out yet
    fresh = True  # no character but blanks since the last separator or soft boundary
    quoted_before = False  # the slot's last atom was quoted and nothing follows it yet
    unclosed = False  # no quote that closes a value follows any more

    def flush(stop: int) -> None:
        text = cell[start:stop].strip(_BLANK)
        if text:
            out.append((text, len(atoms(text, grammar)) > 1))

    def ends_value(j: int) -> bool:
        while j < n and cell[j] in _BLANK and cell[j] not in grammar.hard:
            if cell[j] in grammar.soft:
                return True
            j += 1
        return j >= n or cell[j] in grammar.hard or cell[j] == "," and grammar.comma != "never"

    while i < n:
        c = cell[i]
        if c == '"' and fresh and not unclosed:
            j = i + 1
            while j < n:
                if cell[j] == '"':
                    if cell[j + 1 : j + 2] == '"':
                        j += 1
                    elif ends_value(j + 1):
                        break
                j += 1
            if j < n:
                flush(i)
                text = cell[i + 1 : j].replace('""', '"').strip(_BLANK)
                if text:
                    out.append((text, False))
                i = start = j + 1
                fresh, quoted_before = False, True
                continue
            unclosed = True
        split = c in grammar.hard
        if c == ",":
            if grammar.comma == "hard":
                split = True
            elif grammar.comma == "decimal":
                split = not (cell[i - 1 : i].isdecimal() and cell[i + 1 : i + 2].isdecimal())
            elif grammar.comma == "quoted":
                split = quoted_before and _NEXT.match(cell, i + 1)[1] == '"'
        if split:
            flush(i)
            start, fresh, quoted_before = i + 1, True, False
        elif c in grammar.soft:
            fresh = True
        elif c not in _BLANK:
            fresh = quoted_before = False
        i += 1
    flush(n)
    return out


def atoms(text: str, grammar: Grammar) -> list[str]:
    """The atoms of a plain piece, each with the blanks before it; a blank before a percent sign is no boundary."""
    if not grammar.soft or not any(c in text for c in grammar.soft):
        return [text]
    out, start = [], 0
    for m in _RUN.finditer(text):
        soft = next((k for k in range(m.start(), m.end()) if text[k] in grammar.soft), None)
        if soft is not None and soft > start and text[m.end() : m.end() + 1] not in ("", "%"):
            out.append(text[start:soft])
            start = soft
    return [*out, text[start:]]


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _plain_pieces(cell: Column, grammar: Grammar) -> Column:
    """``pieces_of`` for cells without quotes and brackets, as a column."""
    cuts = [_class(grammar.hard + ("," if grammar.comma == "hard" else ""))] if grammar.hard or grammar.comma == "hard" else []
    cuts += [r"(?<!\p{Nd}),|,(?!\p{Nd})"] if grammar.comma == "decimal" else []
    blank = _class(_BLANK)
    trimmed = F.transform(F.split(cell, "|".join(cuts), -1) if cuts else F.array(cell), lambda x: F.regexp_replace(x, f"^{blank}+|{blank}+$", ""))
    inner = f"{_class(grammar.soft)}{blank}*+[^%]" if grammar.soft else None
    soft = (lambda x: x.rlike(inner)) if inner else (lambda x: F.lit(False))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.struct(x.alias("text"), soft(x).alias("open")))


# --- the model --------------------------------------------------------------------------------


def segment_key(text: str) -> str:
    """What counts as the same value: kinds of dashes and lengths of blank runs make no difference."""
    return _RUN.sub(" ", _AROUND_DASH.sub("-", text.strip(_BLANK)))


def _kind(c: str) -> str:
    return "9" if c.isdecimal() else "a" if c.isalpha() else " " if c in _BLANK else c if c in SIGNS else "?"


class Spelling:
    """P(text) of a value never counted: a chain of character classes, learned from certain values.

    Before anything is seen an end is far likelier than a blank, so a soft boundary splits.
    """

    def __init__(self, bigrams: dict[tuple[str, str], float] | None = None) -> None:
        self.n = bigrams or {}
        self.total: dict[str, float] = {}
        for (a, _), n in self.n.items():
            self.total[a] = self.total.get(a, 0.0) + n

    def step(self, a: str, b: str) -> float:
        """log P(class b | class a); '^' starts and '$' ends a value."""
        rest = 0.49 / CLASSES
        prior = 0.5 if b == "$" else 0.01 if b == " " else rest
        return math.log((self.n.get((a, b), 0.0) + prior) / (self.total.get(a, 0.0) + 1.0))

    def inside(self, text: str, before: str) -> tuple[float, str]:
        """``(log P, last class)`` of the characters of a text after a class."""
        score = 0.0
        for c in text:
            k = _kind(c)
            score += self.step(before, k) - (2.3 if k == "9" else 3.4 if k == "a" else 0.0)
            before = k
        return score, before


class Lattice:
    """All ways to read one open piece: counted values as edges, and spelled ones through a chain state.

    A counted edge weighs its share of all values. A value of any length may instead be spelled
    out, atom by atom, so no length is ruled out and the work is linear in the atoms.
    """

    def __init__(self, parts: list[str], counts: dict[str, float], total: float, longest: int, spelling: Spelling) -> None:
        self.parts, n = parts, len(parts)
        self.known: list[tuple[int, int, float]] = []
        for i in range(n):
            text = ""
            for j in range(i, min(n, i + longest)):
                text += parts[j]
                c = counts.get(segment_key(text), 0.0)
                if c > 0:
                    self.known.append((i, j + 1, math.log((1 - NOVEL) * c / max(total, 1.0))))
        self.first, self.more, self.close = [], [], []
        for p in parts:
            word = segment_key(p)
            score, last = spelling.inside(word, "^")
            self.first.append(math.log(NOVEL) + score)
            self.close.append(spelling.step(last, "$"))
            self.more.append((word, last))
        # the cost of going on from atom i to atom i + 1 inside one spelled value
        self.link = [spelling.inside(" " + self.more[i + 1][0], self.more[i][1])[0] for i in range(n - 1)]

    def _ahead(self, add) -> tuple[list[float], list[float]]:  # noqa: ANN001
        n = len(self.parts)
        done, inside = [0.0] + [-math.inf] * n, [-math.inf] * n
        by_start: dict[int, list[tuple[int, float]]] = {}
        for i, j, w in self.known:
            by_start.setdefault(i, []).append((j, w))
        for i in range(n):
            inside[i] = add(inside[i], done[i] + self.first[i])
            for j, w in by_start.get(i, ()):
                done[j] = add(done[j], done[i] + w)
            done[i + 1] = add(done[i + 1], inside[i] + self.close[i])
            if i + 1 < n:
                inside[i + 1] = inside[i] + self.link[i]
        return done, inside

    def _back(self) -> tuple[list[float], list[float]]:
        n = len(self.parts)
        done, inside = [-math.inf] * n + [0.0], [-math.inf] * n
        by_start: dict[int, list[tuple[int, float]]] = {}
        for i, j, w in self.known:
            by_start.setdefault(i, []).append((j, w))
        for i in range(n - 1, -1, -1):
            inside[i] = self.close[i] + done[i + 1]
            if i + 1 < n:
                inside[i] = _log_add(inside[i], self.link[i] + inside[i + 1])
            done[i] = self.first[i] + inside[i]
            for j, w in by_start.get(i, ()):
                done[i] = _log_add(done[i], w + done[j])
        return done, inside

    def expected(self, least: float = 1e-3) -> Iterator[tuple[str, int, float]]:
        """``(value, atoms, expected times)`` (forward-backward); less than ``least`` counts as never."""
        ahead, _ = self._ahead(_log_add)
        back, inside = self._back()
        z, sums = back[0], {}
        for i, j, w in self.known:
            sums[i, j] = math.exp(ahead[i] + w + back[j] - z)
        for i in range(len(self.parts)):
            at = ahead[i] + self.first[i] - z
            for j in range(i, len(self.parts)):
                if math.exp(min(0.0, at + inside[j])) < least:  # nothing that goes on from here weighs enough
                    break
                sums[i, j + 1] = sums.get((i, j + 1), 0.0) + math.exp(at + self.close[j] + back[j + 1])
                if j < len(self.link):
                    at += self.link[j]
        for (i, j), e in sums.items():
            if e > least:
                yield segment_key("".join(self.parts[i:j])), j - i, e

    def best(self) -> list[str]:
        """The most likely values (Viterbi); ties go to more values."""
        n = len(self.parts)
        score, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
        run, begun = [-math.inf] * n, [0] * n
        by_start: dict[int, list[tuple[int, float]]] = {}
        for i, j, w in self.known:
            by_start.setdefault(i, []).append((j, w))
        for i in range(n):
            if score[i] + self.first[i] >= run[i]:
                run[i], begun[i] = score[i] + self.first[i], i
            for j, w in by_start.get(i, ()):
                if score[i] + w > score[j]:
                    score[j], came[j] = score[i] + w, i
            if run[i] + self.close[i] > score[i + 1]:
                score[i + 1], came[i + 1] = run[i] + self.close[i], begun[i]
            if i + 1 < n:
                run[i + 1], begun[i + 1] = run[i] + self.link[i], begun[i]
        out, j = [], n
        while j:
            out.append("".join(self.parts[came[j] : j]).strip(_BLANK))
            j = came[j]
        return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def split_cell(cell: str, grammar: Grammar) -> list[str]:
    """The values of one cell for itself: soft boundaries are decided by spelling before anything is learned."""
    out = []
    for text, is_open in pieces_of(cell, grammar):
        out += Lattice(atoms(text, grammar), {}, 0.0, 1, Spelling()).best() if is_open else [text]
    return out


# --- over a table -----------------------------------------------------------------------------


def _key(field: Column, text: Column) -> Column:
    same = F.regexp_replace(F.regexp_replace(text, r"\s*[-–—‐‑−]\s*", "-"), f"{_class(_BLANK)}+", " ")
    return F.concat(field, F.lit("\u0001"), same)


def _spellings(certain: DataFrame, fields: list[str]) -> dict[str, Spelling]:
    """Class bigrams of the certain values by field: at most CLASSES squared numbers each."""
    shape = F.regexp_replace(F.col("text"), r"\p{Nd}", "9")
    shape = F.regexp_replace(F.regexp_replace(shape, r"\p{L}", "a"), f"{_class(_BLANK)}+", " ")
    shape = F.regexp_replace(shape, f"[^9a {''.join(chr(92) + c for c in SIGNS)}]", "?")
    shapes = certain.select("field", "n", F.concat(F.lit("^"), shape, F.lit("$")).alias("s")).groupBy("field", "s").agg(F.sum("n").alias("n"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2))))
    found: dict[str, dict[tuple[str, str], float]] = {f: {} for f in fields}
    for r in shapes.select("field", "n", pair.alias("p")).groupBy("field", "p").agg(F.sum("n").alias("n")).collect():
        found[r["field"]][r["p"][0], r["p"][1]] = float(r["n"])
    return {f: Spelling(n) for f, n in found.items()}


def _solve(certain: DataFrame, opened: DataFrame, grammars: dict[str, Grammar], rounds: int) -> DataFrame:
    """``key, n, parts``: the values of each distinct open piece, after ``rounds`` of EM.

    ``certain`` holds ``field, text, n``, ``opened`` ``key, field, text, n``. A value expected in
    one distinct open piece only proves nothing: its count from open pieces is less by one.
    """
    fields = sorted({f for f, g in grammars.items() if g.soft})
    spellings = _spellings(certain, fields)
    sure = cut(certain.groupBy(_key(F.col("field"), F.col("text")).alias("seg")).agg(F.sum("n").cast("double").alias("c"), F.max(F.size(F.split(F.trim("text"), f"{_class(_BLANK)}+"))).alias("len"), F.first("field").alias("field")))
    counts, looked, width = sure, None, 0
    for turn in range(rounds + 1):
        sums = {r["field"]: (r["c"], r["len"]) for r in counts.groupBy("field").agg(F.sum("c").alias("c"), F.max("len").alias("len")).collect()}
        totals = {f: sums.get(f, (0.0, 1)) for f in fields}
        longest = max(n for _, n in totals.values())
        if longest != width:  # segments as long as the longest value known so far
            width = longest

            def segments(batches: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    out = []
                    for key, field, text in zip(batch["key"], batch["field"], batch["text"], strict=True):
                        parts = atoms(text, grammars[field])
                        found = {segment_key("".join(parts[i:j])) for i in range(len(parts)) for j in range(i + 1, min(len(parts), i + width) + 1)}
                        out.extend((key, f"{field}\x01{s}") for s in found)
                    yield pd.DataFrame(out, columns=["key", "seg"])

            looked = cut(opened.select("key", "field", "text").mapInPandas(segments, "key string, seg string"))
            asked = cut(looked.groupBy("seg").agg(F.count("*").alias("w")))
            n_looked = looked.count()
        small = cut(asked.join(counts.where("c > 0").select("seg", "c"), "seg"))
        hits = hot_join(looked, small, "seg", "w", n_looked).select("key", F.struct("seg", "c").alias("h"))
        stub = opened.select("key", F.lit(None).cast("struct<seg:string,c:double>").alias("h"))
        gathered = hits.unionByName(stub).groupBy("key").agg(F.collect_list("h").alias("hits"))  # as wide as one piece
        placed = opened.join(gathered, "key")

        def lattices(batch: pd.DataFrame, totals: dict = totals) -> Iterator[tuple[str, str, Lattice]]:
            for key, field, text, hits in zip(batch["key"], batch["field"], batch["text"], batch["hits"], strict=True):
                known = {h["seg"].partition("\x01")[2]: h["c"] for h in hits}
                total, longest = totals[field]
                yield key, field, Lattice(atoms(text, grammars[field]), known, total, longest, spellings[field])

        if turn == rounds:
            break

        def expect(batches: Iterator[pd.DataFrame], lattices=lattices) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for batch in batches:
                out = [(f"{f}\x01{t}", f, size, e) for _, f, lattice in lattices(batch) for t, size, e in lattice.expected()]
                yield pd.DataFrame(out, columns=["seg", "field", "len", "e"])

        hoped = placed.mapInPandas(expect, "seg string, field string, len int, e double").groupBy("seg", "field").agg(F.greatest(F.sum("e") - 1, F.lit(0.0)).alias("c"), F.max("len").alias("len")).where("c > 0")
        counts = cut(sure.select("seg", "field", "c", "len").unionByName(hoped.select("seg", "field", "c", "len")).groupBy("seg").agg(F.first("field").alias("field"), F.sum("c").alias("c"), F.max("len").alias("len")))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(key, lattice.best()) for key, _, lattice in lattices(batch)]
            yield pd.DataFrame({"key": [k for k, _ in done], "n": batch["n"].to_numpy(), "parts": [v for _, v in done]})

    return cut(placed.select("key", "field", "text", "n", "hits").mapInPandas(decide, "key string, n long, parts array<string>"))


def unpack_values(df: DataFrame, key: str, grammars: dict[str, Grammar] | None = None, rounds: int = 2) -> DataFrame:
    """``key, field_name, value_pos, value_text``: one row per value of the named fields.

    Null, empty and blank cells and empty slots give no row and take no position; repeats are
    kept. Rows with the same key are each unpacked. Other columns are ignored. With ``rounds``
    of 0 nothing is learned, so soft boundaries separate nothing.
    """
    grammars = GRAMMARS if grammars is None else grammars
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("cell")) for f in grammars]
    long = df.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*pairs)).alias("p")).select("key", "p.*")
    long = long.where(F.col("cell").rlike(f"(?s)[^{_class(_BLANK)[1:]}")).withColumn("odd", F.col("cell").contains('"') | F.col("cell").rlike(rf"^{_class(_BLANK)}*\["))
    plain = F.lit(None)
    for f, g in grammars.items():
        plain = F.when(F.col("field") == f, _plain_pieces(F.col("cell"), g)).otherwise(plain)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"text": t, "open": o} for t, o in pieces_of(c, grammars[f])] for f, c in zip(batch["field"], batch["cell"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "field": batch["field"], "pieces": found})

    kind = df.schema[key].dataType.simpleString()
    walked = long.where("odd").select("key", "field", "cell").mapInPandas(walk, f"key {kind}, field string, pieces array<struct<text:string,open:boolean>>")
    pieces = long.where("NOT odd").select("key", "field", plain.alias("pieces")).unionByName(walked)
    has_open = F.exists("pieces", lambda p: p["open"])
    if not any(g.soft for g in grammars.values()) or rounds == 0:
        values = pieces.select("key", "field", F.col("pieces.text").alias("values"))
        return _numbered(values, key)
    pieces = cut(pieces.withColumn("uid", F.monotonically_increasing_id()))
    open_fields = [f for f, g in grammars.items() if g.soft]
    each = pieces.where(F.col("field").isin(open_fields)).select("field", F.explode("pieces").alias("p")).groupBy("field", "p.text", "p.open").agg(F.count("*").alias("n"))
    counted = cut(each)
    opened = cut(counted.where("open").select(F.concat("field", F.lit("\u0001"), "text").alias("key"), "field", "text", "n"))
    closed = pieces.where(~has_open).select("key", "field", F.col("pieces.text").alias("values"))
    if opened.isEmpty():
        return _numbered(closed, key)
    solved = _solve(counted.where("NOT open").select("field", "text", "n"), opened, grammars, rounds)
    mixed = pieces.where(has_open).select("uid", F.col("key").alias("own"), "field", F.posexplode("pieces").alias("no", "p"))
    sure = mixed.where("NOT p.open").select("uid", "own", "field", "no", F.array("p.text").alias("parts"))
    asked = mixed.where("p.open").select("uid", "own", "field", "no", F.concat("field", F.lit("\u0001"), "p.text").alias("key"))
    total = opened.agg(F.sum("n").alias("n")).first()["n"]
    read = hot_join(asked, solved, "key", "n", total).select("uid", "own", "field", "no", "parts")
    whole = sure.unionByName(read).groupBy("uid", "own", "field").agg(F.array_sort(F.collect_list(F.struct("no", "parts"))).alias("x"))  # as wide as one cell
    return _numbered(closed.unionByName(whole.select(F.col("own").alias("key"), "field", F.flatten("x.parts").alias("values"))), key)


def _numbered(values: DataFrame, key: str) -> DataFrame:
    at = values.select("key", "field", F.posexplode("values").alias("i", "v"))
    return at.select(F.col("key").alias(key), F.col("field").alias("field_name"), (F.col("i") + 1).alias("value_pos"), F.col("v").alias("value_text"))
