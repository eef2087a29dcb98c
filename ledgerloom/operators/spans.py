"""Spans of patterns in text, with positions, windows, and what stands around them.

What concerns one text stays in its row: arrays and higher-order functions, no Python and no
shuffle. Positions count characters from 0; a span is [start, stop).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import collapse, fold, let


def find_spans(text: Column, pattern: str) -> Column:
    """Array of ``hit, start, stop`` of a pattern; null text gives null.

    The positions are prefix sums over the pieces between the hits, so the pattern must not
    hold look-around that sees beyond a hit's own characters when split.
    """
    kind = "array<struct<hit:string,start:int,stop:int>>"

    def build(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
        starts = _starts(steps)
        span = lambda hit, start: F.struct(hit.alias("hit"), start.alias("start"), (start + F.length(hit)).alias("stop"))
        return F.when(F.size(x["hits"]) > 0, F.zip_with(x["hits"], starts, span)).otherwise(F.array().cast(kind))

    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.isNotNull(), let(pieces, build))


def _starts(steps: Column, block: int = 512) -> Column:
    """Where each hit starts, from the lengths of gap and hit: running sums, in blocks so that no array is grown hit by hit."""
    kind = "array<int>"

    def sums(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        step = lambda s, x: F.struct((s["at"] + x["g"] + x["h"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["g"])).alias("out"))
        return F.aggregate(part, zero, step)

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: sums(F.slice(x, b * block + 1, F.lit(block))))
        offsets = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), lambda s, y: F.struct((s["at"] + y["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return let(parts, lambda p: F.flatten(F.zip_with(p, offsets(p), lambda y, o: F.transform(y["out"], lambda v: v + o))))

    return F.when(F.size(steps) > 0, let(steps, whole)).otherwise(F.array().cast(kind))


def spans_of(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """One row per span: ``keys, hit, start, stop, text`` (the whole text, for windows)."""
    rows = df.select(*keys, F.col(text).alias("text"))
    return rows.select(*keys, "text", F.explode(find_spans(F.col("text"), pattern)).alias("s")).select(*keys, "s.*", "text")


def window_around(text: Column, start: Column, stop: Column, width: int) -> Column:
    """The text around a span, clamped to the text's ends."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(text, first + 1, F.least(F.length(text), stop + width) - first)


def pattern_candidates(df: DataFrame, group: list[str], order: list[str], text: str, pattern: str, width: int = 200) -> DataFrame:
    """Distinct hits per group: ``group, code, n_hits, first_context, rank``, in order of first appearance.

    Only the smallest context struct of each code travels, so frequent codes combine early.
    """
    hits = spans_of(df, [*group, *[c for c in order if c not in group]], text, pattern)
    hits = hits.withColumn("context", window_around(F.col("text"), F.col("start"), F.col("stop"), width))
    first = F.min(F.struct(*order, "start", "context")).alias("f")
    found = hits.groupBy(*group, F.col("hit").alias("code")).agg(F.count("*").alias("n_hits"), first)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*[f"f.{c}" for c in order], "f.start"))
    return found.withColumn("rank", rank).select(*group, "code", "n_hits", F.col("f.context").alias("first_context"), "rank")


def keyword_pattern(keyword: str) -> str:
    """A folded stem at a word's start, with flexible white space between its words."""
    return r"(?<![\p{L}\p{N}_])" + r"[\s\p{Z}]+".join(w for w in keyword.split())


def folded_hits(df: DataFrame, keys: list[str], text: str, keywords: dict[str, str]) -> DataFrame:
    """``keys, name, n_hits`` for each name whose stem occurs in the accent-folded text.

    One pass looks at every word's start for the longest stem; a hit counts for each stem it begins with.
    """
    bodies = {n: r"[\s\p{Z}]+".join(k.split()) for n, k in keywords.items()}
    any_of = "|".join(sorted(bodies.values(), key=lambda b: (-len(b), b)))
    hits = F.regexp_extract_all(fold(F.col(text)), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?=({any_of}))"), F.lit(1))
    rows = df.select(*keys, hits.alias("_hits")).where(F.size("_hits") > 0)
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.size(F.filter("_hits", lambda h: h.rlike(f"^(?:{b})"))).alias("n_hits")) for n, b in bodies.items()])
    return rows.select(*keys, F.explode(counts).alias("h")).select(*keys, "h.*").where("n_hits > 0")


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, line_no, line``: lines counted from 0, blank ones included."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.col(text), "\r\n|\n|\r", -1)).alias("line_no", "line"))


def heading_spans(text: Column, heading: str) -> Column:
    """Spans of whole lines that begin (after blanks and bars) with ``heading``."""
    return find_spans(text, rf"(?md)^[ \t|]*(?:{heading.removeprefix('^')}).*$")


def last_label(labels: Column, at: Column) -> Column:
    """``hit`` of the last of the spans that starts at or before a position, null before the first.

    An as-of join inside one row: labels and look-ups of a text never leave it.
    """
    return let(F.filter(labels, lambda h: h["start"] <= at), lambda before: F.get(before, F.size(before) - 1))["hit"]  # spans come in order


def line_at(text: Column, at: Column) -> Column:
    """Number of the line, from 0, that holds a position."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def labelled_hits(df: DataFrame, keys: list[str], text: str, pattern: str, heading: str, none: str = "unknown") -> DataFrame:
    """``keys, line_no, phase``: lines with a hit, and the last heading at or before them. No shuffle."""
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t"))
    rows = rows.select(*keys, "_t", find_spans(F.col("_t"), pattern).alias("_s"), heading_spans(F.col("_t"), heading).alias("_h"))

    def place(s: Column) -> Column:
        return F.struct(line_at(F.col("_t"), s["start"]).alias("line_no"), F.coalesce(F.trim(last_label(F.col("_h"), s["start"])), F.lit(none)).alias("phase"))

    return rows.select(*keys, F.explode(F.array_distinct(F.transform("_s", place))).alias("_p")).select(*keys, "_p.*")


def sections(df: DataFrame, keys: list[str], text: str, heading: str) -> DataFrame:
    """``keys, section, heading, start, stop, n_lines, n_chars``: what stands under each heading line.

    A heading opens a section and belongs to it; what comes before the first is section 0
    without heading (absent if the text begins with one). Characters of line ends don't count.
    Row-local: the text isn't cut into rows of lines.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t")).select(*keys, "_t", heading_spans(F.col("_t"), heading).alias("_h"))

    def build(h: Column) -> Column:
        first = F.array(F.struct(F.lit(None).cast("string").alias("hit"), F.lit(0).alias("start"), F.lit(0).alias("stop")))
        opened = F.when((F.size(h) > 0) & (F.get(h, F.lit(0))["start"] == 0), h).otherwise(F.concat(first, h))
        shift = F.when((F.size(h) > 0) & (F.get(h, F.lit(0))["start"] == 0), 1).otherwise(0)

        def cut(o: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(o, i + 1)["start"], F.length("_t"))
                return F.struct((i + shift).alias("section"), collapse(x["hit"]).alias("heading"), x["start"].alias("start"), stop.alias("stop"), (i + 1 == F.size(o)).alias("last"))

            return F.transform(o, one)

        return let(opened, cut)

    parts = rows.select(*keys, "_t", F.explode(let(F.col("_h"), build)).alias("_s")).select(*keys, "_t", "_s.*")
    body = F.substring(F.col("_t"), F.col("start") + 1, F.col("stop") - F.col("start"))
    ends = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return parts.select(*keys, "section", "heading", "start", "stop", (ends + F.col("last").cast("int")).alias("n_lines"), (F.col("stop") - F.col("start") - ends).alias("n_chars"))


def line_windows(df: DataFrame, keys: list[str], text: str, pattern: str, before: int = 1, after: int = 40, longest: int = 12_000) -> DataFrame:
    """``line_passages`` of the texts that aren't oversized, without the flag."""
    return line_passages(df, keys, text, pattern, before, after, longest).where("NOT oversized").drop("oversized")


def line_passages(df: DataFrame, keys: list[str], text: str, pattern: str, before: int = 1, after: int = 40, longest: int = 12_000) -> DataFrame:
    """Passages around matching lines: ``keys, passage_no, first_line, last_line, passage, oversized``.

    Each match takes lines before and after it; overlapping or touching ranges are one passage.
    Passages with the same text up to white space come once. ``oversized`` tells that the
    passages of a text together exceed ``longest``; none is left out or clipped. Row-local: only
    arrays of one text, no shuffle.
    """
    # one look at the whole text spares those without a match the work on their lines
    rows = df.where(F.lower(F.col(text)).rlike(f"(?m){pattern}")).select(*keys, F.split(F.col(text), "\n", -1).alias("_l"))
    n = F.size("_l")
    marked = F.transform("_l", lambda x, i: F.when(F.lower(x).rlike(pattern), F.struct(F.greatest(F.lit(0), i - before).alias("a"), F.least(n - 1, i + after).alias("b"))))
    ranges = F.filter(marked, lambda r: r.isNotNull())
    kind = "array<struct<a:int,b:int>>"

    def merge(done: Column, r: Column) -> Column:
        last = F.get(F.slice(done, -1, 1), F.lit(0))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (r["a"] <= last["b"] + 1), joined).otherwise(F.concat(done, F.array(r))).cast(kind)

    rows = rows.select(*keys, "_l", F.aggregate(ranges, F.array().cast(kind), merge).alias("_r"))
    joined = lambda r: F.array_join(F.slice(F.col("_l"), r["a"] + 1, r["b"] - r["a"] + 1), "\n")

    def passage(r: Column, i: Column) -> Column:
        return let(joined(r), lambda t: F.struct(F.md5(collapse(t)).alias("sig"), i.alias("i"), r["a"].alias("first_line"), r["b"].alias("last_line"), t.alias("passage")))

    def once(p: Column) -> Column:
        """Of equal signatures, side by side once sorted, the first; then in written order again."""
        first = F.filter(p, lambda x, k: (k == 0) | (F.get(p, k - 1)["sig"] != x["sig"]))
        return F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["first_line"].alias("first_line"), x["last_line"].alias("last_line"), x["passage"].alias("passage"))))

    rows = rows.where(F.size("_r") > 0).select(*keys, let(F.array_sort(F.transform("_r", passage)), once).alias("_p"))
    rows = rows.withColumn("_o", F.aggregate("_p", F.lit(0), lambda a, x: a + F.length(x["passage"])) > longest)
    return rows.select(*keys, "_o", F.posexplode("_p").alias("_i", "_x")).select(*keys, (F.col("_i") + 1).alias("passage_no"), "_x.first_line", "_x.last_line", "_x.passage", F.col("_o").alias("oversized"))


def line_chunks(df: DataFrame, keys: list[str], text: str, size: int = 2400) -> DataFrame:
    """``keys, chunk_no, first_line, last_line``: whole lines of a text packed into chunks of ``size``.

    A longer line stands alone; one character counts for each line end inside a chunk. The fold
    keeps only where chunks begin.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.transform(F.split(F.col(text), "\n", -1), F.length).alias("_n"))

    def step(s: Column, x: Column) -> Column:
        grown = s["used"] + 1 + x
        fits = (s["used"] >= 0) & (grown <= size)
        return F.struct((s["i"] + 1).alias("i"), F.when(fits, grown).otherwise(x).alias("used"), F.when(fits, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["i"]))).alias("starts"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("used"), F.array().cast("array<int>").alias("starts"))
    rows = rows.select(*keys, F.size("_n").alias("_k"), F.aggregate("_n", zero, step)["starts"].alias("_s"))
    bounds = F.transform("_s", lambda a, i: F.struct((i + 1).alias("chunk_no"), a.alias("first_line"), (F.coalesce(F.get("_s", i + 1), F.col("_k")) - 1).alias("last_line")))
    return rows.select(*keys, F.explode(bounds).alias("_b")).select(*keys, "_b.*")


def outside(bare: Column, typed: Column) -> Column:
    """The spans of one array that overlap none of another: a question inside one row."""
    return F.filter(bare, lambda b: ~F.exists(typed, lambda t: (b["start"] < t["stop"]) & (b["stop"] > t["start"])))


def overlap_anti(df: DataFrame, keys: list[str], text: str, bare: str, typed: str) -> DataFrame:
    """``keys, hit, start, stop``: hits of the pattern ``bare`` that overlap no hit of ``typed`` in the same text. No shuffle."""
    rows = df.select(*keys, F.struct(find_spans(F.col(text), bare).alias("b"), find_spans(F.col(text), typed).alias("t")).alias("_x"))
    return rows.select(*keys, F.explode(outside(F.col("_x.b"), F.col("_x.t"))).alias("_s")).select(*keys, "_s.*")


def greedy_chunks(units: DataFrame, keys: list[str], order: str, text: str, size: int = 2400) -> DataFrame:
    """Whole units packed in order into chunks of at most ``size`` characters (a longer unit stands alone).

    ``keys, order, chunk_no``; one blank counts between units of a chunk. The fold runs over the
    lengths of one document's units, not over their texts.
    """
    sizes = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))).alias("u"))

    def step(state: Column, u: Column) -> Column:
        grown = state["used"] + 1 + u["n"]
        fits = (state["used"] >= 0) & (grown <= size)
        no = F.when(fits, state["no"]).otherwise(state["no"] + 1)
        out = F.concat(state["out"], F.array(F.struct(u["o"].alias("o"), no.alias("chunk_no"))))
        return F.struct(no.alias("no"), F.when(fits, grown).otherwise(u["n"]).alias("used"), out.alias("out"))

    kind = units.schema[order].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("no"), F.lit(-1).alias("used"), F.array().cast(f"array<struct<o:{kind},chunk_no:int>>").alias("out"))
    return sizes.select(*keys, F.explode(F.aggregate("u", zero, step)["out"]).alias("x")).select(*keys, F.col("x.o").alias(order), "x.chunk_no")


def budget_pack(passages: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """``passages`` plus ``packed``: taken in order while the budget lasts, skipping what doesn't fit."""
    listed = passages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("n")))).alias("p"))

    def step(state: Column, p: Column) -> Column:
        fits = state["used"] + p["n"] <= budget
        return F.struct(F.when(fits, state["used"] + p["n"]).otherwise(state["used"]).alias("used"), F.concat(state["out"], F.array(fits)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))
    flags = F.aggregate("p", zero, step)["out"]
    zipped = F.transform(F.col("p"), lambda p, i: F.struct(*[p[c].alias(c) for c in order], F.get(flags, i).alias("packed")))
    return listed.select(*keys, F.explode(zipped).alias("z")).select(*keys, "z.*")


def ranked_passages(passages: DataFrame, query: list[str], scores: list[str], text: list[Column], tie: str, k: int = 6) -> DataFrame:
    """The k best passages per query by descending scores; of equal texts only the best counts."""
    best = [F.col(s).desc() for s in scores]
    w = Window.partitionBy(*query, *text).orderBy(*best, tie)
    once = passages.withColumn("_twin", F.row_number().over(w)).where("_twin = 1").drop("_twin")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*best, tie))).where(F.col("rank") <= k)


def texts_with_tables(df: DataFrame, keys: list[str], text: str, tables: str) -> DataFrame:
    """``keys, part, text``: the prose as part 0, then each table by itself (cells with bars between, a row a line), so that no hit spans both."""
    line = lambda row: F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | ")
    shown = F.transform(F.coalesce(F.col(tables), F.array().cast("array<array<array<string>>>")), lambda t: F.array_join(F.transform(t, line), "\n"))
    return df.select(*keys, F.posexplode(F.concat(F.array(F.col(text)), shown)).alias("part", "text")).where("text IS NOT NULL")


def ranked_search(chunks: DataFrame, keys: list[str], terms: list[str], strength: Column, lots: Column, preferred: Column, k: int = 6) -> DataFrame:
    """``keys, position, id``: the k best chunks of each query, the first one's continuation right behind it.

    ``chunks`` holds ``id, source, section, start, heading, table_header, text, kind, lot_hint``;
    ``lots`` is the array of lots asked for, ``preferred`` whether the source was named. A chunk
    hinted to another lot leaves; one without a term and strength does too. Order: strength, lot
    match, tables, number of terms, preferred source, then as written. Of chunks with the same
    heading and text up to white space the best counts; the continuation (the next chunk of its
    section) comes whatever it says, and once.
    """
    if not any(t.strip() for t in terms):
        raise ValueError("no usable search term")
    asked = F.coalesce(lots, F.array().cast("array<string>"))
    mine = F.coalesce(F.array_contains(asked, F.col("lot_hint")), F.lit(False))
    whole = F.lower(F.concat_ws("\n", F.coalesce("table_header", F.lit("")), "text"))
    score = reduce(lambda a, b: a + b, [whole.contains(t.strip().lower()).cast("int") for t in terms if t.strip()])
    rows = chunks.where((F.size(asked) == 0) | F.col("lot_hint").isNull() | (F.col("lot_hint") == "") | mine)
    rows = rows.select("*", F.struct(strength.alias("a"), mine.alias("b"), (F.col("kind") == "table").alias("c"), score.alias("d"), preferred.alias("e")).alias("_rank"))
    rows = rows.where((F.col("_rank.a") > 0) | (F.col("_rank.d") > 0))
    order = [F.col("_rank").desc(), "source", "start", "id"]
    twin = Window.partitionBy(*keys, F.coalesce("heading", F.lit("")), F.md5(collapse(F.col("text")))).orderBy(*order)
    once = rows.withColumn("_twin", F.row_number().over(twin)).where("_twin = 1")
    best = once.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k)
    first = best.where("_r = 1").select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)], F.col("source").alias("_s"), F.col("section").alias("_c"), F.col("start").alias("_b"))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(keys)] + [F.col("c.source").eqNullSafe(F.col("_s")), F.col("c.section").eqNullSafe(F.col("_c"))]
    nexts = chunks.alias("c").join(first, same).where(F.col("c.start") > F.col("_b")).groupBy(*keys).agg(F.min(F.struct("start", "id"))["id"].alias("id"))
    both = best.select(*keys, "id", F.when(F.col("_r") == 1, 0).otherwise(F.col("_r")).alias("_o")).unionByName(nexts.select(*keys, "id", F.lit(1).alias("_o")))
    listed = both.groupBy(*keys, "id").agg(F.min("_o").alias("_o"))
    return listed.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).where(F.col("position") <= k).select(*keys, "position", "id")


def support_needle(text: Column, length: int = 80) -> Column:
    """The middle ``length`` characters of a normalised text of at least that length, else null."""
    n = F.length(text)
    return F.when(n >= length, F.substring(text, F.floor((n - length) / 2).cast("int") + 1, F.lit(length)))
