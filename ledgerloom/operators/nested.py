"""Nested JSON records as flat tables that keep their parent links.

Each body is read once, token by token, into (path, ordinals, value) triples without building
the tree; every key on the way to a value has an ordinal, its number in written order. The
paths of all bodies then show which keys repeat, and every path belongs to the group of its
repeated ancestors: their keys name the table, their ordinals are its key, and the prefix of the
ordinals is the key of the parent. Each group is pivoted into one table, a column for each path
below the last repeated ancestor. Only the different paths reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

STEP = "\x1f"  # stands between the keys of a path
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
OPEN, CLOSE, LEAF = "open", "close", "leaf"


def json_events(text: str) -> Iterator[tuple[str, str | int | None, object]]:
    """``(kind, step, value)`` of a strict JSON text in written order; ValueError where it is none.

    ``step`` is the key or the list position from 1 that leads to the value. Containers give an
    open event, with "object" or "list" as value, and a close event. Nesting is limited only by
    memory.
    """
    space, scalar = _SPACE.match, _SCALAR.match
    path: list[str | int | None] = [None]
    stack: list[str] = []
    i = space(text, 0).end()
    while True:
        c = text[i : i + 1]
        if c == "{" or c == "[":
            yield OPEN, path[-1], "object" if c == "{" else "list"
            i = space(text, i + 1).end()
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                i += 1
                yield CLOSE, path[-1], None
            elif c == "{":
                stack.append("{")
                i = _key(text, i, path)
                continue
            else:
                stack.append("[")
                path.append(1)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
            yield LEAF, path[-1], value
        else:
            m = scalar(text, i)
            if not m:
                raise ValueError(f"no JSON value at {i}")
            i = m.end()
            yield LEAF, path[-1], None if m[0] == "null" else m[0]
        while True:  # after a value
            i = space(text, i).end()
            c = text[i : i + 1]
            if not stack:
                if c:
                    raise ValueError(f"text after the value at {i}")
                return
            top = stack[-1]
            if c == ",":
                i = space(text, i + 1).end()
                if top == "{":
                    path.pop()
                    i = _key(text, i, path)
                else:
                    path[-1] += 1
                break
            if c != ("}" if top == "{" else "]"):
                raise ValueError(f"no end of the container at {i}")
            stack.pop()
            path.pop()
            i += 1
            yield CLOSE, path[-1], None


def _key(text: str, i: int, path: list[str | int]) -> int:
    if text[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(text, i + 1, True)
    i = _SPACE.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    path.append(key)
    return _SPACE.match(text, i + 1).end()


@dataclass(frozen=True)
class Levels:
    """What is known of the records beforehand.

    names: keys that hold entries even where no body shows a list, numbered on over all plain
    objects of their parent entry. wrappers: keys that only wrap the entries of the key above.
    nested: a key of ``names`` whose entries may stand inside each other and count on.
    """

    names: tuple[str, ...] = ()
    wrappers: tuple[str, ...] = ()
    nested: str = ""


class _Place:
    """An open object or list: which key its values belong to, and where that key's entries are numbered."""

    __slots__ = ("path", "ordinals", "counts", "key", "listed", "maybe", "outer")

    def __init__(self, path: tuple, ordinals: tuple, counts: dict, key: str | None = None, listed: bool = False, maybe: bool = False, outer: _Place | None = None) -> None:
        self.path, self.ordinals, self.counts = path, ordinals, counts
        self.key, self.listed, self.maybe, self.outer = key, listed, maybe, outer


ENTRY, LIST, VALUE, PACKED = "entry", "list", "value", "packed"


def triples(text: str, levels: Levels = Levels()) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], str, object, tuple[str, ...]]]:
    """``(path, ordinals, kind, value, packed)`` of everything in a JSON text; ValueError where it is none.

    A list stands for its items, at whatever depth of lists, a lone value for itself. Nulls are
    not there; blank strings are values but no items, their ordinal is 0. A string that holds a
    JSON list or object comes as one (kind packed, ordinal 0) and also with its content; what is
    inside carries the paths of such strings in ``packed``. An object is an entry, numbered
    within its parent; a list tells that its path repeats.
    """
    yield (), (), ENTRY, None, ()
    root = _Place((), (), {})
    yield from _read(text, root, None, levels, ())


def _read(text: str, base: _Place, key: str | None, levels: Levels, packed: tuple[str, ...]) -> Iterator[tuple]:
    stack: list[_Place] = []

    def number(at: _Place, key: str) -> int:
        name = key if key in levels.names else (*at.path, key)
        at.counts[name] = n = at.counts.get(name, 0) + 1
        return n

    def enter(at: _Place, key: str, listed: bool) -> _Place:
        if key == levels.nested and at.path and at.path[-1] == key and at.outer is not None:
            at = at.outer
        n = number(at, key)
        return _Place((*at.path, key), (*at.ordinals, n), {} if listed else at.counts, outer=at)

    for kind, step, value in json_events(text):
        if kind == CLOSE:
            done = stack.pop()
            if done.maybe and done.key is not None:  # {} is an entry without fields
                new = enter(done, done.key, done.listed)
                yield new.path, new.ordinals, ENTRY, None, packed
            continue
        if stack:
            at = stack[-1]
            if at.maybe:
                at.maybe = False
                if step not in levels.wrappers:
                    new = enter(at, at.key, at.listed)
                    yield new.path, new.ordinals, ENTRY, None, packed
                    new.key = None
                    stack[-1] = at = new
            own = at.key if at.key is not None else step if isinstance(step, str) else None
            listed = at.listed
        else:
            at, own, listed = base, key, False
        if own is None:  # a list at the very top, or the top itself: plain
            if kind == OPEN:
                stack.append(_Place(at.path, at.ordinals, at.counts, outer=at.outer))
            elif value is not None:
                yield ("",), (number(at, ""),), VALUE, value, packed
            continue
        if kind == OPEN and value == "list":
            stack.append(_Place(at.path, at.ordinals, at.counts, own, True, outer=at.outer))
            yield (*at.path, own), (*at.ordinals, 0), LIST, None, packed
        elif kind == OPEN:
            stack.append(_Place(at.path, at.ordinals, at.counts, own, listed, True, outer=at.outer))
        elif value is not None:
            path = (*at.path, own)
            blank = isinstance(value, str) and not value.strip()
            if isinstance(value, str) and value.lstrip()[:1] in ("[", "{") and _is_json(value):
                yield path, (*at.ordinals, 0), PACKED, value, packed
                inner = _Place(at.path, at.ordinals, at.counts, outer=at.outer)
                yield from _read(value, inner, own, levels, (*packed, STEP.join(path)))
            else:
                yield path, (*at.ordinals, 0 if blank else number(at, own)), VALUE, value, packed


def _is_json(text: str) -> bool:
    try:
        for _ in json_events(text):
            pass
    except ValueError:
        return False
    return True


def read_triples(df: DataFrame, key: str, body: str, levels: Levels = Levels()) -> DataFrame:
    """``uid, key, path, ordinals, kind, value, packed`` of all bodies, written once; ``uid`` tells rows with one key apart.

    Null, empty and invalid bodies give nothing. Only the two named columns are read. Rows are
    not gathered: a body's triples come from the task that reads it.
    """
    columns = [F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("key"), F.col(f"`{body}`").alias("body")]
    kind = df.schema[key].dataType.simpleString()
    if df.schema[body].dataType.simpleString() != "string":
        raise TypeError(f"{body} is no string column")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for uid, k, text in zip(batch["uid"], batch["key"], batch["body"], strict=True):
                begin = len(out)
                try:
                    for path, ordinals, what, value, packed in triples(text, levels):
                        out.append((uid, k, STEP.join(path), ",".join(map(str, ordinals)), what, value, "\n".join(packed) or None))
                except ValueError:
                    del out[begin:]
            yield pd.DataFrame(out, columns=["uid", "key", "path", "ordinals", "kind", "value", "packed"])

    rows = df.where(F.col(f"`{body}`").isNotNull()).select(columns)
    return cut(rows.mapInPandas(run, f"uid long, key {kind}, path string, ordinals string, kind string, value string, packed string"))


# --- groups of paths --------------------------------------------------------------------------


@dataclass(frozen=True)
class Group:
    """A path's place: the keys that repeat on it, where they stand in it, and the rest as a column."""

    keys: tuple[str, ...]
    places: tuple[int, ...]
    column: str


def group_paths(seen: Sequence[tuple[str, str]], levels: Levels = Levels()) -> dict[str, Group]:
    """The group of every path, from the different ``(path, kind)`` of all bodies.

    A key repeats on a path if some body has a list there, or if it is one of ``levels.names``.
    """
    listed = {p for p, kind in seen if kind == LIST}
    out = {}
    for path in sorted({p for p, _ in seen}):
        steps = path.split(STEP) if path else []
        places = [i for i, k in enumerate(steps) if k in levels.names or STEP.join(steps[: i + 1]) in listed]
        last = places[-1] + 1 if places else 0
        out[path] = Group(tuple(steps[i] for i in places), tuple(places), ".".join(steps[last:]))
    return out


def grouped(triple: DataFrame, levels: Levels = Levels(), items_only: bool = False) -> tuple[DataFrame, dict[str, Group]]:
    """``uid, key, group, at, kind, column, value`` (``at``: ordinals of the repeated keys), and the groups.

    With ``items_only`` only entries and items come out, not the fields inside them.

    Strings that hold JSON count as their content where their path repeats, else as strings.
    """
    # a list inside a string proves nothing about the key of that string
    kind = F.when((F.col("kind") == LIST) & (F.element_at(F.split("packed", "\n"), -1) == F.col("path")), VALUE).otherwise(F.col("kind"))
    seen = [(r["path"], r["kind"]) for r in triple.select("path", kind.alias("kind")).distinct().collect()]
    groups = group_paths(seen, levels)
    spark = triple.sparkSession
    listed = [(p, STEP.join(g.keys), list(g.places), g.column, bool(g.keys) and not g.column) for p, g in groups.items() if not (items_only and g.column)]
    known = spark.createDataFrame(listed, "path string, group string, places array<int>, column string, item boolean")
    rows = triple.join(F.broadcast(known), "path")  # as many rows as there are different paths
    items = [p for p, _, _, _, item in listed if item]
    opened = F.forall(F.split("packed", "\n"), lambda p: p.isin(items)) if items else F.lit(False)
    numbers = F.split("ordinals", ",")
    at = F.transform("places", lambda i: F.get(numbers, i).cast("int"))
    keep = (F.col("packed").isNull() | opened) & (F.col("kind") != LIST) & ~((F.col("kind") == PACKED) & F.col("item"))
    rows = rows.where(keep).select("uid", "key", "group", at.alias("at"), "kind", "column", "value")
    return rows.where(~F.exists("at", lambda n: n == 0)), groups  # a blank is no item


def entries(rows: DataFrame) -> DataFrame:
    """``uid, key, group, at, n_children``: each entry of each group once, with how many entries of further groups it holds directly.

    Every entry tells itself and its parent; both are added up per key, combined before the shuffle.
    """
    own = rows.where((F.col("kind") == ENTRY) & (F.col("column") == "") | (F.col("kind") != ENTRY) & (F.col("column") == "") & (F.col("group") != "")).select("uid", "key", "group", "at")
    above = F.when(F.col("group").contains(STEP), F.regexp_replace("group", f"{STEP}[^{STEP}]*$", "")).otherwise(F.lit(""))
    facts = own.select("uid", "key", "group", "at", F.lit(1).alias("own"), F.lit(0).alias("child"))
    facts = facts.unionByName(own.where("group <> ''").select("uid", "key", above.alias("group"), F.slice("at", F.lit(1), F.size("at") - 1).alias("at"), F.lit(0).alias("own"), F.lit(1).alias("child")))
    return facts.groupBy("uid", "key", "group", "at").agg(F.max("own").alias("own"), F.sum("child").cast("int").alias("n_children")).where("own = 1").drop("own")


def path_tables(triple: DataFrame, key: str, levels: Levels = Levels(), names: dict[tuple[str, ...], tuple[str, Sequence[str]]] | None = None) -> dict[str, DataFrame]:
    """One table for each group of paths: ``key``, the ordinals of its repeated keys, its columns, ``n_children``.

    ``names`` gives groups (tuples of repeated keys) a table name and names of ordinals; others
    are called by their keys, joined by underscores, with ordinals ``<key>_no``. Columns are
    paths with underscores, numbered where two are alike; items that are no objects have a
    column ``value``. A key written twice in one object gives its greatest value.
    """
    rows, groups = grouped(triple, levels)
    rows = cut(rows)
    counts = entries(rows)
    columns: dict[tuple[str, ...], set[str]] = {(): set()}
    for g in groups.values():
        columns.setdefault(g.keys, set()).add(g.column)
    valued = {(tuple(r["group"].split(STEP)) if r["group"] else (), r["column"]) for r in rows.where(F.col("kind") != ENTRY).select("group", "column").distinct().collect()}
    out: dict[str, DataFrame] = {}
    for keys in sorted(columns):
        name, ordinals = (names or {}).get(keys, ("_".join(keys) or "record", [f"{k}_no" for k in keys]))
        own = sorted(c for c in columns[keys] if (keys, c) in valued)
        titles = _titles(own, [key, *ordinals, "n_children"])
        group = STEP.join(keys)
        wide = [F.max(F.when((F.col("kind") != ENTRY) & (F.col("column") == c), F.col("value"))).alias(titles[c]) for c in own]
        table = rows.where(F.col("group") == group).groupBy("uid", "key", "at").agg(F.count("*").alias("_n"), *wide)
        numbered = table.join(counts.where(F.col("group") == group).drop("group", "key"), ["uid", "at"])
        out[name] = numbered.select(F.col("key").alias(key), *[F.get("at", F.lit(i)).alias(n) for i, n in enumerate(ordinals)], *[F.col(f"`{titles[c]}`") for c in own], "n_children")
    return out


def _titles(paths: Sequence[str], taken: Sequence[str]) -> dict[str, str]:
    """A column name for each path; names that differ in case only are alike."""
    used, out = {x.lower() for x in taken}, {}
    for p in paths:
        title = base = re.sub(r"\W", "_", p) or "value"
        k = 1
        while title.lower() in used:
            k += 1
            title = f"{base}_{k}"
        used.add(title.lower())
        out[p] = title
    return out


#: A procurement record: its levels, and the names of their tables and ordinals.
PROCUREMENT = Levels(("lots", "criterion", "subCriterion"), ("lot",), "subCriterion")
PROCUREMENT_TABLES = {
    (): ("records", []),
    ("lots",): ("lots", ["lot_no"]),
    ("lots", "criterion"): ("criteria", ["lot_no", "criterion_no"]),
    ("lots", "criterion", "subCriterion"): ("sub_criteria", ["lot_no", "criterion_no", "sub_no"]),
    ("additionalCpvType",): ("additional_codes", ["item_no"]),
}


def procurement_tables(df: DataFrame, key: str = "record_id", body: str = "body") -> dict[str, DataFrame]:
    return path_tables(read_triples(df, key, body, PROCUREMENT), key, PROCUREMENT, PROCUREMENT_TABLES)


def criterion_positions(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """``key, lot_no, criterion_no, sub_no`` of each criterion and sub-criterion; what has none shows as 0."""
    rows, _ = grouped(read_triples(df, key, body, PROCUREMENT), PROCUREMENT, items_only=True)
    chain = [STEP.join(PROCUREMENT.names[:n]) for n in range(4)]
    found = entries(rows.where(F.col("group").isin(chain)))
    at: list[Column] = [F.coalesce(F.get("at", F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(("lot_no", "criterion_no", "sub_no"))]
    return found.where((F.size("at") >= 2) | (F.col("n_children") == 0)).select(F.col("key").alias(key), *at)
