"""Extracted lots against true ones: how they align, and what then agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import lot_key
from ledgerloom.session import cut


def distinct_records(records: DataFrame, tables: list[DataFrame], key: str, record: str) -> DataFrame:
    """``key, record``: the readable records of each key; of records with equal content the first.

    Content is equal if all rows of all ``tables`` are (as given by ``path_tables``), in whatever
    order the fields are written. No group is wider than one record.
    """
    rows = None
    for i, t in enumerate(tables):
        own = t.select(record, F.md5(F.to_json(F.struct(F.lit(i).alias("_t"), *[F.col(f"`{c}`") for c in t.columns if c != record]))).alias("_e"))
        rows = own if rows is None else rows.unionByName(own)
    content = rows.groupBy(record).agg(F.md5(F.array_join(F.array_sort(F.collect_list("_e")), "")).alias("_c"))
    return records.select(key, record).join(content, record).groupBy(key, "_c").agg(F.min(record).alias(record)).drop("_c")


def lot_sets(rows: DataFrame, key: str, lot: str, weight: str, entry: list[str] | None = None) -> DataFrame:
    """``key, entry, lot_key, weights, complete``: the sorted exact weights of each lot with their counts.

    A lot is what shares a lot key or, where ``entry`` names columns, what shares these (true
    lots that are alike in label stay apart). A row without weight makes its lot incomplete.
    Equal weights are counted before they are gathered, so a set is as long as its different weights.
    """
    exact = F.col(weight).cast("decimal(18,6)")
    own = F.to_json(F.struct(*entry)) if entry else F.lit("")
    counted = rows.groupBy(key, own.alias("entry"), lot_key(F.col(lot)).alias("lot_key"), exact.alias("w")).agg(F.count("*").alias("n"))
    known = F.when(F.col("w").isNotNull(), F.struct("w", "n"))
    return counted.groupBy(key, "entry", "lot_key").agg(F.array_sort(F.collect_list(known)).alias("weights"), F.count(F.when(F.col("w").isNull(), 1)).alias("missing")).withColumn("complete", F.col("missing") == 0).drop("missing")


def _matched(pred: Column, gold: Column, tolerance: float) -> Column:
    """How many weights of two counted sets can be paired one to one; greedy from the smallest, as ``tolerance_match``.

    The state holds the last extracted weight that was used, and how often.
    """
    numbered = F.transform(pred, lambda y, j: F.struct(y["w"].alias("w"), y["n"].alias("n"), j.alias("j")))

    def step(state: Column, g: Column) -> Column:
        near = F.filter(numbered, lambda y: (y["j"] >= state["j"]) & (F.abs(y["w"] - g["w"]) <= F.lit(tolerance)))

        def take(s: Column, y: Column) -> Column:
            before = F.when(y["j"] == s["j"], s["used"]).otherwise(F.lit(0).cast("long"))
            k = F.least(s["left"], y["n"] - before)
            moved = k > 0
            return F.struct(F.when(moved, y["j"]).otherwise(s["j"]).alias("j"), F.when(moved, before + k).otherwise(s["used"]).alias("used"), (s["left"] - k).alias("left"), (s["n"] + k).alias("n"))

        start = F.struct(state["j"].alias("j"), state["used"].alias("used"), g["n"].alias("left"), state["n"].alias("n"))
        return F.aggregate(near, start, take)

    none = F.lit(0).cast("long")
    zero = F.struct(F.lit(0).alias("j"), none.alias("used"), none.alias("left"), none.alias("n"))
    return F.when(pred.isNull() | gold.isNull(), none).otherwise(F.aggregate(gold, zero, step)["n"])


def _shape(sets: DataFrame, key: str, tag: str) -> DataFrame:
    return sets.groupBy(key).agg(
        F.count("*").alias(f"n_{tag}"), F.count(F.when(F.col("lot_key") == "all", 1)).alias(f"unnamed_{tag}"), F.countDistinct("lot_key").alias(f"keys_{tag}"), F.min("lot_key").alias(f"key_{tag}")
    )


def inventory(gold: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """``key, assessable, unknown, unlisted``: declared lots (``key, lot``) against the true ones.

    Assessable only where all true lots have labels of their own; unknown are declared lots that
    are not true, unlisted true ones not declared (both null where not assessable).
    """
    known = gold.groupBy(key).agg(F.count("*").alias("_n"), F.countDistinct(F.when(F.col("lot_key") != "all", F.col("lot_key"))).alias("_k"))
    said = declared.select(key, lot_key(F.col("lot")).alias("lot_key")).where("lot_key <> 'all'").distinct().withColumn("said", F.lit(True))
    true = gold.where("lot_key <> 'all'").select(key, "lot_key").distinct().withColumn("true", F.lit(True))
    both = said.join(true, [key, "lot_key"], "full").groupBy(key).agg(F.count(F.when(F.col("true").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("said").isNull(), 1)).alias("unlisted"))
    out = known.join(both, key, "left").withColumn("assessable", F.col("_n") == F.col("_k"))
    only = lambda c: F.when(F.col("assessable"), F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return out.select(key, "assessable", only("unknown"), only("unlisted"))


def unordered_matches(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """``key, unordered``: how many lots agree as sets of exact weights, whatever their labels; only complete extracted ones count."""
    signature = F.to_json("weights").alias("s")
    rows = pred.where(F.col("complete") & (F.size("weights") > 0)).select(key, signature, F.col("times").alias("p"), F.lit(0).cast("long").alias("g"))
    rows = rows.unionByName(gold.select(key, signature, F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("g")))
    per = rows.groupBy(key, "s").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return per.groupBy(key).agg(F.sum(F.least("p", "g")).alias("unordered"))


def compare_lots(pred: DataFrame, gold: DataFrame, key: str, invalid: DataFrame | None = None, shared: DataFrame | None = None, declared: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """``key, mode, tp, fp, fn, gold_lots, pred_lots, matched_lots, exact, unordered, unordered_exact, inventory_complete`` per record.

    ``invalid`` names records whose scope contradicts itself, ``shared`` those whose one set
    applies to every true lot, ``declared`` (``key, lot``) the lots a record says it has. Modes,
    first rule that holds: invalid_scope (also for a declared lot that isn't true); single_set
    (one lot each side, same label or one without); by_lot_label (all lots labelled, no label
    twice; lone lots under different labels match nothing); unresolved_lot_alignment. Aligned
    lots match weights one to one within the tolerance; where nothing aligns every true weight
    is missed and every extracted one false. ``exact`` only if all lots of both sides match
    completely; ``unordered`` compares sets exactly, without labels.
    """
    shapes = _shape(pred, key, "p").join(_shape(gold, key, "g"), key, "full").fillna(0)
    for frame, name in ((invalid, "bad"), (shared, "shared")):
        flags = shapes.select(key).limit(0) if frame is None else frame.select(key).distinct()
        shapes = shapes.join(flags.withColumn(name, F.lit(True)), key, "left").fillna(False, [name])
    if declared is not None:
        shapes = shapes.join(inventory(gold, declared, key), key, "left")
    else:
        shapes = shapes.withColumns({"assessable": F.lit(False), "unknown": F.lit(None).cast("long"), "unlisted": F.lit(None).cast("long")})
    bad = F.col("bad") | (F.coalesce("unknown", F.lit(0)) > 0)
    spread = F.col("shared") & ~bad & (F.col("n_p") > 0) & (F.col("n_g") > 0)
    n_p = F.when(spread, F.col("n_g")).otherwise(F.col("n_p"))
    one = (n_p == 1) & (F.col("n_g") == 1)
    near = spread | (F.col("key_p") == F.col("key_g")) | (F.col("key_p") == "all") | (F.col("key_g") == "all")
    labelled = (F.col("unnamed_g") == 0) & (F.col("keys_g") == F.col("n_g")) & (spread | (F.col("unnamed_p") == 0) & (F.col("keys_p") == F.col("n_p")))
    mode = F.when(bad, "invalid_scope").when(one & near, "single_set").when(one | labelled, "by_lot_label").otherwise("unresolved_lot_alignment")
    whole = F.when(F.col("assessable"), (F.col("unknown") == 0) & (F.col("unlisted") == 0))
    modes = cut(shapes.select(key, mode.alias("mode"), spread.alias("spread"), n_p.alias("n_p"), "n_g", whole.alias("inventory_complete"), bad.alias("bad")))

    pair = F.when(F.col("mode") == "single_set", F.lit("*")).when(F.col("mode") == "by_lot_label", F.concat(F.lit("="), "lot_key"))
    g = gold.join(modes.select(key, "mode"), key).select(key, F.coalesce(pair, F.concat_ws(":", F.lit("g"), "entry", "lot_key")).alias("pair"), F.col("weights").alias("gw"))
    p = pred.join(modes.select(key, "mode", "spread"), key)
    plain = p.where("NOT spread").select(key, F.coalesce(pair, F.concat(F.lit("p:"), "lot_key")).alias("pair"), F.col("weights").alias("pw"), F.col("complete").alias("pc"))
    # a shared set meets each true lot; labels of true lots may repeat, then nothing pairs
    copies = p.where("spread").select(key, F.col("weights").alias("pw"), F.col("complete").alias("pc")).join(g.select(key, "pair"), key)
    copies = copies.select(key, F.when(F.col("pair").startswith("g:"), F.concat(F.lit("p:"), "pair")).otherwise(F.col("pair")).alias("pair"), "pw", "pc")
    j = plain.unionByName(copies).join(g, [key, "pair"], "full")
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    j = j.select(key, _matched(F.col("pw"), F.col("gw"), tolerance).alias("tp"), size("pw").alias("np"), size("gw").alias("ng"), (F.col("gw").isNotNull() & F.col("pw").isNotNull()).alias("met"), F.coalesce("pc", F.lit(False)).alias("whole"))
    full: Column = F.col("met") & (F.col("tp") == F.col("np")) & (F.col("tp") == F.col("ng")) & F.col("whole")
    sums = j.groupBy(key).agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("ng") - F.col("tp")).alias("fn"), F.count(F.when(full, 1)).alias("matched_lots"))
    times = F.when(F.col("spread"), F.col("n_g")).otherwise(F.lit(1)).cast("long")
    alike = unordered_matches(pred.join(modes.select(key, "spread", "n_g"), key).withColumn("times", times), gold, key)
    out = modes.join(sums, key).join(alike, key, "left")
    every = lambda c: (F.col("n_g") > 0) & (c == F.col("n_g")) & (c == F.col("n_p")) & ~F.col("bad")
    unordered = F.coalesce("unordered", F.lit(0)).cast("long")
    return out.select(
        key, "mode", "tp", "fp", "fn", F.col("n_g").alias("gold_lots"), F.col("n_p").alias("pred_lots"), "matched_lots", every(F.col("matched_lots")).alias("exact"),
        unordered.alias("unordered"), every(unordered).alias("unordered_exact"), "inventory_complete",
    )
