"""Fuzzy matching against allowed lists, and nearest and range joins of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.text import differing, digit_count, let, normalize_batch

# Columns of the receiving sheet in pixels, right end open.
LAYOUT = [("pallet", 90, 175), ("box", 175, 235), ("sku", 235, 390), ("name", 390, 725), ("qty", 725, 785), ("exp", 785, 905), ("mfg", 905, 1025), ("batch", 1025, 1185)]

# The columns of sheets without a batch column, and the top of the table.
NO_BATCH_LAYOUT = [("pallet", 68, 147), ("box", 153, 235), ("sku", 241, 440), ("name", 446, 839), ("qty", 845, 934), ("exp", 940, 1082), ("mfg", 1088, 1231)]
TABLE_TOP = 124


def spelled(allowed: Column) -> Column:
    """The entries of an allowed list as they are compared: array of key and text. Lists that many rows share are spelled once, before these are joined."""
    return F.transform(allowed, lambda a: F.struct(normalize_batch(a).alias("key"), a.alias("text")))


def best_allowed(value: Column, allowed: Column, share: float, drop_empty: bool) -> Column:
    """The one entry of ``allowed`` (an array of texts, ``spelled``) closest to ``value`` by edit distance, if it
    is the only closest and within ``share`` of the length (at least 1); else null."""
    return let(normalize_batch(value), lambda key: _best(key, allowed, share, drop_empty))


def _best(key: Column, allowed: Column, share: float, drop_empty: bool) -> Column:
    limit = F.greatest(F.lit(1), F.floor(F.length(key) * F.lit(share)).cast("int"))
    entries = F.filter(allowed, lambda e: e["key"] != "") if drop_empty else allowed

    def only(found: Column) -> Column:
        first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        return F.when(second.isNull() | (first["d"] < second["d"]), first["text"])

    # an entry beyond the limit can neither win nor tie
    off = F.transform(entries, lambda e: F.struct(F.levenshtein(key, e["key"]).alias("d"), e["text"].alias("text")))
    near = let(F.array_sort(F.filter(off, lambda e: e["d"] <= limit)), only)
    # most values are an entry as it is: no distances then
    return F.when(key != "", let(F.filter(entries, lambda e: e["key"] == key), lambda same: F.when(F.size(same) == 0, near).when(F.size(same) == 1, F.get(same, F.lit(0))["text"])))


def reconciled_batch(value: Column, allowed: Column, entries: Column | None = None) -> Column:
    """Invoice rule: within a quarter of the length, else emptied for review. ``entries``: the list as ``spelled`` before."""
    return F.coalesce(best_allowed(value, spelled(allowed) if entries is None else entries, 0.25, False), F.lit(""))


def reconciled_label_batch(value: Column, allowed: Column, entries: Column | None = None) -> tuple[Column, Column]:
    """Label rule: within 15 %, else as it was; and where the choice differs (places in it). ``entries``: as above."""
    chosen = best_allowed(value, spelled(allowed) if entries is None else entries, 0.15, True)
    places = F.when(chosen.isNotNull(), let(chosen, lambda c: _places(value, c)))
    return F.coalesce(chosen, value), F.coalesce(places, F.array().cast("array<int>"))


def _places(value: Column, chosen: Column) -> Column:
    letters = F.filter(F.sequence(F.lit(0), F.greatest(F.length(chosen) - 1, F.lit(0))), lambda i: F.substring(chosen, i + 1, F.lit(1)).rlike("[A-Za-z0-9]"))
    # most entries are spelled alike: the places of letters are listed only where something differs
    in_text = lambda at: F.when(F.size(at) > 0, let(letters, lambda l: F.transform(at, lambda i: F.get(l, i)))).otherwise(at)
    return let(differing(normalize_batch(value), normalize_batch(chosen)), in_text)


def column_of(xc: Column, layout: list[tuple[str, int, int]] = LAYOUT) -> Column:
    """The column that holds ``xc``: few fixed intervals, so a case expression, no join."""
    out = F.lit(None).cast("string")
    for name, x1, x2 in reversed(layout):
        out = F.when((xc >= x1) & (xc < x2), name).otherwise(out)
    return out


def nearest(items: DataFrame, slots: DataFrame, keys: list[str], place: str, center: str, slot: list[str]) -> DataFrame:
    """``items`` with ``near``: of the slots of the same keys the one whose ``center`` is nearest to the item's
    ``place``, as a struct of gap and the columns ``slot``; of equally near ones the first by these columns. Items of keys without
    slots, or without a place, have null; slots without a center count for none.

    Items and slots are one table, sorted by height once in each group of keys: of the slots below the nearest is the last
    one before the item, and of those above the first one behind it. No item meets more than these two."""
    held, at = [f"_{c}" for c in slot], F.col("_at")
    marks = slots.where(F.col(center).isNotNull()).select(*keys, F.col(center).cast("double").alias("_at"), F.struct(*[F.col(c).alias(h) for c, h in zip(slot, held)]).alias("_slot"))
    marks = marks.groupBy(*keys, "_at").agg(F.min("_slot").alias("_slot"))  # of slots at one height the first
    both = items.withColumn("_at", F.col(place).cast("double")).unionByName(marks, allowMissingColumns=True)

    # slots come before items of their height
    both = both.withColumn("_mark", F.when(F.col("_slot").isNotNull(), F.struct("_at", "_slot")))
    near = ", ".join(f"`{k}`" for k in keys)
    beside = lambda f: F.expr(f"{f}(_mark, 1) ignore nulls over (partition by {near} order by _at, _mark is null)")
    found = both.withColumns({"_below": beside("lag"), "_above": beside("lead")}).where("_mark is null")
    side = lambda c: F.when(F.col(c).isNotNull() & at.isNotNull(), F.struct(F.abs(at - F.col(f"{c}._at")).alias("gap"), *[F.col(f"{c}._slot.{h}").alias(n) for n, h in zip(slot, held)]))
    return found.withColumn("near", F.least(side("_below"), side("_above"))).drop("_at", "_slot", "_mark", "_below", "_above")


def nearest_slot(items: DataFrame, slots: DataFrame, tolerance: Column) -> DataFrame:
    """Each item (doc_id, seq, yc) with the slot (doc_id, slot, center) nearest to it, the
    first of equals, if it is within ``tolerance`` (a column of the item)."""
    found = nearest(items, slots, ["doc_id"], "yc", "center", ["slot"])
    return found.where(F.col("near.gap") <= tolerance).select("doc_id", "seq", "near.slot", "near.gap")


def document_total(items: DataFrame, reach: float = 32.0) -> DataFrame:
    """doc_id, total: the number in the quantity column nearest to a total marker's height."""
    markers = items.where(F.col("text").rlike("(?i)TOTA[L1I]|合计")).select("doc_id", F.col("yc").alias("my"), F.col("seq").alias("mseq"))
    numbers = items.withColumn("digits", F.regexp_replace(F.translate("text", "OoQDlISs", "00001155"), r"(?U)\D", ""))
    numbers = numbers.where((column_of(F.col("xc")) == "qty") & (F.col("digits") != "")).select("doc_id", "yc", "seq", "digits")
    near = markers.join(numbers, "doc_id").where(F.abs(F.col("yc") - F.col("my")) <= reach)
    key = F.struct(F.abs(F.col("yc") - F.col("my")), "mseq", "seq")
    return near.groupBy("doc_id").agg(F.min_by(F.col("digits").cast("long"), key).alias("total"))


def row_lines(rows: DataFrame, low: float, high: float) -> DataFrame:
    """doc_id, row_idx, top, bottom: borders halfway between row centers (doc_id,
    row_idx, center), the outer ones half a gap out, within [low, high]."""
    w = Window.partitionBy("doc_id").orderBy("row_idx")
    before, after = F.lag("center").over(w), F.lead("center").over(w)
    top = F.when(before.isNotNull(), (before + F.col("center")) / 2).when(after.isNull(), F.lit(low)).otherwise(F.greatest(F.lit(low), F.col("center") - (after - F.col("center")) / 2))
    bottom = F.when(after.isNotNull(), (after + F.col("center")) / 2).when(before.isNull(), F.lit(high)).otherwise(F.least(F.lit(high), F.col("center") + (F.col("center") - before) / 2))
    return rows.select("doc_id", "row_idx", top.alias("top"), bottom.alias("bottom"))


def layouts(items: DataFrame, header_y: float, fallback: str = "fixed") -> DataFrame:
    """doc_id, layout (``with_batch``, ``without_batch`` or ``fallback``) of fragments (doc_id, xc, yc, text).

    A printed batch header decides first; then, by a margin of 20 pixels, whose columns' middles the
    headers are nearer to; then a header of the making date; then, for pages without headers of
    columns and the fallback ``fixed``, in whose columns more numbers of fitting length
    stand, by a margin of 6. All are sums over a document's fragments: one aggregation. Only fragments at the headers' height are
    spelled as words."""
    head = F.col("yc").between(TABLE_TOP - 15, header_y + 12)

    def told(w: Column, xc: Column) -> Column:
        quantity = ((F.length(w) == 3) & w.endswith("TY")) | w.endswith("QTY")
        kinds = [("pallet", w.startswith("PALL")), ("box", w == "BOX"), ("sku", w.contains("SKU")), ("name", w == "NAME"), ("qty", quantity), ("exp", w.startswith("EXP")), ("mfg", w.startswith("MF"))]
        named = F.coalesce(*[F.when(test, F.lit(field)) for field, test in kinds])
        tests = {"batch": w.contains("BATC") & (w.contains("BATCH") | w.startswith("BATC")), "made": w.contains("MFG") | w.startswith("MF"), "other": w.startswith("EXP") | quantity}
        return F.struct(named.alias("field"), xc.alias("xc"), *[test.alias(name) for name, test in tests.items()])

    # a struct made inside the row: few fragments are headers, and the pass over all of them stays short
    header = F.when(head, let(F.struct(F.regexp_replace(F.upper("text"), "[^A-Z]", "").alias("w"), F.col("xc").alias("xc")), lambda x: told(x["w"], x["xc"])))
    rows = items.select("doc_id", "xc", digit_count(F.col("text")).alias("n"), header.alias("head"))

    def off(layout: list[tuple[str, int, int]]) -> Column:
        return F.avg(F.coalesce(*[F.when(F.col("head.field") == f, F.abs(F.col("head.xc") - (a + b) / 2)) for f, a, b in layout]))

    def fitting(layout: list[tuple[str, int, int]]) -> Column:
        inside = {f: (F.col("xc") >= a) & (F.col("xc") < b) for f, a, b in layout}
        points = [(inside["sku"] & F.col("n").between(8, 14), 2), (inside["qty"] & F.col("n").between(1, 4), 3), ((inside["exp"] | inside["mfg"]) & F.col("n").isin(6, 8), 1)]
        return sum(F.count_if(test) * worth for test, worth in points)

    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    seen = rows.groupBy("doc_id").agg(
        *[some(F.col(f"head.{test}")).alias(test) for test in ("batch", "made", "other")],
        F.count("head.field").alias("headers"),
        some(F.col("head.field").isin("name", "qty", "exp", "mfg")).alias("telling"),
        (off(NO_BATCH_LAYOUT) + 20 < off(LAYOUT)).alias("nearer"),
        (fitting(LAYOUT) - fitting(NO_BATCH_LAYOUT)).alias("lead"),
    )
    dense = (F.col("headers") == 0) & F.lit(fallback == "fixed")
    layout = (
        F.when(F.col("batch"), "with_batch")
        .when((F.col("telling") & F.col("nearer")) | (F.col("made") & F.col("other")), "without_batch")
        .when(dense & (F.col("lead") <= -6), "without_batch")
        .when(dense & (F.col("lead") >= 6), "with_batch")
        .otherwise(fallback)
    )
    return seen.select("doc_id", layout.alias("layout"))
