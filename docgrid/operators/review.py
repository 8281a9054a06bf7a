"""Lists that come with a request, issues of fields, review of rows, and their typed export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docgrid.functions import text as T
from docgrid.operators import labels

# Bounds of lists and of exported texts, scores below which a reading is doubted, words of the sheet.
MOST_ITEMS, MOST_CHARACTERS, MOST_ROWS = 50, 64, 500
WIDEST = {"sku": 64, "name": 256, "qty": 32, "exp": 32, "mfg": 32, "batch": 64, "pallet": 64, "box": 64}
LOW = 0.85
RELIABLE = {"sku": 0.90, "pallet": 0.75, "box": 0.80, "qty": 0.85, "exp": 0.80, "mfg": 0.80, "batch": 0.80}
CHECKED, UNCHECKED = "已勾选", "未勾选"
REQUIRED = ["sku", "qty"]


def _whole_json(value: Column) -> Column:
    """Whether a text is one JSON value from end to end. The parser is content with a valid beginning, so the text must
    have the shape of a single value, and be the only item of an array and the only field of an object."""
    shaped = F.trim(value).rlike(r"(?s)^(?:\[.*\]|\{.*\}|\"(?:[^\"\\]|\\.)*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)$")
    item = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))), "$", "array<variant>")
    field = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"a":'), value, F.lit("}"))), "$", "map<string,variant>")
    return F.coalesce(shaped & (F.size(item) == 1) & (F.size(field) == 1), F.lit(False))


def listed(value: Column, between: str = r"[\s,，;；]+") -> Column:
    """Array of texts from JSON or, where it is none, from text with white space, commas or
    semicolons between; null for JSON that is no list; empty for null and blank."""
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    parts = F.split(value, between)
    array = F.trim(value).startswith("[")
    return F.when(blank, F.array().cast("array<string>")).when(~_whole_json(value), parts).when(array, F.from_json(value, "array<string>"))


def required_list(value: Column) -> Column:
    """Struct of fields (each once, in the order asked) and problem (``required`` for none, ``not_a_list``,
    ``unsupported: `` and the first unknown name, or null; with a problem fields is null)."""

    def checked(asked: Column) -> Column:
        unknown = F.get(F.filter(asked, lambda f: ~f.isin(labels.FIELDS)), F.lit(0))
        problem = F.when(asked.isNull(), "not_a_list").when(unknown.isNotNull(), F.concat(F.lit("unsupported: "), unknown)).when(F.size(asked) == 0, "required")
        return F.struct(F.when(problem.isNull(), F.array_distinct(asked)).alias("fields"), problem.alias("problem"))

    return T.let(F.transform(listed(F.trim(value), r"[\s,;]+"), lambda x: F.trim(F.coalesce(x, F.lit("None")))), checked)


def batch_list(value: Column) -> Column:
    """Struct of items (trimmed, the first spelling of each, without those of no letter or digit) and
    problem (not_a_list, too_long, too_many or null; with a problem items is null)."""

    def bounded(x: Column) -> Column:
        items, keys = x["items"], x["keys"]
        long = F.exists(keys, lambda k: F.length(k) > MOST_CHARACTERS)
        too_many = F.size(F.array_distinct(keys)) > MOST_ITEMS
        problem = F.when(items.isNull(), "not_a_list").when(long, "too_long").when(too_many, "too_many")
        kept = F.filter(items, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.struct(F.when(problem.isNull(), kept).alias("items"), problem.alias("problem"))

    clean = F.filter(F.transform(listed(value), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: T.normalize_batch(x) != "")
    spelled = T.let(clean, lambda c: F.struct(c.alias("items"), F.transform(c, T.normalize_batch).alias("keys")))
    return T.let(spelled, bounded)


def field_issue(field: str, row: Mapping[str, Column], backend: Column, score: Column, edited: Column, reviewed: Column) -> Column:
    """missing, invalid or low, in this order, or null; ``backend`` is the error that came with
    the field, ``edited`` and ``reviewed`` say what a person has settled."""
    value = F.trim(F.coalesce(row[field], F.lit("")))
    shaped = {"sku": value.rlike(r"^[0-9]{8,}$"), "qty": value.rlike(r"^[1-9][0-9]*$"), "exp": T.is_date(value), "mfg": T.is_date(value)}.get(field, F.lit(True))
    return (
        F.when(F.lit(field in REQUIRED) & (value == ""), "missing")
        .when((value != "") & ~shaped, "invalid")
        .when(backend == "missing", "missing")
        .when((F.coalesce(backend, F.lit("")) != "") & ~edited, "invalid")
        .when((score < LOW) & ~F.isnan(score) & ~edited & ~reviewed, "low")
    )


def row_review(issues: Mapping[str, Column], scores: Mapping[str, Column], edited: Mapping[str, Column], ticked: Column) -> dict[str, Column]:
    """pending (a required field has an issue), hard (missing or invalid), reviewed (for the export:
    not hard, and sure or ticked)."""
    any_of = lambda tests: F.coalesce(F.array_contains(F.array(*tests), True), F.lit(False))
    hard = any_of([issues[f].isin("missing", "invalid") for f in REQUIRED])
    doubted = any_of([(scores[f] < LOW) & ~F.isnan(scores[f]) & ~edited[f] for f in REQUIRED])
    return {"pending": any_of([issues[f].isNotNull() for f in REQUIRED]), "hard": hard, "reviewed": ~hard & (~doubted | ticked)}


def typed(row: Mapping[str, Column], score: Column, reviewed: Column, include_batch: Column) -> dict[str, Column]:
    """Columns of the sheet: the quantity as a number and dates as dates where they are such, with their
    texts beside; whether the quantity is marked; the batch only if asked for."""
    raw = F.trim(F.coalesce(row["qty"], F.lit("")))
    number = F.when(raw.rlike(r"^[1-9]\d{0,14}$"), raw.try_cast("long"))
    out = {"qty": number, "qty_text": raw, "qty_marked": number.isNull()}
    for f in ("exp", "mfg"):
        text = F.trim(F.coalesce(row[f], F.lit("")))
        out |= {f: F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")), f"{f}_text": text}
    return out | {"batch": F.when(include_batch, F.coalesce(row["batch"], F.lit(""))), "row_confidence": score, "status": F.when(reviewed, CHECKED).otherwise(UNCHECKED)}


def problems(row: Mapping[str, Column], score: Column, n_rows: Column) -> Column:
    """What a request breaks, in order: rows, the names of too long fields, confidence."""
    long = [F.when(F.length(row[f]) > n, F.lit(f)) for f, n in WIDEST.items() if f in row]
    return F.array_compact(F.array(F.when(~n_rows.between(1, MOST_ROWS), "rows"), *long, F.when(~score.between(0, 1), "row_confidence")))


def file_name(po: Column) -> Column:
    kept = F.substring(F.regexp_replace(F.coalesce(po, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 32)
    return F.when(kept == "", "unknown").otherwise(kept)


def reliable(field: str, text: Column, score: Column) -> Column:
    return F.coalesce(T.is_valid(field, text) & (score >= RELIABLE[field]), F.lit(False))


def replaces(field: str, current: Column, current_score: Column, new: Column, new_score: Column) -> Column:
    """Whether a new reading takes a cell's place: from 0.3 on; into an empty cell always; a name from
    0.35 on; never one valid SKU for another; a quantity without its tick; the valid one of two;
    a valid one at most 0.05 below; else the better score."""
    was, now = T.is_valid(field, current), T.is_valid(field, new)
    no_score = current_score.isNull()
    rule = F.when(current == "", True)
    if field == "name":
        rule = rule.when(F.lit(True), new_score >= 0.35)
    if field == "sku":
        rule = rule.when(was & now & (current != new), False)
    if field == "qty":
        rule = rule.when(was & now & current.endswith("1") & (new == F.substring(current, F.lit(1), F.length(current) - 1)), True)
    rule = rule.when(was != now, now).when(now, no_score | (new_score >= current_score - 0.05)).otherwise(no_score | (new_score > current_score))
    return F.coalesce((new != "") & (new_score >= 0.30) & rule, F.lit(False))


def observed(field: Column, text: Column, total: Column) -> Column:
    """Whether a fragment of a column can be one of its values, to find the rows by; names never."""
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    digits = F.regexp_replace(compact, r"(?U)\D", "")
    n = F.length(digits)
    fits = (
        F.when(field == "sku", n.between(8, 14))
        .when(field == "qty", n.between(1, 4) & ~F.coalesce(digits.try_cast("long") == total, F.lit(False)))
        .when(field == "box", n.between(1, 4))
        .when(field.isin("exp", "mfg"), n.isin(6, 8))
        .when(field == "pallet", n > 0)
        .when(field == "batch", F.length(F.regexp_replace(compact, "[^A-Za-z0-9]", "")) >= 4)
    )
    return F.coalesce(fits, F.lit(False))


def label_boxes(found: DataFrame) -> DataFrame:
    """The outlines (x, y, w, h, area, corners, brightness; width, height, scale of their frame) that can be
    white labels, at the source's scale, in reading order (place, from 0, within ``frame``)."""
    size = F.col("width") * F.col("height")
    touches = sum(F.when(t, 1).otherwise(0) for t in (F.col("x") <= 2, F.col("y") <= 2, F.col("x") + F.col("w") >= F.col("width") - 2, F.col("y") + F.col("h") >= F.col("height") - 2))
    share = F.col("area") / (F.col("w") * F.col("h"))
    kept = found.where(F.col("area").between(size * 0.002, size * 0.45) & (F.col("w") >= 28) & (F.col("h") >= 20) & (F.col("w") / F.col("h")).between(0.55, 4.2))
    kept = kept.where((share >= 0.70) & F.col("corners").between(4, 8) & (F.col("brightness") >= 175) & (touches < 3))
    scaled = [F.bround(F.col(c) / F.col("scale")).cast("long").alias(n) for c, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))]
    return kept.select("frame", *scaled, F.bround(F.least(F.lit(0.99), share), 3).alias("confidence"))


def case_of(value: Column) -> Column:
    """Struct of image and expected from ``IMAGE=QTY,QTY,...``; null if it is not of this form."""
    image, numbers = F.regexp_extract(value, r"(?s)^([^=]+)=(.+)$", 1), F.split(F.regexp_extract(value, r"(?s)^([^=]+)=(.+)$", 2), ",", -1)
    expected = F.transform(numbers, lambda x: F.trim(x).try_cast("long"))
    return F.when(value.rlike(r"(?s)^[^=]+=.+$") & ~F.exists(expected, lambda x: x.isNull()), F.struct(image.alias("image"), expected.alias("expected")))


def compared(actual: Column, expected: Column) -> Column:
    """Struct of right (equal numbers at equal places), missing_or_extra (rows), mismatches (row from 1, expected, actual)."""
    n = F.least(F.size(actual), F.size(expected))
    pairs = F.transform(F.slice(F.arrays_zip(actual.alias("a"), expected.alias("e")), F.lit(1), n), lambda p, i: F.struct((i + 1).alias("row"), p["e"].alias("expected"), p["a"].alias("actual")))
    off = F.filter(pairs, lambda p: p["expected"] != p["actual"])
    return F.struct((n - F.size(off)).alias("right"), F.abs(F.size(actual) - F.size(expected)).alias("missing_or_extra"), off.alias("mismatches"))


def part_of(group: Column, parts: int = 10, held: int = 1) -> Column:
    """train or validation, the same for all rows of a group."""
    return F.when(F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long") % parts < held, "validation").otherwise("train")


# The sheet's title and labels, and what stands for a sum that is not sure.
TITLE, LABELS, OPEN_SUM = "入库单核实明细", ("PO 号", "明细合计", "单据合计", "备注"), "待核实"


def sheet_sections(lines: DataFrame) -> DataFrame:
    """doc_id, section (title, order, note, line), ordinal (the sheet's row), cells (texts of the row's columns, in order) of lines
    (doc_id, row_idx, po_no, note, document_total, qty: number or null, qty_marked, values: array of texts).

    Sums and lines come from one aggregation over two grouping sets; the sum of a document with a marked quantity is not
    sure. Sorted by document and row, as files of ranges of documents."""
    whole = F.grouping("row_idx") == 1
    figures = lines.groupingSets([["doc_id", "row_idx"], ["doc_id"]], "doc_id", "row_idx").agg(
        whole.alias("whole"), F.first("values").alias("values"), F.max("po_no").alias("po_no"), F.max("note").alias("note"), F.max("document_total").alias("document_total"), F.sum("qty").alias("sum"), F.bool_or("qty_marked").alias("open")
    )
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    total = F.when(F.col("open"), F.lit(OPEN_SUM)).otherwise(plain(F.col("sum")))
    po, summed, printed, note = map(F.lit, LABELS)
    row = lambda section, at, *texts: F.struct(F.lit(section).alias("section"), at.cast("long").alias("ordinal"), F.array(*texts).alias("cells"))
    head = F.array(row("title", F.lit(1), F.lit(TITLE)), row("order", F.lit(2), po, plain(F.col("po_no")), summed, total, printed, plain(F.col("document_total"))), row("note", F.lit(3), note, plain(F.col("note"))))
    line = F.array(F.struct(F.lit("line").alias("section"), (F.col("row_idx") + 6).cast("long").alias("ordinal"), F.concat(F.array((F.col("row_idx") + 1).cast("string")), F.col("values")).alias("cells")))
    out = figures.select("doc_id", F.explode(F.when(F.col("whole"), head).otherwise(line)).alias("r")).select("doc_id", "r.*")
    return out.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ordinal")


def accuracy(cases: DataFrame, by: str) -> DataFrame:
    """By group: cases, right, expected (numbers), exact (share right), complete (cases with all rows), median_ms (exact) of compared
    cases (``by``, right, missing_or_extra, n_expected, elapsed_ms)."""
    return cases.groupBy(by).agg(
        F.count("*").alias("cases"), F.sum("right").cast("long").alias("right"), F.sum("n_expected").cast("long").alias("expected"), (F.sum("right") / F.sum("n_expected")).alias("exact"),
        F.count_if(F.col("missing_or_extra") == 0).alias("complete"), F.median("elapsed_ms").alias("median_ms"),
    )


def write_report(cases: DataFrame, by: str, path: str) -> dict[str, int]:
    """Writes ``accuracy`` as JSON below ``path``; the numbers of cases, of right and of expected numbers are taken on the way."""
    seen = Observation("cases")
    watched = cases.observe(seen, F.count("*").alias("cases"), F.sum("right").cast("long").alias("right"), F.sum("n_expected").cast("long").alias("expected"))
    accuracy(watched, by).write.mode("overwrite").json(path)
    return seen.get
