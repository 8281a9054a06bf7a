"""Cleaning and checking of recognized field texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters mistaken for digits, and groups of look-alike characters.
DIGIT_LOOKALIKES = ("OoQDlISs", "00001155")
CONFUSABLE = ["O0", "I1", "17", "B8", "S5", "E5", "Z2", "G6"]
EDGE_MARKS = "/／\\|:：;；,.，。"
FIELDS = ["pallet", "box", "sku", "name", "qty", "exp", "mfg", "batch"]


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once; without it, nested cleaning multiplies the expression."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def clean_text(c: Column) -> Column:
    """Trim, one space between words, no table-rule slashes at the ends; most texts have neither and stay."""
    return let(c, lambda t: F.when(t.rlike(r"[\s/／]"), _clean_text(t)).otherwise(t))


def _clean_text(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.trim(F.regexp_replace(c, "[/／]+$", ""))
    return F.trim(F.regexp_replace(c, "^[/／]+", ""))


def is_gtin(c: Column) -> Column:
    """GTIN of 8, 12, 13 or 14 digits with a right check digit; null and others are false."""
    return let(c, _is_gtin)


def _is_gtin(c: Column) -> Column:
    # places count from the end; a text that is shorter has none there, which weighs nothing
    digit = lambda i: F.greatest(F.ascii(F.substring(c, -1 - i, 1)), F.lit(48)) - 48
    weighed = reduce(lambda a, b: a + b, [digit(i) * 3 if i % 2 else digit(i) for i in range(14)])
    return F.coalesce(F.when(c.rlike(r"^(\d{8}|\d{12}|\d{13}|\d{14})$"), weighed % 10 == 0), F.lit(False))


def clean_sku(c: Column) -> Column:
    """Edges freed of rules and marks; other edge characters go only if a valid GTIN remains."""
    text = F.regexp_replace(clean_text(F.coalesce(c, F.lit(""))), r"\s+", "")
    return let(F.btrim(text, F.lit(EDGE_MARKS)), _clean_sku)


def _clean_sku(text: Column) -> Column:
    inner = F.regexp_replace(text, r"^\D+|\D+$", "")
    n = F.length(text) - 1
    left, right = F.substring(text, F.lit(1), n), F.substring(text, F.lit(2), n)
    left_ok, right_ok = is_gtin(left), is_gtin(right)
    one = F.when(left_ok & (~right_ok | (left == right)), left).when(right_ok & ~left_ok, right).otherwise(text)
    return (
        F.when((inner != text) & is_gtin(inner), inner)
        .when(~text.rlike(r"^\d+$") | is_gtin(text), text)
        .when(n.isin(8, 12, 13, 14), one)
        .otherwise(text)
    )


def clean_digits(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), *DIGIT_LOOKALIKES), r"(?U)\D", "")


def digit_count(c: Column) -> Column:
    """How many digits a text has, of any script; texts of one byte a character need no pattern."""
    plain = F.length(c) - F.length(F.translate(c, "0123456789", ""))
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(F.length(F.regexp_replace(c, r"(?U)\D", "")))


def clean_pallet(c: Column) -> Column:
    return F.replace(F.regexp_replace(clean_text(F.coalesce(c, F.lit(""))), r"\s+", ""), F.lit("／"), F.lit("/"))


def clean_date(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[.／:：]", "-"), r"\s+", "")


def clean_batch(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")


def normalize_batch(c: Column) -> Column:
    return F.upper(clean_batch(c))


def regroup_date(c: Column) -> Column:
    """Digits as Y-M-D from eight on, Y-M from six on, else the trimmed text."""
    def shaped(t: Column) -> Column:
        d = F.regexp_replace(t, r"(?U)\D", "")
        part = lambda a, n: F.substring(d, a, n)
        return (
            F.when(F.length(d) >= 8, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)))
            .when(F.length(d) >= 6, F.concat_ws("-", part(1, 4), part(5, 2)))
            .otherwise(F.trim(t))
        )

    return let(F.coalesce(c, F.lit("")), shaped)


def is_date(c: Column) -> Column:
    """Calendar date YYYY-MM-DD of 1900 to 2200; the empty text counts as valid."""
    year = F.substring(c, 1, 4)
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & year.between("1900", "2200")
    return F.coalesce((c == "") | (shaped & c.try_cast("date").isNotNull()), F.lit(True))


def normalized(field: str, c: Column) -> Column:
    kinds = {"sku": clean_sku, "pallet": clean_pallet, "qty": clean_digits, "box": clean_digits, "exp": regroup_date, "mfg": regroup_date, "batch": clean_batch}
    return kinds.get(field, lambda x: x)(clean_text(F.coalesce(c, F.lit(""))))


def is_valid(field: str, c: Column) -> Column:
    """Whether a normalized value is good for its field; empty is not."""
    return let(c, lambda v: _is_valid(field, v))


def _is_valid(field: str, c: Column) -> Column:
    if field == "sku":
        ok = c.rlike(r"^\d{8,14}$") & (~F.length(c).isin(8, 12, 13, 14) | is_gtin(c))
    elif field in ("qty", "box"):
        ok = c.rlike(r"^[1-9]\d*$")
    elif field in ("exp", "mfg"):
        ok = is_date(c)
    elif field == "pallet":
        ok = c.rlike(r"^\d+/\d+$")
    elif field == "batch":
        ok = c.rlike("^[A-Za-z0-9]{4,}$")
    else:
        ok = F.length(c) >= 2
    return F.coalesce((c != "") & ok, F.lit(False))


def differing(a: Column, b: Column) -> Column:
    """0-based places where two texts of one length differ; other lengths: none."""

    def places(t: Column) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.length(t["a"]) - 1, F.lit(0)))
        found = F.filter(every, lambda i: F.substring(t["a"], i + 1, F.lit(1)) != F.substring(t["b"], i + 1, F.lit(1)))
        return F.when((F.length(t["a"]) == F.length(t["b"])) & (t["a"] != t["b"]), found).otherwise(F.array().cast("array<int>"))

    return let(F.struct(a.alias("a"), b.alias("b")), places)


def confusable(a: Column, b: Column) -> Column:
    """0-based places where texts of one length differ by look-alike characters."""
    pairs = sorted({p for g in CONFUSABLE for p in (g, g[::-1])})

    def places(t: Column) -> Column:
        two = lambda i: F.concat(F.substring(t["a"], i + 1, F.lit(1)), F.substring(t["b"], i + 1, F.lit(1)))
        return F.filter(differing(t["a"], t["b"]), lambda i: two(i).isin(pairs))

    return let(F.struct(F.upper(a).alias("a"), F.upper(b).alias("b")), places)


def trailing_check_mark(qty: Column, box: Column) -> Column:
    """The quantity without a last 1 that the box number shows to be a tick."""
    cut = F.substring(qty, F.lit(1), F.length(qty) - 1)
    return F.when((F.length(qty) > 1) & qty.endswith("1") & (cut == box), cut).otherwise(qty)


def line_decision(lines: Column) -> Column:
    """Whether the lines (array of text, confidence) are one sure identifier: a struct of
    accepted, reason (null if accepted) and confidence (of a single line with a text)."""
    first = F.get(lines, F.lit(0))
    text = F.regexp_replace(F.coalesce(first["text"], F.lit("")), r"(?U)^\s+|\s+$", "")
    score = F.when(~F.isnan(first["confidence"]) & (F.abs(first["confidence"]) < F.lit(float("inf"))), first["confidence"])
    shaped = text.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_./:-]{1,127}\z") & text.rlike(r"\d")
    n = F.coalesce(F.size(lines), F.lit(0))
    reason = (
        F.when(n < 1, "no_text")
        .when(n > 1, "multiple_lines")
        .when(text == "", "no_text")
        .when(~shaped, "invalid_identifier")
        .when(score.isNull(), "invalid_confidence")
        .when(score < 0.95, "low_confidence")
    )
    return let(reason, lambda r: F.struct(r.isNull().alias("accepted"), r.alias("reason"), F.when((n == 1) & (text != ""), score).alias("confidence")))
