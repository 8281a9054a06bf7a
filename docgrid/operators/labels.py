"""Package label texts: dates with their roles, and the batch number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.text import confusable, let
from docgrid.operators.matching import reconciled_label_batch

# The patterns of dates, times and labels. Digits, white space and words are those of all scripts.
YEAR = r"((?:19|20|21)\d{2})(?!\d)"
DATE = r"(?U)(?<!\d)(\d{1,2})\s*(?:[./-]|\s+)\s*(\d{1,2})\s*(?:[./-]|\s+)\s*" + YEAR
COMPACT = r"(?U)(?<!\d)(\d{2})(\d{2})\s*[./-]\s*" + YEAR
TIME = r"(?U)(?<!\d)(?:[01]?\d|2[0-3])\s*[:.]\s*[0-5]\d(?::[0-5]\d)?(?!\d)"
LEADING_TIME = r"(?U)^\s*(?:[01]?\d|2[0-3])\s*[:.]\s*[0-5]\d(?::[0-5]\d)?\s+"
MADE = r"MFG|MFD|MAN|MANUFACTURE|MANUFACTURING|PROD|PRODUCED|PRODUCTION"
EXPIRES = r"EXP|EXPIRY|EXPIRATION|BBE|USE\s+BY|BEST\s+BEFORE"
BATCH = r"(?i)\b(?:LOT|BATCH)(?:\s*(?:NO|NUMBER|CODE))?\s*[:#-]?\s*"
PROSE = r"(?i)\b(?:DATE|DD|MM|YYYY|DLD|REG|TRADEMARK|WEBSITE|WWW|BEST|BEFORE|MANUFACTURING|EXPIRY|EXPIRATION)\b"
FIELDS = ["manufacture_at", "expire_at", "batch"]
WIDE_DIGITS = "０１２３４５６７８９"
REACH = 48
FAR = 1 << 20


def _gap(line: Column, start: Column, end: Column, labels: str) -> Column:
    """Characters between the places ``start`` to ``end`` (0-based) of the line and the nearest label,
    FAR beyond ``REACH``. A character of the date stays in view, as a label must end before it."""
    before, after = F.substring(line, F.lit(1), start + 1), F.substring(line, end, F.length(line))
    left = F.when(before.rlike(rf"(?is)\b(?:{labels})\b.*.$"), F.length(F.regexp_extract(before, rf"(?is)^.*\b(?:{labels})\b(.*).$", 1)))
    right = F.when(after.rlike(rf"(?is)^..*?\b(?:{labels})\b"), F.length(F.regexp_extract(after, rf"(?is)^.(.*?)\b(?:{labels})\b", 1)))
    near = F.least(left, right)
    return F.when(near <= REACH, near).otherwise(F.lit(FAR))


def lines_of(text: Column) -> Column:
    return F.split(F.trim(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))), "\n")


def _matches(line: Column, pattern: str) -> Column:
    """value (date or null), role (manufacture, expire, unknown) of each match of a date's pattern."""

    def one(raw: Column, start: Column) -> Column:
        part = lambda n: F.translate(F.regexp_extract(raw, pattern, n), WIDE_DIGITS, "0123456789")
        value = F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")
        gaps = F.struct(*[_gap(line, start, start + F.length(raw), names).alias(k) for k, names in (("made", MADE), ("ends", EXPIRES))])
        role = let(gaps, lambda g: F.when(g["made"] < g["ends"], "manufacture").when(g["ends"] < g["made"], "expire").otherwise("unknown"))
        return F.struct(value.alias("value"), role.alias("role"))

    def placed(x: Column) -> Column:
        length = lambda i: F.length(F.get(x["pieces"], i)) + F.coalesce(F.length(F.get(x["raws"], i)), F.lit(0))
        upto = lambda i: F.aggregate(F.slice(F.sequence(F.lit(0), F.size(x["raws"])), F.lit(1), i), F.lit(0), lambda a, j: a + length(j))
        return F.transform(x["raws"], lambda raw, i: let(upto(i) + F.length(F.get(x["pieces"], i)), lambda start: one(raw, start)))

    return let(F.struct(F.split(line, pattern, -1).alias("pieces"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("raws")), placed)


def dates(lines: Column) -> Column:
    """at (line), value (date), role of all valid day-month-year dates of the lines (an array)."""
    found = F.transform(lines, lambda line, at: F.transform(F.concat(_matches(line, DATE), _matches(line, COMPACT)), lambda m: F.struct(at.alias("at"), m["value"].alias("value"), m["role"].alias("role"))))
    return F.filter(F.flatten(found), lambda d: d["value"].isNotNull())


def roles(found: Column, want_made_only: bool = False) -> Column:
    """Struct of manufacture_at, expire_at from ``dates`` by the decision table: one labelled date
    each way is taken; without a conflict, one or two unlabelled dates fill what is open, later ones
    as expiry; two dates that aren't in order are both dropped."""
    of = lambda role: F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda d: d["role"] == role), lambda d: d["value"])))
    return let(F.struct(of("manufacture").alias("manufacture"), of("expire").alias("expire"), of("unknown").alias("unknown")), lambda s: _decided(s, want_made_only))


def _decided(sets: Column, want_made_only: bool) -> Column:
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    m, e = only(sets["manufacture"]), only(sets["expire"])
    conflict = (F.size(sets["manufacture"]) > 1) | (F.size(sets["expire"]) > 1)

    def filled(u: Column) -> Column:
        n, u0, u1 = F.size(u), F.get(u, F.lit(0)), F.get(u, F.lit(1))
        none = m.isNull() & e.isNull() & ~conflict
        open_e = m.isNotNull() & e.isNull() & ~conflict & (n == 1) & (u0 > m)
        open_m = m.isNull() & e.isNotNull() & ~conflict & (n == 1) & (u0 < e)
        single = F.lit(want_made_only)
        made = F.when(none & (((n == 1) & single) | (n == 2)), u0).when(open_m, u0).otherwise(m)
        ends = F.when(none & (n == 1) & ~single, u0).when(none & (n == 2), u1).when(open_e, u0).otherwise(e)
        return F.struct(made.alias("made"), ends.alias("ends"))

    def ordered(x: Column) -> Column:
        ok = F.coalesce(x["made"] < x["ends"], F.lit(True))
        return F.struct(F.when(ok, x["made"]).cast("string").alias("manufacture_at"), F.when(ok, x["ends"]).cast("string").alias("expire_at"))

    return let(let(F.array_except(sets["unknown"], F.array(m, e)), filled), ordered)


def _sanitized(c: Column, has_date: Column, explicit: bool, structured: Column) -> Column:
    """The batch number that a cleaned line may hold, or null."""
    return let(F.regexp_replace(F.btrim(c, F.lit(" \t;,.#-()[]")), r"\s+", " "), lambda v: _good(v, has_date, explicit, structured))


def _good(v: Column, has_date: Column, explicit: bool, structured: Column) -> Column:
    compact = F.regexp_replace(v, "[^A-Za-z0-9]", "")
    tokens = F.split(v, " ")
    strong = F.exists(tokens, lambda t: F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) >= 5)
    mixed = F.exists(tokens, lambda t: t.rlike("[A-Za-z]") & t.rlike(r"\d"))
    good = (
        v.rlike(r"^(?:[A-Za-z0-9][A-Za-z0-9_:\- ]*[A-Za-z0-9]|[A-Za-z0-9])$")
        & ~v.rlike(rf"^(?:{DATE})$")
        & ~v.rlike(rf"^(?:{TIME})$")
        & ~v.rlike(r"^.*\b(?:19|20|21)\d{2}$")
        & F.length(compact).between(5, 48)
        & compact.rlike(r"\d")
        & (~v.contains(" ") | has_date | strong | mixed | (structured & _structured(v)) | F.lit(explicit))
    )
    return F.when(good, v)


def _structured(v: Column) -> Column:
    digits = F.length(F.regexp_replace(v, r"\D", ""))
    return v.rlike(TIME) & ~v.rlike(DATE) & ~v.rlike(COMPACT) & v.rlike(r"^[\d\s:]*$") & (F.size(F.split(F.trim(v), r"\s+")) >= 5) & (digits >= 12)


def batch(lines: Column, found: Column) -> Column:
    """The only explicitly labelled value of the lines; else the best scored line, if only one scores
    best. Lines at most one away from a date of ``found`` score higher."""
    at_dates = F.transform(found, lambda d: d["at"])

    def one(line: Column, at: Column) -> Column:
        near = F.exists(at_dates, lambda d: F.abs(d - at) <= 1)
        return let(F.struct(line.alias("line"), near.alias("near"), (line.rlike(DATE) | line.rlike(COMPACT)).alias("dated")), _candidate)

    return let(F.transform(lines, one), _chosen)


def _candidate(x: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, DATE, " "), COMPACT, " ")
    tail = F.regexp_replace(bare(F.regexp_replace(x["line"], rf"(?is)^.*?{BATCH[4:]}", "")), LEADING_TIME, "")
    explicit = F.when(x["line"].rlike(BATCH), _sanitized(tail, x["dated"], True, F.lit(True)))
    named = rf"(?i)\b(?:{MADE}|{EXPIRES})\b"
    plain = F.regexp_replace(F.regexp_replace(bare(x["line"]), named, " "), LEADING_TIME, "")
    value = F.when(~(x["line"].rlike(PROSE) | x["line"].rlike(named)), _sanitized(plain, x["dated"], False, x["near"]))
    return let(value, lambda v: F.struct(explicit.alias("explicit"), v.alias("value"), _score(v, x["near"]).alias("score")))


def _score(value: Column, near: Column) -> Column:
    def scored(compact: Column) -> Column:
        mixed = compact.rlike("[A-Za-z]") & compact.rlike(r"\d")
        points = F.when(near, 100).otherwise(0) + F.when(_structured(value), 100).otherwise(0) + F.when(mixed, 50).otherwise(0)
        return points + F.when(value.contains(" "), 0).otherwise(20) + F.least(F.length(compact), F.lit(40))

    return let(F.regexp_replace(value, "[^A-Za-z0-9]", ""), scored)


def _chosen(rows: Column) -> Column:
    said = F.array_distinct(F.filter(F.transform(rows, lambda r: r["explicit"]), lambda v: v.isNotNull()))

    def best(kept: Column) -> Column:
        values = F.transform(kept, lambda r: r["value"])
        first = F.filter(kept, lambda r, i: F.array_position(values, r["value"]) == i + 1)  # a value counts by its first line
        top = F.array_max(F.transform(first, lambda r: r["score"]))
        return let(F.filter(first, lambda r: r["score"] == top), lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))["value"]))

    guess = let(F.filter(rows, lambda r: r["value"].isNotNull()), best)
    return let(said, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))).when(F.size(s) == 0, guess))


def parsed(text: Column, want_made_only: bool = False) -> Column:
    """Struct of manufacture_at, expire_at (yyyy-MM-dd), batch of a label's text, null where not
    found. All inside the row, no shuffle."""

    def whole(x: Column) -> Column:
        return F.struct(roles(x["dates"], want_made_only).alias("r"), batch(x["lines"], x["dates"]).alias("batch"))

    found = let(lines_of(text), lambda lines: let(F.struct(lines.alias("lines"), dates(lines).alias("dates")), whole))
    return let(found, lambda x: F.struct(x["r"]["manufacture_at"].alias("manufacture_at"), x["r"]["expire_at"].alias("expire_at"), x["batch"].alias("batch")))


def merged(*texts: Column) -> Column:
    """The distinct trimmed lines of the texts, in order."""
    lines = F.concat(*[F.transform(F.split(F.coalesce(t, F.lit("")), r"\R"), lambda x: F.trim(x)) for t in texts])
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def missing(found: Column, required: Column) -> Column:
    """Those of the ``required`` fields (an array of names) that ``found`` (``parsed``) lacks."""
    value = lambda f: F.coalesce(*[F.when(f == name, found[name]) for name in FIELDS], F.lit(""))
    return F.filter(required, lambda f: F.trim(value(f)) == "")


def packages(texts: DataFrame, required: Column) -> DataFrame:
    """``texts`` (primary, enhanced: two readings of a label's text; allowed: an array of batches; other
    columns but p1 to p3) with the fields (empty where not found), batch_original, raw_text, missing
    (required fields) and places (0-based, of the batch, to look at again).

    Where the first reading lacks required fields, the second and both texts merged are parsed
    too, and the reading with most of them is taken, the earliest of equals. The allowed
    list sets the batch right. Places are those where the first and second reading differ
    by look-alikes, and those set right. No shuffle; each step is one projection."""
    lacks = lambda c: F.size(missing(F.col(c), required))
    out = texts.withColumn("p1", parsed(F.col("primary"))).withColumn("again", lacks("p1") > 0)
    out = out.withColumn("both", F.when(F.col("again"), merged(F.col("primary"), F.col("enhanced"))))
    out = out.withColumn("p2", F.when(F.col("again"), parsed(F.col("enhanced")))).withColumn("p3", F.when(F.col("again"), parsed(F.col("both"))))
    ranked = F.least(*[F.struct(lacks(c).alias("lacks"), F.lit(i).alias("i")) for i, c in enumerate(("p1", "p2", "p3"))])["i"]
    out = out.withColumn("best", F.when(F.col("again"), ranked).otherwise(0))
    out = out.withColumn("found", F.when(F.col("best") == 0, F.col("p1")).when(F.col("best") == 1, F.col("p2")).otherwise(F.col("p3")))
    seen = [F.coalesce(confusable(F.col("found.batch"), F.col(f"{c}.batch")), F.array().cast("array<int>")) for c in ("p1", "p2")]
    out = out.withColumn("seen", F.array_union(*seen))
    right, moved = reconciled_label_batch(F.col("found.batch"), F.col("allowed"))
    fields = {c: F.coalesce(F.col(f"found.{c}"), F.lit("")) for c in ("manufacture_at", "expire_at")}
    out = out.withColumns(fields | {"batch": F.coalesce(right, F.lit("")), "batch_original": F.coalesce("found.batch", F.lit("")), "places": F.array_sort(F.array_union("seen", moved))})
    out = out.withColumns({"raw_text": F.coalesce("both", "primary"), "missing": missing(F.col("found"), required)})
    return out.drop("p1", "p2", "p3", "again", "both", "best", "found", "seen", "primary", "enhanced", "allowed")
