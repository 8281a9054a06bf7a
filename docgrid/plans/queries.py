"""The queries over whole fixture tables, each with its SQL counterpart for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.fixtures import fixture, with_views
from docgrid.functions import dates
from docgrid.functions import text as T
from docgrid.operators import labels, matching, pages, reconcile, rows, votes
from docgrid.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query, and its SQL with the fixtures it needs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = with_views(*views) if views else ""
            tail = sql.strip()
            ORACLE[f.__name__] = f"{head}, {tail[5:]}" if head and tail.startswith("with ") else f"{head}\n{tail}"
        return f

    return add


# DuckDB forms of the scalar functions.
def _clean(x: str) -> str:
    x = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(trim(regexp_replace({x}, '[/／]+$', '')), '^[/／]+', ''))"


def _digits(x: str) -> str:
    return f"regexp_replace(translate({x}, 'OoQDlISs', '00001155'), '\\D', '', 'g')"


def _alnum(x: str) -> str:
    return f"regexp_replace({x}, '[^A-Za-z0-9]', '', 'g')"


def _gtin(x: str) -> str:
    return (
        f"(regexp_full_match({x}, '\\d{{8}}|\\d{{12}}|\\d{{13}}|\\d{{14}}') and "
        f"(10 - cast(list_sum(list_transform(range(1, length({x})), lambda i: coalesce(try_cast(substr({x}, length({x}) - cast(i as int), 1) as int), 0) * case when i % 2 = 1 then 3 else 1 end)) as int) % 10) % 10"
        f" = coalesce(try_cast(right({x}, 1) as int), -1))"
    )


def _regroup(x: str) -> str:
    d = f"regexp_replace({x}, '\\D', '', 'g')"
    return f"case when length({d}) >= 8 then substr({d}, 1, 4) || '-' || substr({d}, 5, 2) || '-' || substr({d}, 7, 2) when length({d}) >= 6 then substr({d}, 1, 4) || '-' || substr({d}, 5, 2) else trim({x}) end"


def _date_ok(x: str) -> str:
    return f"({x} = '' or (regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and substr({x}, 1, 4) between '1900' and '2200' and try_cast({x} as date) is not null))"


SKU = f"""with k1 as (select *, trim(regexp_replace({_clean('sku_text')}, '\\s+', '', 'g'), '/／\\|:：;；,.，。') as t from inv_line),
k2 as (select *, regexp_replace(regexp_replace(t, '^\\D+', ''), '\\D+$', '') as inner_, substr(t, 1, length(t) - 1) as l_, substr(t, 2) as r_ from k1),
sku_clean as (select *, case when inner_ <> t and {_gtin('inner_')} then inner_ when not regexp_full_match(t, '\\d+') or {_gtin('t')} then t
  when length(t) - 1 in (8, 12, 13, 14) and {_gtin('l_')} and (not {_gtin('r_')} or l_ = r_) then l_
  when length(t) - 1 in (8, 12, 13, 14) and {_gtin('r_')} and not {_gtin('l_')} then r_ else t end as sku from k2)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "inv_line")


def _tick(qty: str, box: str) -> str:
    return f"case when length({qty}) > 1 and right({qty}, 1) = '1' and substr({qty}, 1, length({qty}) - 1) = {box} then substr({qty}, 1, length({qty}) - 1) else {qty} end"


INVOICE = f"""with q as (select doc_id, {_digits(_clean('qty_text'))} as q0, {_digits(_clean('box_text'))} as box from inv_line),
r as (select doc_id, {_tick('q0', 'box')} as qty, q0 from q)
select doc_id, count(*) as n_lines, cast(count(*) filter (qty = '') as bigint) as n_missing,
  cast(count(*) filter (qty <> '' and not regexp_full_match(qty, '[1-9]\\d*')) as bigint) as n_invalid,
  cast(count(*) filter (qty <> q0) as bigint) as n_ticks,
  case when bool_and(regexp_full_match(qty, '[1-9]\\d*')) then cast(sum(try_cast(qty as bigint)) as bigint) end as total_qty
from r group by doc_id"""


@query(INVOICE, "inv_line")
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("doc_id", T.normalized("qty", F.col("qty_text")).alias("q0"), T.normalized("box", F.col("box_text")).alias("box"))
    r = lines.withColumn("qty", T.trailing_check_mark(F.col("q0"), F.col("box")))
    valid = T.is_valid("qty", F.col("qty"))
    return r.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("qty") == "").alias("n_missing"),
        F.count_if((F.col("qty") != "") & ~valid).alias("n_invalid"),
        F.count_if(F.col("qty") != F.col("q0")).alias("n_ticks"),
        F.when(F.bool_and(valid), F.sum(F.expr("try_cast(qty as bigint)"))).alias("total_qty"),
    )


@query(SKU + f"select doc_id, row_idx, sku, {_gtin('sku')} as gtin from sku_clean", "inv_line")
def sku_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "row_idx", T.clean_sku(F.col("sku_text")).alias("sku")).withColumn("gtin", T.is_gtin(F.col("sku")))


@query(
    f"""select doc_id, row_idx, {_clean('qty_text')} as cleaned, {_digits('qty_text')} as digits, regexp_replace({_clean('pallet_text')}, '\\s+', '', 'g') as pallet,
    regexp_replace(regexp_replace(trim(mfg_text), '[.／:：]', '-', 'g'), '\\s+', '', 'g') as mfg, {_alnum('batch_text')} as batch, upper({_alnum('batch_text')}) as batch_key from inv_line""",
    "inv_line",
)
def text_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _lines(spark, sf_dir).select(
        "doc_id", "row_idx", T.clean_text(c("qty_text")).alias("cleaned"), T.clean_digits(c("qty_text")).alias("digits"), T.clean_pallet(c("pallet_text")).alias("pallet"),
        T.clean_date(c("mfg_text")).alias("mfg"), T.clean_batch(c("batch_text")).alias("batch"), T.normalize_batch(c("batch_text")).alias("batch_key"),
    )


@query(
    SKU
    + f"""select doc_id, row_idx, (regexp_full_match(sku, '\\d{{8,14}}') and (length(sku) not in (8, 12, 13, 14) or {_gtin('sku')})) as sku_ok,
    regexp_full_match({_digits(_clean('qty_text'))}, '[1-9]\\d*') as qty_ok, regexp_full_match({_digits(_clean('box_text'))}, '[1-9]\\d*') as box_ok,
    ({_regroup(_clean('exp_text'))} <> '' and {_date_ok(_regroup(_clean('exp_text')))}) as exp_ok, regexp_full_match({_clean('pallet_text')}, '\\d+/\\d+') as pallet_ok,
    regexp_full_match({_alnum(_clean('batch_text'))}, '[A-Za-z0-9]{{4,}}') as batch_ok from sku_clean""",
    "inv_line",
)
def field_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("sku", "qty", "box", "exp", "pallet", "batch")
    return _lines(spark, sf_dir).select("doc_id", "row_idx", *[T.is_valid(f, T.normalized(f, F.col(f"{f}_text"))).alias(f"{f}_ok") for f in fields])


@query(
    SKU
    + f""", v as (select doc_id, row_idx, sku, {_digits('qty_text')} as qty, regexp_replace(regexp_replace(trim(exp_text), '[.／:：]', '-', 'g'), '\\s+', '', 'g') as exp from sku_clean)
    select doc_id, row_idx, case when sku = '' then 'missing' when not regexp_full_match(sku, '\\d{{8,}}') then 'invalid_format' end as sku_error,
    case when qty = '' then 'missing' when not regexp_full_match(qty, '[1-9]\\d*') then 'invalid_format' end as qty_error,
    case when not {_date_ok('exp')} then 'invalid_format' end as exp_error from v""",
    "inv_line",
)
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lines(spark, sf_dir).select("doc_id", "row_idx", T.clean_sku(F.col("sku_text")).alias("sku"), T.clean_digits(F.col("qty_text")).alias("qty"), T.clean_date(F.col("exp_text")).alias("exp"))
    error = lambda f, p: F.when(F.col(f) == "", "missing").when(~F.col(f).rlike(p), "invalid_format").alias(f"{f}_error")
    return v.select("doc_id", "row_idx", error("sku", r"^\d{8,}$"), error("qty", r"^[1-9]\d*$"), F.when(~T.is_date(F.col("exp")), "invalid_format").alias("exp_error"))


@query(f"select doc_id, row_idx, {_regroup('exp_text')} as exp, {_regroup('mfg_text')} as mfg, {_date_ok(_regroup('exp_text'))} as exp_ok from inv_line", "inv_line")
def date_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lines(spark, sf_dir).select("doc_id", "row_idx", T.regroup_date(F.col("exp_text")).alias("exp"), T.regroup_date(F.col("mfg_text")).alias("mfg"))
    return out.withColumn("exp_ok", T.is_date(F.col("exp")))


ALLOWED = """with allowed as (select distinct doc_id, batch_true as a from inv_line union select doc_id, max(reverse(batch_true)) from inv_line group by doc_id),
scored as (select i.doc_id, row_idx, upper(regexp_replace(batch_text, '[^A-Za-z0-9]', '', 'g')) as k, a, levenshtein(upper(regexp_replace(batch_text, '[^A-Za-z0-9]', '', 'g')), upper(a)) as d, batch_text
  from inv_line i join allowed using (doc_id)),
ranked as (select *, row_number() over (partition by doc_id, row_idx order by d, a) as n, lead(d) over (partition by doc_id, row_idx order by d, a) as d2 from scored)"""


def _with_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    per = lines.groupBy("doc_id").agg(F.array_distinct(F.array_append(F.collect_set("batch_true"), F.max(F.reverse("batch_true")))).alias("allowed"))
    return lines.join(per.withColumn("entries", matching.spelled(F.col("allowed"))), "doc_id")


@query(ALLOWED + "select doc_id, row_idx, case when (d2 is null or d < d2) and d <= greatest(1, cast(floor(length(k) * 0.25) as int)) then a else '' end as batch from ranked where n = 1", "inv_line")
def batch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_allowed(spark, sf_dir).select("doc_id", "row_idx", matching.reconciled_batch(F.col("batch_text"), F.col("allowed"), F.col("entries")).alias("batch"))


@query(
    ALLOWED
    + """, chosen as (select *, case when (d2 is null or d < d2) and d <= greatest(1, cast(floor(length(k) * 0.15) as int)) then a end as c from ranked where n = 1)
    select doc_id, row_idx, coalesce(c, batch_text) as batch,
    coalesce(array_to_string(list_filter(range(0, length(k)), lambda i: c is not null and length(k) = length(c) and substr(k, cast(i as int) + 1, 1) <> substr(upper(c), cast(i as int) + 1, 1)), ','), '') as places from chosen""",
    "inv_line",
)
def batch_match_pkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, places = matching.reconciled_label_batch(F.col("batch_text"), F.col("allowed"), F.col("entries"))
    return _with_allowed(spark, sf_dir).select("doc_id", "row_idx", batch.alias("batch"), F.array_join(places.cast("array<string>"), ",").alias("places"))


@query(
    """with p as (select doc_id, row_idx, upper(batch_true) as a, upper(batch_text) as b from inv_line)
    select doc_id, row_idx, array_to_string(list_filter(range(0, length(a)), lambda i: length(a) = length(b) and
    list_contains(['O0','0O','I1','1I','17','71','B8','8B','S5','5S','E5','5E','Z2','2Z','G6','6G'], substr(a, cast(i as int) + 1, 1) || substr(b, cast(i as int) + 1, 1))), ',') as places from p""",
    "inv_line",
)
def confusion_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "row_idx", F.array_join(T.confusable(F.col("batch_true"), F.col("batch_text")).cast("array<string>"), ",").alias("places"))


def _year_sql(f: str, low: int, high: int) -> str:
    return f"""{f}_c as (select *, list_sort(list_transform(range(anchor + ({low}), anchor + {high + 1}), lambda y: {{'d': list_sum(list_transform(range(1, 5), lambda k: cast(substr(cast(y as varchar), cast(k as int), 1) <> substr({f}, cast(k as int), 1) as int))), 'y': y}})) as {f}_s,
    regexp_full_match({f}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and coalesce(try_cast(substr({f}, 1, 4) as int) not between anchor + ({low}) and anchor + {high}, true) as {f}_off from %s),
    {f}_d as (select *, case when {f}_off then case when {f}_s[1].d <= 2 and {f}_s[1].d < {f}_s[2].d then 'context_year' else 'implausible_year' end end as {f}_w from {f}_c),
    {f}_e as (select *, case when {f}_w = 'context_year' then cast({f}_s[1].y as varchar) || substr({f}, 5, 6) else {f} end as {f}_1 from {f}_d)"""


def _final(f: str) -> str:
    bad = f"({f}_1 <> '' and (not {_date_ok(f + '_1')} or (not swapped and coalesce({f}_w = 'implausible_year', false))))"
    return f"case when {bad} then '' else {f}_1 end as {f}, case when {bad} then 'manual_required' when swapped then 'date_order' else {f}_w end as {f}_reason"


@query(
    f"""with base as (select doc_id, row_idx, {_regroup('exp_text')} as exp, {_regroup('mfg_text')} as mfg, cast(substr(mfg_true, 1, 4) as int) as anchor from inv_line),
    {_year_sql('mfg', -3, 1) % 'base'}, {_year_sql('exp', 0, 6) % 'mfg_e'},
    o as (select *, ({_date_ok('exp_1')} and {_date_ok('mfg_1')} and exp_1 <> '' and mfg_1 <> '' and exp_1 < mfg_1) as swapped from exp_e)
    select doc_id, row_idx, {_final('exp')}, {_final('mfg')} from o""",
    "inv_line",
)
def context_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _lines(spark, sf_dir).select("doc_id", "row_idx", T.regroup_date(F.col("exp_text")).alias("exp"), T.regroup_date(F.col("mfg_text")).alias("mfg"), F.substring("mfg_true", 1, 4).cast("int").alias("anchor"))
    return reconcile.context_dates(base).select("doc_id", "row_idx", "exp", "exp_reason", "mfg", "mfg_reason")


@query(
    """select doc_id, row_idx, case when h % 4 in (0, 1, 2) then case when h % 4 = 1 then null else case when mfg_true < exp_true then mfg_true end end end as manufacture_at,
    case when h % 4 in (0, 1, 2) then exp_true end as expire_at, batch_true as batch from package_label join inv_line using (doc_id, row_idx, h)""",
    "package_label",
)
def package_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixture(spark, sf_dir, "package_label")
    return texts.select("doc_id", "row_idx", labels.parsed(F.col("raw_text")).alias("p")).select("doc_id", "row_idx", "p.*")


@query(
    "select doc_id, seq, case when xc >= 90 and xc < 175 then 'pallet' when xc < 235 then 'box' when xc < 390 then 'sku' when xc < 725 then 'name' when xc < 785 then 'qty' when xc < 905 then 'exp' when xc < 1025 then 'mfg' when xc < 1185 then 'batch' end as field, score from fragment where xc >= 90",
    "fragment",
)
def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixture(spark, sf_dir, "fragment")
    return items.select("doc_id", "seq", matching.column_of(F.col("xc")).alias("field"), "score").where("field is not null")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and a total marker 20 px below each document's last row."""
    items = fixture(spark, sf_dir, "fragment").select("doc_id", "seq", "xc", "yc", "text")
    last = items.groupBy("doc_id").agg((F.max("seq") + 1).alias("seq"), F.lit(100e0).alias("xc"), (F.max("yc") + 20).alias("yc"), F.lit("TOTAL").alias("text"))
    return items.unionByName(last)


@query(
    f"""with m as (select doc_id, max(yc) + 20 as my from fragment group by doc_id),
    c as (select f.doc_id, abs(yc - my) as d, seq, try_cast({_digits('text')} as bigint) as q from fragment f join m using (doc_id) where xc >= 725 and xc < 785 and abs(yc - my) <= 32 and {_digits('text')} <> '')
    select doc_id, arg_min(q, row(d, seq)) as total from c group by doc_id""",
    "fragment",
)
def document_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.document_total(_totals(spark, sf_dir))


@query(
    """with h as (select doc_id, row_idx as seq, case row_idx % 3 when 0 then 'PO ' || lpad(cast(doc_id as varchar), 6, '0') when 1 then 'Inbound date ' || mfg_true else 'page ' || row_idx || ' of 12' end as t, mfg_true from inv_line)
    select doc_id, coalesce(arg_max('PO' || lpad(cast(doc_id as varchar), 6, '0'), seq) filter (seq % 3 = 0), '') as po_no,
    coalesce(arg_max(substr(mfg_true, 1, 4), seq) filter (seq % 3 = 1), '') as inbound_date, arg_max(cast(seq as int), seq) filter (seq % 3 = 2) as page_number from h group by doc_id""",
    "inv_line",
)
def header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("case row_idx % 3 when 0 then 'PO ' || lpad(cast(doc_id as string), 6, '0') when 1 then 'Inbound date ' || mfg_true else 'page ' || row_idx || ' of 12' end")
    items = _lines(spark, sf_dir).select("doc_id", "row_idx", text.alias("t"))
    last = lambda p: F.max_by(F.when(F.col("t").rlike(p), F.regexp_extract("t", p, 1)), F.when(F.col("t").rlike(p), F.col("row_idx")))
    po, day, page = last(r"(?i)PO\s*(\d{5,})"), last(r"(?i)INBOUND\s*DATE\s*([\d/]+)"), last(r"(?i)PAGE\s*(\d+)\s*OF\s*(\d+)")
    return items.groupBy("doc_id").agg(F.coalesce(F.concat(F.lit("PO"), po), F.lit("")).alias("po_no"), F.coalesce(day, F.lit("")).alias("inbound_date"), page.cast("int").alias("page_number"))


CLUSTER = "select doc_id, seq, cast(row_idx - min(row_idx) over (partition by doc_id) as int) as row from fragment"


@query(CLUSTER, "fragment")
def row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.clustered(fixture(spark, sf_dir, "fragment"))


@query(
    """with s as (select distinct doc_id, row_idx as slot, 172e0 + 33 * row_idx as center from inv_line),
    j as (select f.doc_id, seq, slot, abs(yc - center) as gap from fragment f join s using (doc_id) where abs(yc - center) <= 24.75e0)
    select doc_id, seq, slot, gap from (select *, row_number() over (partition by doc_id, seq order by gap, slot) as k from j) where k = 1""",
    "fragment",
)
def row_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _lines(spark, sf_dir).select("doc_id", F.col("row_idx").alias("slot"), (F.lit(172e0) + F.lit(33) * F.col("row_idx")).alias("center"))
    return matching.nearest_slot(fixture(spark, sf_dir, "fragment"), slots, F.lit(0.75 * 33))


@query(
    """with c as (select doc_id, row_idx, avg(yc) as center from fragment group by all),
    w as (select *, lag(center) over (partition by doc_id order by row_idx) as b, lead(center) over (partition by doc_id order by row_idx) as a from c)
    select doc_id, row_idx, case when b is not null then (b + center) / 2 when a is null then 155e0 else greatest(155e0, center - (a - center) / 2) end as top,
    case when a is not null then (a + center) / 2 when b is null then 1100e0 else least(1100e0, center + (center - b) / 2) end as bottom from w""",
    "fragment",
)
def row_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = fixture(spark, sf_dir, "fragment").groupBy("doc_id", "row_idx").agg(F.avg("yc").alias("center"))
    return matching.row_lines(centers, 155e0, 1100e0)


@query(
    """with p as (select distinct l_suppkey as k, cast(l_orderkey as bigint) as x from lineitem), g as (select k, x, x - row_number() over (partition by k order by x) as r from p)
    select k, min(x) as first, max(x) as last, (min(x) + max(x)) / 2e0 as middle from g group by k, r""",
)
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixture(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").cast("long").alias("x"))
    return rows.islands(points, "k", "x")


@query(
    """with s as (select doc_id, list_sort(list(yc)) as v from fragment group by doc_id),
    base as (select * from s)
    select doc_id, yc from (
      with recursive f(doc_id, yc, v) as (
        select doc_id, v[1], v from base
        union all
        select doc_id, list_filter(v, lambda x: x >= yc + 45)[1], list_filter(v, lambda x: x >= yc + 45) from f where len(list_filter(v, lambda x: x >= yc + 45)) > 0)
      select doc_id, yc from f)""",
    "fragment",
)
def thin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.thinned(fixture(spark, sf_dir, "fragment"), "doc_id", "yc", 45)


@query("select doc_id, cast(row_idx - min(row_idx) over (partition by doc_id) as int) as row, field, trim(text, '') as text, round_even(score, 3) as conf from fragment", "fragment")
def cell_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixture(spark, sf_dir, "fragment").drop("field").withColumn("field", matching.column_of(F.col("xc")))
    return rows.cells(rows.grouped(items, "field", "x1", "text", "score").select("doc_id", "row", F.inline("items")))


@query("select doc_id, row_idx, count(*) filter (field in ('sku', 'qty', 'exp', 'mfg', 'batch')) as n, sum(score) filter (field in ('sku', 'qty', 'exp', 'mfg', 'batch')) as total, min(score) as least from fragment group by doc_id, row_idx", "fragment")
def row_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = F.col("field").isin("sku", "qty", "exp", "mfg", "batch")
    return fixture(spark, sf_dir, "fragment").groupBy("doc_id", "row_idx").agg(F.count_if(counted).alias("n"), F.sum(F.when(counted, F.col("score"))).alias("total"), F.min("score").alias("least"))


def _qty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pages.settled(fixture(spark, sf_dir, "reading").withColumn("text", T.normalized("qty", F.col("text")))).where(T.is_valid("qty", F.col("text")))
    box = _lines(spark, sf_dir).select("doc_id", "row_idx", T.normalized("box", F.col("box_text")).alias("box"))
    return r.join(box, ["doc_id", "row_idx"])


READ = f"""with r as (select x.doc_id, x.row_idx, pos, source, {_digits(_clean('x.text'))} as text, score, {_digits(_clean('box_text'))} as box from reading x join inv_line using (doc_id, row_idx)
  where regexp_full_match({_digits(_clean('x.text'))}, '[1-9]\\d*')),
g as (select doc_id, row_idx, text, any_value(box) as box, count(*) as n, max(score) as best, max(cast(source = 'page' as int)) as page, min(pos) as pos from r group by doc_id, row_idx, text)"""


# What closes the gap to the total, from v (doc_id, row_idx, qty, options, disputed, value, gap): f (doc_id, row_idx, new, kind).
TOTALS = """alt as (select doc_id, row_idx, gap, value, list_distinct(list_append(options, value)) as choices, row_number() over (partition by doc_id order by row_idx) as k from v where gap <> 0 and disputed and len(list_distinct(list_append(options, value))) > 1),
    alts as (select * from alt),
    ways as (select * from (with recursive c(doc_id, gap, k, done, changes) as (
        select distinct doc_id, gap, cast(0 as bigint), cast(0 as hugeint), cast([] as struct(row_idx int, new bigint)[]) from alts
        union all
        select c.doc_id, c.gap, c.k + 1, c.done + u.new - u.value, case when u.new = u.value then changes else list_append(changes, {'row_idx': u.row_idx, 'new': u.new}) end
        from c join (select doc_id, row_idx, value, k, unnest(choices) as new from alts) u on u.doc_id = c.doc_id and u.k = c.k + 1)
      select doc_id, changes from c where done = gap and k = (select max(k) from alts a where a.doc_id = c.doc_id))),
    one as (select doc_id, any_value(changes) as changes from ways group by doc_id having count(*) = 1),
    picked as (select doc_id, u.row_idx, cast(u.new as varchar) as new, 'invoice_total_candidates' as kind from (select doc_id, unnest(changes) as u from one)),
    digit as (select doc_id, row_idx, cast(value + gap as varchar) as new from v where gap <> 0 and disputed and value + gap > 0 and length(cast(value + gap as varchar)) = length(qty)
      and list_sum(list_transform(range(1, length(qty) + 1), lambda i: cast(substr(qty, cast(i as int), 1) <> substr(cast(value + gap as varchar), cast(i as int), 1) as int))) = 1 and doc_id not in (select doc_id from one)),
    digits as (select doc_id, any_value(row_idx) as row_idx, any_value(new) as new, 'invoice_total_single_digit' as kind from digit group by doc_id having count(*) = 1),
    tick as (select doc_id, row_idx, left(qty, length(qty) - 1) as new from v where gap < 0 and length(qty) > 1 and right(qty, 1) = '1' and value - cast(left(qty, length(qty) - 1) as bigint) = -gap
      and doc_id not in (select doc_id from one union all select doc_id from digits)),
    ticks as (select doc_id, any_value(row_idx) as row_idx, any_value(new) as new, 'invoice_total_check' as kind from tick group by doc_id having count(*) = 1),
    f as (select * from picked union all select * from digits union all select * from ticks)"""


@query(
    READ
    + """, o as (select doc_id, row_idx, arg_max({'t': text, 'b': best, 'n': n}, row(n, best, -pos)) as w, arg_max({'t': text, 'b': best, 'n': n}, n) filter (text = box) as x, count(*) as texts, max(best) as top,
    count(distinct length(text)) as sizes, max(length(text)) as size, count(distinct substr(text, 2)) as ends, min(substr(text, 2)) as e from g group by doc_id, row_idx),
    f as (select *, texts > 1 and sizes = 1 and size >= 3 and ends = 1 and top < 0.85e0 as common, x is not null and x.n = w.n and x.b >= w.b - 0.05e0 - 1e-9 as boxed from o)
    select doc_id, row_idx, case when common then e when boxed then x.t else w.t end as text, case when common then top when boxed then x.b else w.b end as score, texts > 1 as ambiguous from f""",
    "reading",
)
def qty_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.quantity(_qty_readings(spark, sf_dir))


@query(READ + "select doc_id, row_idx, arg_max(text, row(n, page, best, -pos)) as text, arg_max(best, row(n, page, best, -pos)) as score, count(*) > 1 as ambiguous from g group by doc_id, row_idx", "reading")
def structured_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.structured(_qty_readings(spark, sf_dir))


@query(
    READ
    + """, o as (select doc_id, row_idx, arg_max(text, row(n, page, best, -pos)) as t, arg_max(best, row(n, page, best, -pos)) as b, list_reverse_sort(list(n)) as ns from g group by doc_id, row_idx),
    c as (select doc_id, row_idx, text as pt, score as ps from r where source = 'page'),
    k as (select *, pt is not null and length(t) < length(pt) as keep from o left join c using (doc_id, row_idx))
    select doc_id, row_idx, case when keep then pt else t end as text, case when keep then ps else b end as score, keep or (len(ns) > 1 and ns[1] = ns[2]) as ambiguous from k""",
    "reading",
)
def sku_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _qty_readings(spark, sf_dir)
    return votes.sku(r, r.where("source = 'page'").select("doc_id", "row_idx", F.col("text").alias("page_text"), F.col("score").alias("page_score")))


@query(READ + ", c as (select doc_id, row_idx, count(*) as n from g group by doc_id, row_idx) select doc_id, bool_or(n > 1) as fallback, cast(count(*) filter (n > 1) as bigint) as cells from c group by doc_id", "reading")
def fallback_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes.structured(_qty_readings(spark, sf_dir))
    return v.groupBy("doc_id").agg(F.bool_or("ambiguous").alias("fallback"), F.count_if(F.col("ambiguous")).alias("cells"))


@query(
    READ
    + """, o as (select doc_id, row_idx, arg_max({'t': text, 'b': best, 'n': n}, row(n, best, -pos)) as w, arg_max({'t': text, 'b': best, 'n': n}, n) filter (text = box) as x, count(*) as texts, max(best) as top,
    count(distinct length(text)) as sizes, max(length(text)) as size, count(distinct substr(text, 2)) as ends, min(substr(text, 2)) as e, list_sort(list(cast(text as bigint))) as options from g group by doc_id, row_idx),
    l as (select doc_id, cast(row_idx as int) as row_idx, texts > 1 as disputed, options, case when texts > 1 and sizes = 1 and size >= 3 and ends = 1 and top < 0.85e0 then e when x is not null and x.n = w.n and x.b >= w.b - 0.05e0 - 1e-9 then x.t else w.t end as qty from o),
    t as (select doc_id, cast(sum(qty_true) as bigint) as total from inv_line group by doc_id),
    v as (select l.*, cast(qty as bigint) as value, total - sum(cast(qty as bigint)) over (partition by doc_id) as gap from l join t using (doc_id)),
    """
    + TOTALS
    + """
    select doc_id, row_idx, coalesce(f.new, qty) as qty, case when f.new is not null then qty end as raw_qty, f.kind as correction from v left join f using (doc_id, row_idx)""",
    "reading",
)
def qty_total_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array_sort(F.collect_list(F.col("text").try_cast("long"))).alias("options")
    read = votes.quantity(_qty_readings(spark, sf_dir), texts)
    chosen = read.select("doc_id", F.col("row_idx").cast("int").alias("row_idx"), F.col("text").alias("qty"), F.when(F.col("ambiguous"), F.col("options")).alias("options"))
    total = _lines(spark, sf_dir).groupBy("doc_id").agg(F.sum("qty_true").alias("total"))
    return reconcile.against_total(chosen.join(total, "doc_id"))


ISSUES = (
    SKU
    + f""", v as (select sku, {_digits('qty_text')} as qty, {_regroup('exp_text')} as exp from sku_clean),
u as (select 'sku' as field, case when sku = '' then 'missing' when not regexp_full_match(sku, '\\d{{8,}}') then 'invalid' end as issue from v
  union all select 'qty', case when qty = '' then 'missing' when not regexp_full_match(qty, '[1-9]\\d*') then 'invalid' end from v
  union all select 'exp', case when exp = '' then 'missing' when not {_date_ok('exp')} then 'invalid' end from v)
select field, issue, count(*) as n from u where issue is not null group by field, issue"""
)


@query(ISSUES, "inv_line")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lines(spark, sf_dir).select(T.clean_sku(F.col("sku_text")).alias("sku"), T.clean_digits(F.col("qty_text")).alias("qty"), T.regroup_date(F.col("exp_text")).alias("exp"))
    u = v.unpivot([], ["sku", "qty", "exp"], "field", "value")
    good = F.when(F.col("field") == "sku", F.col("value").rlike(r"^\d{8,}$")).when(F.col("field") == "qty", F.col("value").rlike(r"^[1-9]\d*$")).otherwise(T.is_date(F.col("value")))
    issue = F.when(F.col("value") == "", "missing").when(~good, "invalid")
    return u.select("field", issue.alias("issue")).where("issue is not null").groupBy("field", "issue").agg(F.count("*").alias("n"))


@query(
    SKU
    + f""", v as (select doc_id, row_idx, sku, {_digits('qty_text')} as qty, {_regroup('exp_text')} as exp from sku_clean)
    select doc_id, row_idx + 1 as line, sku, case when regexp_full_match(qty, '[1-9]\\d*') and length(qty) <= 15 then try_cast(qty as bigint) end as qty, qty as qty_text,
    try_cast(case when {_date_ok('exp')} and exp <> '' then exp end as date) as exp, substr(regexp_replace('PO' || doc_id, '[^A-Za-z0-9_-]', '', 'g'), 1, 32) as file_name from v""",
    "inv_line",
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lines(spark, sf_dir).select("doc_id", "row_idx", T.clean_sku(F.col("sku_text")).alias("sku"), T.clean_digits(F.col("qty_text")).alias("qty_text"), T.regroup_date(F.col("exp_text")).alias("e"))
    number = F.when(F.col("qty_text").rlike(r"^[1-9]\d{0,14}$"), F.expr("try_cast(qty_text as bigint)"))
    name = F.substring(F.regexp_replace(F.concat(F.lit("PO"), F.col("doc_id").cast("string")), "[^A-Za-z0-9_-]", ""), 1, 32)
    return v.select("doc_id", (F.col("row_idx") + 1).alias("line"), "sku", number.alias("qty"), "qty_text", F.when(T.is_date(F.col("e")), F.try_to_date("e", "yyyy-MM-dd")).alias("exp"), name.alias("file_name"))


@query("select session, seq, cast(sum(cnt) over (partition by session order by seq) as bigint) as total from shot where op = 'append'", "shot")
def shot_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.running_total(fixture(spark, sf_dir, "shot"))


@query(
    """with s as (select session, list({'op': op, 'c': cast(cnt as bigint)} order by seq) as ops from shot group by session),
    recursive_base as (select session, ops from s)
    select session, total, shots from (
      with recursive f(session, ops, i, log) as (
        select session, ops, 1, cast([] as bigint[]) from recursive_base
        union all
        select session, ops, i + 1, case ops[i].op when 'append' then list_append(log, ops[i].c) when 'reset' then cast([] as bigint[])
          else case when len(log) = 0 then log when ops[i].op = 'undo' then log[:-2] when ops[i].op = 'plus' then list_append(log[:-2], log[-1] + 1) else list_append(log[:-2], greatest(log[-1] - 1, 0)) end end
        from f where i <= len(ops))
      select session, cast(coalesce(list_sum(log), 0) as bigint) as total, cast(len(log) as bigint) as shots from f where i = len(ops) + 1)""",
    "shot",
)
def shot_undo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.folded(fixture(spark, sf_dir, "shot"))


@query(
    f"""with a as (select doc_id, row_idx, qty_true, try_cast({_digits('qty_text')} as int) as q from inv_line)
    select doc_id, count(*) as n_rows, cast(count(*) filter (q = qty_true) as bigint) as n_right, cast(count(*) filter (q is null) as bigint) as n_missing from a group by doc_id""",
    "inv_line",
)
def accuracy_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    actual = lines.select("doc_id", "row_idx", T.clean_digits(F.col("qty_text")).alias("t")).withColumn("q", F.expr("try_cast(t as int)")).where("q is not null")
    j = lines.select("doc_id", "row_idx", "qty_true").join(actual, ["doc_id", "row_idx"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("q") == F.col("qty_true")).alias("n_right"), F.count_if(F.col("q").isNull()).alias("n_missing"))


@query("select f as field, c as ch, count(*) as n from (select 'batch' as f, unnest(string_split(batch_text, '')) as c from inv_line union all select 'qty', unnest(string_split(qty_text, '')) from inv_line) where c <> '' group by f, c", "inv_line")
def char_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _lines(spark, sf_dir).select(F.col("batch_text").alias("batch"), F.col("qty_text").alias("qty")).unpivot([], ["batch", "qty"], "field", "t")
    return u.select("field", F.explode(F.split("t", "")).alias("ch")).where("ch <> ''").groupBy("field", "ch").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(p_name, 'system_lookup_required') as name from lineitem left join part on p_partkey = l_partkey")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixture(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = fixture(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(part, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_name", F.lit("system_lookup_required")).alias("name"))


@query(
    """with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from documents),
    d as (select doc_id, line, min(pos) as pos from l where line <> '' group by doc_id, line)
    select doc_id, count(*) as n_lines, md5(string_agg(line, chr(10) order by pos)) as merged from d group by doc_id""",
)
def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir, "documents")
    merged = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return docs.select("doc_id", merged.alias("m")).where(F.size("m") > 0).select("doc_id", F.size("m").cast("long").alias("n_lines"), F.md5(F.array_join("m", "\n")).alias("merged"))


@query(
    """with c as (select event_id, cast(user_id % 300 + 10 as double) as w, cast(event_id % 260 + 8 as double) as h, event_id * 7 % 100 / 1e2 as rect from events)
    select event_id, w / h as aspect from c where w >= 28 and h >= 20 and w / h between 0.55e0 and 4.2e0 and rect >= 0.7e0 and w * h between 0.002e0 * 640000 and 0.45e0 * 640000""",
)
def label_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture(spark, sf_dir, "events").selectExpr("event_id", "cast(user_id % 300 + 10 as double) as w", "cast(event_id % 260 + 8 as double) as h", "event_id * 7 % 100 / 1e2 as rect")
    return c.where("w >= 28 and h >= 20 and w / h between 0.55e0 and 4.2e0 and rect >= 0.7e0 and w * h between 0.002e0 * 640000 and 0.45e0 * 640000").selectExpr("event_id", "w / h as aspect")


# Both engines run these: a text of one of five kinds for each line.
MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(substr(mfg_true, 6, 2) as int) - 2, 3)"
DMY = "substr(mfg_true, 9, 2) || '{0}' || substr(mfg_true, 6, 2) || '{0}' || substr(mfg_true, 1, 4)"
DATED = f"""case row_idx % 5 when 0 then 'EXP ' || {DMY.format('/')} when 1 then 'x 1' || chr(10) || 'MFG:' || mfg_true || ' kg'
  when 2 then 'LOT ' || replace(mfg_true, '-', '') || ' BBE ' || {MON} || ' ' || substr(mfg_true, 9, 2) || ', ' || substr(mfg_true, 1, 4)
  when 3 then 'ABC' || replace(mfg_true, '-', '') || 'X' else 'EXP' || {DMY.format('')} end"""
DATES = f"""with t as (select doc_id, row_idx, row_idx % 5 as k, mfg_true as d, {DATED} as text, {MON} || ' ' || substr(mfg_true, 9, 2) || ', ' || substr(mfg_true, 1, 4) as named,
  {DMY.format('/')} as slashed, {DMY.format('')} as solid, substr(mfg_true, 9, 2) as dd, substr(mfg_true, 6, 2) as mm from inv_line),
u as (select *, k in (0, 4) and dd <= '12' and dd <> mm as two from t)"""


@query(
    DATES
    + """select doc_id, row_idx, case k when 0 then slashed when 1 then d when 2 then named else solid end as raw, case when two then '' else d end as value,
    case when two then d || ',' || substr(d, 1, 5) || dd || '-' || mm else d end as candidates, case when two then 'ambiguous' else 'valid' end as status,
    case when k = 1 then 'manufacture_at' else 'expire_at' end as field, cast(k = 1 as int) as line from u where k <> 3""",
    "inv_line",
)
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).selectExpr("doc_id", "row_idx", f"{DATED} as text").select("doc_id", "row_idx", F.inline(dates.scanned(F.col("text"))["dates"]))
    return found.withColumn("candidates", F.array_join("candidates", ","))


@query(DATES + "select doc_id, row_idx, case when k = 2 then replace(text, named, d) when k in (0, 4) and not two then replace(replace(text, slashed, d), solid, d) else text end as text from u", "inv_line")
def plain_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _lines(spark, sf_dir).selectExpr("doc_id", "row_idx", f"{DATED} as text")
    return texts.select("doc_id", "row_idx", dates.scanned(F.col("text"))["normalized"].alias("text"))


@query(
    """with l as (select doc_id, row_idx, trim(string_agg(text, ' ' order by x1, text)) as t from fragment where yc > 220 group by doc_id, row_idx)
    select doc_id, coalesce(string_agg(t, ' | ' order by row_idx) filter (t <> ''), '') as notes from l group by doc_id""",
    "fragment",
)
def notes_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.notes(fixture(spark, sf_dir, "fragment"), 220)


SECOND = """select doc_id, row_idx, h, qty_true, case when h % 2 = 0 then box_text else '7' end as box, cast(qty_true as string) as qty, (512 + (doc_id * 13 + row_idx * 7) % 512) / 1024e0 as qty_score,
  case when h <> 3 then (512 + (doc_id * 5 + row_idx * 3) % 512) / 1024e0 end as box_score, (doc_id * 3 + row_idx) % 100 / 1e2 as score, case when h in (4, 5) then 'model_disagreement' end as review,
  case when h in (5, 6, 7) then 'ambiguous' end as issue, doc_id % 2 = 0 as agrees, case when h % 3 = 0 then '' else pallet_text end as pallet, pallet_text as pallet2 from {0}"""


@query(
    f"""with s as ({SECOND.format('inv_line').replace('as string', 'as varchar')})
    select doc_id, row_idx, coalesce(pallet = '' and score >= 0.8e0, false) as pallet_taken,
    coalesce(qty <> box and score >= 0.4e0 and box_score < 0.8e0 and qty_score >= 0.85e0 and ((review is null and issue is null) or (review is not null and issue is not null and agrees and qty_score >= 0.95e0)), false) as box_taken from s""",
    "inv_line",
)
def second_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(SECOND.format("{lines}"), lines=_lines(spark, sf_dir))
    c = F.col
    box = votes.takes_box(c("box"), T.normalized("box", c("qty")), c("score"), c("box_score"), c("qty"), c("qty_score"), c("review"), c("issue"), c("agrees"))
    return s.select("doc_id", "row_idx", votes.takes_pallet(c("pallet"), T.normalized("pallet", c("pallet2")), c("score")).alias("pallet_taken"), box.alias("box_taken"))


CONFIDENCE = "(928 + (doc_id * 13 + row_idx * 7) % 96) / 1024e0"


@query(
    f"""with s as (select doc_id, row_idx, case h when 9 then 0 when 13 then 2 else 1 end as n, case h when 17 then ' ' when 18 then 'no digits' else batch_text end as t, case when h <> 19 then {CONFIDENCE} end as c from inv_line)
    select doc_id, row_idx, n = 1 and trim(t) <> '' and regexp_full_match(t, '[A-Za-z0-9-]+') and regexp_matches(t, '[0-9]') and coalesce(c >= 0.95e0, false) as accepted,
    case when n = 0 then 'no_text' when n = 2 then 'multiple_lines' when trim(t) = '' then 'no_text' when not regexp_full_match(t, '[A-Za-z0-9-]+') or not regexp_matches(t, '[0-9]') then 'invalid_identifier'
      when c is null then 'invalid_confidence' when c < 0.95e0 then 'low_confidence' end as reason, case when n = 1 and trim(t) <> '' then c end as confidence from s""",
    "inv_line",
)
def identifier_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"named_struct('text', case h when 17 then ' ' when 18 then 'no digits' else batch_text end, 'confidence', case when h <> 19 then {CONFIDENCE} end)"
    s = _lines(spark, sf_dir).selectExpr("doc_id", "row_idx", f"array_repeat({line}, case h when 9 then 0 when 13 then 2 else 1 end) as lines")
    return s.select("doc_id", "row_idx", T.line_decision(F.col("lines")).alias("d")).select("doc_id", "row_idx", "d.*")


HEADERS = """select doc_id, h.xc + 0e0 as xc, 138e0 as yc, h.text from {0} cross join (values (0, 'Batch', 1142), (0, 'Qty', 872), (1, 'Name', 628), (1, 'aty', 872), (2, 'MFG', 965), (2, 'EXP', 845)) h(k, text, xc) where row_idx = 0 and doc_id % 4 = h.k"""


@query(
    """with n as (select doc_id, length(regexp_replace(text, '\\D', '', 'g')) as n, field from fragment),
    s as (select doc_id, count(*) filter (field = 'qty' and n between 1 and 4) * 3 + count(*) filter (field = 'exp' and n in (6, 8)) - count(*) filter (field = 'batch' and n in (6, 8)) as lead from n group by doc_id)
    select doc_id, case when doc_id % 4 = 0 then 'with_batch' when doc_id % 4 <> 3 or lead <= -6 then 'without_batch' when lead >= 6 then 'with_batch' else 'fixed' end as layout from s""",
    "fragment",
)
def layout_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = spark.sql(HEADERS.format("{lines}"), lines=_lines(spark, sf_dir))
    items = fixture(spark, sf_dir, "fragment").select("doc_id", "xc", "yc", "text")
    return matching.layouts(items.unionByName(heads), 150)
