"""Queries over requests, free texts, sheets as files, training records and counting logs, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.fixtures import fixture
from docgrid.functions import text as T
from docgrid.operators import general, review
from docgrid.plans.page_queries import CASES
from docgrid.plans.queries import CONFIDENCE, DATED, DATES, _digits, _lines, query
from docgrid.streaming import sessions

# Lists of fields as requests send them, by row: JSON, texts with blanks, repeats, unknown names, JSON that is no list, nothing, and texts that only begin like JSON.
ASKED = """case row_idx % 12 when 0 then '["batch", "expire_at", "batch"]' when 1 then 'expire_at,manufacture_at' when 2 then ' batch ; expire_at ' when 3 then '["batch", "sku"]' when 4 then '"batch"' when 5 then '{"batch": 1}' when 6 then '   ' when 7 then '[]'
  when 8 then cast(doc_id as string) || ' ' || cast(row_idx as string) when 9 then '["batch"] ["expire_at"]' when 10 then 'true, batch' else cast(doc_id as string) end"""


@query(
    """with r as (select doc_id, row_idx, row_idx % 12 as k from inv_line)
    select doc_id, row_idx, case k when 0 then 'batch,expire_at' when 1 then 'expire_at,manufacture_at' when 2 then 'batch,expire_at' end as fields,
      case k when 3 then 'unsupported: sku' when 4 then 'not_a_list' when 5 then 'not_a_list' when 6 then 'required' when 7 then 'required' when 8 then 'unsupported: ' || doc_id when 9 then 'unsupported: ["batch"]' when 10 then 'unsupported: true' when 11 then 'not_a_list' end as problem from r""",
    "inv_line",
)
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _lines(spark, sf_dir).selectExpr("doc_id", "row_idx", f"{ASKED} as t").select("doc_id", "row_idx", review.required_list(F.col("t")).alias("r"))
    return asked.select("doc_id", "row_idx", F.array_join("r.fields", ",").alias("fields"), "r.problem")


# A line's reading of a batch, sure in some rows; the page's readings, of which the first is blank in some.
ONE = "case h when 17 then ' ' when 18 then 'no digits' else batch_text end"


@query(
    DATES
    + f""", i as (select doc_id, row_idx, row_idx % 4 <> 3 as asked, h = 9 or h = 13 as odd, case h when 9 then 'no_text' when 13 then 'multiple_lines' end as why, {ONE} as t, case when h <> 19 then {CONFIDENCE} end as c from inv_line),
    d as (select *, not odd and trim(t) <> '' and regexp_full_match(t, '[A-Za-z0-9-]+') and regexp_matches(t, '[0-9]') as shaped from i),
    e as (select *, asked and shaped and coalesce(c >= 0.95e0, false) as fast, case when not asked then null when odd then why when trim(t) = '' then 'no_text' when not shaped then 'invalid_identifier' when c is null then 'invalid_confidence' when c < 0.95e0 then 'low_confidence' end as reason from d)
    select doc_id, row_idx, case when fast then t else text end as raw_text, case when asked then fast end as fast, reason, case when fast or k = 3 then '' when two then 'ambiguous' else 'valid' end as status, case when fast or k = 3 or two then '' else d end as value from e join u using (doc_id, row_idx)""".replace("else d end as value", "else u.d end as value"),
    "inv_line",
)
def general_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts by mode: identifiers where the line is sure, else the page, read again where it shows nothing."""
    nothing = "array_repeat(named_struct('box', array(array(5e0, 0e0), array(90e0, 15e0)), 'text', '  ', 'confidence', 0.5e0), case when row_idx % 2 = 0 then 1 else 0 end)"
    page = "reverse(transform(split(text, '\\n'), (t, i) -> named_struct('box', array(array(5e0, i * 20e0), array(90e0, i * 20e0 + 15)), 'text', t, 'confidence', 0.9e0)))"
    line = f"named_struct('box', array(array(5e0, 0e0), array(90e0, 15e0)), 'text', {ONE}, 'confidence', case when h <> 19 then {CONFIDENCE} end)"
    texts = _lines(spark, sf_dir).selectExpr("*", f"{DATED} as text")
    read = texts.selectExpr("doc_id", "row_idx", f"array_repeat({line}, case h when 9 then 0 when 13 then 2 else 1 end) as line", f"case when row_idx % 7 = 6 then {nothing} else {page} end as primary", f"case when row_idx % 7 = 6 then {page} end as enhanced", "case when row_idx % 4 <> 3 then 'identifier' else 'paragraph' end as mode")
    g = read.select("doc_id", "row_idx", general.read_text(F.col("mode"), F.col("line"), F.col("primary"), F.col("enhanced")).alias("g"))
    first = F.get("g.dates", F.lit(0))
    return g.select("doc_id", "row_idx", "g.raw_text", "g.fast", "g.reason", F.coalesce(first["status"], F.lit("")).alias("status"), F.coalesce(first["value"], F.lit("")).alias("value"))


@query(
    f"""with v as (select doc_id, row_idx, {_digits('qty_text')} as q, sku_text, exp_text, h from inv_line), m as (select *, not (regexp_full_match(q, '[1-9]\\d*') and length(q) <= 15) as open, case when regexp_full_match(q, '[1-9]\\d*') and length(q) <= 15 then cast(q as bigint) end as n from v),
    t as (select doc_id, case when bool_or(open) then '待核实' else cast(cast(sum(n) as bigint) as varchar) end as s from m group by doc_id), p as (select doc_id, cast(sum(qty_true) as bigint) as total from inv_line group by doc_id)
    select doc_id, 'title' as section, cast(1 as bigint) as ordinal, '入库单核实明细' as cells from t union all select doc_id, 'order', 2, array_to_string(['PO 号', 'PO' || doc_id, '明细合计', s, '单据合计', case when doc_id % 4 = 0 then '' else cast(total as varchar) end], '|') from t join p using (doc_id)
    union all select doc_id, 'note', 3, '备注|' || case when doc_id % 3 = 0 then '' else 'two boxes open' end from t union all select doc_id, 'line', row_idx + 6, array_to_string([cast(row_idx + 1 as varchar), sku_text, q, exp_text], '|') from m""",
    "inv_line",
)
def sheet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sheet as rows: title, order with its sums, note and lines."""
    c = F.col
    lines = _lines(spark, sf_dir)
    total = lines.groupBy("doc_id").agg(F.sum("qty_true").alias("document_total"))
    v = lines.withColumn("q", T.clean_digits(c("qty_text"))).join(total, "doc_id")
    row = {"qty": c("q"), "exp": c("exp_text"), "mfg": c("mfg_text"), "batch": c("batch_text")}
    out = v.withColumns(review.typed(row, F.lit(None), F.lit(True), F.lit(True)))
    out = out.withColumns({"po_no": F.concat(F.lit("PO"), c("doc_id").cast("string")), "note": F.when(c("doc_id") % 3 != 0, "two boxes open"), "document_total": F.when(c("doc_id") % 4 != 0, c("document_total")), "values": F.array("sku_text", "q", "exp_text")})
    return review.sheet_sections(out).withColumn("cells", F.array_join("cells", "|"))


@query(
    f"""with a as (select doc_id, list(coalesce(try_cast({_digits('qty_text')} as bigint), 0) order by row_idx) as a from inv_line where row_idx <> 3 or doc_id % 2 = 0 group by doc_id),
    x as (select doc_id, list(cast(qty_true as bigint) order by row_idx) as e from inv_line group by doc_id),
    z as (select doc_id, a, e, len(list_filter(range(1, least(len(a), len(e)) + 1), lambda i: a[i] = e[i])) as r, abs(len(a) - len(e)) as off, cast(doc_id * 37 % 501 as double) as ms from a join x using (doc_id) where doc_id % 11 > 1)
    select 'model-' || doc_id % 5 as model, count(*) as cases, cast(sum(r) as bigint) as "right", cast(sum(len(e)) as bigint) as expected, sum(r) / sum(len(e)) as exact, cast(count(*) filter (off = 0) as bigint) as complete, median(ms) as median_ms from z group by all""",
    "inv_line",
)
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth cases against what was read, by model, with the exact median of their times."""
    lines = _lines(spark, sf_dir)
    ordered = "array_join(transform(array_sort(collect_list(struct(row_idx, qty_true))), x -> cast(x.qty_true as string)), ',')"
    case = spark.sql(CASES.format(list=ordered, source="{lines}"), lines=lines).select("doc_id", review.case_of(F.col("t")).alias("c")).where("c is not null")
    read = lines.where("row_idx <> 3 or doc_id % 2 = 0").select("doc_id", "row_idx", F.coalesce(T.clean_digits(F.col("qty_text")).try_cast("long"), F.lit(0)).alias("q"))
    actual = read.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "q"))), lambda x: x["q"]).alias("a"))
    done = case.join(actual, "doc_id").select("doc_id", review.compared(F.col("a"), F.col("c.expected")).alias("r"), F.size("c.expected").alias("n_expected"))
    done = done.select(F.concat(F.lit("model-"), (F.col("doc_id") % 5).cast("string")).alias("model"), "r.right", "r.missing_or_extra", "n_expected", (F.col("doc_id") * 37 % 501).cast("double").alias("elapsed_ms"))
    return review.accuracy(done, "model")


@query(
    """with s as (select session, list({'op': op, 'c': cast(cnt as bigint), 'q': seq} order by seq) as ops from shot group by session),
    f as (with recursive f(session, ops, i, log) as (
        select session, ops, 1, cast([] as bigint[]) from s
        union all
        select session, ops, i + 1, case ops[i].op when 'append' then list_append(log, ops[i].c) when 'reset' then cast([] as bigint[])
          else case when len(log) = 0 then log when ops[i].op = 'undo' then log[:-2] when ops[i].op = 'plus' then list_append(log[:-2], log[-1] + 1) else list_append(log[:-2], greatest(log[-1] - 1, 0)) end end
        from f where i <= len(ops)) select * from f)
    select session, ops[i - 1].q as seq, coalesce(log[-1], 0) as current, cast(coalesce(list_sum(log), 0) as bigint) as total from f where i > 1""",
    "shot",
)
def shot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current count and the total as shown after each operation."""
    return sessions.current_counts(fixture(spark, sf_dir, "shot"))
