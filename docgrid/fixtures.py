"""Receiving lines, fragments, readings, labels and counting sessions derived from the
test tables, in SQL that Spark and DuckDB both run; see FIXTURES.md."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {}
SQL["inv_line"] = """
with b as (
  select l_orderkey as doc_id, l_partkey as p,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as bigint) as row_idx,
         cast(l_quantity as int) as q, cast(l_shipdate as date) as d
  from lineitem),
c as (
  select doc_id, row_idx, q, d, p, (doc_id * 31 + row_idx * 17) % 20 as h,
         '893' || lpad(cast(p as string), 9, '0') as body
  from b),
s as (
  select *, 3 * (cast(substr(body, 2, 1) as int) + cast(substr(body, 4, 1) as int) + cast(substr(body, 6, 1) as int)
               + cast(substr(body, 8, 1) as int) + cast(substr(body, 10, 1) as int) + cast(substr(body, 12, 1) as int))
             + cast(substr(body, 1, 1) as int) + cast(substr(body, 3, 1) as int) + cast(substr(body, 5, 1) as int)
             + cast(substr(body, 7, 1) as int) + cast(substr(body, 9, 1) as int) + cast(substr(body, 11, 1) as int) as wsum
  from c),
e as (
  select doc_id, row_idx, h, q,
         body || cast((10 - wsum % 10) % 10 as string) as sku,
         cast(d as string) as mfg,
         cast(cast(d + interval '24' month as date) as string) as exp,
         upper(substr(md5(cast(p as string)), 1, 10)) as batch
  from s)
select doc_id, row_idx, h, q as qty_true, sku as sku_true, mfg as mfg_true, exp as exp_true, batch as batch_true,
  case h when 4 then sku || 'N' when 5 then '1' || sku when 6 then '|' || sku || '/' when 7 then 'B' || substr(sku, 2) else sku end as sku_text,
  case h when 0 then cast(q as string) || '1' when 1 then replace(cast(q as string), '0', 'O') when 2 then '' when 3 then ' ' || cast(q as string) || ' /' else cast(q as string) end as qty_text,
  case h when 13 then '' else cast(q as string) end as box_text,
  case h when 8 then '9' || substr(exp, 2) when 9 then '' when 10 then mfg when 14 then substr(exp, 1, 7) else exp end as exp_text,
  case h when 10 then exp when 15 then replace(mfg, '-', '.') else mfg end as mfg_text,
  case h when 11 then replace(batch, '1', 'I') when 12 then substr(batch, 1, 9) when 16 then substr(batch, 1, 5) || '-' || substr(batch, 6) else batch end as batch_text,
  cast(row_idx + 1 as string) || '/' || cast(row_idx + 3 as string) as pallet_text
from e
"""
SQL["fragment"] = """
select doc_id, row_idx, f.ord, f.field, (f.x1 + f.x2) / 2e0 as xc,
       172 + 33 * row_idx + ((doc_id * 7 + row_idx * 3 + f.ord * 5) % 9 - 4) * 0.5e0 as yc,
       (512 + (doc_id * 13 + row_idx * 7 + f.ord * 11) % 512) / 1024e0 as score,
       row_idx * 8 + f.ord as seq, f.x1 + 0e0 as x1,
       case f.field when 'pallet' then pallet_text when 'box' then box_text when 'sku' then sku_text when 'qty' then qty_text
         when 'exp' then exp_text when 'mfg' then mfg_text else batch_text end as text
from inv_line cross join (values
  (0,'pallet',90,175), (1,'box',175,235), (2,'sku',235,390), (4,'qty',725,785),
  (5,'exp',785,905), (6,'mfg',905,1025), (7,'batch',1025,1185)) f(ord, field, x1, x2)
"""
SQL["reading"] = """
select doc_id, row_idx, 'qty' as field, 0 as pos, 'page' as source, qty_text as text,
       (512 + (doc_id * 13 + row_idx * 7) % 512) / 1024e0 as score from inv_line
union all
select doc_id, row_idx, 'qty', 1, 'cell', cast(qty_true as string),
       (512 + (doc_id * 5 + row_idx * 3) % 512) / 1024e0 from inv_line
union all
select doc_id, row_idx, 'qty', 2, 'column',
       case when h in (0, 17) then qty_text else cast(qty_true as string) || '1' end,
       (512 + (doc_id * 3 + row_idx * 11) % 512) / 1024e0 from inv_line where h % 3 = 0
"""
SQL["package_label"] = """
select doc_id, row_idx, h,
 case h % 4 when 0 then 'MFG ' || dm || chr(10) || 'EXP ' || de || chr(10) || 'LOT ' || batch_true
            when 1 then de || chr(10) || batch_true
            when 2 then dm || ' ' || batch_true || chr(10) || de || ' 02:26'
            else 'EXP ' || dm || chr(10) || 'MFG ' || de || chr(10) || batch_true end as raw_text
from (select *, substr(mfg_true,9,2) || '/' || substr(mfg_true,6,2) || '/' || substr(mfg_true,1,4) as dm,
             substr(exp_true,9,2) || '/' || substr(exp_true,6,2) || '/' || substr(exp_true,1,4) as de
      from inv_line) w
"""
SQL["shot"] = """
select user_id as session, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as seq,
       case event_type when 'purchase' then 'append' when 'click' then 'append'
                       when 'view' then 'plus' when 'error' then 'minus' else 'undo' end as op,
       cast(floor(value) as bigint) % 10 as cnt
from events
"""
SQL["sheet"] = """
with n as (select doc_id, max(row_idx) + 1 as n, sum(qty_true) as total from inv_line group by doc_id),
cells as (
  select doc_id, row_idx as r, f.ord, f.x1, f.w, 172 + 33 * row_idx + ((doc_id * 7 + row_idx * 3 + f.ord * 5) % 9 - 4) * 0.5e0 as yc,
    (512 + (doc_id * 13 + row_idx * 7 + f.ord * 11) % 512) / 1024e0 as score,
    case f.ord when 0 then pallet_text when 1 then box_text when 2 then substr(sku_text, 1, 6) when 3 then substr(sku_text, 7) when 4 then 'Item' when 5 then 'no. ' || cast(row_idx as string)
      when 6 then qty_text when 7 then exp_text when 8 then mfg_text else batch_text end as text
  from inv_line cross join (values (0, 95, 60), (1, 180, 40), (2, 240, 60), (3, 310, 70), (4, 400, 80), (5, 500, 90), (6, 730, 40), (7, 790, 100), (8, 910, 100), (9, 1030, 100)) f(ord, x1, w)
  union all
  select doc_id, n + e.k, 20 + e.ord, e.x1, 40, 172 + 33 * (n + e.k) + e.dy, 0.75e0, case e.ord when 1 then cast(total as string) when 8 then 'PO' || lpad(cast(doc_id as string), 6, '0') || ' Total' else e.text end
  from n cross join (values (0, 400, 0, 0e0, 'TOTAL'), (1, 740, 0, 1e0, ''), (2, 240, 1, 0e0, 'SKU #'), (3, 400, 1, 2e0, 'Name'), (4, 740, 1, 0e0, '5'), (5, 400, 2, 0e0, 'only a name'),
    (6, 240, 30, 0e0, 'checked by'), (7, 300, 30, 3e0, 'K.'), (8, 240, 32, 0e0, ''), (9, 240, 34, 0e0, 'two boxes open')) e(ord, x1, k, dy, text)
  union all
  select doc_id, -1, 40 + e.ord, e.x1, 90, e.yc, 0.875e0, case e.ord when 0 then 'PO ' || lpad(cast(doc_id as string), 6, '0') when 1 then 'Inbound date 2026/01/0' || cast(doc_id % 9 + 1 as string) when 2 then 'Page 1 of 2' else 'page ' || cast(doc_id % 3 + 1 as string) || ' OF 3' end
  from n cross join (values (0, 100, 20e0), (1, 400, 22e0), (2, 700, 24e0), (3, 900, 40e0)) e(ord, x1, yc))
select doc_id, (r + 1) * 64 + ord as seq, x1 + 0e0 as x1, x1 + w + 0e0 as x2, yc - 8 as y1, yc + 8 as y2, text, score from cells where trim(text) <> ''
"""
# The sheet in one pass over the lines, as Spark reads it: what stands once on a sheet is made beside its first line.
ONE_PASS = {"sheet": """
with l as (select *, max(row_idx) over (partition by doc_id) + 1 as n, sum(qty_true) over (partition by doc_id) as total from inv_line),
cells as (
  select doc_id, f.ord, f.x1, f.w, case f.part when 'line' then row_idx when 'end' then n + f.k else -1 end as r,
    case f.part when 'line' then 172 + 33 * row_idx + ((doc_id * 7 + row_idx * 3 + f.ord * 5) % 9 - 4) * 0.5e0 when 'end' then 172 + 33 * (n + f.k) + f.dy else f.dy end as yc,
    case f.part when 'line' then (512 + (doc_id * 13 + row_idx * 7 + f.ord * 11) % 512) / 1024e0 when 'end' then 0.75e0 else 0.875e0 end as score,
    case f.ord when 0 then pallet_text when 1 then box_text when 2 then substr(sku_text, 1, 6) when 3 then substr(sku_text, 7) when 5 then 'no. ' || cast(row_idx as string)
      when 6 then qty_text when 7 then exp_text when 8 then mfg_text when 9 then batch_text when 21 then cast(total as string) when 28 then 'PO' || lpad(cast(doc_id as string), 6, '0') || ' Total'
      when 40 then 'PO ' || lpad(cast(doc_id as string), 6, '0') when 41 then 'Inbound date 2026/01/0' || cast(doc_id % 9 + 1 as string) when 43 then 'page ' || cast(doc_id % 3 + 1 as string) || ' OF 3' else f.text end as text
  from l join (values ('line', 0, 95, 60, 0, 0e0, ''), ('line', 1, 180, 40, 0, 0e0, ''), ('line', 2, 240, 60, 0, 0e0, ''), ('line', 3, 310, 70, 0, 0e0, ''), ('line', 4, 400, 80, 0, 0e0, 'Item'), ('line', 5, 500, 90, 0, 0e0, ''),
    ('line', 6, 730, 40, 0, 0e0, ''), ('line', 7, 790, 100, 0, 0e0, ''), ('line', 8, 910, 100, 0, 0e0, ''), ('line', 9, 1030, 100, 0, 0e0, ''),
    ('end', 20, 400, 40, 0, 0e0, 'TOTAL'), ('end', 21, 740, 40, 0, 1e0, ''), ('end', 22, 240, 40, 1, 0e0, 'SKU #'), ('end', 23, 400, 40, 1, 2e0, 'Name'), ('end', 24, 740, 40, 1, 0e0, '5'), ('end', 25, 400, 40, 2, 0e0, 'only a name'),
    ('end', 26, 240, 40, 30, 0e0, 'checked by'), ('end', 27, 300, 40, 30, 3e0, 'K.'), ('end', 28, 240, 40, 32, 0e0, ''), ('end', 29, 240, 40, 34, 0e0, 'two boxes open'),
    ('head', 40, 100, 90, 0, 20e0, ''), ('head', 41, 400, 90, 0, 22e0, ''), ('head', 42, 700, 90, 0, 24e0, 'Page 1 of 2'), ('head', 43, 900, 90, 0, 40e0, '')) f(part, ord, x1, w, k, dy, text)
    on f.part = 'line' or row_idx = 0)
select doc_id, (r + 1) * 64 + ord as seq, x1 + 0e0 as x1, x1 + w + 0e0 as x2, yc - 8 as y1, yc + 8 as y2, text, score from cells where trim(text) <> ''
"""}
NEEDS = {"sheet": ["inv_line"], "inv_line": ["lineitem"], "fragment": ["inv_line"], "reading": ["inv_line"], "package_label": ["inv_line"], "shot": ["events"]}


def with_views(*names: str) -> str:
    """A ``with`` clause that defines the named fixtures, for use before a select."""
    order: list[str] = []
    for n in names:
        order += [d for d in NEEDS[n] if d in SQL and d not in order] + [n]
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in dict.fromkeys(order))


def fixture(spark: SparkSession, sf_dir: str, name: str, *more: str, dealt: bool = True) -> DataFrame:
    """The named fixture; ``more``: columns of its lines to be kept in each fragment, which need no join then. ``dealt``: whether what is
    made of the lines stays dealt by doc_id; unions of such inputs lose that, so who deals several inputs itself does without."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {d: fixture(spark, sf_dir, d, dealt=dealt) for d in NEEDS[name]}
    if name == "inv_line" and dealt:  # before its columns are named, else the plan no longer knows by what they were dealt
        parts["lineitem"] = parts["lineitem"].repartition("l_orderkey")
    text = ONE_PASS.get(name, SQL[name]).replace("select doc_id, row_idx,", " ".join(["select doc_id, row_idx,", *[f"{c}," for c in more]]), 1)
    for d in parts:
        text = re.sub(rf"\b(from|join)\s+{d}\b", rf"\1 {{{d}}}", text)
    return spark.sql(text, **parts)
