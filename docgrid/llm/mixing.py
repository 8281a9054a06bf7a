"""Mixing sources to target weights: hierarchical token budgets.

The token budget goes down the tree domain, language, source. At each node it is
dealt among the children in proportion to their weights, none above what its
leaves can give (tokens times ``max_epochs``). What a child cannot take goes to its
siblings first; only what all siblings together cannot take is missing at the
parent, where the parent's siblings take it in turn. A leaf fills its budget with
whole epochs and a prefix of one more, in the order of a seeded hash for that epoch.

The prefix is found without sorting a leaf in one task: token sums of 256 hash
buckets settle all but one bucket a leaf, that bucket is cut into 256 again, and so
on; a few documents are sorted at last. The document texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import fresh, written

LEVELS = ("domain", "lang", "source")
#: The table of leaves is broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Digits of the hash (hexadecimal) that a round settles: 256 buckets a leaf; 8 digits leave a document or two of a billion.
DIGITS, ROUNDS = 2, 4
TOKEN = r"[^ \t\n\r]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with budget: whole tokens for each leaf; ``budget``
    is a column over the sum ``total`` of all tokens. Children of weight 0 get none."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).first()[0]  # one number
    nodes = nodes.withColumn("total", F.lit(total)).withColumn("budget", budget.cast("long")).drop("total")
    for depth, level in enumerate(levels):
        above, own = list(levels[:depth]), list(levels[: depth + 1])
        kids = nodes.groupBy(*own).agg(F.sum("cap").alias("cap"), F.first("budget").alias("over")).withColumn("w", _weight(level, weights)).where("w > 0")
        family = Window.partitionBy(*(above or [F.lit(0)]))
        order = family.orderBy(F.col("cap") / F.col("w"), *own)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        kids = kids.withColumn("share", (F.col("over") - before) / after)
        level_share = F.max(F.when(F.col("share") < F.col("cap") / F.col("w"), F.col("share"))).over(family)
        kids = kids.withColumn("share", level_share)
        kids = kids.select(*own, F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.greatest(F.col("share"), F.lit(0.0)) * F.col("w")))).cast("long").alias("budget"))
        nodes = nodes.drop("budget").join(kids, own)
    return nodes.select(*levels, "tokens", "budget")


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    domain: Column,
    ratio: float = 0.5,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    max_epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """``docs`` with domain, n_tokens and epoch (0-based): a row for each copy chosen.

    The budget is ``ratio`` of all tokens, rounded down; shares are rounded down to
    whole tokens. Documents are taken whole: the prefix ends before the first that
    would pass the budget. Null lang, source or domain are the empty label; null
    texts have no token, and documents without tokens come with the prefix they
    stand in. Rows of one doc_id stand together: all in the prefix, or none. A column
    ``domain``, ``n_tokens`` or ``epoch`` of the input is replaced; an empty table
    gives an empty result."""
    labels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in labels.items()]
    slim = written(docs.select("doc_id", n_tokens(F.col("text")).alias("n"), *keys), "tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    dealt = budgets(leaves, LEVELS, weights or {}, F.floor(F.col("total") * F.lit(float(ratio))), max_epochs)
    whole = F.coalesce(F.floor(F.col("budget") / F.nullif(F.col("tokens"), F.lit(0))), F.lit(0)).cast("long")
    dealt = dealt.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    dealt = written(dealt.select(*LEVELS, "whole", "rest"), "leaves")
    n_leaves = dealt.count()
    small = F.broadcast if n_leaves <= BROADCAST_ROWS else (lambda x: x)

    # By two digits of the hash at a time: the bucket of each leaf in which the budget ends, and what comes before it.
    edge = slim.join(small(dealt), list(LEVELS)).withColumns({"h": _order(seed, F.col("whole")), "base": F.lit(0).cast("long")})
    for depth in range(1, ROUNDS + 1):
        bucket = F.substring("h", 1, DIGITS * depth)
        sums = edge.groupBy(*LEVELS, bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
        passed = sums.withColumn("upto", upto).where("upto > rest")
        found = passed.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("c"))
        cut = written(found.select(*LEVELS, F.col("c.bucket").alias("cut"), F.col("c.base").alias("base")), "cuts")
        edge = edge.drop("base").join(small(cut), list(LEVELS)).where(bucket == F.col("cut")).drop("cut")
        edge = written(edge, "edge")
    ids = edge.groupBy(*LEVELS, "h").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    run = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("h"))
    last = ids.withColumn("upto", run).where("upto <= rest").groupBy(*LEVELS).agg(F.max("h").alias("last"))
    plan = dealt.join(cut.drop("base"), list(LEVELS), "left").join(last, list(LEVELS), "left")
    # A document is in the prefix if its hash comes before the cut bucket, or in it up to the last that fits.
    own = {k: fresh(docs, f"_{k}") for k in (*LEVELS, "whole", "rest", "cut", "last", "h", "n")}
    plan = written(plan.select(*[F.col(k).alias(own[k]) for k in (*LEVELS, "whole", "rest", "cut", "last")]), "plan")
    out = docs.withColumns({own[k]: c for k, c in zip(LEVELS, keys)}).withColumn(own["n"], n_tokens(F.col("text")))
    out = out.join(small(plan), [own[k] for k in LEVELS]).withColumn(own["h"], _order(seed, F.col(own["whole"])))
    h, whole, rest, cut_, last_ = (F.col(own[k]) for k in ("h", "whole", "rest", "cut", "last"))
    begin = F.substring(h, 1, DIGITS * ROUNDS)
    head = cut_.isNull() | (begin < cut_) | ((begin == cut_) & (h <= F.coalesce(last_, F.lit(""))))
    head = head & ((rest > 0) | (whole == 0))
    times = whole + F.when(head, 1).otherwise(0)
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("domain", "n_tokens", "epoch")]
    out = out.where(times > 0).select(*kept, F.col(own["domain"]).alias("domain"), F.col(own["n"]).alias("n_tokens"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("epoch"))
    names = {c.lower(): c for c in docs.columns}
    order = [*docs.columns, *[c for c in ("domain", "n_tokens", "epoch") if c not in names]]
    return out.select(*order)


def sql(ratio: float = 0.5, max_epochs: int = 2, seed: int = 42) -> str:
    """The same rows in DuckDB's SQL, with equal weights: (doc_id, domain, lang, source, n_tokens, epoch)."""
    parts = []
    for depth, level in enumerate(LEVELS):
        own = ", ".join(LEVELS[: depth + 1])
        over = f"partition by {', '.join(LEVELS[:depth])}" if depth else ""
        source = f"b{depth - 1}" if depth else "whole_budget"
        joined = f"l join b{depth - 1} using ({', '.join(LEVELS[:depth])})" if depth else "l cross join whole_budget"
        parts.append(
            f"k{depth} as (select {own}, sum(cap) as cap, any_value({source}.budget) as over_, 1e0 as w from {joined} group by {own}),"
            f"s{depth} as (select *, (over_ - coalesce(sum(cap) over ({over} order by cap / w, {own} rows between unbounded preceding and 1 preceding), 0))"
            f" / sum(w) over ({over} order by cap / w, {own} rows between current row and unbounded following) as share from k{depth}),"
            f"m{depth} as (select *, max(case when share < cap / w then share end) over ({over}) as level from s{depth}),"
            f"b{depth} as (select {own}, cast(case when level is null then cap else least(cap, floor(greatest(level, 0) * w)) end as bigint) as budget from m{depth})"
        )
    return f"""
with d as (
  select doc_id, coalesce(substr(source, 1, 4), '') as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) as n from documents),
l as (select domain, lang, source, sum(n) as tokens, sum(n) * {max_epochs} as cap from d group by all),
whole_budget as (select cast(floor(sum(tokens) * {float(ratio)}) as bigint) as budget from l),
{', '.join(parts)},
plan as (select domain, lang, source, coalesce(budget // nullif(tokens, 0), 0) as whole, budget - coalesce(budget // nullif(tokens, 0), 0) * tokens as rest
         from l join b2 using (domain, lang, source)),
o as (select d.*, whole, rest, md5(concat_ws(':', '{seed}', whole, coalesce(cast(doc_id as varchar), ''))) as h from d join plan using (domain, lang, source)),
r as (select *, sum(n) over (partition by domain, lang, source order by h, doc_id) as upto from o),
t as (select *, whole + case when upto <= rest and (rest > 0 or whole = 0) then 1 else 0 end as times from r)
select doc_id, domain, lang, source, cast(n as bigint) as n_tokens, cast(unnest(range(cast(times as bigint))) as bigint) as epoch from t where times > 0
"""
