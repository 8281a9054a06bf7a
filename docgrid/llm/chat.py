"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all preceding turns as
context, and only that reply under the loss. Turns are marked as
``<s>[INST] role [/INST]text</s>``. Texts and roles are escaped, ``&`` to
``&amp;``, ``<`` to ``&lt;`` and ``[`` to ``&lsqb;``, so that no control string can
stand inside them, and the escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<s>[INST] ", " [/INST]", "</s>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(rows: DataFrame) -> DataFrame:
    """conv_id, example (0-based), text, loss_start, loss_end (code points of ``text``).

    One row for each assistant turn. Turns after the last assistant turn, or those of
    a conversation without one, follow as one more row with nothing under the loss
    (null offsets), so that the output holds every turn. Null texts and roles are
    empty; turns with one number go by role, then text; repeated rows are turns of
    their own; a null conv_id is a conversation. Other columns are ignored."""
    clean = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = clean.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
            escape(F.col("text")).alias("body"),
        ).alias("t"),
    )
    talks = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (F.element_at("t", i)["role"] == "assistant") | (i == F.size("t")))
    each = talks.select("conv_id", "t", F.posexplode(ends).alias("example", "at"))
    prior = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("at") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    last = F.element_at("t", F.col("at"))
    start = F.when(last["role"] == "assistant", F.length("prior") + F.length(last["head"]))
    return each.withColumn("prior", prior).select(
        "conv_id",
        "example",
        F.concat("prior", last["head"], last["body"], F.lit(END)).alias("text"),
        start.cast("long").alias("loss_start"),
        (start + F.length(last["body"])).cast("long").alias("loss_end"),
    )


def turns(text: Column) -> Column:
    """The turns of an example, read back: array of (role, text)."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), F.position(F.lit(CLOSE), p) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, F.position(F.lit(CLOSE), p) + len(CLOSE), F.length(p))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turns and trainable text, hashed."""
    reply = F.coalesce(unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))), F.lit(""))
    per = examples.select("conv_id", "example", "text", reply.alias("reply")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.withColumn("turns", turns(F.col("whole"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_examples",
    )


SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
          + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 22 as size,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
         count(*) over (partition by conv_id) as n
  from rows),
summed as (
  select *, sum(size) over (partition by conv_id order by pos) as upto, (role = 'assistant' or pos = n) as ends from sized)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(upto) filter (ends) as bigint) as formatted_chars,
       cast(count(*) filter (ends) as bigint) as n_examples
from summed group by conv_id
"""
