"""Ranked lexical search over document shards.

Documents are cut into shards of about ``SHARD_BYTES`` of text. A shard holds, for each of its
terms, the documents with it and how often they have it; the written index is a table with a
row for each term of a shard, so that Spark selects and counts terms. For a search, the postings
of the asked terms come together by shard as CSR arrays, and their integer impacts are computed once,
from the statistics of all documents. Items are then scored term at a time into a dense
accumulator of the shard's documents; each shard gives its k best, and these are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import slices, written

SHARD_BYTES = 16 << 20
#: Items are searched in batches of about so much text, each in one pass over the index's asked terms.
ITEM_BYTES = 4 << 20
TOP = 10
INDEX = "shard long, term string, docs array<int>, counts array<int>, ids array<long>"
_SPACE = 0x20
_PLAIN = np.full(256, _SPACE, np.uint8)
_PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of large-string ``texts``: each one's text number, and the term. A term is a run of
    ASCII letters and digits and of all other scripts' characters, with A-Z lowered."""
    texts = pa.array(texts, pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(_PLAIN[raw]))
    parts = pc.split_pattern(plain, " ")
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return doc[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def _postings(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with a count in each text of a shard: lengths of the texts, the terms, their CSR offsets, documents and counts."""
    doc, flat = terms_of(texts)
    coded = flat.dictionary_encode()
    term, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(texts))
    code, counts = np.unique(term * n + doc, return_counts=True)
    starts = np.searchsorted(code, np.arange(len(coded.dictionary) + 1) * n)
    return np.bincount(doc, minlength=len(texts)), coded.dictionary, starts, code % n, counts


def index(docs: DataFrame, shard: int = SHARD_BYTES) -> DataFrame:
    """The written index: a row (shard, term, docs, counts) for each term of a shard, docs being numbers
    within the shard, and a row without a term for the shard's ids and its documents' numbers of terms.

    One pass without a shuffle. Null texts are empty; rows repeated in ``docs`` are documents of
    their own; other columns are ignored; an empty table gives an empty index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ints = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
        for batch in batches:
            for part in slices(batch, "text", shard):
                lengths, terms, starts, doc, counts = _postings(part.column("text"))
                ids = pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
                rows = [pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), ints([0, len(lengths)], lengths), ids]
                yield pa.RecordBatch.from_arrays(rows, INDEX_NAMES)
                n = len(terms)
                rows = [pa.array(np.full(n, number)), terms.cast(pa.string()), ints(starts, doc), ints(starts, counts), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, INDEX_NAMES)
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, INDEX), "postings")


INDEX_NAMES = ["shard", "term", "docs", "counts", "ids"]


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n: how often an item has a term. Rows of one id with different texts are one item; equal rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, flat = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(of)), flat.cast(pa.string())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("n"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest positive scores; of equal ones those with the smallest ids."""
    place = np.flatnonzero(scores > 0)
    if len(place) > k:
        least = scores[place][np.argpartition(scores[place], len(place) - k)[len(place) - k]]
        over, tied = place[scores[place] > least], place[scores[place] == least]
        if len(over) + len(tied) > k:
            want = k - len(over)
            tied = tied[np.argpartition(ids[tied], want - 1)[:want]]
        place = np.concatenate((over, tied))
    return place


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _found(held: DataFrame, queries: list[tuple[int | None, dict[str, int]]], df: dict[str, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each shard. ``held``: the index's rows of asked terms and those of ids."""
    names = sorted(df)
    weight = np.array([_weight(n_docs, df[t]) for t in names], np.int64)
    number = {t: i for i, t in enumerate(names)}
    asked = [(item, [(number[t], c) for t, c in counts.items() if t in number]) for item, counts in queries]

    def run(shard: pa.Table) -> pa.Table:
        terms = shard.column("term").to_pylist()
        head = terms.index(None)
        ids = shard.column("ids")[head].values
        order = np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False))
        lengths = shard.column("counts")[head].values.to_numpy(zero_copy_only=False).astype(np.int64)
        m = 100 - 75 + (75 * lengths * n_docs) // n_terms
        rows = shard.filter(pc.is_valid(shard.column("term"))).combine_chunks()
        if not len(rows):
            return pa.table({"item_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        term = np.array([number[t] for t in terms if t is not None])
        size = pc.list_value_length(rows.column("docs")).to_numpy()
        doc, tf = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("docs", "counts"))
        impact = np.repeat(weight[term], size) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        ends = np.cumsum(size)
        place = {t: slice(z - s, z) for t, z, s in zip(term.tolist(), ends.tolist(), size.tolist())}
        out: list[list] = [[], [], []]
        score = np.zeros(len(lengths), np.int64)
        for item, counts in asked:
            score[:] = 0
            for t, c in counts:
                if t in place:
                    score[doc[place[t]]] += c * impact[place[t]]  # a document once a term
            found = best(score, order, k)
            out[0] += [item] * len(found)
            out[1].append(ids.take(pa.array(found)))
            out[2].append(score[found])
        return pa.table({"item_id": pa.array(out[0], pa.int64()), "doc_id": pa.chunked_array(out[1], pa.int64()), "score": pa.array(np.concatenate(out[2]))})

    return held.groupBy("shard").applyInArrow(run, "item_id long, doc_id long, score long")


def search(postings: DataFrame, items: DataFrame, k: int = TOP, batch: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of the ``index`` with the highest score above
    0, equal scores by doc_id, null ids last. Items without terms have no rows; null ids of items are an id.

    Items come to the driver in batches of about ``batch`` bytes of text, as each must meet each shard."""
    n_docs, n_terms = postings.where("term is null").select(F.explode("counts").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = written(_item_terms(items), "items").withColumn("size", F.octet_length("term") + 8)
    total = counted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shares = max(1, math.ceil(total / batch))
    out = None
    for share in range(shares):
        own = counted.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == share)
        asked = own.select("term").distinct()
        held = written(postings.join(F.broadcast(asked), "term").select(*INDEX_NAMES), "asked")
        df = dict(map(tuple, held.groupBy("term").agg(F.sum(F.size("docs"))).collect()))  # terms of one batch of items
        queries: dict[int | None, Counter] = {}
        for item, term, n in own.select("item_id", "term", "n").collect():
            queries.setdefault(item, Counter())[term] = n
        rows = _found(held.unionByName(postings.where("term is null")), list(queries.items()), df, n_docs, n_terms, k)
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
i as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
asked as (select item_id, term, count(*) as c from i group by item_id, term),
tf as (select doc_id, term, count(*) as tf from d group by doc_id, term),
len as (select doc_id, count(*) as n from d group by doc_id),
total as (select count(*) as nn, cast(sum(n) as bigint) as l from len),
df as (select term, count(*) as df from tf group by term),
m as (select doc_id, 25 + (75 * n * nn) // l as m from len, total),
scored as (
  select item_id, doc_id, cast(sum(c * cast(floor(1000 * ln(cast(2 * nn + 2 as double) / cast(2 * df + 1 as double))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join tf using (term) join df using (term) join m using (doc_id), total group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""
