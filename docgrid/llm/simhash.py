"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into four blocks of 16. Of a pair that differs
in at most two bits, at least two blocks are equal, so each fingerprint enters
six tables, one for each pair of blocks, under a key of 32 bits; pairs that meet
in a table are verified by their Hamming distance.

A bucket of more than ``bucket_limit`` distinct fingerprints is not paired up.
Its fingerprints go through their one-bit neighbours instead: two fingerprints
differ in at most two bits just if some value is within one bit of both. Each
gives 65 rows, a value has at most 65 fingerprints around it, and one row per
fingerprint of a value links them all; so links found are the same and the work
stays in proportion to the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import components, first_of_each, row_key, written

BLOCKS = 4
MAX_DISTANCE = 2
BUCKET_LIMIT = 32


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a whole text: A-Z lowered, words split at
    ASCII white space, shingles with repeats; no word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 4096):
        part = zip(starts[at : at + 4096].tolist(), ends[at : at + 4096].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, rid (``row_key``), fp (the fingerprint as a signed long) for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "rid", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, rid long, fp long")


def _tables(fp: Column) -> Column:
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(BLOCKS)]
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i)]
    return F.array(*[F.lit(n * (1 << 32)) + block[i] * 65536 + block[j] for n, (i, j) in enumerate(pairs)])


def links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(u, v): links between different fingerprints of ``distinct`` (fp) at
    ``MAX_DISTANCE`` bits or fewer, enough of them to connect all that are close."""
    rows = distinct.select("fp", F.explode(_tables(F.col("fp"))).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = written(rows.join(sizes, "bucket"), "buckets")
    few = held.where(F.col("n") <= bucket_limit)
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE
    met = (
        few.alias("a")
        .join(few.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.fp") < F.col("b.fp")) & close)
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    many = held.where(F.col("n") > bucket_limit).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    near = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("of"))  # 65 at most
    around = least.where(F.size("of") > 1).select("u", F.explode("of").alias("v")).where("u <> v")
    return met.unionByName(around).distinct()


def _classes(docs: DataFrame, shingle: int, bucket_limit: int) -> DataFrame:
    """doc_id, rid, fp, component (the root's fingerprint), component_id per row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(prints.select("fp").distinct(), bucket_limit))
    nodes = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.where("root <> fp").select("fp", "root").join(names, "root").select("fp", "root", "component_id")
    named = named.unionByName(names.select(F.col("root").alias("fp"), "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "rid", "fp", F.col("root").alias("component"), "component_id")


def classes(docs: DataFrame, shingle: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) per row.

    Null and empty texts, and texts of white space only, have fingerprint zero
    and are linked like any other. Repeated rows each give a row. A null doc_id
    gives a row, but never names a component unless its whole component has no
    id. Other columns are ignored; an empty table gives an empty result."""
    rows = _classes(docs, shingle, bucket_limit)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs``, all columns, with one row of each class: that with the smallest doc_id.

    Null ids come last. Of rows with one id the texts are classed on their own, so another text
    under the same id stays; of rows repeated with id and text one stays."""
    return first_of_each(docs, _classes(docs, shingle, bucket_limit))
