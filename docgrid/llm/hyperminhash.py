"""Near copies by HyperMinHash: compressed registers, banded, then estimates, then whole sets.

A document is its set of hashed shingles. A hash falls into one of ``BUCKETS`` buckets by its first bits; a
bucket keeps its least hash as one byte, the number of leading zeros and the ``MANTISSA`` bits behind the
first one. A bucket without a hash takes that of the first filled bucket in a fixed order of its own, so that any two
registers are equal with the chance of the sets' similarity, or by accident. Eight registers are a band, and a
band is a number of 64 bits: documents that share a band are candidates.

A candidate pair is estimated twice before its sets are compared, each time corrected for registers that
are equal by accident, with ``SIGMAS`` standard deviations of slack: by the last bits of all registers where the pair meets,
which Spark counts inside the join, and by whole registers.

Of each band, first all documents are compared with the smallest one only. What this links is one component,
and pairs inside a component need no comparison any more: they cannot change it. Pairs across components
are compared then, in blocks that meet in cells of their own, so that no band is gathered in one task. A pair is
compared in the first band that it shares, and comes out of the join once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import components, row_key, slices, written

SHINGLE = 5
PERCENT = 85
BUCKETS, MANTISSA, BAND = 512, 4, 8
SIGMAS = 5.0
BLOCK = 1024
BATCH_BYTES = 1 << 20
_ZEROS = (1 << (8 - MANTISSA)) - 1  # the most leading zeros that a register tells
_BITS = int(math.log2(BUCKETS))
_ORDER = np.random.default_rng(13).permutation(np.arange(1, BUCKETS))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 0x20
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles, one text after the other, and where each text's begin.

    A-Z are lowered, words split at ASCII white space; fewer words are one shingle; no word, no shingle."""
    texts = pa.array(texts, pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(_PLAIN[raw])])
    parts = pc.split_pattern(plain.view(pa.large_string()), " ")
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(n), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    digests = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = digests[coded.indices.to_numpy(zero_copy_only=False)] if len(text) else np.zeros(0, np.uint64)
    count = np.bincount(text, minlength=n)
    begin = np.cumsum(count) - count
    left = np.repeat(begin + count, count) - np.arange(len(word))  # words from here to the text's end
    found, of = [], []
    for size in range(1, shingle + 1):
        at = np.flatnonzero(left >= shingle) if size == shingle else begin[count == size]
        h = word[at]
        for k in range(1, size):
            h = h * _STEP + word[at + k]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        found.append(h ^ (h >> np.uint64(29))), of.append(text[at])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.searchsorted(of[new], np.arange(n + 1))


def registers(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The registers of sets (``shingle_sets``), one row each, and which of them have a hash of their own; sets without members have zeros."""
    n = len(starts) - 1
    of = np.repeat(np.arange(n), np.diff(starts))
    bucket = (found >> np.uint64(64 - _BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(of * BUCKETS + bucket, prepend=-1))  # the least hash of each bucket
    rest = found[first] << np.uint64(_BITS)
    zeros = np.minimum(53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1], 53).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out, filled = np.zeros((n, BUCKETS), np.uint8), np.zeros((n, BUCKETS), bool)
    out[of[first], bucket[first]] = (np.minimum(zeros, _ZEROS) << np.uint64(MANTISSA) | tail).astype(np.uint8)
    filled[of[first], bucket[first]] = True
    row, col = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for step in _ORDER:
        if not len(row):
            break
        source = col ^ step
        there = filled[row, source]
        out[row[there], col[there]] = out[row[there], source[there]]
        row, col = row[~there], col[~there]
    return out, filled


def slack(similarity: float, n: np.ndarray, accident: float = 0.5**MANTISSA) -> np.ndarray:
    """How far an estimate may fall below the similarity. Filled buckets are a sample of a set's members, of small sets
    nearly all of these; and unlike ones are equal by ``accident``."""
    n = np.maximum(1, n)
    filled = BUCKETS * (1 - np.exp(-n / BUCKETS))
    return SIGMAS * np.sqrt((similarity * (1 - filled / n) + accident / (1 - accident)) * (1 - similarity) / filled + 1e-9)


def bands(similarity: float) -> int:
    """So many bands that a pair of this similarity misses all with a chance of a millionth, or all there are."""
    return min(BUCKETS // BAND, math.ceil(math.log(1e-6) / math.log(1 - similarity**BAND)))


def _fp(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def described(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, rid (``row_key``), n (members), fp (a hash of the whole set), bits and filled (the registers' mantissas in
    planes of bits, and which have hashes of their own), slack of an estimate by these, keys (bands, packed registers) per row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                found, starts = shingle_sets(batch.column("text"))
                values, filled = registers(found, starts)
                size = np.diff(starts)
                prints = [_fp(found[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]
                lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view("<i8").ravel()), x.shape[1] // 8).cast(pa.list_(pa.int64()))
                planes = np.concatenate([np.packbits(values >> k & 1, axis=1) for k in range(MANTISSA)], axis=1)
                bits = [lists(x) for x in (planes, np.packbits(filled, axis=1))]
                rows = [batch.column("doc_id"), batch.column("rid"), pa.array(size.astype(np.int64)), pa.array(prints, pa.int64()), pa.array(slack(similarity, size)), *bits, lists(values)]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "rid", "n", "fp", "slack", "bits", "filled", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid long, n long, fp long, slack double, bits array<long>, filled array<long>, keys array<long>")


def _sets(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """fp, items (the set, as binary): of the rows of ``docs`` that ``rids`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                found, starts = shingle_sets(batch.column("text"))
                sets = [found[i:j] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(map(_fp, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "items"])

    rows = docs.select(row_key(), F.col("text").cast("string").alias("text")).join(rids, "rid", "left_semi")
    return rows.select("text").mapInArrow(run, "fp long, items binary").dropDuplicates(["fp"])


def _likely(similarity: float, x: str, y: str) -> Column:
    """Whether two rows (of n, slack, bits, filled) can be similar by their sizes and mantissas. These lie in planes, a bit of all
    registers each, so 64 registers at a time are unlike where any plane differs. Of the unlike ones that both fill, one in
    2^MANTISSA has an equal mantissa."""
    c = lambda side, name: F.col(f"{side}.{name}")
    sizes = F.least(c(x, "n"), c(y, "n")) >= F.greatest(c(x, "n"), c(y, "n")) * F.lit(similarity - 1e-9)
    longs = BUCKETS // 64
    off = [reduce(lambda a, b: a.bitwiseOR(b), [c(x, "bits")[k].bitwiseXOR(c(y, "bits")[k]) for k in range(at, MANTISSA * longs, longs)]) for at in range(longs)]
    words = [(c(x, "filled")[k], c(y, "filled")[k], off[k]) for k in range(longs)]
    some = sum(F.bit_count(a.bitwiseOR(b)) for a, b, _ in words)
    both = sum(F.bit_count(a.bitwiseAND(b)) for a, b, _ in words)
    unlike = sum(F.bit_count(a.bitwiseAND(b).bitwiseAND(o)) for a, b, o in words)
    return sizes & (both - unlike * F.lit(1 / (1 - 0.5**MANTISSA)) >= some * (F.lit(similarity) - F.greatest(c(x, "slack"), c(y, "slack"))))


def _verified(docs: DataFrame, pairs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are similar enough. Only texts of documents that are
    in a pair are read again, and only these are shuffled."""
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    one = written(_sets(docs, written(distinct.join(ends, "fp", "left_semi").select("rid"), "ends")), "sets")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    a, b = (one.select(F.col("fp").alias(c), F.col("items").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(confirmed, "u long, v long"), "links")


def links(docs: DataFrame, distinct: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(u, v): links between different sets of ``distinct`` (fp, rid, n, slack, bits, filled, keys), enough of them to connect
    all that are similar; and the pairs across components that were compared."""
    similarity = percent / 100
    keys = F.transform(F.slice("keys", 1, bands(similarity)), lambda k, i: F.struct(i.alias("band"), k.alias("key")))
    rows = distinct.where("n > 0").select("fp", F.explode(keys).alias("k")).select("fp", "k.band", F.xxhash64("k.band", "k.key").alias("key"))
    shared = rows.groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(shared.select("key", "first"), "key"), "bands")
    told = distinct.select("fp", "n", "slack", "bits", "filled")
    star = met.where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v")).distinct()
    star = star.join(told.alias("x"), F.col("u") == F.col("x.fp")).join(told.alias("y"), (F.col("v") == F.col("y.fp")) & _likely(similarity, "x", "y")).select("u", "v")
    star = written(star, "stars")
    found = _verified(docs, star, distinct, percent)

    rooted = components(found).select(F.col("node").alias("fp"), "root")
    met = met.join(rooted, "fp", "left").select("key", "band", "fp", "first", F.coalesce("root", "fp").alias("root"))
    mixed = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    mixed = mixed.where("low <> high and size > 2").select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    met = met.join(mixed, "key").join(distinct.select(*told.columns, F.slice("keys", 1, bands(similarity)).alias("shares")), "fp").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = written(met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "cells")
    a = met.withColumnsRenamed({"mine": "i", "other": "j"}).alias("x")
    b = met.withColumnsRenamed({"other": "i", "mine": "j"}).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    apart = (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.fp") != F.col("x.first"))
    # a smallest document's pairs were compared before; any other pair meets in the first band that it shares as well
    once = F.array_position(F.zip_with("x.shares", "y.shares", lambda k, l: k == l), True) == F.col("x.band") + 1
    across = a.join(b, same & apart & _likely(similarity, "x", "y") & once).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    across = written(across, "across")
    return found.unionByName(_verified(docs, across, distinct, percent)), across


def rooted_rows(docs: DataFrame, percent: int = PERCENT, link_empty: bool = False) -> DataFrame:
    """doc_id, rid, n, component (a number for each class), component_id (smallest doc_id reachable) per row of
    ``docs``. Empty sets are classes of their own rows, or with ``link_empty`` one class."""
    prints = written(described(docs, percent / 100), "described")
    full = prints if link_empty else prints.where("n > 0")
    same = F.min(F.struct("rid", "n", "slack", "bits", "filled", "keys"))
    distinct = written(full.groupBy("fp").agg(F.min("doc_id").alias("low"), same.alias("x")).select("fp", "low", "x.*"), "prints")
    found, _ = links(docs, distinct, percent)
    rooted = components(found).withColumnRenamed("node", "fp")
    nodes = distinct.select("fp", "low").join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.where("root <> fp").select("fp", "root").join(names, "root").select("fp", "root", "component_id")
    named = named.unionByName(names.select(F.col("root").alias("fp"), "root", "component_id"))
    out = full.select("doc_id", "rid", "n", "fp").join(named, "fp").select("doc_id", "rid", "n", F.col("root").alias("component"), "component_id")
    return out if link_empty else out.unionByName(prints.where("n = 0").select("doc_id", "rid", "n", F.col("fp").alias("component"), F.col("doc_id").alias("component_id")))


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (whether that is the row's own) per row.

    Null and empty texts, and texts of white space, have empty sets and are linked with nothing. Rows
    repeated in ``docs`` each give a row. A null doc_id gives a row, but never names a component unless its
    whole component has no id; it is kept just then. Other columns are ignored; an empty table gives an empty result."""
    rows = rooted_rows(docs, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
