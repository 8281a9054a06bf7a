"""Exact repeated passages over a sparse suffix array, by longest previous factors.

A position of a text is *repeated* if the ``length`` bytes that start there also
start at another position, of the same or another document. The rule to keep the
first copy asks for an *earlier* one: the longest previous factor (LPF) of the
position has ``length`` bytes or more. In suffix order, with equal suffixes (to
that depth) in text order, the nearest smaller text position before and after a
suffix are its only candidates for that factor.

To sort the suffixes of all positions would move each text some hundred times.
Most suffixes cannot have a partner, so they are ruled out first, exactly:

1. The *key* of a position is the least hash of the 32-grams in its window of
   ``length`` bytes. Equal windows have equal keys. Runs of neighbouring positions
   with one key make a *block* (about 85 positions); a block's digest covers all
   its bytes. A key of only one block has no partner and goes.
2. Blocks of one key with equal digests repeat as a whole. Where a key has one
   digest only, its positions are settled without comparing suffixes.
3. Of the other keys one block for each digest, the first in text order, is kept with
   its bytes, dealt by the key. The suffixes in it are sorted, to the depth of ``length``
   bytes, and the previous and next smaller places in that order give their longest
   previous factors; the mirror, with larger places, gives later matches. A key with more
   than ``key_limit`` such suffixes is dealt by the single windows' digests instead, which
   any number of tasks can share.

All positions are compared on the input as given. Documents are row units: the
text of one fits in memory, as does one block, while keys, blocks and copies may
be any number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import fresh, written

LENGTH = 200
GRAM = 32
KEY_LIMIT = 1 << 19
BUCKET = 20_000
PIECE = 1 << 19
RUN = 1024
_TOP = np.uint64(2**64 - 1)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def window_keys(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The key of each position of ``data`` (bytes) with ``length`` bytes to come,
    and the hashes of the 32-grams of which the keys are the least."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(29)
    width, factor = 1, 0xD6E8FEB86659FD93
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % 2**64
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return _sliding(h, length - GRAM + 1, np.minimum), h


def _twice(h: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal least hashes that stand next to each other within ``width``: first, second."""
    edge = np.zeros(width - 1, np.uint64)
    least = np.flatnonzero(h == _sliding(np.concatenate((edge, keys, edge)), width, np.maximum))
    pair = (h[least[1:]] == h[least[:-1]]) & (np.diff(least) < width)
    return least[:-1][pair], least[1:][pair]


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, memoryview, list[tuple[int, int, int, int]]]]:
    """Texts in buffers of about ``PIECE`` bytes, long ones in overlapping parts:
    the bytes, and (text, offset in the text, start, positions) of the parts."""
    parts: list[bytes] = []
    held: list[tuple[int, int, int, int]] = []
    at = 0
    for i, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            held.append((i, offset, at, len(part) - length + 1))
            parts.append(part)
            at += len(part)
            if at >= PIECE:
                whole = b"".join(parts)
                yield np.frombuffer(whole, np.uint8), memoryview(whole), held
                parts, held, at = [], [], 0
    if held:
        whole = b"".join(parts)
        yield np.frombuffer(whole, np.uint8), memoryview(whole), held


def blocks(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of the texts, in parts: text number, first position, positions, key,
    digest, and whether the block may hold a window twice (its key's 32-gram comes twice)."""
    for data, view, held in _buffers(texts, length):
        keys, h = window_keys(data, length)
        one, two = _twice(h, keys, length - GRAM + 1)
        text, offset, start, count = (np.array(x, np.int64) for x in zip(*held))
        heads, sizes = [], []
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = np.unique(np.concatenate((change, start, start + count)))
        bounds = bounds[bounds <= len(keys)]
        if len(bounds) == 0 or bounds[-1] < len(keys):
            bounds = np.append(bounds, len(keys))
        if bounds[0] > 0:
            bounds = np.insert(bounds, 0, 0)
        first, size = bounds[:-1], np.diff(bounds)
        if len(size) and size.max() > RUN:
            for a, n in zip(first.tolist(), size.tolist()):
                heads.extend(range(a, a + n, RUN))
                sizes.extend(min(RUN, a + n - x) for x in range(a, a + n, RUN))
            first, size = np.array(heads, np.int64), np.array(sizes, np.int64)
        part = np.searchsorted(start, first, "right") - 1
        ok = (part >= 0) & (first < start[part] + count[part])
        first, size, part = first[ok], size[ok], part[ok]
        digest = xxhash.xxh3_64_intdigest
        spans = zip(first.tolist(), (first + size + length - 1).tolist())
        made = np.array([digest(view[a:b]) for a, b in spans], np.uint64).view(np.int64)
        at = np.searchsorted(one, first)
        twice = np.append(two, len(data) * 2)[at] < first + size + length - GRAM
        yield text[part], first - start[part] + offset[part], size, keys[first].view(np.int64), made, twice


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _all_blocks(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                for text, p0, n, key, digest, twice in blocks(_bytes(part.column("text")), length):
                    rows = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("rid").take(rows), part.column("doc_id").take(rows), pa.array(key), pa.array(digest), pa.array(p0), pa.array(n), pa.array(twice)],
                        ["rid", "doc_id", "key", "digest", "p0", "n", "twice"],
                    )

    return docs.mapInArrow(run, "rid long, doc_id long, key long, digest long, p0 long, n long, twice boolean")


def suffix_order(data: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` in order of their first ``length`` bytes, equal ones in text
    order (``order``), and for each the common prefix with the one before it, up to ``length``.

    The first two bytes deal the suffixes into buckets, which are sorted one after the
    other; a prefix of less than two bytes counts as none."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    code = data[starts].astype(np.int32) * 256 + data[starts + 1]
    by = np.lexsort((order, code))
    cuts = np.append(np.flatnonzero(np.diff(code[by])) + 1, len(by))
    common = np.zeros(len(by), np.int64)
    wide = -(-length // 8) * 8
    lo = 0
    for n, hi in enumerate(cuts.tolist()):
        if hi - lo < BUCKET and n + 1 < len(cuts):
            continue
        some = by[lo:hi]
        rows = np.zeros((len(some), wide), np.uint8)
        rows[:, :length] = windows[starts[some]]
        sa = np.argsort(rows.view(f"V{wide}").ravel(), kind="stable")  # equal suffixes have one code, in which ``by`` is in text order
        by[lo:hi] = some[sa]
        words = rows[sa].view(np.uint64)
        off = words[1:] ^ words[:-1]
        first = (off != 0).argmax(axis=1)
        last = off[np.arange(len(off)), first]
        low = last & (~last + np.uint64(1))  # its lowest bit is in the first byte that differs
        bits = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
        common[lo + 1 : hi] = np.where(last == 0, length, np.minimum(length, first * 8 + bits // 8))
        lo = hi
    return by, np.where(common < 2, 0, common)


def nearest_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in suffix order, the nearest one before it with a smaller place (-1: none)
    and the common prefix with it, by jumps over candidates that are known to be larger."""
    found, least = np.arange(-1, len(place) - 1), common.copy()
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        at = found[open_]
        larger = place[at] > place[open_]
        open_, at = open_[larger], at[larger]
        least[open_] = np.minimum(least[open_], least[at])
        found[open_] = found[at]
        open_ = open_[found[open_] >= 0]
    least[found < 0] = 0
    return found, least


def previous_factors(sa: np.ndarray, common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, up to the depth of the suffix order: the
    longer of its common prefixes with the previous and with the next smaller place."""
    place = order[sa]
    _, before = nearest_smaller(place, common)
    _, after = nearest_smaller(place[::-1], np.concatenate((common[:1], common[:0:-1])))
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(before, after[::-1])
    return out


def repeats(data: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int, first_kept: bool) -> np.ndarray:
    """For each suffix whether its longest previous factor is ``length`` or more, or without
    ``first_kept`` whether this or its mirror, the longest next factor, is."""
    sa, common = suffix_order(data, starts, order, length)
    out = previous_factors(sa, common, order) >= length
    return out if first_kept else out | (previous_factors(sa, common, -order) >= length)


def _sorted_suffixes(rows: DataFrame, length: int, first_kept: bool) -> DataFrame:
    """Suffix order within each key; rows come dealt and sorted by it."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        n = t.column("n").to_numpy()
        blobs = t.column("bytes").to_pylist()
        at = np.concatenate(([0], np.cumsum(n)))
        data = np.frombuffer(b"".join(blobs), np.uint8)
        heads = np.concatenate(([0], np.cumsum([len(b) for b in blobs])[:-1]))
        ids = pd.DataFrame({"d": t.column("doc_id").to_pandas().astype("Int64"), "r": t.column("rid").to_numpy(), "p": t.column("p0").to_numpy()})
        rank = np.empty(len(n), np.int64)
        rank[ids.sort_values(["d", "r", "p"], na_position="first").index.to_numpy()] = np.arange(len(n))
        inside = np.arange(at[-1]) - np.repeat(at[:-1], n)
        repeated = repeats(data, np.repeat(heads, n) + inside, np.repeat(rank, n) * (RUN + 1) + inside, length, first_kept)
        edge = np.zeros(at[-1] + 1, bool)
        edge[at[:-1]] = True
        begins = np.flatnonzero(repeated & (edge[:-1] | ~np.concatenate(([False], repeated[:-1]))))
        ends = np.flatnonzero(repeated & (np.append(edge[1:-1], True) | ~np.concatenate((repeated[1:], [False])))) + 1
        if not len(begins):
            return None
        row = np.repeat(np.arange(len(n)), n)[begins]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [t.column("rid").take(take).combine_chunks(), t.column("doc_id").take(take).combine_chunks(), pa.array(ids["p"].to_numpy()[row] + inside[begins]), pa.array(ends - begins)],
            ["rid", "doc_id", "p0", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        work = 0
        for batch in batches:
            for part in _slices(batch, 1024):
                keys = part.column("key").to_numpy()
                if work > 60_000:
                    cut = int(np.searchsorted(keys != held[-1].column("key")[-1].as_py(), True)) if keys[0] == held[-1].column("key")[-1].as_py() else 0
                    held.append(part.slice(0, cut))
                    if cut < len(keys):
                        if (out := settle(held)) is not None:
                            yield out
                        held, work, part = [], 0, part.slice(cut)
                    else:
                        continue
                held.append(part)
                work += int(part.column("n").to_numpy().sum())
        if held and (out := settle(held)) is not None:
            yield out

    return rows.mapInArrow(run, "rid long, doc_id long, p0 long, n long")


def _with_bytes(texts: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The blocks of ``reps`` with their bytes, one task-local pass over each text."""
    wanted = reps.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("key", "p0", "n", "crowded")).alias("wanted"))
    met = texts.join(wanted, (texts.rid == wanted.rid) & texts.doc_id.eqNullSafe(wanted.doc_id)).select(texts.rid, texts.doc_id, "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in _slices(batch, 64):
                rid, doc, key, p0, n, blob, window = [], [], [], [], [], [], []
                for r, d, text, found in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "text", "wanted"))):
                    data = (text or "").encode()
                    for w in found:
                        a, k = w["p0"], w["n"]
                        if w["crowded"]:
                            for p in range(a, a + k):
                                rid.append(r), doc.append(d), key.append(w["key"]), p0.append(p), n.append(1), blob.append(None)
                                window.append(digest(data[p : p + length]))
                        else:
                            rid.append(r), doc.append(d), key.append(w["key"]), p0.append(a), n.append(k), window.append(None)
                            blob.append(data[a : a + k + length - 1])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                arrays = [pa.array(x, kind) for x, kind in zip((rid, doc, key, p0, n, blob, window), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "key", "p0", "n", "bytes", "window"])

    return met.mapInArrow(run, "rid long, doc_id long, key long, p0 long, n long, bytes binary, window binary")


def _texts(docs: DataFrame) -> DataFrame:
    """rid (a digest of id and text, never null), doc_id, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def repeated_spans(texts: DataFrame, length: int = LENGTH, first_kept: bool = False, key_limit: int = KEY_LIMIT) -> DataFrame:
    """rid, doc_id, spans (array of p0, n: runs of repeated positions) of ``_texts`` rows that have some."""
    found = written(_all_blocks(texts, length), "blocks")
    keys = found.groupBy("key").agg(F.count("*").alias("copies"), ((F.min("digest") != F.max("digest")) | F.max("twice")).alias("mixed"), F.max("twice").alias("twice"))
    keys = keys.where("copies > 1 or twice")
    hits = written(found.drop("twice").join(keys.select("key", "mixed"), "key"), "hits")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "rid", "p0")
    kinds = hits if first_kept else hits.where("mixed")
    reps = kinds.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max("mixed").alias("mixed"), F.min_by(F.struct("doc_id", "n"), place).alias("own"))
    reps = written(reps.select("key", "digest", "copies", "mixed", F.col("first.rid").alias("rid"), "own.doc_id", F.col("first.p0").alias("p0"), "own.n"), "reps")
    if first_kept:
        named = reps.where("copies > 1").select("key", "digest", F.col("rid").alias("r0"), F.col("doc_id").alias("d0"), F.col("p0").alias("q0"))
        whole = hits.join(named, ["key", "digest"]).where(~((F.col("rid") == F.col("r0")) & F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("p0") == F.col("q0"))))
    else:
        whole = hits.where("not mixed").unionByName(hits.where("mixed").join(reps.where("copies > 1").select("key", "digest"), ["key", "digest"]))
    whole = whole.select("rid", "doc_id", "p0", "n")
    mixed = reps.where("mixed")
    crowd = mixed.groupBy("key").agg((F.sum("n") > key_limit).alias("crowded"))
    blobs = _with_bytes(texts, mixed.join(crowd, "key"), length)
    plain = blobs.where("window is null").drop("window").repartition("key").sortWithinPartitions("key")
    some = _sorted_suffixes(plain, length, first_kept)
    single = blobs.where("window is not null")
    groups = single.groupBy("window").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
    crowded = single.join(groups, "window")
    if first_kept:
        crowded = crowded.where(place != F.col("first"))
    spans = whole.unionByName(some).unionByName(crowded.select("rid", "doc_id", "p0", "n"))
    return spans.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("p0", "n")).alias("spans"))


def _covered(data: bytes, spans: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of removed bytes: starts, ends."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.array([s["p0"] for s in spans], np.int64)
    b = a + np.array([s["n"] for s in spans], np.int64) + length - 1
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return a[new], np.minimum(b[last], len(data))


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]))


def _joined(docs: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    return texts.join(spans, (texts.rid == spans.rid) & texts.doc_id.eqNullSafe(spans.doc_id), "left").select(texts.doc_id, "text", "spans")


def removal_report(docs: DataFrame, length: int = LENGTH, first_kept: bool = False, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty, and texts below ``length`` bytes lose nothing.
    Rows with one id and one text are copies of each other: with ``first_kept``
    neither is the earlier, so both stay; else both go. A null id takes part like
    any other and comes first in text order. Other columns are ignored; an empty
    table gives an empty result."""
    texts = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                starts, ends = _covered(data, spans, length)
                out.append((len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(_kept(data, starts, ends)).hexdigest()))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(docs, texts, repeated_spans(texts, length, first_kept, key_limit))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_later_copies(docs: DataFrame, length: int = LENGTH, key_limit: int = KEY_LIMIT) -> DataFrame:
    """``docs`` (doc_id, text, other columns) with later copies of repeated passages
    cut out of the texts and the first copy kept, in (doc_id, offset) order.

    Cuts shrink to whole characters. Rows whose text goes entirely are dropped;
    rows that were null or empty before stay as they are."""
    own, rid, doc, found, cut_ = (fresh(docs, c) for c in ("own", "rid", "doc", "spans", "cut"))
    spans = repeated_spans(_texts(docs), length, True, key_limit).select(F.col("rid").alias(rid), F.col("doc_id").alias(doc), F.col("spans").alias(found))
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    met = keyed.join(spans, (F.col(own) == F.col(rid)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, s: object) -> str | None:
            if t is None or s is None or len(s) == 0:
                return t
            data = t.encode()
            starts, ends = _covered(data, list(s), length)
            for i in range(len(starts)):
                while starts[i] < ends[i] and data[starts[i]] & 0xC0 == 0x80:
                    starts[i] += 1
                while ends[i] > starts[i] and ends[i] < len(data) and data[ends[i]] & 0xC0 == 0x80:
                    ends[i] -= 1
            return _kept(data, starts, ends).decode()

        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    # else the filter below gets a cut of its own: two Python workers for each task, and each text cut twice
    cut = cut.asNondeterministic()
    some = F.when(F.col(found).isNotNull(), F.col("text"))  # only texts with spans go to Python
    out = met.withColumn(cut_, F.when(F.col(found).isNull(), F.col("text")).otherwise(cut(some, found)))
    out = out.where(F.col(found).isNull() | (F.length(cut_) > 0))
    return out.select(*[F.col(cut_).alias(c) if c == "text" else F.col(c) for c in docs.columns])
