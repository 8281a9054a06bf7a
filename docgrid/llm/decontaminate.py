"""Benchmark decontamination: a BM25 index of test items, queried by every passage.

The items' inverted index has, for each term, its postings with BM25 weights, the
largest weight, and the largest weight in each block of items. Weights are divided
by the item's score against itself, so that a passage that holds an item in full
scores 1. Every passage (windows of words that overlap by half) is a query; all
items above the threshold are retrieved by block-max WAND: a passage whose terms'
largest weights cannot reach the threshold has no pivot and ends there, a block
whose own bounds cannot reach it is passed over, and only then are postings scored.
The two bounds are taken for many passages at once.

A retrieved item counts as a leak if the passage holds at least ``OVERLAP`` of the
five-word shingles of its question and as many of its answer.

Document frequencies, the number of items, their mean length and the longest are those of
all items. An index is bounded by ``INDEX_BYTES`` of item text; a larger benchmark is
indexed in shards of that size under these same statistics, one pass each, so scores and
what is found don't depend on the shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import written

THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4
INDEX_BYTES = 4 << 20
PIECE = 1 << 20
BATCH = 1 << 18
CELLS = 1 << 20  # passages x blocks whose bounds are added up at once
K1, B = 1.2, 0.75
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = pow(int(_BASE), -1, 2**64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(n: int, cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(cache.get("up", ())) < n:
        with np.errstate(over="ignore"):
            cache["up"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))))
            cache["down"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(_BACK)))))
    return cache["up"], cache["down"]


def words(data: bytes, cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased UTF-8 ``data``, and where they start. A word
    is a run of digits, a-z and bytes of other scripts; its hash depends on it alone."""
    raw = np.frombuffer(data, np.uint8)
    inside = _WORD[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(raw) + 1, cache)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), start


@dataclass
class Statistics:
    """Of all items: number, mean and greatest length in words, and document frequencies
    (sorted word hashes, and how many items have them) of at least the words of one index."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Statistics:
        cache: dict[str, np.ndarray] = {}
        sets = [h for _, text in items if len(h := words(text.lower().encode("utf-8", "replace"), cache)[0])]
        terms, df = np.unique(np.concatenate([np.unique(h) for h in sets] or [np.zeros(0, np.uint64)]), return_counts=True)
        lengths = [len(h) for h in sets]
        return Statistics(len(sets), sum(lengths) / max(1, len(sets)), max(lengths, default=1), terms, df)


class Index:
    """Inverted index of (item_id, text) pairs with block maxima. Postings lie term by term in
    flat arrays, as do the blocks that a term has, each with its largest weight."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None) -> None:
        known = known or Statistics.of(items)
        cache: dict[str, np.ndarray] = {}
        found = [(i, text, words(text.lower().encode("utf-8", "replace"), cache)[0]) for i, text in sorted(items)]
        found = [(i, text, h) for i, text, h in found if len(h)]
        self.ids = [i for i, _, _ in found]
        self.parts = [self._parts(text, h, cache) for _, text, h in found]
        self.longest = known.longest
        self.blocks = -(-len(found) // BLOCK)
        counts = [np.unique(h, return_counts=True) for _, _, h in found]
        self.vocabulary = np.unique(np.concatenate([t for t, _ in counts] or [np.zeros(0, np.uint64)]))
        df = known.df[np.searchsorted(known.terms, self.vocabulary)]
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        term, doc, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, (terms, tf) in enumerate(counts):
            at = np.searchsorted(self.vocabulary, terms)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / known.mean))
            term.append(at), doc.append(np.full(len(at), k)), weight.append(w / w.sum())
        flat = np.concatenate(term)
        by = np.argsort(flat, kind="stable")  # items stay in their order
        flat, self.doc, self.weight = flat[by], np.concatenate(doc)[by], np.concatenate(weight)[by]
        v = len(self.vocabulary)
        self.start = np.searchsorted(flat, np.arange(v + 1))
        new = np.flatnonzero(np.diff(flat * max(1, self.blocks) + self.doc // BLOCK, prepend=-1))
        self.block = (self.doc // BLOCK)[new]
        self.block_max = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.block_start = np.searchsorted(flat[new], np.arange(v + 1))
        self.sizes = {SHINGLE, *(len(x) for parts in self.parts for p in parts for x in p)}
        self.top = np.maximum.reduceat(self.weight, self.start[:-1]) if v else np.zeros(0)
        self.listed = np.zeros(1 << 20, bool)
        self.listed[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def postings(self, term: int) -> list[tuple[int, float]]:
        a, z = self.start[term], self.start[term + 1]
        return list(zip(self.doc[a:z].tolist(), self.weight[a:z].tolist()))

    def _able(self, terms: list[int], threshold: float) -> tuple[np.ndarray, list[dict[int, float]]]:
        """The blocks whose bound reaches the threshold, and each term's maxima in these."""
        spans = [slice(self.block_start[t], self.block_start[t + 1]) for t in terms]
        bound = np.bincount(np.concatenate([self.block[x] for x in spans]), np.concatenate([self.block_max[x] for x in spans]), self.blocks)
        able = bound >= threshold - 1e-6
        if not able.any():
            return np.zeros(0, np.int64), []
        return np.flatnonzero(able), [{b: m for b, m in zip(self.block[x].tolist(), self.block_max[x].tolist()) if able[b]} for x in spans]

    @staticmethod
    def _parts(text: str, h: np.ndarray, cache: dict[str, np.ndarray]) -> list[set[tuple[int, ...]]]:
        """Shingles of question and answer: split after the first question mark, else after two thirds of the words."""
        asked = text.find("?") + 1
        cut = len(words(text[:asked].lower().encode(), cache)[0]) if asked else 2 * len(h) // 3
        return [shingles(part) for part in (h[:cut], h[cut:]) if len(part)] or [shingles(h)]

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are in the vocabulary: their places among ``h``, and in the vocabulary."""
        some = np.flatnonzero(self.listed[(h >> np.uint64(44)).astype(np.int64)])
        if not len(some) or not len(self.vocabulary):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == h[some]
        return some[same], at[same]

    def _promising(self, term: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: float) -> list[int]:
        """Passages (``term`` from first to last) with a block whose bound reaches the threshold; many are added up at once."""
        out = []
        step = max(1, CELLS // max(1, self.blocks))
        for a in range(0, len(first), step):
            z = min(a + step, len(first))
            t = term[first[a] : last[z - 1]]
            begin, n = self.block_start[t], self.block_start[t + 1] - self.block_start[t]
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.repeat(np.repeat(np.arange(z - a), last[a:z] - first[a:z]), n)
            bound = np.bincount(row * self.blocks + self.block[at], self.block_max[at], (z - a) * self.blocks).reshape(z - a, self.blocks)
            out += (np.flatnonzero(bound.max(axis=1) >= threshold - 1e-6) + a).tolist()
        return out

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items (number, score) that reach ``threshold``, by block-max WAND."""
        able, maxima = self._able(terms, threshold)
        if not len(able):
            return []
        lists = [(self.postings(t), float(self.top[t])) for t in terms]
        cursor = [0] * len(lists)
        out = []
        for i, (postings, _) in enumerate(lists):
            cursor[i] = bisect_left(postings, (int(able[0]) * BLOCK,))
        while True:
            live = sorted((lists[i][0][cursor[i]][0], i) for i in range(len(lists)) if cursor[i] < len(lists[i][0]))
            bound, pivot = 0.0, None
            for n, (doc, i) in enumerate(live):
                bound += lists[i][1]
                if bound >= threshold - 1e-6:
                    pivot = n
                    break
            if pivot is None:
                return out
            doc = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
                pivot += 1
            block = doc // BLOCK
            ahead = [i for _, i in live[: pivot + 1]]
            following = able[np.searchsorted(able, block) :]
            if not len(following):
                return out
            if following[0] > block:
                goal, ahead = int(following[0]) * BLOCK, [i for _, i in live]
            elif sum(maxima[i].get(block, 0.0) for i in ahead) < threshold - 1e-6:
                goal = (block + 1) * BLOCK  # no item of the block up to the next list's can reach it
                if pivot + 1 < len(live):
                    goal = min(goal, live[pivot + 1][0])
                goal = max(goal, doc + 1)
            elif live[0][0] == doc:
                score = sum(lists[i][0][cursor[i]][1] for i in ahead)
                if score >= threshold - 1e-9:
                    out.append((doc, score))
                goal = doc + 1
            else:
                goal = doc
            for i in ahead:
                cursor[i] = bisect_left(lists[i][0], (goal,), cursor[i])

    def leaks(self, texts: list[bytes], cache: dict[str, np.ndarray], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """Items leaked into lower-cased texts: (text, item, score, question overlap, answer overlap)."""
        h, start = words(b"\n".join(texts), cache)
        place, term = self.places(h)
        if not len(place):
            return []
        ends = np.cumsum([len(t) + 1 for t in texts])
        heads = np.searchsorted(start, np.concatenate(([0], ends)))  # first word of each text
        half = self.longest
        base = np.concatenate(([0], np.cumsum(-(-np.diff(heads) // half))))  # its first passage
        text = np.searchsorted(heads, place, "right") - 1
        local = (place - heads[text]) // half
        passage = base[text] + local
        v = len(self.vocabulary)
        code = np.unique(np.concatenate((passage * v + term, (passage * v + term - v)[local > 0])))
        of, term = code // v, code % v
        keep = np.bincount(of, self.top[term])[of] >= threshold - 1e-6
        of, term = of[keep], term[keep]
        if not len(of):
            return []
        first = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1))
        last = np.append(first[1:], len(of))
        out = []
        for k in self._promising(term, first, last, threshold):
            found = self.wand(term[first[k] : last[k]].tolist(), threshold)
            if found:
                n = int(np.searchsorted(base, of[first[k]], "right")) - 1
                begin = heads[n] + (of[first[k]] - base[n]) * half
                passage_words = h[begin : min(begin + 2 * half, heads[n + 1])]
                held = {s for size in self.sizes for s in shingles(passage_words, size)}
                for doc, score in found:
                    shares = [len(p & held) / len(p) for p in self.parts[doc]]
                    if min(shares) >= overlap:
                        out.append((n, doc, score, shares[0], shares[-1]))
        return out


def shingles(h: np.ndarray, n: int = SHINGLE) -> set[tuple[int, ...]]:
    x = h.tolist()
    return {tuple(x[i : i + n]) for i in range(max(1, len(x) - n + 1))} if x else set()


def _pieces(data: bytes, overlap_words: int) -> Iterator[bytes]:
    """A long text in parts cut between words, each with the words before it that a passage may need."""
    if len(data) <= PIECE:
        yield data
        return
    edge = np.flatnonzero(np.diff(_WORD[np.frombuffer(data, np.uint8)], prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    i, z = 0, 0
    while z < len(start):
        z = max(int(np.searchsorted(start, start[i] + PIECE)), i + 2 * overlap_words)
        yield data[start[i] : end[min(z, len(end)) - 1]]
        i = z - overlap_words


def leaks_of(index: Index, texts: list[str | None], cache: dict[str, np.ndarray]) -> list[dict[int, tuple[float, float, float]]]:
    """For each whole text, item_id -> (score, question overlap, answer overlap)."""
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    held: list[bytes] = []
    of: list[int] = []

    def settle() -> None:
        for n, doc, *figures in index.leaks(held, cache) if held else ():
            best, item = out[of[n]], index.ids[doc]
            best[item] = max(best.get(item, tuple(figures)), tuple(figures))
        held.clear(), of.clear()

    size = 0
    for n, text in enumerate(texts):
        for piece in _pieces((text or "").lower().encode("utf-8", "replace"), 2 * index.longest):
            held.append(piece), of.append(n)
            size += len(piece)
            if size >= BATCH:
                settle()
                size = 0
    settle()
    return out


def indexes(benchmark: DataFrame, most: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of about ``most`` bytes of text, with the statistics of all.
    The rows of one item_id come to one index."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = math.ceil(size / most) or 1
    if shards == 1:
        yield Index([tuple(r) for r in items.collect()])
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            sets = [words(t.lower().encode("utf-8", "replace"), cache)[0] for t in batch.column("text").to_pylist()]
            arrays = [pa.array([np.unique(h).view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([len(h) for h in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), *arrays], ["shard", "terms", "n"])

    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    rows = written(items.select("shard", "text").mapInArrow(terms, "shard long, terms array<long>, n long").where("n > 0"), "items")
    n, mean, longest = rows.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    each = rows.select("shard", F.explode("terms").alias("term"))
    df = written(each.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    for k in range(shards):
        own = df.join(each.where(F.col("shard") == k).select("term").distinct(), "term").toArrow()  # the words of ``most`` bytes
        term, of = own.column("term").to_numpy().view(np.uint64), own.column("df").to_numpy()
        by = np.argsort(term)
        yield Index([tuple(r) for r in items.where(F.col("shard") == k).select("item_id", "text").collect()], Statistics(n or 0, mean or 0.0, longest or 1, term[by], of[by]))


def _run(docs: DataFrame, index: Index, schema: str, keep: bool) -> DataFrame:
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = defaultdict(list)
            clean = []
            for n, found in enumerate(leaks_of(index, batch.column("text").to_pylist(), cache)):
                clean.append(not found)
                for item, (score, asked, answered) in sorted(found.items()) if not keep else ():
                    for name, x in zip(("n", "item_id", "score", "question_overlap", "answer_overlap"), (n, item, score, asked, answered)):
                        rows[name].append(x)
            if keep:
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(clean)).columns, columns)
            else:
                kinds = {"item_id": pa.int64(), "score": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}
                ids = batch.column("doc_id").take(pa.array(rows["n"], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(rows[k], kind) for k, kind in kinds.items()]], ["doc_id", *kinds])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (BM25, 1 for the whole item), question_overlap, answer_overlap:
    a row for each item that leaked into a row of ``docs``.

    One pass over whole texts, no shuffle. Null and empty texts and items have no
    leaks; items with one id count as one, with the best figures; rows repeated in
    ``docs`` repeat in the result; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    return reduce(DataFrame.unionByName, (_run(rows, index, schema, False) for index in indexes(benchmark)))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows into which an item leaked."""
    for index in indexes(benchmark):
        docs = _run(docs, index, docs.schema, True)
    return docs
