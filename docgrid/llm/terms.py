"""Hashed terms of texts, and the choice of those that tell two classes apart."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import written

SPACE = 1 << 20
PREFIXES = (4, 5, 6)
EDGES = ".,;:!?|\"'()[]<>*-_#&%/"
_CACHE = 60_000


class Terms:
    """Distinct hashed terms of a text: words, and beginnings of longer words.

    With ``chosen`` (sorted ids), the places of those ids instead."""

    def __init__(self, chosen: np.ndarray | None = None) -> None:
        self.at = None if chosen is None else {int(t): i for i, t in enumerate(chosen)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def _of(self, token: str) -> tuple[int, ...]:
        word = token.strip(EDGES)
        names = [f"w{word}", *[f"p{word[:k]}" for k in PREFIXES if len(word) > k]] if word else []
        ids = {zlib.crc32(x.encode("utf-8", "replace")) % SPACE for x in names}
        if self.at is not None:
            ids = {self.at[i] for i in ids if i in self.at}
        if len(self.seen) >= _CACHE:
            self.seen.clear()
        self.seen[token] = out = tuple(ids)
        return out

    def __call__(self, text: str | None) -> list[int]:
        out: set[int] = set()
        seen = self.seen
        for token in set((text or "").lower().split()):
            ids = seen.get(token)
            if ids is None:
                ids = self._of(token)
            if ids:
                out.update(ids)
        return sorted(out)


def choose(rows: DataFrame, most: int, least_rows: int = 4, least_chi: float = 8.0) -> np.ndarray:
    """Ids of the terms of ``rows`` (text, label 0/1; a bounded sample) whose presence
    goes with the label most by the chi-square statistic: ``most`` of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(), np.zeros((2, SPACE), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                n[y, terms(text)] += 1
        some = np.flatnonzero(n.sum(axis=0))
        for at in range(0, len(some), 50_000):
            ids = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[0, ids]), pa.array(n[1, ids])], ["term", "n0", "n1"])

    totals = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    a, b = (max(1, x) for x in totals)
    counts = rows.select("text", "label").mapInArrow(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    off = F.col("n1") * float(a) - F.col("n0") * float(b)  # doubles: the square passes a long
    chi = off * off * float(a + b) / (F.lit(float(a)) * float(b) * n * F.greatest(F.lit(a + b) - n, F.lit(1)))
    best = counts.where(n >= least_rows).withColumn("chi", chi).where(F.col("chi") >= least_chi)
    return np.array(sorted(r["term"] for r in best.orderBy(F.desc("chi"), "term").select("term").limit(most).collect()), np.int64)


def placed(rows: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, start of each row in places, places) of ``rows``, in the order of their ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(chosen)
        for batch in batches:
            found = pa.array([terms(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("label"), found], ["seq", "label", "at"])

    got = rows.select("text", "seq", "label").mapInArrow(run, "seq long, label int, at array<int>").toPandas().sort_values("seq")
    lists = got["at"].tolist()
    start = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return got["label"].to_numpy(np.float64), start, np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)])


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """text, label, seq of at most ``rows`` documents with a label, drawn by the hash
    of their id; several labels of a document count as the largest, and of several
    documents of one id one is taken, by the digest of its text."""
    kept = labels.where(F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    kept = kept.withColumn("seq", F.xxhash64("doc_id")).orderBy("seq", "doc_id").limit(rows)
    names = [c for c in docs.columns if c not in ("doc_id", "label", "seq")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names)
    met = texts.join(F.broadcast(kept), "doc_id")  # bounded by ``rows``
    one = met.groupBy("doc_id").agg(F.min_by(F.struct("label", "seq", *names), F.xxhash64("text")).alias("row"))
    return written(one.select("doc_id", "row.*"), "sample")
