"""Quality by co-training: two views of a document teach each other.

The content view sees the terms and the make-up of the text; the metadata view
sees language, source and length. Both are fitted on labelled rows. In each round each
view scores all unlabelled documents, and those that it is surest of, by a global quantile
for each class, are labelled for the other view: what these say of its features
(how often each goes with which class) comes from all of them by aggregation, and the other
view is fitted anew with that as a feature. The share of documents that are labelled so grows
from round to round. At the end each view is calibrated on labelled rows that neither was
fitted on, and a logistic combination of both, fitted on the same rows, scores all documents.

Texts are read once, for the features of all documents, which are written as a table; rounds and
scores read that. Only the fit on labelled rows is bounded, by ``TRAIN_ROWS``, drawn by the hash of the id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import written
from docgrid.llm.terms import Terms, choose, sample
from docgrid.llm.toxicity import held_out

TRAIN_ROWS = 12_000
TERMS = 2048
ROUNDS = 3
PER_ROUND = 0.05  # share of the unlabelled documents that a view labels in the first round
SURE = 0.9
BINS = 1000
META = 512
MAKEUP = 8
SPLIT = "abs(xxhash64(doc_id, 7)) % 4 = 0"


def makeup(text: str | None) -> list[float]:
    """Shares that tell prose from junk, each about 0 to 1."""
    t = text or ""
    n, tokens, lines = max(1, len(t)), t.split(), t.split("\n")
    letters = sum(map(str.isalpha, t))
    digits = sum(map(str.isdigit, t))
    spaces = sum(map(str.isspace, t))
    m = max(1, len(tokens))
    return [
        letters / n,
        digits / n,
        (len(t) - letters - digits - spaces) / n,
        len(set(tokens)) / m,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(t) / m / 20),
        min(1.0, math.log1p(len(tokens)) / 10),
        sum(1 for w in tokens if w[-1] in ".,!?") / m,
    ]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Places of the metadata view's features."""
    size = 31 if n_chars is None else min(30, int(2 * math.log2(1 + max(0, n_chars))))
    return [zlib.crc32(f"lang {lang}".encode()) % 64, 64 + zlib.crc32(f"source {source}".encode()) % 384, 448 + size]


@dataclass
class Sets:
    """Rows of places (content or metadata): the places of all rows in turn, and where each row starts."""

    at: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Sets:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        start = column.offsets.to_numpy().astype(np.int64)
        return Sets(column.values.to_numpy()[start[0] : start[-1]].astype(np.int64), start - start[0])

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def sums(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.at], len(self.start) - 1)


class Logistic:
    """Logistic regression over sets of places and a few dense features."""

    def __init__(self, places: int, dense: int = 0) -> None:
        self.w, self.d, self.bias = np.zeros(places), np.zeros(dense), 0.0
        self.mean, self.scale = np.zeros(dense), np.ones(dense)

    def logits(self, sets: Sets, dense: np.ndarray) -> np.ndarray:
        return np.clip(sets.sums(self.w) + ((dense - self.mean) / self.scale) @ self.d + self.bias, -30, 30)

    def fit(self, sets: Sets, dense: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Logistic:
        if not len(y):
            return self
        n, row, at = len(y), sets.row, sets.at
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        x = (dense - self.mean) / self.scale
        self.w[:], self.d[:] = 0, 0
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        p = [self.w, self.d, np.array([math.log(share / (1 - share))])]
        m = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
        for step in range(1, steps + 1):
            z = np.bincount(row, self.w[at], n) + x @ self.d + p[2][0]
            e = (_sigmoid(z) - y) / n
            for a, g, (m1, m2) in zip(p, (np.bincount(at, e[row], len(self.w)) + decay * self.w, x.T @ e + decay * self.d, np.array([e.sum()])), m):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                a -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        self.bias = float(p[2][0])
        return self


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class View:
    """One view: a logistic regression over its places, its dense features, and what the
    other view's labels say of its places (``taught``: a log ratio for each)."""

    def __init__(self, places: int, dense: int) -> None:
        self.model = Logistic(places, dense + 1)
        self.taught = np.zeros(places)

    def _dense(self, sets: Sets, dense: np.ndarray) -> np.ndarray:
        mean = sets.sums(self.taught) / np.maximum(1, np.diff(sets.start))
        return np.concatenate((dense, mean[:, None]), axis=1)

    def fit(self, sets: Sets, dense: np.ndarray, y: np.ndarray) -> None:
        self.model.fit(sets, self._dense(sets, dense), y)

    def logits(self, sets: Sets, dense: np.ndarray) -> np.ndarray:
        return self.model.logits(sets, self._dense(sets, dense))

    def learn(self, counts: np.ndarray, rows: np.ndarray) -> None:
        """``counts`` (class, place) of the rows labelled by the other view, ``rows`` of each class."""
        share = (counts + 1.0) / (rows[:, None] + 2.0)
        self.taught = np.log(share[1] / share[0])


@dataclass
class Features:
    """Features of rows, by view."""

    content: Sets
    dense: np.ndarray
    meta: Sets

    @staticmethod
    def of(rows: pa.RecordBatch | pa.Table) -> Features:
        dense = np.array(rows.column("dense").to_pylist(), np.float64).reshape(rows.num_rows, MAKEUP)
        return Features(Sets.of(rows.column("content")), dense, Sets.of(rows.column("meta")))


class CoTrained:
    """Both views with their calibration, and the combination."""

    def __init__(self, chosen: np.ndarray) -> None:
        self.chosen = chosen
        self.content, self.meta = View(len(chosen), MAKEUP), View(META, 0)
        self.calibrated = [Logistic(0, 1), Logistic(0, 1)]
        self.combined = Logistic(0, 2)

    def logits(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        return self.content.logits(f.content, f.dense), self.meta.logits(f.meta, np.zeros((len(f.dense), 0)))

    def fit_views(self, f: Features, y: np.ndarray) -> None:
        self.content.fit(f.content, f.dense, y)
        self.meta.fit(f.meta, np.zeros((len(y), 0)), y)

    def calibrate(self, f: Features, y: np.ndarray) -> CoTrained:
        none, z = _no_sets(len(y)), self.logits(f)
        both = np.stack([c.fit(none, v[:, None], y).logits(none, v[:, None]) for c, v in zip(self.calibrated, z)], axis=1)
        self.combined.fit(none, both, y)
        return self

    def scores(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated content score, calibrated metadata score, combined score."""
        none = _no_sets(len(f.dense))
        z = [c.logits(none, v[:, None]) for c, v in zip(self.calibrated, self.logits(f))]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.combined.logits(none, np.stack(z, axis=1)))


def _no_sets(n: int) -> Sets:
    return Sets(np.zeros(0, np.int64), np.zeros(n + 1, np.int64))


def features(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """doc_id, content, dense, meta of each row: the only pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(chosen)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column("text").to_pylist()
                meta = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
                arrays = [pa.array([terms(t) for t in texts], pa.list_(pa.int32())), pa.array([makeup(t) for t in texts], pa.list_(pa.float32())), pa.array([metadata(*m) for m in meta], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "content", "dense", "meta"])

    return docs.mapInArrow(run, "doc_id long, content array<int>, dense array<float>, meta array<int>")


def _spread(free: DataFrame, model: CoTrained) -> np.ndarray:
    """How many of the unlabelled rows have which score: (view, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for view, z in enumerate(model.logits(Features.of(batch))):
                n[view] += np.bincount(_bin(z), minlength=BINS)
        view, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(at), pa.array(n[view, at])], ["view", "bin", "n"])

    out = np.zeros((2, BINS), np.int64)
    for r in free.mapInArrow(run, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["view"], r["bin"]] = r["n"]
    return out


def _bin(z: np.ndarray) -> np.ndarray:
    return np.minimum((_sigmoid(z) * BINS).astype(np.int64), BINS - 1)


def _bounds(n: np.ndarray, share: float, good: float) -> tuple[int, int]:
    """The bins up to which class 0 and from which class 1 is taken: the surest ``share`` of the
    rows, by the classes' shares, as far as the view is ``SURE``; a bin is taken whole."""
    low = int(np.searchsorted(np.cumsum(n), max(1, n.sum() * share * (1 - good))))
    high = BINS - 1 - int(np.searchsorted(np.cumsum(n[::-1]), max(1, n.sum() * share * good)))
    return min(low, round((1 - SURE) * BINS) - 1), max(high, round(SURE * BINS))


def _lessons(free: DataFrame, model: CoTrained, bounds: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the pupils content and metadata: counts (class, place) and rows (class) over all
    unlabelled documents that the other view is sure of. One row a task and place is shuffled."""
    sizes = (len(model.chosen), META)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((2, size + 1), np.int64) for size in sizes]
        for batch in batches:
            f = Features.of(batch)
            bins = [_bin(z) for z in model.logits(f)]
            for pupil, sets in ((0, f.content), (1, f.meta)):
                low, high = bounds[1 - pupil]
                sure = bins[1 - pupil]
                for label, taken in ((0, sure <= low), (1, sure >= high)):
                    counts[pupil][label, :-1] += np.bincount(sets.at[taken[sets.row]], minlength=sizes[pupil])
                    counts[pupil][label, -1] += int(taken.sum())
        rows = [(pupil, label, at, c[label, at]) for pupil, c in enumerate(counts) for label, at in np.argwhere(c)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)], ["pupil", "label", "place", "n"])

    out = [np.zeros((2, size + 1)) for size in sizes]
    for r in free.mapInArrow(run, "pupil long, label long, place long, n long").groupBy("pupil", "label", "place").agg(F.sum("n").alias("n")).collect():
        out[r["pupil"]][r["label"], r["place"]] = r["n"]
    return [(c[:, :-1], c[:, -1]) for c in out]


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[CoTrained, DataFrame]:
    """The model, from labelled rows that are not held out and all unlabelled rows, and the
    table of all rows' features."""
    docs = _columns(docs)
    known = sample(docs, labels.where(~held_out()), "quality", train_rows)
    chosen = choose(known.where(f"not ({SPLIT})"), TERMS)
    every = written(features(docs, chosen), "features")
    rows = features(known, chosen).join(F.broadcast(known.select("doc_id", "label", "seq")), "doc_id")  # bounded by ``train_rows``
    got = rows.select("*", F.expr(SPLIT).alias("apart")).toArrow().sort_by("seq")
    y, apart = got.column("label").to_numpy().astype(np.float64), got.column("apart").to_numpy()
    model = CoTrained(chosen)
    if not len(y):
        return model, every
    apart = apart if apart.any() and not apart.all() else np.ones(len(y), bool)
    fitted = ~apart if not apart.all() else apart
    f, good = Features.of(got.filter(pa.array(fitted))), float(y[fitted].mean())
    model.fit_views(f, y[fitted])
    free = written(every.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").drop("doc_id"), "unlabelled")
    for turn in range(rounds):
        n = _spread(free, model)
        if not n.sum():
            break
        lessons = _lessons(free, model, [_bounds(view, PER_ROUND * (turn + 1), good) for view in n])
        for view, (counts, of) in zip((model.content, model.meta), lessons):
            view.learn(counts, of)
        model.fit_views(f, y[fitted])
    return model.calibrate(Features.of(got.filter(pa.array(apart))), y[apart]), every


def report(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, content_score, metadata_score, score, predicted.

    Scores are chances of quality 1. Null texts and metadata are classes of their
    own; a row without id counts as unlabelled. Without usable labels all scores are even.
    Repeated rows each get theirs; other columns are ignored; an empty table gives an empty result."""
    model, every = train(docs, labels, train_rows, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, model.scores(Features.of(batch)))], ["doc_id", "content_score", "metadata_score", "score"])

    rows = every.mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
