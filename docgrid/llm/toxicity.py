"""Toxicity by a factorization machine over hashed terms.

The score of a text is the logistic of a bias, a weight for each term that it has,
and for each pair of its terms the product of their factor vectors; pairs such as
an insult with the mention of a group so get a weight of their own, which single
weights cannot give. Terms are words and the beginnings of longer words.

It is fitted on at most ``train_rows`` labelled documents. The labels never enter a
score, nor do language, source or id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.terms import Terms, choose, placed, sample

#: Bound of the labelled sample, and of the terms that the machine knows.
TRAIN_ROWS = 20_000
TERMS = 4096
RANK = 4
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


class FactorizationMachine:
    """Second order, over sets of terms: score = logistic(bias + sum w + sum of <v_i, v_j> over pairs)."""

    def __init__(self, terms: int, rank: int = RANK, seed: int = 42) -> None:
        self.bias = 0.0
        self.w = np.zeros(terms)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (terms, rank))

    def logit(self, at: list[int]) -> float:
        if not at:
            return self.bias
        v = self.v[at]
        s = v.sum(axis=0)
        return float(self.bias + self.w[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, at: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(at), -30, 30))))

    def fit(self, label: np.ndarray, start: np.ndarray, at: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 2e-4) -> FactorizationMachine:
        """Full-batch Adam on the mean logistic loss with weight decay."""
        n = len(label)
        if not n:
            return self
        row = np.repeat(np.arange(n), np.diff(start))
        mean = min(max(label.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        params = [np.array([self.bias]), self.w, self.v]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        rank, size = self.v.shape[1], len(self.w)
        by_row = lambda x: np.bincount(row, x, n)
        by_term = lambda x: np.bincount(at, x, size)
        for step in range(1, steps + 1):
            v = self.v[at]
            s = np.stack([by_row(v[:, k]) for k in range(rank)], axis=1)
            q = by_row((v * v).sum(axis=1))
            z = params[0][0] + by_row(self.w[at]) + 0.5 * ((s * s).sum(axis=1) - q)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
            e = err[row]
            inner = e[:, None] * (s[row] - v)
            grads = [np.array([err.sum()]), by_term(e) + decay * self.w, np.stack([by_term(inner[:, k]) for k in range(rank)], axis=1) + decay * self.v]
            for p, g, (m1, m2) in zip(params, grads, moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        self.bias = float(params[0][0])
        return self


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: int = TERMS, rank: int = RANK) -> tuple[np.ndarray, FactorizationMachine]:
    """The chosen terms and the fitted machine, from labelled rows that are not held out."""
    rows = sample(docs.select("doc_id", "text"), labels.where(~held_out()), "toxic", train_rows)
    chosen = choose(rows, terms)
    return chosen, FactorizationMachine(len(chosen), rank).fit(*placed(rows, chosen))


def scored(docs: DataFrame, model: tuple[np.ndarray, FactorizationMachine], column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; one pass, no shuffle. Null and
    empty texts get the score of a text without known terms. A column of that
    name is replaced."""
    chosen, machine = model
    kept = [c for c in docs.columns if c != column]
    schema = docs.select(kept).schema.add(column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(chosen)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scores = pa.array([machine.score(terms(t)) for t in batch.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], [*kept, column])

    return docs.select(kept).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on).

    Without usable labels the score is even for all; repeated rows each get theirs;
    an empty table gives an empty result."""
    model = train(docs, labels, train_rows)
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
