"""One-vs-rest logistic regression for blocks of labels at once.

Documents are kept as sparse blocks, a stored table that every pass reads. A
pass evaluates the losses and gradients of all labels of a block: each task
multiplies its sparse rows with the weight matrix, and its partial gradients,
cut into feature ranges, are summed map-side and by range. A pass returns
features × labels of the block, at most ``FIT_CELLS`` numbers, whatever the
number of documents.

Each column of the matrix is a label with an L-BFGS iteration of its own: its
own direction, step and history. A label that has converged leaves its column to
the next one, so the number of passes follows the label-iterations divided by
the width of a block, not the number of labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import store_table

# Features × labels of one block: the driver holds about 20 matrices of this size.
FIT_CELLS = 2_000_000
BLOCK_NONZEROS = 200_000
RANGE_CELLS = 100_000
WORK_CELLS = 100_000  # a product that stays in a core's cache
HISTORY = 8
_TOTALS = -1  # the range of losses and intercept gradients
_BLOCK = "n int, starts binary, ids binary, vals binary, by_id binary, label_starts binary, labels binary"


@dataclass(frozen=True)
class SparseRows:
    """Rows of (id, value) pairs one after another; row r has those from starts[r] to starts[r + 1]."""

    starts: np.ndarray
    ids: np.ndarray
    vals: np.ndarray
    by_id: np.ndarray | None = None  # places of the pairs in the order of their ids, if known

    @classmethod
    def of(cls, ids: pd.Series, vals: pd.Series) -> SparseRows:
        sizes = np.array([0 if i is None else len(i) for i in ids], dtype=np.int64)
        join = lambda lists, kind: np.concatenate([np.empty(0, kind), *(np.asarray(v, kind) for v in lists if v is not None and len(v))])
        return cls(np.append(0, np.cumsum(sizes)), join(ids, np.int64), join(vals, np.float64))

    def _parts(self, width: int) -> Iterator[tuple[int, int]]:
        """Row ranges whose products with a matrix of ``width`` columns take about ``WORK_CELLS``."""
        n, most, low = len(self.starts) - 1, max(1, WORK_CELLS // max(width, 1)), 0
        while low < n:
            high = int(np.searchsorted(self.starts, self.starts[low] + most, side="right")) - 1
            high = min(max(high, low + 1), n, low + most)
            yield low, high
            low = high

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.starts) - 1, matrix.shape[1]))
        for low, high in self._parts(matrix.shape[1]):
            begin, end = self.starts[low], self.starts[high]
            filled = low + np.flatnonzero(np.diff(self.starts[low : high + 1]))
            if len(filled):
                products = self.vals[begin:end, None] * matrix[self.ids[begin:end]]
                out[filled] = np.add.reduceat(products, self.starts[filled] - begin, axis=0)
        return out

    def add_transposed(self, right: np.ndarray, out: np.ndarray) -> None:
        """out += rowsᵀ · right."""
        order = self.order()
        ids, vals = self.ids[order], self.vals[order]
        row_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[order]
        most = max(1, WORK_CELLS // max(right.shape[1], 1))
        for low in range(0, len(ids), most):
            part = slice(low, low + most)
            first = np.flatnonzero(np.append(True, ids[part][1:] != ids[part][:-1]))
            products = vals[part, None] * right[row_of[part]]
            out[ids[part][first]] += np.add.reduceat(products, first, axis=0)

    def order(self) -> np.ndarray:
        return np.argsort(self.ids, kind="stable") if self.by_id is None else self.by_id


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def sparse_blocks(features: DataFrame) -> DataFrame:
    """``labels_idx``, ``feature_ids`` and ``feature_values`` as stored blocks of documents."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.cumsum([0 if i is None else len(i) for i in batch["feature_ids"]])
            for _, part in batch.groupby(sizes // BLOCK_NONZEROS):
                rows = SparseRows.of(part["feature_ids"], part["feature_values"])
                labels = SparseRows.of(part["labels_idx"], part["labels_idx"])
                yield pd.DataFrame([{
                    "n": len(part), "starts": rows.starts.tobytes(), "ids": rows.ids.astype(np.int32).tobytes(),
                    "vals": rows.vals.astype(np.float32).tobytes(), "by_id": rows.order().astype(np.int32).tobytes(), "label_starts": labels.starts.tobytes(),
                    "labels": labels.ids.astype(np.int32).tobytes()}])

    return store_table(features.select("labels_idx", "feature_ids", "feature_values").mapInPandas(pack, _BLOCK), "sparse-blocks")


def _evaluate(blocks: DataFrame, weights: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed losses and gradients of each column; ``weights`` ends with the intercepts.

    ``share`` has the weights of negative and positive documents by column.
    """
    sc = blocks.sparkSession.sparkContext
    sent = sc.broadcast((weights, labels, share))
    d, width = weights.shape[0] - 1, weights.shape[1]
    step = max(1, RANGE_CELLS // width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, columns, factor = sent.value
        place = {int(idx): at for at, idx in enumerate(columns)}
        gradient, totals, touched = np.zeros((d, width)), np.zeros((2, width)), np.zeros(d, dtype=bool)
        for batch in batches:
            for block in batch.itertuples(index=False):
                rows = SparseRows(np.frombuffer(block.starts, np.int64), np.frombuffer(block.ids, np.int32), np.frombuffer(block.vals, np.float32).astype(float),
                                  np.frombuffer(block.by_id, np.int32))
                margin = rows.times(matrix[:-1]) + matrix[-1]
                y = np.zeros(margin.shape, dtype=bool)
                sizes = np.diff(np.frombuffer(block.label_starts, np.int64))
                at = np.array([place.get(i, -1) for i in np.frombuffer(block.labels, np.int32).tolist()], dtype=np.int64)
                y[np.repeat(np.arange(block.n), sizes)[at >= 0], at[at >= 0]] = True
                weight = np.where(y, factor[1], factor[0])
                totals[0] += (weight * np.logaddexp(0, np.where(y, -margin, margin))).sum(axis=0)
                rest = weight * (sigmoid(margin) - y)
                totals[1] += rest.sum(axis=0)
                rows.add_transposed(rest, gradient)
                touched[rows.ids] = True
        out = [(_TOTALS, totals.ravel())]
        out += [(low // step, gradient[low : low + step].ravel()) for low in range(0, d, step) if touched[low : low + step].any()]
        yield pd.DataFrame(out, columns=["range", "cells"])

    partial = blocks.mapInPandas(run, "range int, cells array<double>").select("range", array_to_vector("cells").alias("cells"))
    summed = partial.groupBy("range").agg(vector_to_array(Summarizer.sum(F.col("cells"))).alias("cells"))
    gradient, losses = np.zeros((d + 1, width)), np.zeros(width)
    for row in summed.toPandas().itertuples(index=False):
        cells = np.asarray(row.cells).reshape(-1, width)
        if row.range == _TOTALS:
            losses, gradient[-1] = cells[0], cells[1]
        else:
            gradient[row.range * step : row.range * step + len(cells)] = cells
    sent.destroy()
    return losses, gradient


@dataclass(frozen=True)
class Problem:
    """Mean weighted log loss plus half ``penalty`` times the squared weights, without the intercept."""

    blocks: DataFrame
    n: int
    penalty: float
    share: dict[int, tuple[float, float]]

    def at(self, weights: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = np.array([self.share.get(int(i), (1.0, 1.0)) for i in labels]).T
        losses, gradient = _evaluate(self.blocks, weights, labels, share)
        losses, gradient = losses / self.n, gradient / self.n
        gradient[:-1] += self.penalty * weights[:-1]
        return losses + self.penalty / 2 * (weights[:-1] ** 2).sum(axis=0), gradient


class _Columns:
    """L-BFGS state of the labels in the block; arrays have a column per label."""

    def __init__(self, size: int, labels: list[int]):
        k = len(labels)
        self.labels = np.array(labels)
        self.weights, self.gradient, self.direction = (np.zeros((size, k)) for _ in range(3))
        self.loss, self.step, self.slope = np.full(k, np.inf), np.zeros(k), np.zeros(k)
        self.fresh, self.rounds = np.ones(k, dtype=bool), np.zeros(k, dtype=int)
        self.moves, self.turns = np.zeros((HISTORY, size, k)), np.zeros((HISTORY, size, k))
        self.inverse = np.zeros((HISTORY, k))  # 0 where a column has no such pair
        self.next = 0

    def trial(self) -> np.ndarray:
        return self.weights + self.step * self.direction

    def take(self, trial: np.ndarray, loss: np.ndarray, gradient: np.ndarray) -> None:
        """Move the columns whose loss fell enough, shorten the steps of the others."""
        good = self.fresh | (loss <= self.loss + 1e-4 * self.step * self.slope + 1e-14)
        move, turn = np.where(good, trial - self.weights, 0), np.where(good, gradient - self.gradient, 0)
        curved = (move * turn).sum(axis=0)
        usable = good & ~self.fresh & (curved > 1e-16)
        self.moves[self.next], self.turns[self.next] = move, turn
        self.inverse[self.next] = np.where(usable, 1 / np.where(usable, curved, 1), 0)
        self.next = (self.next + 1) % HISTORY
        self.weights, self.gradient = np.where(good, trial, self.weights), np.where(good, gradient, self.gradient)
        self.loss = np.where(good, loss, self.loss)
        self.rounds += good & ~self.fresh
        self.fresh &= ~good
        fresh_direction = self._descend()
        self.direction = np.where(good, fresh_direction, self.direction)
        self.step = np.where(good, 1.0, self.step / 4)
        self.slope = (self.gradient * self.direction).sum(axis=0)

    def _descend(self) -> np.ndarray:
        order = [(self.next + i) % HISTORY for i in range(HISTORY)]  # oldest first
        q, shares = self.gradient.copy(), {}
        for i in reversed(order):
            shares[i] = self.inverse[i] * (self.moves[i] * q).sum(axis=0)
            q -= shares[i] * self.turns[i]
        scale = np.full(q.shape[1], 2.0)
        for i in order:
            length = (self.turns[i] ** 2).sum(axis=0)
            known = (self.inverse[i] > 0) & (length > 0)
            scale = np.where(known, 1 / np.where(known, self.inverse[i] * length, 1), scale)
        q *= scale
        for i in order:
            back = self.inverse[i] * (self.turns[i] * q).sum(axis=0)
            q += self.moves[i] * (shares[i] - back)
        return -q

    def steepness(self) -> np.ndarray:
        return np.abs(self.gradient).max(axis=0)

    def replace(self, at: int, label: int) -> None:
        self.labels[at], self.fresh[at], self.loss[at], self.rounds[at] = label, True, np.inf, 0
        for array in (self.weights, self.gradient, self.direction):
            array[:, at] = 0
        self.step[at] = self.slope[at] = 0
        self.inverse[:, at] = 0

    def keep(self, at: np.ndarray) -> None:
        for name in ("labels", "loss", "step", "slope", "fresh", "rounds"):
            setattr(self, name, getattr(self, name)[at])
        for name in ("weights", "gradient", "direction", "inverse"):
            setattr(self, name, getattr(self, name)[:, at])
        self.moves, self.turns = self.moves[:, :, at], self.turns[:, :, at]


def minimise(problem: Problem, n_features: int, labels: list[int], tol: float, max_iter: int, cells: int | None = None) -> Iterator[tuple[int, np.ndarray, float]]:
    """(label, weights with the intercept last, largest gradient entry), as the labels finish.

    A label finishes when no gradient entry exceeds ``tol``, after ``max_iter``
    steps, or when no step lowers its loss any more.
    """
    width = max(1, (cells or FIT_CELLS) // (n_features + 1))
    waiting = list(reversed(labels))
    state = _Columns(n_features + 1, [waiting.pop() for _ in range(min(width, len(waiting)))])
    while len(state.labels):
        trial = state.trial()
        state.take(trial, *problem.at(trial, state.labels))
        steep = state.steepness()
        over = ~state.fresh & ((steep <= tol) | (state.rounds >= max_iter) | (state.step < 1e-9))
        stay = np.ones(len(over), dtype=bool)
        for at in np.flatnonzero(over):
            yield int(state.labels[at]), state.weights[:, at].copy(), float(steep[at])
            if waiting:
                state.replace(at, waiting.pop())
            else:
                stay[at] = False
        if not stay.all():
            state.keep(np.flatnonzero(stay))
