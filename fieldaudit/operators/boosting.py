"""Gradient-boosted trees grown leaf by leaf from histograms (STA15), for two classes under log loss.

Features are cut into bins once. A tree grows best-first: the leaf whose split gains most is split next, until ``leaves`` leaves
stand or no split gains. What a split gains is read off sums of gradients per (node, feature, bin), and one pass over the rows makes
the sums of all nodes that the best-first order asks for next, so that a tree costs about as many passes as it has levels. Sums are
made in the tasks, added by (node, feature) in one small shuffle, and turned into the best split there: the driver sees one row per
node and feature, and holds the trees. Rows carry their raw score; it is written anew every ``WRITE_ROUNDS`` rounds, and trees since
then are applied in the pass. A sample that one task holds (``TASK_ROWS``) is fitted in that task.

Ties: gains that agree to nine digits go to the lower feature, then to the lower bin; among leaves, to the one made first. Null
and NaN features lie in the first bin; rows without a label are left out; a frame with one class only gives one tree without a split, and so does one
of fewer than twice ``LEAST_ROWS`` rows; fitting an empty frame is an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.sources.store import cut

BINS = 255
ROUNDS, LEAVES, RATE, LEAST_ROWS, LEAST_HESSIAN = 220, 31, 0.1, 20, 1e-3
WRITE_ROUNDS = 20
#: A sample of at most so many rows is what one task holds; its rounds run in that task, with the same results.
TASK_ROWS = 20_000


@dataclass
class Tree:
    """Nodes in the order in which they were made; ``feature`` is -1 at a leaf. Rows with a bin up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(0.0)
        return self.left[node], self.left[node] + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of a matrix of bins."""
        feature, at, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node = np.zeros(len(bins), np.int64)
        todo = np.arange(len(bins))
        while len(todo):
            todo = todo[feature[node[todo]] >= 0]
            here = node[todo]
            node[todo] = left[here] + (bins[todo, feature[here]] > at[here])
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(bins)]


@dataclass
class Model:
    """Borders of the bins per feature (a value's bin is the number of borders below it), the start, and the trees."""

    borders: list[list[float]]
    start: float
    trees: list[Tree]

    def bins(self, values: np.ndarray) -> np.ndarray:
        values = np.where(np.isnan(values), -np.inf, values)
        return np.stack([np.searchsorted(b, values[:, k]) for k, b in enumerate(self.borders)], 1).astype(np.uint8)

    def raw(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        return self.start + sum((t.scores(bins) for t in self.trees), np.zeros(len(values)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array column as a matrix; nulls inside are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def borders_of(df: DataFrame, features: str, width: int, bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` borders per feature: between distinct values where these are few, else at quantiles."""
    shares = [k / bins for k in range(1, bins)]
    value = lambda k: F.nanvl(F.get(F.col(features), F.lit(k)).cast("double"), F.lit(None))
    row = df.agg(*[F.percentile_approx(value(k), shares, 50_000).alias(f"q{k}") for k in range(width)]).first()
    return [sorted(set(q or ())) for q in row]


def gain(g, h):
    return g * g / h


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int, float, float, float]:
    """(gain, bin, and the left side's sums) of the best cut through one feature's bins; no gain where no cut is allowed."""
    left = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    right = g.sum() - left[0], h.sum() - left[1], n.sum() - left[2]
    fit = (left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    if not fit.any():
        return 0.0, 0, 0.0, 0.0, 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        more = np.where(fit, gain(*left[:2]) + gain(*right[:2]) - gain(g.sum(), h.sum()), -np.inf)
    at = int(np.argmax(np.round(more, 9)))
    return float(more[at]), at, float(left[0][at]), float(left[1][at]), float(left[2][at])


SUMS = "node int, feature int, g binary, h binary, n binary"
SPLITS = "node int, feature int, gain double, bin int, g double, h double, n double, all_g double, all_h double, all_n double"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class Split(NamedTuple):
    """The best split of a node by one feature, with the sums left of it and in all."""

    node: int
    feature: int
    gain: float
    bin: int
    g: float
    h: float
    n: float
    all_g: float
    all_h: float
    all_n: float


def node_sums(bins: np.ndarray, y: np.ndarray, raw: np.ndarray, tree: Tree, nodes: list[int]) -> np.ndarray:
    """Sums of gradients, Hessians and rows by (node, feature, bin), as an array [3, nodes, features, 256]."""
    width = bins.shape[1]
    slot_of = np.full(len(tree.feature), -1)
    slot_of[nodes] = np.arange(len(nodes))
    slot = slot_of[tree.places(bins)]
    mine = slot >= 0
    bins, y, slot, p = bins[mine], y[mine], slot[mine], 1 / (1 + np.exp(-raw[mine]))
    at = ((slot[:, None] * width + np.arange(width)) * 256 + bins).ravel()
    size = len(nodes) * width * 256
    return np.stack([np.bincount(at, np.repeat(w, width), size) for w in (p - y, p * (1 - p), np.ones(len(p)))]).reshape(3, len(nodes), width, 256)


def split_of(node: int, feature: int, sums: np.ndarray) -> Split:
    return Split(node, feature, *best_split(*sums), *sums.sum(axis=1).tolist())


def splits(state: DataFrame, width: int, recent: list[Tree], tree: Tree, nodes: list[int]) -> list[Split]:
    """The best split of every node and feature, over rows (bins, y, raw) of a frame."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes), width, 256))
        for batch in batches:
            bins, y, raw = columns_of(batch, width)
            total += node_sums(bins, y, raw + sum((t.scores(bins) for t in recent), np.zeros(len(bins))), tree, nodes)
        rows = [[node, f, *(total[k, s, f].tobytes() for k in range(3))] for s, node in enumerate(nodes) for f in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_schema(SUMS))], schema=arrow_schema(SUMS))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for node, f, *parts in zip(*(batch.column(k).to_pylist() for k in range(5))):
                part = np.stack([np.frombuffer(x) for x in parts])
                held[node, f] = held[node, f] + part if (node, f) in held else part
        if held:
            rows = [split_of(*key, v) for key, v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_schema(SPLITS))], schema=arrow_schema(SPLITS))

    return [Split(*row) for row in state.mapInArrow(sums, SUMS).repartition("node", "feature").mapInArrow(best, SPLITS).collect()]


def columns_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    return bins, *(np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (1, 2))


def grow(best_splits, leaves: int, rate: float) -> Tree:
    """One tree, best-first. ``best_splits`` of (tree, nodes) is asked for the nodes that the order reaches with what is known so far."""
    tree, cuts, sums = Tree(), {}, {}
    asked = [0]
    while asked:
        found: dict[int, list[Split]] = {}
        for row in best_splits(tree, asked):
            found.setdefault(row.node, []).append(row)
        for node in asked:
            rows = found[node]
            sums[node] = rows[0].all_g, rows[0].all_h
            top = max(rows, key=lambda r: (round(r.gain, 9), -r.feature))
            cuts[node] = top if top.gain > 1e-9 else None
        asked = []
        for node in order(tree, cuts, leaves):
            if tree.feature[node] < 0:
                asked += tree.split(node, cuts[node].feature, cuts[node].bin)
    return pruned(tree, cuts, sums, leaves, rate)


def grown_in_one_task(state: DataFrame, width: int, rounds: int, leaves: int, rate: float) -> list[Tree]:
    """All rounds over a frame of one task's size, in that task: the same sums, without a job for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [columns_of(batch, width) for batch in batches]
        if not parts:
            return
        bins, y, raw = (np.concatenate(c) for c in zip(*parts))
        raw, done = raw.copy(), []

        def best(tree, nodes):
            sums = node_sums(bins, y, raw, tree, nodes)
            return [split_of(node, f, sums[:, s, f]) for s, node in enumerate(nodes) for f in range(width)]

        for _ in range(rounds):
            done.append(grow(best, leaves, rate))
            raw += done[-1].scores(bins)
            if len(done[-1].feature) == 1:
                break
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([vars(t) for t in done])])], ["trees"])

    (row,) = state.coalesce(1).mapInArrow(run, "trees string").collect()
    return [Tree(**t) for t in json.loads(row.trees)]


def order(tree: Tree, cuts: dict, leaves: int) -> list[int]:
    """The nodes that are split, best first, as far as their gains are known."""
    open_nodes, done = [0], []
    while len(done) < leaves - 1:
        known = [n for n in open_nodes if cuts.get(n) is not None]
        if not known:
            break
        node = max(known, key=lambda n: (round(cuts[n].gain, 9), -n))
        done.append(node)
        open_nodes.remove(node)
        if tree.feature[node] >= 0:
            open_nodes += [tree.left[node], tree.left[node] + 1]
    return done


def pruned(tree: Tree, cuts: dict, sums: dict, leaves: int, rate: float) -> Tree:
    """The tree of the final order, without nodes that were only tried, and with the values of its leaves."""
    out, place = Tree(), {0: 0}
    for node in order(tree, cuts, leaves):
        a, b = out.split(place[node], tree.feature[node], tree.bin[node])
        place[tree.left[node]], place[tree.left[node] + 1] = a, b
    for old, new in place.items():
        g, h = sums[old]
        out.value[new] = -rate * g / h if h > 0 else 0.0
    return out


def fit(df: DataFrame, features: str, label: str, rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE) -> Model:
    """Fits on an array column and a label of 0 and 1."""
    df = cut(df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(features, label))
    first = df.agg(F.max(F.size(features)), F.min(F.size(features)), F.avg(F.col(label).cast("double")), F.count("*")).first()
    if first[0] is None or first[0] != first[1]:
        raise ValueError("features need rows, and one length")
    width, share = first[0], min(max(first[2], 1e-12), 1 - 1e-12)
    model = Model(borders_of(df, features, width), math.log(share / (1 - share)), [])
    binned = Model(model.borders, 0.0, [])

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in binned.bins(matrix(batch.column(0), width))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), pa.array(np.full(len(rows), model.start))], ["bins", "y", "raw"])

    schema = "bins binary, y double, raw double"
    state = df.select(F.col(features), F.col(label).cast("double")).mapInArrow(to_bins, schema)
    if first[3] <= TASK_ROWS:
        model.trees = grown_in_one_task(state, width, rounds, leaves, rate)
        return model
    state = cut(state)
    recent: list[Tree] = []
    for _ in range(rounds):
        recent.append(grow(lambda tree, nodes: splits(state, width, recent, tree, nodes), leaves, rate))  # noqa: B023
        model.trees.append(recent[-1])
        if len(recent[-1].feature) == 1:
            break  # no split is allowed, and no later tree will find one
        if len(recent) == WRITE_ROUNDS:
            state = cut(state.mapInArrow(adding(list(recent), width), schema))
            recent = []
    return model


def adding(trees: list[Tree], width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            raw = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)) + sum(t.scores(bins) for t in trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw)], ["bins", "y", "raw"])

    return add


def scored(df: DataFrame, model: Model, features: str, out: str = "prob") -> DataFrame:
    """Adds the probability of class 1; rows without features get none."""
    width = len(model.borders)

    @F.arrow_udf("double")
    def probability(values: pa.Array) -> pa.Array:
        there = np.asarray(values.is_valid())
        result = np.full(len(values), np.nan)
        if there.any():
            result[there] = 1 / (1 + np.exp(-model.raw(matrix(values.filter(pa.array(there)), width))))
        return pa.array(result, mask=~there)

    return df.withColumn(out, probability(F.col(features)))
