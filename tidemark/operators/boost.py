"""Histogram boosting: blocks of rows hold their bins and scores, trees are grown from binned gradient sums.

A step of growth is one job: each task goes through its blocks (some thousand rows as a few arrays), brings scores up to date with the
trees since they were last written, and adds up gradients by node, feature and bin for all trees of the round at once;
Spark adds up the tasks' sums, and the driver, which sees only those, picks the splits. Of two siblings only the smaller
one is counted, the other is its parent less it. Scores are written out every few rounds, so a lost executor costs those
rounds at most.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import logistic, softmax
from tidemark.operators.cut import cut
from tidemark.operators.predicates import tree_column

#: Rounds between cuts of the score table's lineage; trees a model scores as expressions, more are scored in Arrow batches.
CUT_EVERY, EXPRESSIONS = 10, 20
#: Rows of sums that come to the driver at most without being added up over the tasks before.
MOST_ROWS = 1 << 19


def edges(df: DataFrame, features: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Distinct quantile edges of each feature, so that bin <= k exactly if x <= edges[k]; 254 at most.

    Edges are values of the feature, from one pass over all features with a rank error of 1e-5 at most.
    """
    at = [(k + 1) / bins for k in range(min(bins, 255) - 1)]
    if not features or not at:
        return {c: [] for c in features}
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    found = df.agg(*(F.percentile_approx(x, at, 100_000).alias(f"q{k}") for k, x in enumerate(numbers))).first()
    return {c: sorted(set(found[k] or ())) for k, c in enumerate(features)}


def _walk(tree: tuple, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The tree's values over columns of numbers; what is not at most a threshold (NaN too) goes right."""
    out = np.empty(n)

    def go(node: tuple, rows: np.ndarray) -> None:
        if node[0] == "leaf":
            out[rows] = node[1]
            return
        left = columns[node[1]][rows] <= node[2]
        go(node[3], rows[left])
        go(node[4], rows[~left])

    go(tree, np.arange(n))
    return out


@dataclass
class Boosted:
    """An additive model: base scores and trees by output (one for regression and binary, one a class else)."""

    objective: str
    features: list[str]
    bases: list[float]
    rate: float
    trees: list[list[tuple]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def scores(self) -> list[Column]:
        """Raw scores as column expressions."""
        out = []
        for k, base in enumerate(self.bases):
            score = F.lit(base)
            for stage in self.trees:
                score = score + self.rate * tree_column(stage[k])
            out.append(score)
        return out

    def scored(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """df, with raw score columns __raw<k> if the model is large, and the scores as columns."""
        if len(self.trees) <= EXPRESSIONS:
            return df, self.scores()
        names = [f"__raw{k}" for k in range(len(self.bases))]
        kept, features, bases, rate, trees = df.columns, self.features, self.bases, self.rate, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = {c: batch.column(len(kept) + k).to_numpy(zero_copy_only=False).astype(np.float64) for k, c in enumerate(features)}
                raw = [np.full(n, b) for b in bases]
                for stage in trees:
                    for k, tree in enumerate(stage):
                        raw[k] += rate * _walk(tree, x, n)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *map(pa.array, raw)], names=[*kept, *names])

        numbers = df.select("*", *(F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(features)))
        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
        return numbers.mapInArrow(run, schema), [F.col(n) for n in names]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction (regression), or probability_<k> by class."""
        rows, raw = self.scored(df)
        if self.objective == "regression":
            made = {"prediction": raw[0]}
        elif self.objective == "binary":
            made = {"probability_1": logistic(raw[0]), "probability_0": 1 - logistic(raw[0])}
        else:
            made = {f"probability_{k}": p for k, p in enumerate(softmax(raw))}
        return rows.withColumns(made).drop(*(c for c in rows.columns if c.startswith("__raw") and c not in df.columns))


#: A block's columns, each the bytes of an array.
_BLOCK = {"bins": np.uint8, "y": np.float64, "w": np.float64, "valid": np.bool_, "u": np.int64, "s": np.float64}
_STORED = ", ".join(f"{name} binary" for name in _BLOCK)


def _packed(arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary()) for x, kind in zip(arrays, _BLOCK.values(), strict=True)], names=list(_BLOCK))


@dataclass
class _Shape:
    """What a task needs to bring scores and gradients up to date."""

    objective: str
    features: int
    bins: int
    outputs: int
    rate: float
    subsample: float

    def scores(self, block: dict[str, np.ndarray], trees: list[list[tuple]]) -> list[np.ndarray]:
        columns = {str(f): block["bins"][:, f] for f in range(self.features)}
        raw = list(block["s"].copy())
        for stage in trees:
            for k, tree in enumerate(stage):
                raw[k] += self.rate * _walk(tree, columns, len(block["y"]))
        return raw

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                read = {name: np.frombuffer(batch.column(k)[i].as_buffer(), dtype=kind) for k, (name, kind) in enumerate(_BLOCK.items())}
                yield read | {"bins": read["bins"].reshape(-1, self.features), "s": read["s"].reshape(self.outputs, -1)}

    def probabilities(self, raw: list[np.ndarray]) -> np.ndarray:
        z = np.stack(raw)
        z = np.exp(z - z.max(axis=0))
        return z / z.sum(axis=0)

    def gradients(self, y: np.ndarray, raw: list[np.ndarray], limit: float | None) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.objective == "regression":
            residual = raw[0] - y
            return [(residual if limit is None else np.clip(residual, -limit, limit), np.ones(len(y)))]
        if self.objective == "binary":
            p = 1 / (1 + np.exp(-raw[0]))
            return [(p - y, p * (1 - p))]
        return [(p - (y == k), p * (1 - p)) for k, p in enumerate(self.probabilities(raw))]

    def loss(self, y: np.ndarray, raw: list[np.ndarray]) -> np.ndarray:
        if self.objective == "regression":
            return (raw[0] - y) ** 2
        if self.objective == "binary":
            return np.logaddexp(0, np.where(y == 1, -raw[0], raw[0]))
        return -np.log(np.maximum(self.probabilities(raw)[y.astype(np.int64), np.arange(len(y))], 1e-15))

    def drawn(self, u: np.ndarray, turn: int) -> np.ndarray:
        """Rows that a round sees: a hash of the row's own hash and the round."""
        if self.subsample >= 1:
            return np.ones(len(u), dtype=bool)
        mixed = (u.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11) < np.uint64(int(self.subsample * 2**53))


_SUMS = "tree int, node int, feature int, bin int, g double, h double, n long"


def _sums(rows: DataFrame, shape: _Shape, trees: list[list[tuple]], turn: int, growing: list[dict[int, tuple]], wanted: list[list[int]], limit: float | None, first: bool, parts: int) -> tuple[list[dict[int, np.ndarray]], tuple[float, int]]:
    """For each tree and wanted node its (feature, bin, [g, h, n]) sums; and (first) the loss and number of held-out rows."""
    tops = [max(x, default=1) for x in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, b = shape.features, shape.bins
        total = [np.zeros((3, len(w) * f * b)) for w in wanted]
        lost, held = 0.0, 0
        for block in shape.blocks(batches):
            x, y, weight, valid, u = (block[c] for c in ("bins", "y", "w", "valid", "u"))
            raw = shape.scores(block, trees)
            if first and valid.any():
                lost, held = lost + float(shape.loss(y[valid], [r[valid] for r in raw]).sum()), held + int(valid.sum())
            on = np.flatnonzero(~valid & shape.drawn(u, turn))
            x, y, weight, raw = x[on], y[on], weight[on], [r[on] for r in raw]
            for k, (g, h) in enumerate(shape.gradients(y, raw, limit)):
                node = np.ones(len(y), dtype=np.int64)
                for n in sorted(growing[k]):  # parents come before their children
                    feature, cut_at, _ = growing[k][n]
                    here = node == n
                    node[here] = 2 * n + (x[here, feature] > cut_at)
                place = np.full(2 * tops[k] + 2, -1)
                place[wanted[k]] = np.arange(len(wanted[k]))
                at = place[np.minimum(node, len(place) - 1)]
                some = np.flatnonzero(at >= 0)
                base = at[some] * (f * b)
                gs, hs = (g * weight)[some], (h * weight)[some]
                for c in range(f):
                    key = base + c * b + x[some, c]
                    for row, values in enumerate((gs, hs, None)):
                        total[k][row] += np.bincount(key, values, minlength=total[k].shape[1])
        parts = []
        for k, sums in enumerate(total):
            used = np.flatnonzero(sums[2])
            node = np.array(wanted[k], dtype=np.int64)[used // (f * b)] if len(used) else used
            parts.append((np.full(len(used), k), node, used // b % f, used % b, sums[0, used], sums[1, used], sums[2, used].astype(np.int64)))
        if held:
            parts.append(([-1], [0], [0], [0], [lost], [0.0], [held]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        types = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SUMS.split(", ")])

    found = rows.mapInArrow(run, _SUMS)
    if parts * sum(len(w) for w in wanted) * shape.features * shape.bins > MOST_ROWS:  # else the driver adds up the tasks' sums itself
        found = found.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    tree, node, feature, at, g, h, n = (c.to_numpy() for c in found.toArrow().columns)
    out: list[dict[int, np.ndarray]] = [{x: np.zeros((shape.features, shape.bins, 3)) for x in w} for w in wanted]
    for k, by_node in enumerate(out):
        for x, sums in by_node.items():
            mine = (tree == k) & (node == x)
            for row, values in enumerate((g, h, n)):
                np.add.at(sums, (feature[mine], at[mine], row), values[mine])
    held = tree < 0
    return out, (float(g[held].sum()), int(n[held].sum()))


def _best(sums: np.ndarray, names: list[str], allowed: list[int], sizes: list[int], lam: float, least: int, monotone: dict[str, int]) -> tuple | None:
    """(gain, feature, bin) of a node's best split; of equal gains (to 1e-9) the first feature by name, then the first bin."""
    best: tuple | None = None
    for f in sorted(allowed, key=lambda f: names[f]):
        upto = np.cumsum(sums[f], axis=0)
        total, left = upto[-1], upto[: sizes[f]]
        right = total - left
        score = lambda x: x[..., 0] ** 2 / (x[..., 1] + lam)
        gain = score(left) + score(right) - score(total)
        ok = (left[:, 2] >= least) & (right[:, 2] >= least)
        if way := monotone.get(names[f]):
            ok &= way * (-right[:, 0] / (right[:, 1] + lam) + left[:, 0] / (left[:, 1] + lam)) >= 0
        gain = np.where(ok, np.round(gain, 9), 0)
        if len(gain) and gain.max() > (best[0] if best else 0):
            best = (float(gain.max()), f, int(gain.argmax()))
    return best


def _tree(n: int, nodes: dict[int, tuple], totals: dict[int, np.ndarray], lam: float, name) -> tuple:
    """The grown tree below a node; name gives a split's column and threshold."""
    if n in nodes:
        return ("node", *name(*nodes[n][:2]), _tree(2 * n, nodes, totals, lam, name), _tree(2 * n + 1, nodes, totals, lam, name))
    g, h, _ = totals[n]
    return ("leaf", float(-g / (h + lam)))


def fit(
    df: DataFrame, features: list[str], target: str, objective: str = "regression", valid: Column | None = None, rounds: int = 20, depth: int = 3, rate: float = 0.2, lam: float = 1.0, least: int = 20, bins: int = 32,
    classes: int = 2, huber: float | None = None, patience: int = 5, monotone: dict[str, int] | None = None, weight: Column | None = None, subsample: float = 1.0, colsample: float = 1.0, leaves: int | None = None,
    refit: bool = False, seed: int = 0,
) -> Boosted:
    """Boosts squared (or Huber) loss, binary or multiclass log loss.

    valid marks rows held out: fitting stops when their loss has not improved by a ten-thousandth for `patience` rounds,
    and the rounds after the best one go; with refit the model is then fitted anew on all rows for as many rounds. target
    is a number, or a class number 0, 1, ...; rows without one are left out. Trees grow level by level to `depth`, or, with
    `leaves`, by the best leaf first up to so many leaves. Missing values go right. subsample and colsample are the shares
    of rows (by a hash of the row) and of features that a round sees; huber is the share of residuals that are not clipped.
    """
    monotone = monotone or {}
    cuts = edges(df, features, bins)
    y, k = F.col(target).cast("double"), classes if objective == "multiclass" else 1
    known = df.where(y.isNotNull()).select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), y.alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), (F.lit(False) if valid is None else F.coalesce(valid, F.lit(False))).alias("valid"))
    prior = known.where(~F.col("valid")).agg((F.sum(F.col("y") * F.col("w")) / F.sum("w"))).first()[0]
    if objective == "regression":
        bases = [prior or 0.0]
    elif objective == "binary":
        p = min(max(0.5 if prior is None else prior, 1e-6), 1 - 1e-6)
        bases = [math.log(p / (1 - p))]
    else:
        bases = [0.0] * k
    shape = _Shape(objective, len(features), max((len(x) for x in cuts.values()), default=0) + 1, k, rate, subsample)
    held = [np.array(cuts[c]) for c in features]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.stack([np.zeros(n), *(np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64), "left") for i, e in enumerate(held))], axis=1)[:, 1:]
            yield _packed([x, *(batch.column(len(held) + i).to_numpy(zero_copy_only=False) for i in range(4)), np.repeat(np.array(bases)[:, None], n, axis=1)])

    rows = cut(known.withColumn("u", F.xxhash64(*(f"x{i}" for i in range(len(features))), "y")).mapInArrow(binned, _STORED))

    def advanced(trees: list[list[tuple]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in shape.blocks(batches):
                yield _packed([*(block[c] for c in list(_BLOCK)[:5]), np.stack(shape.scores(block, trees))])

        return run

    parts = rows.rdd.getNumPartitions()
    model = Boosted(objective, features, bases, rate)
    pending: list[list[tuple]] = []  # trees since scores were written, over bins
    best, best_at = float("inf"), 0
    rng = np.random.default_rng(seed)
    for turn in range(rounds + 1):
        limit = None
        if huber is not None and turn < rounds:
            def residuals(batches: Iterator[pa.RecordBatch], trees=tuple(pending)) -> Iterator[pa.RecordBatch]:
                for block in shape.blocks(batches):
                    far = np.abs(shape.scores(block, list(trees))[0] - block["y"])[~block["valid"]]
                    yield pa.RecordBatch.from_arrays([pa.array(far)], names=["r"])

            limit = rows.mapInArrow(residuals, "r double").agg(F.percentile_approx("r", huber, 100_000)).first()[0]
        growing: list[dict[int, tuple]] = [{} for _ in range(k)]
        if turn == rounds and valid is None:
            break
        sums, (lost, n_held) = _sums(rows, shape, pending, turn, growing, [[1]] * k if turn < rounds else [[]] * k, limit, True, parts)
        if valid is not None and turn:
            now = lost / max(n_held, 1)
            model.history.append(math.sqrt(now) if objective == "regression" else now)
            if model.history[-1] < best * (1 - 1e-4):
                best, best_at = model.history[-1], turn
            elif turn - best_at >= patience:
                break
        if turn == rounds:
            break
        chosen = sorted(rng.choice(len(features), max(1, round(colsample * len(features))), replace=False).tolist()) if colsample < 1 else list(range(len(features)))
        chosen = [f for f in chosen if len(held[f])]
        find = lambda x: _best(x, features, chosen, [len(e) for e in held], lam, least, monotone)
        totals = [{1: s[1][0].sum(axis=0) if len(features) else np.zeros(3)} for s in sums]
        hists = [dict(s) for s in sums]
        open_: list[list[tuple]] = [[] for _ in range(k)]  # heaps of (-gain, node, feature, bin)
        for t in range(k):
            if split := find(hists[t][1]):
                open_[t].append((-split[0], 1, *split[1:]))
        while any(open_):
            smaller: list[list[int]] = [[] for _ in range(k)]
            for t in range(k):
                if leaves is None:
                    now_split, open_[t] = sorted(open_[t], key=lambda x: x[1]), []
                else:
                    now_split = [heapq.heappop(open_[t])] if open_[t] and len(growing[t]) + 1 < leaves else []
                    if not now_split:
                        open_[t] = []
                for _, n, f, at in now_split:
                    growing[t][n] = (f, at, None)
                    left = hists[t][n][f, : at + 1].sum(axis=0)
                    totals[t][2 * n], totals[t][2 * n + 1] = left, totals[t][n] - left
                    more = n.bit_length() < depth if leaves is None else len(growing[t]) + 1 < leaves and n.bit_length() < 30
                    if more:
                        smaller[t].append(2 * n + int(left[2] * 2 > totals[t][n][2]))
                    else:
                        del hists[t][n]
            if not any(smaller):
                continue
            found, _ = _sums(rows, shape, pending, turn, growing, smaller, limit, False, parts)
            for t in range(k):
                for n, own in found[t].items():
                    hists[t][n], hists[t][n ^ 1] = own, hists[t].pop(n >> 1) - own
                    for child in (n & ~1, n | 1):
                        if split := find(hists[t][child]):
                            heapq.heappush(open_[t], (-split[0], child, *split[1:]))
        model.trees.append([_tree(1, growing[t], totals[t], lam, lambda f, at: (features[f], float(held[f][at]))) for t in range(k)])
        pending.append([_tree(1, growing[t], totals[t], lam, lambda f, at: (str(f), at)) for t in range(k)])
        if len(pending) == CUT_EVERY:
            rows, pending = cut(rows.mapInArrow(advanced(pending), _STORED)), []
            parts = rows.rdd.getNumPartitions()
    if valid is not None:
        model.trees = model.trees[: max(1, best_at)]
        if refit:
            history = model.history
            model = fit(df, features, target, objective, None, max(1, best_at), depth, rate, lam, least, bins, classes, huber, patience, monotone, weight, subsample, colsample, leaves, False, seed)
            model.history = history
    return model
