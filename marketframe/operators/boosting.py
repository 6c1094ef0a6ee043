"""Gradient boosting with softmax loss, patience and truncation to the best round (ML-02, ML-05, TOP-04, ML-09).

Spark finds the bin edges over all rows and bins every row once; the binned rows serve all fits of a call. Every
fit learns from all its rows. A fit (a fold of the stack, a trial of the search) of at most ``GROUP_ROWS`` rows is
one group, so that fits run side by side on the cluster (``fit_groups``). The trees of a larger one are grown level
by level over blocks of rows, whose histograms Spark adds up (``fit_spread``): no task holds more than a block.
Models are small (trees as arrays) and are scored by Spark over all rows.

In a fit the trees of all classes grow together, level by level: one set of histograms (node, feature, bin) a
level serves every class. After each round the loss on the watching rows is taken; the loop ends when it has not
fallen for ``patience`` rounds, and the model is cut to its best round. Without watching rows all rounds stay.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT
from ..session import removed
from ..sources.io import scratch_path

N_CLASSES, N_BINS, EDGE_ACCURACY, BLOCK_VALUES = 5, 32, 10_000, 500_000
GROUP_ROWS = 250_000      # rows of a fit that one group holds (some hundred bytes each); larger fits are spread
BLOCK_ROWS = 16_384       # rows of a block of a spread fit
WRITE_EVERY = 20          # rounds of a spread fit after which the rows' margins are written


@dataclass(frozen=True)
class Params:
    # Defaults of the boosted learner.
    rounds: int = 1000
    depth: int = 6
    step: float = 0.05
    row_fraction: float = 0.8
    feature_fraction: float = 0.8
    min_weight: float = 5.0
    min_rows: int = 1
    alpha: float = 0.1
    lam: float = 1.0
    leaves: int = 0            # most leaves of a tree; 0: as many as the depth allows
    draw_every: int = 1        # rounds between draws of rows
    patience: int = 50
    seed: int = DEFAULT.random_state


@dataclass
class Model:
    """All trees end to end. A node has feature -1 (leaf) or sends bins above ``cut`` to child + 1, others to child;
    ``value`` is what a row adds to its class if it ends there. ``roots``: (round, class)."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    rounds_run: int
    best_loss: float

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return Model(**{k: x[k] if x[k].ndim else x[k].item() for k in x.files})

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """(row, class) sums of the trees' leaf values; bins: (feature, row)."""
        out = np.zeros((bins.shape[1], self.roots.shape[1]))
        for trees in self.roots:
            for c, root in enumerate(trees):
                at = np.full(bins.shape[1], root)
                on = np.flatnonzero(self.feature[at] >= 0)
                while len(on):
                    node = at[on]
                    at[on] = self.child[node] + (bins[self.feature[node], on] > self.cut[node])
                    on = on[self.feature[at[on]] >= 0]
                out[:, c] += self.value[at]
        return out

    def contributions(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, class, feature): what the splits on each feature add along a row's paths, and (class): the roots'
        values. Over the features, with the class's roots, they add up to the margins."""
        n, k = bins.shape[1], self.roots.shape[1]
        out = np.zeros((n, k, bins.shape[0]))
        for trees in self.roots:
            for c, root in enumerate(trees):
                at = np.full(n, root)
                on = np.flatnonzero(self.feature[at] >= 0)
                while len(on):
                    node = at[on]
                    at[on] = self.child[node] + (bins[self.feature[node], on] > self.cut[node])
                    out[on, c, self.feature[node]] += self.value[at[on]] - self.value[node]
                    on = on[self.feature[at[on]] >= 0]
        return out, self.value[self.roots].sum(axis=0)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _slopes(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss: (class, row), as ``margins``."""
    prob = softmax(margins.T).T
    truth = (labels[None, :] == np.arange(len(margins))[:, None]).astype(float)
    return prob - truth, np.maximum(2 * prob * (1 - prob), 1e-6)


def _losses(margins: np.ndarray, labels: np.ndarray) -> np.ndarray:
    prob = softmax(margins.T)
    return -np.log(np.maximum(prob[np.arange(len(prob)), labels], 1e-15))


def _gains(left: list[np.ndarray], total_g, total_h, total_n, p: Params) -> np.ndarray:
    """Gain of every cut; left: sums of g, h (and rows, where ``min_rows`` asks) up to each cut; the totals' shapes
    fit to them."""

    def squared(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        x -= p.alpha
        np.maximum(x, 0.0, out=x)
        return np.square(x, out=x)

    right_h = total_h - left[1]
    ok = np.minimum(left[1], right_h) >= p.min_weight
    if p.min_rows > 1:
        ok &= np.minimum(left[2], total_n - left[2]) >= p.min_rows
    gain, right = squared(left[0]), squared(total_g - left[0])
    gain /= np.maximum(left[1], 0.0) + p.lam
    right /= np.maximum(right_h, 0.0) + p.lam
    gain += right
    gain -= squared(total_g) / (total_h + p.lam)
    gain[~ok] = -np.inf
    return gain


class _Trees:
    """A round's trees of all classes while they grow, level by level."""

    def __init__(self, n_classes: int, p: Params):
        self.p, k = p, n_classes
        self.feature, self.cut, self.child, self.value = [np.full(k, -1)], [np.zeros(k, int)], [np.full(k, -1)], []
        self.leaves, self.total, self.first, self.level = np.ones(k, int), k, 0, 0
        self.owner = np.arange(k)                 # class of every node of the level

    def add(self, sum_g: np.ndarray, sum_h: np.ndarray, best, best_f, best_c) -> np.ndarray:
        """Takes the sums of the level's nodes and their best splits; returns which are split. The nodes of the next
        level come in pairs, in the order of the split ones."""
        p, owner = self.p, self.owner
        self.value.append(-p.step * _shrunk(sum_g, p.alpha) / (sum_h + p.lam))
        split = best > 1e-9
        if p.leaves:  # the best splits of each class, while its leaves last
            for c in np.unique(owner[split]):
                mine = np.flatnonzero(split & (owner == c))
                mine = mine[np.argsort(-best[mine], kind="stable")]
                split[mine[max(0, p.leaves - self.leaves[c]):]] = False
                self.leaves[c] += min(len(mine), max(0, p.leaves - self.leaves[c]))
        if split.any():
            order = np.cumsum(split) - 1
            self.feature[-1][split], self.cut[-1][split] = best_f[split], best_c[split]
            self.child[-1][split] = self.total + 2 * order[split]
            self.owner, self.first, self.level = np.repeat(owner[split], 2), self.total, self.level + 1
            self.total += 2 * int(split.sum())
            for x, fill in ((self.feature, -1), (self.cut, 0), (self.child, -1)):
                x.append(np.full(len(self.owner), fill))
        return split

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in (self.feature, self.cut, self.child, self.value))


class _Grower:
    """One round: a tree for each class, on the rows and features drawn for the round."""

    def __init__(self, bins: np.ndarray, n_bins: int, p: Params):
        self.bins, self.n_bins, self.p = bins, n_bins, p

    def grow(self, g: np.ndarray, h: np.ndarray, drawn: np.ndarray, features: np.ndarray):
        """g, h, and the result's update: (class, row). Returns (feature, cut, child, value, update)."""
        p, (k, n) = self.p, g.shape
        klass, row = np.repeat(np.arange(k), n), np.tile(np.arange(n), k)
        node = klass.copy()                       # node of every (class, row); all rows are led down, drawn ones count
        g, h, weigh = g.ravel(), h.ravel(), drawn[row]
        trees, update = _Trees(k, p), np.zeros(k * n)
        active, parents = np.arange(k * n), None  # of the level's pairs of nodes: their places in the level before
        while True:
            level, width, total = trees.level, len(trees.owner), trees.total
            own = node[active] - trees.first
            seen = weigh[active]
            at, rows_in, gi, hi = own[seen], row[active[seen]], g[active[seen]], h[active[seen]]
            sum_g, sum_h = np.bincount(at, gi, width), np.bincount(at, hi, width)
            best, best_f, best_c = np.full(width, -np.inf), np.zeros(width, int), np.zeros(width, int)
            if level < p.depth:
                best, best_f, best_c = self._best(at, rows_in, gi, hi, features, sum_g, sum_h, parents)
            split = trees.add(sum_g, sum_h, best, best_f, best_c)
            done = ~split[own]
            update[active[done]] = trees.value[-1][own[done]]
            if not split.any():
                break
            order, parents = np.cumsum(split) - 1, np.flatnonzero(split)  # of each pair of the next level: its parent
            active, own = active[~done], own[~done]
            node[active] = total + 2 * order[own] + (self.bins[best_f[own], row[active]] > best_c[own])
        return *trees.arrays(), update.reshape(k, n)

    def _sums(self, at, rows, weights, features, nodes, parents) -> list[np.ndarray]:
        """Histograms (feature, place in nodes, bin) of each weight. Below the roots ``nodes`` come in pairs: the one
        with fewer rows is summed, and the other one is what is left of their parent."""
        b, width = self.n_bins, len(nodes)
        if parents is None:
            counted, code, size = slice(None), at * b, width * b
        else:
            seen = np.bincount(at, minlength=width)
            small = 2 * np.arange(width // 2) + (seen[1::2] < seen[::2])
            is_small = np.zeros(width, bool)
            is_small[small] = True
            counted = np.flatnonzero(is_small[at])
            code, size, rows = at[counted] // 2 * b, width // 2 * b, rows[counted]
        out = [np.empty((len(features), width, b)) for _ in weights]
        weights = [None if w is None else w[counted] for w in weights]
        for part in self._blocks(len(features), max(len(rows), size)):
            n = len(features[part])
            place = (np.arange(n)[:, None] * size + code + self.bins[features[part][:, None], rows]).ravel()
            for k, w in enumerate(weights):
                got = np.bincount(place, None if w is None else np.tile(w, n), n * size).reshape(n, -1, b)
                if parents is None:
                    out[k][part] = got
                else:
                    out[k][part, small], out[k][part, small ^ 1] = got, self.before[k][part][:, parents] - got
        return out

    def _blocks(self, n_features: int, each: int) -> Iterator[slice]:
        """The features in runs of about BLOCK_VALUES values."""
        step = max(1, BLOCK_VALUES // max(1, each))
        return (slice(at, at + step) for at in range(0, n_features, step))

    def _best(self, at, rows, g, h, features, sum_g, sum_h, parents):
        """Gain, feature and cut of the best split of every node of the level."""
        p, width = self.p, len(sum_g)
        best, best_f, best_c = np.full(width, -np.inf), np.zeros(width, int), np.zeros(width, int)
        n_here = np.bincount(at, minlength=width)
        able = (n_here >= 2 * p.min_rows) & (sum_h >= 2 * p.min_weight)
        # histograms are kept of the nodes that can be split, and of their siblings
        nodes = np.flatnonzero(able if parents is None else np.repeat(able[::2] | able[1::2], 2))
        if not len(nodes):
            return best, best_f, best_c
        place = np.full(width, -1)
        place[nodes] = np.arange(len(nodes))
        counted = place[at] >= 0
        above = None if parents is None else self.place[parents[nodes[::2] // 2]]
        weights = [g[counted], h[counted], None] if p.min_rows > 1 else [g[counted], h[counted]]
        self.before = sums = self._sums(place[at[counted]], rows[counted], weights, features, nodes, above)
        self.place = place
        nodes, own = np.flatnonzero(able), place[able]
        total_g, total_h, total_n = (x[able][:, None] for x in (sum_g, sum_h, n_here))

        top, top_f, top_c = np.full(len(nodes), -np.inf), np.zeros(len(nodes), int), np.zeros(len(nodes), int)
        every = np.arange(len(nodes))
        for part in self._blocks(len(features), len(nodes) * self.n_bins):
            left = [np.cumsum(s[part][:, own, :-1], axis=2) for s in sums]
            gain = _gains(left, total_g, total_h, total_n, p)
            c = gain.argmax(axis=2)
            found = np.take_along_axis(gain, c[:, :, None], axis=2)[:, :, 0]
            f = found.argmax(axis=0)
            better = found[f, every] > top
            top[better], top_f[better], top_c[better] = found[f, every][better], features[part][f][better], c[f, every][better]
        best[nodes], best_f[nodes], best_c[nodes] = top, top_f, top_c
        return best, best_f, best_c


def train(bins: np.ndarray, labels: np.ndarray, watching: np.ndarray, p: Params, n_classes: int = N_CLASSES, n_bins: int = N_BINS) -> Model:
    """bins: (feature, row), uint8; watching: rows that only watch the loss."""
    rng, (n_features, n) = np.random.default_rng(p.seed), bins.shape
    learn = np.flatnonzero(~watching)
    margins, grower = np.zeros((n_classes, n)), _Grower(bins, n_bins, p)
    rounds, best, best_loss, ran = [], 0, np.inf, 0
    for ran in range(1, (p.rounds if len(learn) else 0) + 1):
        g, h = _slopes(margins, labels)
        if (ran - 1) % p.draw_every == 0:
            drawn = np.zeros(n, bool)
            drawn[rng.permutation(learn)[:max(1, round(p.row_fraction * len(learn)))]] = True
        features = np.sort(rng.permutation(n_features)[:max(1, round(p.feature_fraction * n_features))])
        *trees, update = grower.grow(g, h, drawn, features)
        rounds.append(trees)
        margins += update
        if watching.any():
            loss = float(_losses(margins[:, watching], labels[watching]).mean())
            if loss < best_loss - 1e-12:
                best, best_loss = ran, loss
            elif ran - best >= p.patience:
                break
        else:
            best = ran
    return _model(rounds[:best], ran, best_loss, n_classes)


def _model(rounds: list, ran: int, best_loss: float, n_classes: int = N_CLASSES) -> Model:
    """The trees (feature, cut, child, value) of some rounds, end to end."""
    starts = np.cumsum([0, *(len(r[0]) for r in rounds)])[:len(rounds)]
    placed = [(f, c, np.where(k >= 0, k + at, -1), v) for (f, c, k, v), at in zip(rounds, starts)]
    kept = [np.concatenate(x) for x in zip(*placed)] if rounds else [np.zeros(0, int)] * 3 + [np.zeros(0)]
    roots = [np.arange(n_classes) + at for at in starts]
    return Model(kept[0].astype(np.int16), kept[1].astype(np.uint8), kept[2].astype(np.int32), kept[3].astype(np.float64),
                 np.array(roots, np.int32).reshape(-1, n_classes), ran, best_loss)


# ---- Spark side ------------------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, cols: list[str], n_bins: int = N_BINS) -> np.ndarray:
    """(feature, n_bins - 1) quantiles of every column over all rows: one aggregation."""
    at = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, EDGE_ACCURACY).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return np.array([row[i] if row[i] is not None else [0.0] * (n_bins - 1) for i in range(len(cols))])


def binned(df: DataFrame, cols: list[str], edges: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and bins: one byte a column, the number of edges below the value (nulls and NaN: 0)."""
    rows = df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            values = x.column(x.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, len(cols))
            out = np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left")) for v, e in zip(values.T, edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())], names=[*keep, "bins"])

    return rows.mapInArrow(cut, StructType([*rows.schema.fields[:-1], *StructType.fromDDL("bins binary").fields]))


def as_matrix(column: pa.ChunkedArray | pa.Array, n_features: int) -> np.ndarray:
    """(feature, row) of a column of bins."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n_features).T)


def bounded(rows: DataFrame, by: list[str], keys: list[str], max_rows: int) -> DataFrame:
    """At most about ``max_rows`` rows of each group: those whose hash of ``keys`` is below the share that fits.
    Groups within the bound keep every row."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    share = F.lit(float(max_rows)) / F.col("_n")
    u = F.pmod(F.xxhash64(F.lit(DEFAULT.random_state), *keys), F.lit(1_000_000)) / F.lit(1e6)
    return rows.join(F.broadcast(sizes), by).where(u < share).drop("_n")


def fit_groups(rows: DataFrame, n_features: int, params: dict[int, Params]) -> dict[int, Model]:
    """One fit for each key of ``params``; rows: fit (the key), label, watching, bins. The fits run side by side, each
    in one group of all its rows; their models come back to the driver."""

    def one(table: pa.Table) -> pa.Table:
        key = table.column("fit")[0].as_py()
        # rows arrive in any order: a fixed one makes reruns agree
        data, label, watch = table.column("bins").to_pylist(), table.column("label").to_numpy(), np.array(table.column("watching").to_pylist(), bool)
        order = sorted(range(len(data)), key=lambda i: (bool(watch[i]), int(label[i]), data[i]))
        bins = as_matrix(pa.array([data[i] for i in order], pa.binary()), n_features)
        model = train(bins, label[order].astype(np.int64), watch[order], params[key])
        return pa.table({"fit": pa.array([key], pa.int32()), "model": pa.array([model.to_bytes()], pa.binary())})

    dealt = rows.select(F.col("fit").cast("int").alias("fit"), F.col("label").cast("int").alias("label"), "watching", "bins") \
        .repartition(4 * len(params), "fit")
    found = dealt.groupBy("fit").applyInArrow(one, "fit int, model binary").collect()
    return {r["fit"]: Model.from_bytes(r["model"]) for r in found}


def fit_each(rows: DataFrame, n_features: int, params: dict[int, Params], keys: list[str]) -> dict[int, Model]:
    """One fit for each key of ``params`` on all its rows, by its size: ``fit_groups`` or ``fit_spread``."""
    sizes = {r["fit"]: r["count"] for r in rows.groupBy("fit").count().collect()}
    large = {k: p for k, p in params.items() if sizes.get(k, 0) > GROUP_ROWS}
    small = {k: p for k, p in params.items() if k not in large}
    models = fit_groups(rows.where(F.col("fit").isin([*small])), n_features, small) if small else {}
    return models | (fit_spread(rows.where(F.col("fit").isin([*large])), n_features, large, keys) if large else {})


@dataclass
class _Fit:
    """A spread fit between two passes: its finished ``rounds``, of which the last ``fresh`` are not in the rows'
    margins yet, and the round that grows."""

    p: Params
    n_features: int
    rounds: list = field(default_factory=list)
    fresh: int = 0
    best: int = 0
    best_loss: float = np.inf
    done: bool = False

    def __post_init__(self):
        self.rng = np.random.default_rng(self.p.seed)
        self.begin()

    def begin(self) -> None:
        self.trees = _Trees(N_CLASSES, self.p)
        self.features = np.sort(self.rng.permutation(self.n_features)[:max(1, round(self.p.feature_fraction * self.n_features))])

    def late(self) -> Model:
        return _model(self.rounds[len(self.rounds) - self.fresh:], 0, 0.0)

    def task(self) -> dict:
        """What a block has to know for the next level."""
        t = self.trees
        return {"p": self.p, "late": self.late(), "feature": np.concatenate(t.feature), "cut": np.concatenate(t.cut),
                "child": np.concatenate(t.child), "first": t.first, "width": len(t.owner), "level": t.level,
                "features": self.features if t.level < self.p.depth else [], "draw": len(self.rounds) // self.p.draw_every}

    def take(self, own: dict, splits: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """The sums of a pass: of the level's nodes, with the loss so far, and the best cut of each feature."""
        t, ran = self.trees, len(self.rounds)
        if t.level == 0:
            if not own["watching"]:
                self.best = ran
            elif ran and own["loss"] / own["watching"] < self.best_loss - 1e-12:
                self.best, self.best_loss = ran, own["loss"] / own["watching"]
            elif ran - self.best >= self.p.patience:
                self.done = True
            self.done |= ran >= self.p.rounds or not own["learning"]
            if self.done:
                return
        width = len(t.owner)
        best, best_f, best_c = np.full(width, -np.inf), np.zeros(width, int), np.zeros(width, int)
        for f, (gain, cut) in sorted(splits.items()):
            better = gain > best
            best[better], best_f[better], best_c[better] = gain[better], f, cut[better]
        if not t.add(own["g"], own["h"], best, best_f, best_c).any():
            self.rounds.append(t.arrays())
            self.fresh += 1
            self.begin()

    def model(self) -> Model:
        return _model(self.rounds[:self.best], len(self.rounds), self.best_loss)


_BLOCK = "fit int, block long, n int, labels binary, watching binary, bins binary, margins binary"


def _blocks_of(rows: DataFrame, n_features: int, keys: list[str]) -> DataFrame:
    """Rows in blocks of at most BLOCK_ROWS of one fit, with margins of zero. The same rows make the same blocks."""
    n = -(-rows.count() // (4 * BLOCK_ROWS))
    dealt = rows.select(F.col("fit").cast("int").alias("fit"), F.col("label").cast("int").alias("label"), "watching", "bins", *keys) \
        .repartition(max(n, 1), F.xxhash64("fit", *keys, "bins")).sortWithinPartitions("fit", *keys, "label", "watching", "bins") \
        .select("fit", "label", "watching", "bins")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32

        def block(x: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([{
                "fit": x.column("fit")[0].as_py(), "block": made, "n": x.num_rows, "labels": x.column("label").to_numpy().astype(np.int32).tobytes(),
                "watching": np.array(x.column("watching").to_pylist(), bool).tobytes(), "bins": as_matrix(x.column("bins"), n_features).tobytes(),
                "margins": np.zeros((N_CLASSES, x.num_rows)).tobytes()}], schema=arrow)

        arrow = pa.schema([("fit", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("labels", "watching", "bins", "margins"))])
        held = None
        for x in batches:
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([x])])
            while held.num_rows:
                fits = held.column("fit").to_numpy()
                own = int(np.searchsorted(fits, fits[0], side="right"))  # sorted by fit
                if own < BLOCK_ROWS and own == held.num_rows:
                    break
                yield block(held.slice(0, min(own, BLOCK_ROWS)))
                held = held.slice(min(own, BLOCK_ROWS))
        if held is not None and held.num_rows:
            yield block(held)

    return dealt.mapInArrow(pack, _BLOCK)


def _block_arrays(x: dict) -> tuple[np.ndarray, ...]:
    """labels, watching, bins and margins of a block."""
    n = x["n"]
    return (np.frombuffer(x["labels"], np.int32), np.frombuffer(x["watching"], bool),
            np.frombuffer(x["bins"], np.uint8).reshape(-1, n), np.frombuffer(x["margins"]).reshape(N_CLASSES, n))


def _block_sums(x: dict, t: dict, n_bins: int = N_BINS) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Of one block: (g, h) of the level's nodes with loss, watching and learning rows at the end; by feature the
    histograms (g, h, rows) of (node, bin)."""
    p, width = t["p"], t["width"]
    labels, watching, bins, margins = _block_arrays(x)
    margins = margins + t["late"].margins(bins).T
    g, h = _slopes(margins, labels)
    drawn = np.random.default_rng([p.seed, t["draw"], x["block"]]).random(x["n"]) < p.row_fraction
    rows = np.flatnonzero(drawn & ~watching)
    klass, row = np.repeat(np.arange(N_CLASSES), len(rows)), np.tile(rows, N_CLASSES)
    node = klass.copy()
    for _ in range(t["level"]):
        on = np.flatnonzero(t["child"][node] >= 0)
        f = t["feature"][node[on]]
        node[on] = t["child"][node[on]] + (bins[f, row[on]] > t["cut"][node[on]])
    here = node >= t["first"]
    at, row, gi, hi = node[here] - t["first"], row[here], g[klass[here], row[here]], h[klass[here], row[here]]
    loss = _losses(margins[:, watching], labels[watching]).sum() if t["level"] == 0 else 0.0
    sums = np.concatenate([np.bincount(at, gi, width), np.bincount(at, hi, width), [loss, watching.sum(), (~watching).sum()]])
    found, code, size = {}, at * n_bins, width * n_bins
    for f in t["features"]:
        place = code + bins[f, row]
        found[int(f)] = np.concatenate([np.bincount(place, gi, size), np.bincount(place, hi, size), np.bincount(place, minlength=size)])
    return sums, found


def _pass(blocks: DataFrame, tasks: dict[int, dict], n_bins: int = N_BINS) -> dict[int, tuple[dict, dict]]:
    """A level of every open fit: its nodes' sums, and the best cut of every node by feature. The histograms are
    added up inside a task and then by (fit, feature) in a shuffle; the driver gets one number and cut a node."""
    shared = blocks.sparkSession.sparkContext.broadcast(tasks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for x in (row for batch in batches for row in batch.to_pylist()):
            sums, found = _block_sums(x, shared.value[x["fit"]], n_bins)
            for f, v in {-1: sums, **found}.items():
                k = (x["fit"], f)
                total[k] = total[k] + v if k in total else v
        for (fit, f), v in total.items():
            yield pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32()), "feature": pa.array([f], pa.int32()), "sums": pa.array([v.tobytes()], pa.binary())})

    def best(table: pa.Table) -> pa.Table:
        fit, f = table.column("fit")[0].as_py(), table.column("feature")[0].as_py()
        total = sum(np.frombuffer(v) for v in sorted(table.column("sums").to_pylist()))  # in a fixed order
        if f >= 0:
            g, h, n = total.reshape(3, -1, n_bins)
            p = shared.value[fit]["p"]
            left = [np.cumsum(v[:, :-1], axis=1) for v in (g, h, n)]
            sum_h, sum_n = h.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
            gain = _gains(left, g.sum(axis=1, keepdims=True), sum_h, sum_n, p)
            gain[((sum_n < 2 * p.min_rows) | (sum_h < 2 * p.min_weight))[:, 0]] = -np.inf
            total = np.concatenate([gain.max(axis=1), gain.argmax(axis=1)])
        return pa.table({"fit": pa.array([fit], pa.int32()), "feature": pa.array([f], pa.int32()), "found": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.where(F.col("fit").isin([*tasks])).mapInArrow(add, "fit int, feature int, sums binary")
    got: dict[int, tuple[dict, dict]] = {fit: ({}, {}) for fit in tasks}
    for r in sums.groupBy("fit", "feature").applyInArrow(best, "fit int, feature int, found binary").collect():
        own, splits = got[r["fit"]]
        v = np.frombuffer(r["found"])
        if r["feature"] < 0:
            w = tasks[r["fit"]]["width"]
            own.update(g=v[:w], h=v[w:2 * w], loss=float(v[-3]), watching=int(v[-2]), learning=int(v[-1]))
        else:
            splits[r["feature"]] = v[:len(v) // 2], v[len(v) // 2:].astype(int)
    shared.destroy()
    return got


def fit_spread(rows: DataFrame, n_features: int, params: dict[int, Params], keys: list[str]) -> dict[int, Model]:
    """``fit_groups`` for fits of any size, side by side. A pass over the blocks serves one level of every fit's
    trees. Rows are drawn one by one with the chance ``row_fraction``, by a generator of the block and the draw. Every
    WRITE_EVERY rounds the blocks are written again with their margins, and the old ones go."""
    spark, fits = rows.sparkSession, {k: _Fit(p, n_features) for k, p in params.items()}

    def written(blocks: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, "boosting")
        blocks.write.parquet(path)
        return path, spark.read.schema(_BLOCK).parquet(path)

    path, blocks = written(_blocks_of(rows, n_features, keys))
    while open_fits := {k: f for k, f in fits.items() if not f.done}:
        for k, (own, splits) in _pass(blocks, {k: f.task() for k, f in open_fits.items()}).items():
            fits[k].take(own, splits)
        if any(f.fresh >= WRITE_EVERY for f in open_fits.values()):
            late = spark.sparkContext.broadcast({k: f.late() for k, f in open_fits.items()})

            def settle(batches: Iterator[pa.RecordBatch], late=late) -> Iterator[pa.RecordBatch]:
                for row, schema in ((row, batch.schema) for batch in batches for row in batch.to_pylist()):
                    _, _, bins, margins = _block_arrays(row)
                    margins = margins + late.value[row["fit"]].margins(bins).T
                    yield pa.RecordBatch.from_pylist([{**row, "margins": margins.tobytes()}], schema=schema)

            old, (path, blocks) = path, written(blocks.where(F.col("fit").isin([*open_fits])).mapInArrow(settle, _BLOCK))
            removed(spark, old)
            for f in open_fits.values():
                f.fresh = 0
    removed(spark, path)
    return {k: f.model() for k, f in fits.items()}


def score(df: DataFrame, model: Model, out: str = "probs", bins: str = "bins") -> DataFrame:
    """``df`` (with a column of bins) with the class probabilities."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at, names = df.columns.index(bins), [*df.columns, out]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n_features = len(x.column(at)[0].as_py()) if x.num_rows else 1
            p = softmax(shared.value.margins(as_matrix(x.column(at), n_features)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*x.columns, flat], names=names)

    return df.mapInArrow(rate, StructType([*df.schema.fields, *StructType.fromDDL(f"{out} array<double>").fields]))


def predict_each(df: DataFrame, models: dict[int, Model], keep: list[str], bins: str = "bins") -> DataFrame:
    """``keep``, fit and predicted: every model's class for every row, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    rows = df.select(*keep, bins)
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("fit int, predicted int").fields])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            matrix = as_matrix(x.column(x.num_columns - 1), len(x.column(x.num_columns - 1)[0].as_py())) if x.num_rows else np.zeros((1, 0), np.uint8)
            for key, model in shared.value.items():
                best = model.margins(matrix).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array([key] * x.num_rows, pa.int32()), pa.array(best)], names=schema.names)

    return rows.mapInArrow(rate, schema)


def explain(df: DataFrame, model: Model, cols: list[str], keep: list[str], bins: str = "bins") -> DataFrame:
    """``keep``, the predicted class, its margin, the bias (its roots' values) and contributions: what each feature's
    splits add to that class along the row's paths. bias and contributions add up to the margin."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keep, bins)
    outputs = "predicted int, margin double, bias double, contributions array<double>"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for start in range(0, x.num_rows, 2000):
                part = x.slice(start, 2000)
                matrix = as_matrix(part.column(part.num_columns - 1), len(cols))
                margins, (parts, roots) = shared.value.margins(matrix), shared.value.contributions(matrix)
                best = margins.argmax(axis=1)
                n = np.arange(len(best))
                flat = parts[n, best].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(cols)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(best.astype(np.int32)), pa.array(margins[n, best]), pa.array(roots[best]), lists],
                    names=[*keep, "predicted", "margin", "bias", "contributions"])

    return rows.mapInArrow(tell, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(outputs).fields]))
