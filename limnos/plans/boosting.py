"""Boosted trees of the second order (M8).

Each round fits one tree to the gradients g = score - y and hessians h = 1 of the squared error.
A split's gain is GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), a leaf's value
-step * G / (H + l2).

*Rows* are kept as blocks of bin codes (one or two bytes a feature), labels and scores: a written table,
made anew every ``refresh`` rounds with the scores so far, so a pass applies at most that many trees.

*Growth* is best first: the leaf of highest gain is split until ``max_leaves`` is met.  Every choice needs the
histograms of the two children of the last one, which would be a pass a split.  Instead a pass adds up the
histograms of all children that the order as known so far reaches, and the order is replayed; it stands when it
reaches no unknown child.  A tree so takes about as many passes as it has levels and equals the one grown
a split at a time.

A pass adds up (gradient, hessian) per (node, feature, bin) within tasks; reducers choose the best split of a
node, so the driver sees one row per node.  Bins end at quantiles of the features, which are values of the data.

*Every value is a threshold*, however many there are.  Where a bin holds more than one value, the pass also adds up the
gradients' absolute values: they bound the gain of any cut inside the bin.  Bins whose bound reaches the node's best gain so far are
searched by a second pass that sorts their rows' values; no other bin can hold the best split.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.plans.forest import MAX_CELLS, _bin_edges, _matrix, _mixed
from limnos.session import ensure_checkpoint_dir

REDUCERS = 8
BLOCK = "block long, n int, codes binary, raw binary, y binary, score binary"
TIE = 1e-10                 # gains this near to the best, relatively, are equal


@dataclass
class Tree:
    """Nodes in the order of their making; feature -1: leaf.  ``bin`` is the last bin that goes left, of it only the values
    up to ``cut`` unless that is NaN."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[float] = field(default_factory=lambda: [0.0])
    cut: list[float] = field(default_factory=lambda: [math.nan])

    def __post_init__(self):
        self.cut += [math.nan] * (len(self.feature) - len(self.cut))       # trees saved before bins were cut

    def leaf_of(self, codes: np.ndarray, raw=None) -> np.ndarray:
        """The leaf of every row of ``codes`` (feature, row); rows are dealt on node by node, so each compares its own code alone.

        ``raw[feature]``: the values, where bins of that feature are cut."""
        at = np.zeros(codes.shape[1], np.int64)
        todo = [(0, np.arange(len(at)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                at[rows] = node
                continue
            f, b, cut = self.feature[node], self.bin[node], self.cut[node]
            code = codes[f][rows]
            right = code > b
            if not math.isnan(cut):
                right |= (code == b) & (raw[f][rows] > cut)
            todo += [(self.left[node], rows[~right]), (self.left[node] + 1, rows[right])]
        return at

    def scores(self, codes: np.ndarray, raw=None) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(codes, raw)]

    def threshold(self, node: int, edges: Sequence[Sequence[float]]) -> float:
        """The largest value of the node's feature that goes left."""
        return float(edges[self.feature[node]][self.bin[node]] if math.isnan(self.cut[node]) else self.cut[node])


@dataclass
class BoostedModel:
    """Trees of bounded size (``rounds`` x ``max_leaves``), the thresholds and the base score."""
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    @property
    def importances(self) -> list[float]:
        """Share of each feature in the summed gains."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return (total / total.sum() if total.sum() else total).tolist()

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with a prediction; NULL where a feature is NULL or NaN.  No shuffle."""
        shared = df.sparkSession.sparkContext.broadcast((self.edges, self.trees, self.base))

        def score(batches):
            edges, trees, base = shared.value
            for cols in batches:
                cols = (cols,) if isinstance(cols, pd.Series) else cols        # one feature comes alone
                x = np.stack([c.to_numpy(float, na_value=np.nan) for c in cols])
                codes = np.stack([np.searchsorted(np.array(e), v, "left") for e, v in zip(edges, x, strict=True)])
                out = np.full(x.shape[1], base)
                for t in trees:
                    out += t.scores(codes, x)
                out = pd.Series(out)
                yield out.where(~np.isnan(x).any(axis=0), None)

        score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        apply = F.pandas_udf(score, "double")
        return df.withColumn(prediction, apply(*[F.col(q(c)).cast("double") for c in self.features]))

    def first(self, rounds: int) -> BoostedModel:
        """The model after its first rounds, the same as one trained with fewer."""
        return BoostedModel(self.features, self.edges, self.base, self.trees[:rounds])

    def splits(self, spark: SparkSession) -> DataFrame:
        """-> (tree, node, feature, threshold, gain, n_rows, left_value, right_value), a row per split."""
        rows = [(k, i, self.features[t.feature[i]], t.threshold(i, self.edges), float(t.gain[i]), float(t.rows[i]),
                 float(t.value[t.left[i]]), float(t.value[t.left[i] + 1]))
                for k, t in enumerate(self.trees) for i in range(len(t.feature)) if t.feature[i] >= 0]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, gain double, n_rows double, "
                                           "left_value double, right_value double")

    def save(self, path: str) -> None:
        meta = json.dumps({"features": self.features, "edges": self.edges, "base": self.base, "trees": [vars(t) for t in self.trees]})
        SparkSession.getActiveSession().createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        meta = json.loads(SparkSession.getActiveSession().read.parquet(path).first()["meta"])
        return cls(meta["features"], meta["edges"], meta["base"], [Tree(**t) for t in meta["trees"]])


def drawn(block: int, n: int, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows of a block a round draws: a hash of (block, row, round), the same in a repeated task."""
    salt = _mixed(np.array([seed * 1_000_003 + tree]))[0]
    ids = _mixed(np.full(n, block)) + np.arange(n, dtype=np.uint64)
    return (_mixed(ids ^ salt) >> np.uint64(11)) / float(1 << 53) < share


def _each(batch):
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _codes(row: dict, k: int) -> np.ndarray:
    raw, n = row["codes"], row["n"]
    return np.frombuffer(raw, np.uint8 if len(raw) == n * k else np.uint16).reshape(k, n)


def _raw(row: dict, mixed: Sequence[int]) -> dict[int, np.ndarray]:
    """The values of the features that have bins of several values."""
    return dict(zip(mixed, np.frombuffer(row["raw"]).reshape(len(mixed), row["n"]), strict=True))


def _mixed_bins(rows: DataFrame, edges: list[np.ndarray]) -> list[tuple[int, int]]:
    """(feature, bin) of the bins that hold more than one value."""
    k = len(edges)

    def ends(batches):
        lo = [np.full(len(e) + 1, np.inf) for e in edges]
        hi = [np.full(len(e) + 1, -np.inf) for e in edges]
        for batch in batches:
            x = _matrix(batch, 0, k)
            for i, e in enumerate(edges):
                code = np.searchsorted(e, x[:, i], "left")
                np.minimum.at(lo[i], code, x[:, i])
                np.maximum.at(hi[i], code, x[:, i])
        for i in range(k):
            held = np.flatnonzero(lo[i] <= hi[i])
            yield pa.RecordBatch.from_pydict({"f": pa.array(np.full(len(held), i, np.int32)), "bin": pa.array(held.astype(np.int32)),
                                              "lo": pa.array(lo[i][held]), "hi": pa.array(hi[i][held])})

    found = (rows.mapInArrow(ends, "f int, bin int, lo double, hi double").groupBy("f", "bin")
             .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("f", "bin").collect())
    return sorted((r["f"], r["bin"]) for r in found)


def _blocks(rows: DataFrame, edges: list[np.ndarray], base: float, mixed: Sequence[int]) -> DataFrame:
    """Rows as blocks of bin codes, feature by feature, with the values of the ``mixed`` features."""
    k = len(edges)
    kind = np.uint8 if max(len(e) for e in edges) < 256 else np.uint16

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch, 0, k), batch.column(k).to_numpy()
                codes = np.stack([np.searchsorted(e, x[:, i], "left").astype(kind) for i, e in enumerate(edges)])
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(y)], pa.int32()), "codes": [codes.tobytes()],
                    "raw": [np.ascontiguousarray(x[:, list(mixed)].T).tobytes()], "y": [y.astype(float).tobytes()],
                    "score": [np.full(len(y), base).tobytes()]})

    return (rows.mapInArrow(pack, "n int, codes binary, raw binary, y binary, score binary")
            .select(F.monotonically_increasing_id().alias("block"), "n", "codes", "raw", "y", "score"))


def _rescored(blocks: DataFrame, trees: list[Tree], k: int, mixed: Sequence[int]) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(trees)

    def add(batches):
        for batch in batches:
            for row in _each(batch):
                codes, raw, score = _codes(row, k), _raw(row, mixed), np.frombuffer(row["score"]).copy()
                for t in shared.value:
                    score += t.scores(codes, raw)
                row["score"] = score.tobytes()
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return blocks.mapInArrow(add, BLOCK)


def _best(blocks: DataFrame, done: list[Tree], tree: Tree, nodes: list[int], number: int, edges: list[np.ndarray],
          mixed: list[tuple[int, int]], l2: float, min_child: float, subsample: float, seed: int) -> dict[int, tuple]:
    """{node: (G, H, feature, bin, gain, left G, left H, cut)} of unsplit nodes; feature -1 where no split is allowed.

    ``min_child`` is the least hessian sum of a child (a number of rows here).  ``mixed``: the bins of several values."""
    k, width = len(edges), max(len(e) for e in edges) + 1
    raws = sorted({f for f, _ in mixed})
    sums_n = 3 if mixed else 2
    several = np.zeros((k, width), bool)
    several[tuple(np.array(mixed, int).reshape(-1, 2).T)] = True

    def drawn_rows(batches):
        """(codes, values, slots, gradients) of the rows of each block that are in a node and drawn."""
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        for batch in batches:
            for row in _each(batch):
                codes, raw, score = _codes(row, k), _raw(row, raws), np.frombuffer(row["score"]).copy()
                for t in done:
                    score += t.scores(codes, raw)
                slot = slot_of[tree.leaf_of(codes, raw)]
                held = slot >= 0
                if subsample < 1.0:
                    held &= drawn(row["block"], row["n"], number, seed, subsample)
                yield codes[:, held], {f: v[held] for f, v in raw.items()}, slot[held], (score - np.frombuffer(row["y"]))[held]

    def add(batches):
        size = len(nodes) * k * width
        total = np.zeros((sums_n, size))
        for codes, _, slot, g in drawn_rows(batches):
            for f in range(k):
                at = (slot * k + f) * width + codes[f]
                total[0] += np.bincount(at, g, minlength=size)
                total[1] += np.bincount(at, minlength=size)
                if f in raws:
                    total[2] += np.bincount(at, np.abs(g), minlength=size)
        total = total.reshape(sums_n, len(nodes), k * width)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(len(nodes), dtype=np.int32)), "cells": pa.array(
            [np.ascontiguousarray(total[:, s]).tobytes() for s in range(len(nodes))], pa.binary())})

    def choose(batches):
        sums = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(data).reshape(sums_n, k, width)
                sums[slot] = sums[slot] + cells if slot in sums else cells
        out = [(slot, *best_split(cells[:2], l2, min_child), *_to_search(cells, several, l2, min_child)) for slot, cells in sums.items()]
        names = ("slot", "g", "h", "f", "bin", "gain", "gl", "hl", "cells", "before")
        types = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(),
                 pa.list_(pa.int32()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=list(names))

    found = (blocks.mapInArrow(add, "slot int, cells binary").repartition(min(len(nodes), REDUCERS), "slot")
             .mapInArrow(choose, "slot int, g double, h double, f int, bin int, gain double, gl double, hl double, cells array<int>, "
                                 "before array<double>").collect())
    best = {r["slot"]: (*tuple(r)[1:8], math.nan) for r in found}
    inside = [(r["slot"], *divmod(c, width), *r["before"][2 * i:2 * i + 2], r["g"], r["h"]) for r in found for i, c in enumerate(r["cells"])]
    if inside:
        for cell, gain, cut, gl, hl in _inside(blocks, drawn_rows, inside, l2, min_child):
            slot, f, b = inside[cell][:3]
            best[slot] = _better(best[slot], (*best[slot][:2], f, b, gain, gl, hl, cut), edges)
    return {nodes[slot]: split for slot, split in best.items()}


def _to_search(cells: np.ndarray, several: np.ndarray, l2: float, min_child: float) -> tuple[list[int], list[float]]:
    """Numbers of a node's bins in which a cut may be best, and (G, H) before each.

    Of the rows of a bin that go left any may be missing, so their G lies between the sums of the negative and of the positive
    gradients, their H between 0 and the bin's.  The gain is convex in both: its largest value is at a corner."""
    if len(cells) < 3:
        return [], []
    at = np.flatnonzero(several.reshape(-1) & (cells[1] > 1).reshape(-1))
    g, h = (np.cumsum(c, axis=1) for c in cells[:2])
    total_g, total_h = g[0, -1], h[0, -1]
    own_g, own_h, size = (c.reshape(-1)[at] for c in cells)
    before_g, before_h = g.reshape(-1)[at] - own_g, h.reshape(-1)[at] - own_h
    bound = np.zeros(len(at))
    slack = 1e-9 * cells[2].sum(axis=1).max()          # what rounding may add to a sum
    with np.errstate(divide="ignore", invalid="ignore"):
        for gl in (before_g + (own_g - size) / 2 - slack, before_g + (own_g + size) / 2 + slack):
            for hl in (before_h, before_h + own_h):
                gain = gl ** 2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g ** 2 / (total_h + l2)
                bound = np.maximum(bound, np.where(np.isnan(gain), np.inf, gain))
    # a child must have its rows
    least = max(min_child, 1e-12)
    may = (before_h + own_h > least) & (total_h - before_h > least)
    top = best_split(cells[:2], l2, min_child)[4]
    taken = np.flatnonzero(may & (bound > 0) & (bound >= top * (1 - TIE)))
    return at[taken].tolist(), np.stack([before_g[taken], before_h[taken]], axis=1).reshape(-1).tolist()


def _inside(blocks: DataFrame, drawn_rows, inside: list[tuple], l2: float, min_child: float) -> list[tuple]:
    """(cell, gain, cut, left G, left H): the best cut between the values of each bin of ``inside``, if one is allowed."""
    by_feature: dict[int, list[tuple[int, int, int]]] = {}
    for cell, (slot, f, b, *_) in enumerate(inside):
        by_feature.setdefault(f, []).append((slot, b, cell))
    slots_n, width = max(c[0] for c in inside) + 1, max(c[2] for c in inside) + 1
    cell_of = {}
    for f, cells in by_feature.items():
        cell_of[f] = np.full((slots_n, width + 1), -1)      # the last column: any later bin
        for slot, b, cell in cells:
            cell_of[f][slot, b] = cell
    shared = blocks.sparkSession.sparkContext.broadcast(([c[3:] for c in inside], cell_of))

    def values(batches):
        for codes, raw, slot, g in drawn_rows(batches):
            for f, numbers in shared.value[1].items():
                known = slot < slots_n
                cell = numbers[slot[known], np.minimum(codes[f][known], width)]
                held = np.flatnonzero(cell >= 0)
                if not len(held):
                    continue
                cell, v, own = cell[held], raw[f][known][held], g[known][held]
                order = np.lexsort((v, cell))
                cell, v, own = cell[order], v[order], own[order]
                first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (v[1:] != v[:-1])))
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(cell[first].astype(np.int32)), "v": pa.array(v[first]), "g": pa.array(np.add.reduceat(own, first)),
                    "h": pa.array(np.diff(np.append(first, len(own))).astype(float))})

    def search(batches):
        """Values come sorted by cell; (cell, value, G up to it, H up to it) is carried on, as the value may come again."""
        ends, best, last = shared.value[0], {}, None
        for batch in batches:
            cell, v, g, h = (batch.column(i).to_numpy() for i in range(4))
            if not len(cell):
                continue
            for lo, hi in _runs(cell):
                c = int(cell[lo])
                before_g, before_h, total_g, total_h = ends[c]
                at = [] if last is None or last[0] != c else [last]
                gs = np.cumsum(np.append(at[0][2] if at else before_g, g[lo:hi]))
                hs = np.cumsum(np.append(at[0][3] if at else before_h, h[lo:hi]))
                vs = np.append(at[0][1] if at else np.nan, v[lo:hi])
                last = (c, float(vs[-1]), float(gs[-1]), float(hs[-1]))
                # a cut after each value that another one of the bin follows
                cut = np.flatnonzero((vs[:-1] != vs[1:]) & ~np.isnan(vs[:-1]))
                gl, hl = gs[cut], hs[cut]
                gr, hr = total_g - gl, total_h - hl
                fits = (hl >= max(min_child, 1e-12)) & (hr >= max(min_child, 1e-12))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fits, gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - total_g ** 2 / (total_h + l2), -np.inf)
                top = gain.max() if len(gain) else -np.inf
                if top > 0 and (c not in best or top * (1 - TIE) > best[c][0]):
                    i = int(np.argmax(gain >= top * (1 - TIE)))
                    best[c] = (float(gain[i]), float(vs[cut[i]]), float(gl[i]), float(hl[i]))
        names = ("cell", "gain", "cut", "gl", "hl")
        out = [(c, *b) for c, b in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32() if i == 0 else pa.float64()) for i in range(5)],
                                         names=list(names))

    return [tuple(r) for r in (
        blocks.mapInArrow(values, "cell int, v double, g double, h double").repartition("cell").sortWithinPartitions("cell", "v")
        .mapInArrow(search, "cell int, gain double, cut double, gl double, hl double").collect())]


def _runs(keys: np.ndarray) -> zip:
    """(start, end) of the runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def _better(one: tuple, other: tuple, edges: list[np.ndarray]) -> tuple:
    """The split of higher gain; of equal ones the first feature, then the smallest threshold."""
    top = max(one[4], other[4])
    known = [s for s in (one, other) if s[2] >= 0 and s[4] >= top * (1 - TIE)]
    return min(known, key=lambda s: (s[2], edges[s[2]][s[3]] if math.isnan(s[7]) else s[7]))


def best_split(cells: np.ndarray, l2: float, min_child: float) -> tuple:
    """(G, H, feature, bin, gain, left G, left H) of a node's sums (2, feature, bin).

    Gains equal to 1e-10 of the best are ties: the first feature, then the smallest threshold."""
    g, h = np.cumsum(cells, axis=2)
    total_g, total_h = float(g[0, -1]), float(h[0, -1])
    gl, hl = g[:, :-1], h[:, :-1]
    gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
    fits = (hl >= max(min_child, 1e-12)) & (hr >= max(min_child, 1e-12))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - total_g ** 2 / (total_h + l2), -np.inf)
    top = gain.max() if gain.size else -np.inf
    if not top > 0:
        return total_g, total_h, -1, 0, 0.0, 0.0, 0.0
    f, b = divmod(int(np.argmax(gain.reshape(-1) >= top * (1 - TIE))), gain.shape[1])
    return total_g, total_h, f, b, float(gain[f, b]), float(gl[f, b]), float(hl[f, b])


def _replay(root: tuple, known: dict[tuple, tuple], max_leaves: int | None, max_depth: int | None, min_gain: float, l2: float,
            step: float) -> tuple[Tree, list[int], list[tuple]]:
    """The tree grown best first as far as splits are known.

    ``known``: path -> best split, a path being the turns from the root; its last entry, the cut within a bin, may be missing.  Returns the tree, its nodes of unknown split and
    their paths."""
    tree, paths = Tree(), [()]
    tree.value[0] = -step * root[0] / (root[1] + l2)
    tree.rows[0] = root[1]
    leaves, unknown = 1, []
    open_ = [0]
    while open_ and (max_leaves is None or leaves < max_leaves):
        # of equal gains the node made first
        node = max(open_, key=lambda i: (known[paths[i]][4], -i))
        open_.remove(node)
        g, h, f, b, gain, gl, hl, *cut = known[paths[node]]
        if f < 0 or gain <= min_gain:
            continue
        first = len(tree.feature)
        tree.feature[node], tree.bin[node], tree.left[node], tree.gain[node] = f, b, first, gain
        tree.cut[node] = cut[0] if cut else math.nan
        for turn, (cg, ch) in enumerate(((gl, hl), (g - gl, h - hl))):
            child, path = first + turn, (*paths[node], turn)
            for name, v in (("feature", -1), ("bin", 0), ("left", -1), ("value", -step * cg / (ch + l2)), ("gain", 0.0), ("rows", ch),
                            ("cut", math.nan)):
                getattr(tree, name).append(v)
            paths.append(path)
            if max_depth is None or len(path) < max_depth:
                if path in known:
                    open_.append(child)
                else:
                    unknown.append(child)
        leaves += 1
    # with no leaf left to add, the children of the last split need no histogram, but those made before
    # may have a better split than one that was taken: all unknown ones are asked for
    if max_leaves is not None and leaves >= max_leaves and unknown:
        last = len(tree.feature) - 2
        unknown = [i for i in unknown if i < last]
    return tree, unknown, [paths[i] for i in unknown]


def grow_tree(best, max_leaves: int | None, max_depth: int | None, min_gain: float, l2: float, step: float) -> Tree:
    """A tree by ``best(tree, nodes) -> {node: split}``, a call per pass."""
    root = best(Tree(), [0])[0]
    known = {(): root}
    if max_depth == 0:
        return _replay(root, known, 1, None, min_gain, l2, step)[0]
    while True:
        tree, nodes, paths = _replay(root, known, max_leaves, max_depth, min_gain, l2, step)
        if not nodes:
            return tree
        found = best(tree, nodes)
        # a node that drew no row has no split
        known |= {p: found.get(i, (0.0, 0.0, -1, 0, 0.0, 0.0, 0.0)) for i, p in zip(nodes, paths, strict=True)}


def train_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, step: float = 0.1,
                  max_depth: int | None = 6, max_leaves: int | None = 31, l2: float = 1.0, min_child: float = 1.0,
                  min_gain: float = 0.0, subsample: float = 1.0, bins: int = 256, refresh: int = 10, seed: int = 42) -> BoostedModel:
    """M8: ``rounds`` trees; without ``max_leaves`` a tree is grown level by level to ``max_depth``.

    Rows with a NULL feature or label are dropped.  ``subsample`` draws rows anew for each tree.  ``bins`` says how rows are added
    up, not which splits there are: every value of a feature is tried.  Written tables stay in the shared folder until the caller
    clears it."""
    if max_depth is None and max_leaves is None:
        raise ValueError("give max_depth, max_leaves or both")
    spark, features = df.sparkSession, list(features)
    k = len(features)
    rows = df.select(*(F.col(q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)),
                     F.col(q(label)).cast("double").alias("y")).na.drop()
    base = rows.agg(F.avg("y")).first()[0]
    if base is None:
        raise ValueError("no rows without NULL to train on")
    edges = _bin_edges(rows, k, bins)
    mixed = _mixed_bins(rows, edges)
    raws = sorted({f for f, _ in mixed})
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosted-{uuid.uuid4().hex}"

    def table(blocks: DataFrame, number: int) -> DataFrame:
        blocks.write.parquet(f"{folder}/{number}")
        return spark.read.schema(BLOCK).parquet(f"{folder}/{number}")

    blocks = table(_blocks(rows, edges, base, raws), 0)
    per_pass = max(1, MAX_CELLS // ((3 if mixed else 2) * k * bins))
    trees: list[Tree] = []
    fresh = 0                                       # trees that the table's scores hold
    for number in range(rounds):
        if number - fresh >= refresh:
            blocks, fresh = table(_rescored(blocks, trees[fresh:], k, raws), number), number

        def best(tree, nodes, blocks=blocks, done=trees[fresh:], number=number):
            found = {}
            for lo in range(0, len(nodes), per_pass):
                found |= _best(blocks, done, tree, nodes[lo:lo + per_pass], number, edges, mixed, l2, min_child, subsample, seed)
            return found
        trees.append(grow_tree(best, max_leaves, max_depth, min_gain, l2, step))
    return BoostedModel(features, [e.tolist() for e in edges], float(base), trees)
