"""Random forests grown in two phases.

A forest of full-depth trees is far larger than its rows, so it is neither grown level by level over all rows nor ever sent
whole to a task.

*Rows that fit in a task* (``HELD_CELLS``) are written once, as blocks.  Every bundle of trees is a task that reads the whole table, without
a shuffle, sorts it once and grows its trees one after the other.  Nobody needs the trees themselves to know the importances or
to score the first rows: a task adds up gains, scores the rows with each grown tree and forgets it.  Trees are written
only when they are asked for again.

*More rows* are grown in two phases:

1. *Top.*  While a tree's node holds more than ``region_rows`` rows of its sample, it is
   split on quantile thresholds of each feature.  One pass adds up the histograms
   (rows, weight, weighted label) of all such nodes of all trees; reducers choose the
   best threshold of a node, so the driver sees one row per node.
2. *Regions.*  A node of at most ``region_rows`` rows goes to one task with its rows and is
   finished there with exact splits, down to pure leaves unless ``max_depth`` or
   ``min_instances`` stops before.  Trees that fit from the root on share a shuffle: rows go
   to a bundle of trees, not to each tree.

A tree's sample is a Poisson(1) weight per row, a hash of (row, tree): rows are not copied to
draw it and a repeated task draws the same.  Finished regions are rows of a written table.
Scoring deals the trees into a few groups and sends each row to a task of every group, where the group's nodes
come first and the rows stream past them; the predictions of a row's trees are then averaged.  If a tree is too large for a
task, a row goes to the regions it falls into instead.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.session import cut_lineage, ensure_checkpoint_dir

REGION_ROWS = 200_000
BINS = 256
MAX_CELLS = 4_000_000       # histogram entries one pass adds up
HELD_BYTES = 64 << 20      # nodes of whole trees that a scoring task holds, about
HELD_CELLS = 30_000_000    # values of the features that a task holds to grow trees on
SCORED_CELLS = 16_000_000  # and that it scores while it grows them
ROW = "_forest_row"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole numbers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], float))


def sample_weights(rows: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often a tree draws each row."""
    if not bootstrap:
        return np.ones(len(rows))
    salt = _mixed(np.array([seed * 1_000_003 + tree]))[0]
    u = (_mixed(rows.astype(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, "right").astype(float)


# ------------------------------------------------------------ one region

@dataclass
class Nodes:
    """Nodes of a (part of a) tree; feature -1: leaf."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))      # summed per feature

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, a few rows at a time: what moves stays in the processor's cache."""
        # a node's left child and feature in one number; a leaf is its own child and nothing exceeds its threshold
        inner = self.feature >= 0
        turn = np.where(inner, np.maximum(self.feature, 0), 0) + (np.where(inner, self.left, np.arange(len(inner))).astype(np.int64) << 16)
        least = np.where(inner, self.threshold, np.inf)
        apart = (self.right - self.left)[inner]
        apart = None if (apart == 1).all() else np.where(inner, self.right - self.left, 0).astype(np.int64)
        found, k = np.zeros(len(x), np.int64), x.shape[1]
        for lo in range(0, len(x), CHUNK_ROWS):
            values = np.ascontiguousarray(x[lo:lo + CHUNK_ROWS]).reshape(-1)
            at = found[lo:lo + CHUNK_ROWS]
            moving = np.arange(len(at))
            node, first = np.zeros(len(at), np.int64), moving * k
            while len(moving):
                code = turn.take(node)
                right = values.take(first + (code & 0xFFFF)) > least.take(node)
                code >>= 16
                child = code + (right if apart is None else right * apart.take(node))
                there = np.flatnonzero(child != node)
                if len(there) < 0.8 * len(moving):
                    at[moving] = child
                    moving, first, child = moving.take(there), first.take(there), child.take(there)
                node = child
        return found


def midpoint(a, b):
    """A threshold that keeps a on its left and b on its right."""
    mid = a / 2 + b / 2
    return np.where((mid >= a) & (mid < b), mid, a)


CHUNK_ROWS = 1 << 14        # rows that go down a tree together
PART_ROWS = 1 << 16         # rows of a subtree that is grown on its own: their columns stay in the processor's cache


@dataclass
class Sorted:
    """Rows in the order of each feature: sorted once for all trees that are grown on them."""
    y: np.ndarray
    values: list[np.ndarray]    # distinct values of each feature
    ranks: np.ndarray           # (row, feature): the number of its value
    order: list[np.ndarray]     # rows by value, per feature

    @classmethod
    def of(cls, columns: Iterable[np.ndarray], y: np.ndarray, k: int) -> Sorted:
        values, order, ranks = [], [], np.empty((len(y), k), np.int32)
        for f, v in enumerate(columns):
            o = np.argsort(v, kind="stable").astype(np.int32)
            v = v[o]
            new = np.append(True, v[1:] != v[:-1])[:len(v)]
            ranks[o, f] = np.cumsum(new, dtype=np.int32) - 1
            order.append(o)
            values.append(v[new])
        return cls(y, values, ranks, order)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None, min_instances: int = 1,
         min_split: int = 2) -> Nodes:
    """The tree of least squared error on rows that count ``w`` times."""
    return grow_sorted(Sorted.of((np.ascontiguousarray(c) for c in x.T), y, x.shape[1]), w, max_depth, min_instances, min_split)


def grow_sorted(rows: Sorted, w: np.ndarray, max_depth: int | None = None, min_instances: int = 1, min_split: int = 2) -> Nodes:
    """The tree of least squared error on rows that count ``w`` times, all nodes of a level at a time.

    Ties (up to 1e-10 of a node's sum of squares) go to the first feature, then the smallest threshold.  Each feature keeps its rows
    sorted within nodes; a split deals them on in order, so values are sorted once.  Left children come before all right ones, so
    either half can be grown on its own once a level's rows are many."""
    n, k = rows.ranks.shape
    held = w > 0
    counts = w.astype(np.uint8 if n and w.max() < 256 else np.int32)
    shift = float((w * rows.y).sum() / w.sum()) if held.any() else 0.0
    wy = w * (rows.y - shift)
    # running sums of labels are whole numbers of steps so small that all together fill an integer: they round once, not at every row
    step = float(np.abs(wy).sum()) / 2.0 ** 61 or 1.0
    steps = np.rint(wy / step).astype(np.int64)
    # by feature: row, rank, weight, weight x label; in the order of the first also label, weight x label and that squared
    cols = []
    for f in range(k):
        o = rows.order[f]
        o = o[held[o]]
        most = len(rows.values[f])
        cols.append([o, rows.ranks[o, f].astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int32), counts[o], steps[o]])
    o = cols[0][0]
    cols[0] += [rows.y[o], wy[o], wy[o] * (rows.y[o] - shift)]
    made, gains, total = [], np.zeros(k), 1
    number = np.empty(n, np.int32)
    todo = [(cols, np.array([len(o)]), np.zeros(1, np.int64), 0, rows.ranks, np.empty(n, np.int8))]
    del cols, o, wy, steps
    while todo:
        cols, size, ids, depth, ranks, side = todo.pop()
        if len(ranks) == n > PART_ROWS >= len(cols[0][0]):
            # rows of a part get numbers of their own
            own = cols[0][0]
            number[own] = np.arange(len(own), dtype=np.int32)
            ranks, side = ranks[own], np.empty(len(own), np.int8)
            for c in cols:
                c[0] = number[c[0]]
        m, start = len(ids), np.cumsum(size) - size
        weight, label = np.add.reduceat(cols[0][2], start, dtype=float), np.add.reduceat(cols[0][5], start)
        node = np.repeat(np.arange(m), size)
        inner = node[1:] == node[:-1]
        labels = cols[0][4]
        open_ = np.zeros(m, bool)
        open_[node[np.flatnonzero((labels[1:] != labels[:-1]) & inner)]] = True     # not pure
        open_ &= weight >= min_split
        if max_depth is not None and depth >= max_depth:
            open_[:] = False
        best, best_f, best_c = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)
        if open_.any():
            inner &= open_[node[1:]]
            mean, lead = label / (weight * step), (np.cumsum(weight) - weight).astype(np.int64)
            before = np.add.reduceat(cols[0][3], start)
            before = np.cumsum(before) - before
            tie = 1e-10 * np.add.reduceat(cols[0][6], start) / (weight * step ** 2)
            for f in range(k):
                r = cols[f][1]
                cand = np.flatnonzero((r[1:] != r[:-1]) & inner)
                if not len(cand):
                    continue
                at = node.take(cand)
                # weight left of a cut, and its labels' sum less what the node's mean makes of it
                wl = np.cumsum(cols[f][2], dtype=np.int64).take(cand)
                wl -= lead.take(at)
                score = np.cumsum(cols[f][3]).take(cand)
                score -= before.take(at)
                score = score - wl * mean.take(at)
                wr = weight.take(at) - wl
                score *= score
                fits = None if min_instances <= 1 else (wl >= min_instances) & (wr >= min_instances)
                wr *= wl
                score /= wr
                if fits is not None:
                    np.copyto(score, -np.inf, where=~fits)
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                where = at[first]
                top = np.maximum.reduceat(score, first)
                wins = top > best[where] + tie[where]
                if not wins.any():
                    continue
                least = np.where(wins, top - tie[where], np.inf)
                hit = np.flatnonzero(score >= np.repeat(least, np.diff(np.append(first, len(cand)))))
                hit = hit[np.append(True, at[hit][1:] != at[hit][:-1])]     # the smallest threshold
                best[where[wins]] = top[wins]
                best_f[where[wins]], best_c[where[wins]] = f, cand[hit]
        split = np.flatnonzero(best_f >= 0)
        left = np.full(m, -1)
        left[split] = total + 2 * np.arange(len(split))
        right = np.where(left >= 0, left + 1, -1)
        threshold, cut = np.zeros(m), np.zeros(m, np.int32)
        for f in range(k):
            mine = np.flatnonzero(best_f == f)
            r, c = cols[f][1], best_c[mine]
            threshold[mine] = midpoint(rows.values[f][r[c]], rows.values[f][r[c + 1]])
            cut[mine] = r[c]
        made.append((ids, best_f, threshold, left, right, label / weight + shift))
        np.add.at(gains, best_f[split], best[split] * weight[split] * step ** 2)
        if not len(split):
            continue
        total += 2 * len(split)
        # rows of split nodes, dealt to the children in the order of each feature
        o = cols[0][0]
        code = ranks.reshape(-1).take(o.astype(np.int64) * k + np.repeat(best_f, size))
        turn = np.where(code <= np.repeat(cut, size), np.int8(1), np.int8(2))
        if len(split) < m:
            turn[np.repeat(best_f < 0, size)] = 0
        side[o] = turn
        lefts = np.add.reduceat(turn == 1, start, dtype=np.int64)[split]
        rights = size[split] - lefts
        together = int(lefts.sum() + rights.sum()) <= PART_ROWS
        dealt = [], []
        for f in range(k):
            goes = side.take(cols[f][0])
            to = [np.flatnonzero(goes == 1), np.flatnonzero(goes == 2)]
            for keep, children in zip([np.concatenate(to)] if together else to, dealt, strict=False):
                children.append([c.take(keep) for c in cols[f]])
            cols[f] = None
        if together:
            todo.append((dealt[0], np.append(lefts, rights), np.append(left[split], right[split]), depth + 1, ranks, side))
        else:
            todo += [(dealt[0], lefts, left[split], depth + 1, ranks, side),
                     (dealt[1], rights, right[split], depth + 1, ranks, side)]
    at = np.concatenate([p[0] for p in made])
    fields = []
    for j in range(1, 6):
        c = np.concatenate([p[j] for p in made])
        fields.append(np.empty_like(c))
        fields[-1][at] = c
    return Nodes(*fields, gains)


# ------------------------------------------------------------ the forest

BLOCK = "first long, n int, x binary, y binary"
NODE_TYPES = (("feature", "<i4"), ("threshold", "<f8"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8"))
REGION = "part int, tree int, region int, " + ", ".join(f"{c} binary" for c, _ in NODE_TYPES) + ", gains array<double>"


@dataclass
class Top:
    """The upper part of a tree; the value of a leaf is the number of its region."""
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right),
                     np.zeros(len(self.feature)))

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.threshold[node] = feature, threshold
        self.left[node], self.right[node] = first, first + 1
        for _ in range(2):
            for name, value in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1),
                                ("depth", self.depth[node] + 1)):
                getattr(self, name).append(value)
        return first, first + 1


@dataclass
class Rows:
    """A table of blocks of training rows and how trees are grown on it, a bundle of them in a task that holds all rows."""
    path: str
    seed: int
    bootstrap: bool
    max_depth: int | None
    min_instances: int
    min_split: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCK).parquet(self.path)

    def grown(self, blocks: DataFrame, trees: int, bundles: int, k: int, use, schema: str) -> DataFrame:
        """Rows of ``use(bundle, trees, blocks to score)``, a task per bundle; ``trees()`` grows (number, nodes) one by one.

        ``blocks``: those of training rows, ``first`` being a row's number, and of rows to score with ``first`` -1 - block and
        the rows' numbers in place of labels."""
        seed, bootstrap, limits = self.seed, self.bootstrap, (self.max_depth, self.min_instances, self.min_split)

        def run(batches):
            found = [[], []]
            bundle = None
            for batch in batches:
                for r in batch.to_pylist():
                    bundle = r["bundle"]
                    found[r["first"] < 0].append(r)
            if bundle is None:
                return
            held, scored = (sorted(rows, key=lambda r: r["first"]) for rows in found)
            del found
            ids = np.concatenate([np.arange(r["first"], r["first"] + r["n"]) for r in held])
            y = np.concatenate([np.frombuffer(r["y"]) for r in held])
            rows = Sorted.of((np.concatenate([np.frombuffer(r["x"], count=r["n"], offset=8 * f * r["n"]) for r in held])
                              for f in range(k)), y, k)
            del held

            def trees_of():
                for t in range(bundle, trees, bundles):
                    w = sample_weights(ids, t, seed, bootstrap)
                    if not (w > 0).any():
                        w = np.ones(len(w))         # a tree that drew no row at all takes each once
                    yield t, grow_sorted(rows, w, *limits)
            yield from use(bundle, trees_of, scored)

        # a bundle's rows are one partition that reads the whole table; beside one that is dealt otherwise, a union leaves them apart
        apart = blocks.sparkSession.range(0, 2, 1, 2).where("id < 0").select(
            F.lit(-1).alias("bundle"), F.col("id").alias("first"), F.lit(0).alias("n"), *(F.lit(None).cast("binary").alias(c) for c in "xy"))
        parts = [apart, *(blocks.coalesce(1).select(F.lit(b).alias("bundle"), "*") for b in range(bundles))]
        while len(parts) > 1:
            parts = [x.union(y) for x, y in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2:]
        return parts[0].mapInArrow(run, schema)


@dataclass
class ForestModel:
    """Tops of the trees (bounded: their leaves hold about ``region_rows`` rows) and the table of regions, or the rows to grow them on."""
    features: list[str]
    tops: list[Top]
    bundles: int
    path: str
    shares: list[float] | None
    rows: Rows | None = None

    @property
    def importances(self) -> list[float]:
        if self.shares is None:
            k = len(self.features)

            def use(bundle, trees, scored):
                for t, nodes in trees():
                    yield _gain_batch(t, nodes.gains)
            spark = SparkSession.getActiveSession()
            found = self.rows.grown(self.rows.blocks(spark), len(self.tops), self.bundles, k, use, "tree int, gains array<double>")
            self._share({r["tree"]: r["gains"] for r in found.collect()})
        return self.shares

    def _share(self, gains: dict[int, Sequence[float]]) -> None:
        found = np.zeros((len(self.tops), len(self.features)))
        for t, of_tree in gains.items():
            found[t] = of_tree
        self.shares = _importances(found)

    def regions(self, spark: SparkSession) -> DataFrame:
        if self.rows is not None:
            def use(bundle, trees, scored):
                for t, nodes in trees():
                    yield _region_batch(bundle, t, nodes)
            self.rows.grown(self.rows.blocks(spark), len(self.tops), self.bundles, len(self.features), use, REGION).write.parquet(self.path)
            self.rows = None
            written = spark.read.schema(REGION).parquet(self.path)
            self._share({r["tree"]: r["gains"] for r in written.select("tree", "gains").collect()})
        return spark.read.schema(REGION).parquet(self.path)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with the mean prediction of the trees; NULL where a feature is NULL or NaN."""
        base = cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id()))
        mean = self.predictions(base, ROW, prediction)
        return base.join(mean.hint("merge"), ROW, "left").drop(ROW)

    def predictions(self, df: DataFrame, row: str, prediction: str = "prediction") -> DataFrame:
        """(``row``, mean prediction) of the rows without a NULL or NaN feature; ``row`` numbers the rows, as a long, each once.

        The first rows are scored while the trees grow, if a task can hold them; the sums are a written table.
        Whole trees are dealt into groups: a group's nodes go to some tasks, each with a share of all rows.  The
        more groups, the more often rows move and the less often nodes do; their number keeps the sum of both small.  A tree too
        large for a task goes by its regions, and a row to the one it falls into."""
        found = df.select(F.col(row).alias("row"), *(F.col(q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)))
        for i in range(len(self.features)):
            found = found.where(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}"))
        if self.rows is not None and self.shares is None:
            totals = self._while_growing(found)
            if totals is not None:
                return totals.select(F.col("row").alias(row), (F.col("total") / len(self.tops)).alias(prediction))
        sizes = {r["tree"]: r["size"] for r in self.regions(df.sparkSession).groupBy("tree").agg(
            F.sum(sum(F.length(c) for c, _ in NODE_TYPES)).alias("size")).collect()}
        grouped = max(sizes.values()) <= HELD_BYTES
        totals = self._by_groups(found, sum(sizes.values())) if grouped else self._by_regions(found)
        return totals.groupBy(F.col("row").alias(row)).agg((F.sum("total") / len(self.tops)).alias(prediction))

    def _while_growing(self, found: DataFrame) -> DataFrame | None:
        """(row, total of all trees) as a written table; None if the rows are too many for a task."""
        spark, k, rows, bundles = found.sparkSession, len(self.features), self.rows, self.bundles
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
        found.mapInArrow(_packer(k, None), "first long, n int, x binary, y binary").select(
            (-1 - F.monotonically_increasing_id()).alias("first"), "n", "x", "y").write.option("compression", "zstd").parquet(f"{folder}/rows")
        scored = spark.read.schema(BLOCK).parquet(f"{folder}/rows")
        if k * (scored.agg(F.sum("n")).first()[0] or 0) > SCORED_CELLS:
            return None

        def use(bundle, trees, blocks):
            sizes = [r["n"] for r in blocks]
            x = np.empty((sum(sizes), k))
            at = 0
            for r in blocks:
                x[at:at + r["n"]] = np.frombuffer(r["x"]).reshape(k, r["n"]).T
                at += r["n"]
            numbers = [(r["first"], r["n"], r["y"]) for r in blocks]
            blocks.clear()
            total = np.zeros(len(x))
            for t, nodes in trees():
                total += nodes.value[nodes.leaf_of(x)]
                yield _total_batch([(bundle, t, 0, b"", nodes.gains.tobytes())])
            for (first, n, own), hi in zip(numbers, np.cumsum(sizes), strict=True):
                yield _total_batch([(bundle, first, n, own if bundle == 0 else b"", total[hi - n:hi].tobytes())])

        def add(batches):
            """Sums of a block over the bundles, in their order; the first brings the rows' numbers."""
            first, own, total = None, b"", None
            for batch in batches:
                for r in batch.to_pylist():
                    values = np.frombuffer(r["totals"])
                    if r["first"] >= 0:
                        yield _sum_batch(1, r["first"] * k + np.arange(k), values)
                    elif r["first"] == first:
                        total = total + values
                    else:
                        if first is not None:
                            yield _sum_batch(0, np.frombuffer(own, np.int64), total)
                        first, own, total = r["first"], r["own"], values
            if first is not None:
                yield _sum_batch(0, np.frombuffer(own, np.int64), total)

        (rows.grown(rows.blocks(spark).union(scored), len(self.tops), bundles, k, use, "bundle int, first long, n int, own binary, totals binary")
         .repartition("first").sortWithinPartitions("first", "bundle").mapInArrow(add, "kind int, row long, total double")
         .write.parquet(f"{folder}/sums"))
        sums = spark.read.schema("kind int, row long, total double").parquet(f"{folder}/sums")
        gains = np.zeros(len(self.tops) * k)
        for r in sums.where("kind = 1").collect():
            gains[r["row"]] = r["total"]
        self.shares = _importances(gains.reshape(-1, k))
        return sums.where("kind = 0").select("row", "total")

    def _by_groups(self, found: DataFrame, size: int) -> DataFrame:
        """(row, total) of each group of trees that a row went to."""
        spark, k, trees = found.sparkSession, len(self.features), len(self.tops)
        tasks = 2 * spark.sparkContext.defaultParallelism
        row_bytes = max(1, found.count()) * 8 * (k + 3)
        groups = min(trees, max(-(-size // HELD_BYTES), math.isqrt(-(-size * tasks // row_bytes))))
        ways = max(1, -(-tasks // groups))
        keys = _Keys(self.tops, self.bundles)
        share = spark.sparkContext.broadcast(({t: (nodes, keys.first[t]) for t, nodes in keys.tops.items()}))

        def score(batches):
            for regions, piece in _nodes_then_rows(batches):
                held = {}
                for tree, region, nodes in regions:
                    held.setdefault(tree, {})[region] = nodes
                x = _matrix(piece, 3, k)
                total = np.zeros(len(x))
                for t, of_tree in sorted(held.items()):
                    if t not in share.value:
                        (nodes,) = of_tree.values()
                        total += nodes.value[nodes.leaf_of(x)]
                        continue
                    top, number = share.value[t]
                    at = number[top.leaf_of(x)]
                    order = np.argsort(at, kind="stable")
                    cuts = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
                    for lo, hi in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                        rows, nodes = order[lo:hi], of_tree.get(int(at[order[lo]]))
                        if nodes is not None:       # None: a region that no row of the sample reached
                            total[rows] += nodes.value[nodes.leaf_of(x[rows])]
                yield pa.RecordBatch.from_pydict({"row": piece.column(1), "total": pa.array(total)})

        rows = found.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
            (F.col("group") * ways + F.pmod("row", F.lit(ways))).cast("int").alias("part"), "row", F.lit(False).alias("is_node"),
            *(f"x{i}" for i in range(k)), *(F.lit(None).cast("int").alias(c) for c in ("tree", "region")),
            *(F.lit(None).cast("binary").alias(c) for c, _ in NODE_TYPES))
        nodes = self.regions(spark).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).select(
            (F.pmod("tree", F.lit(groups)) * ways + F.col("way")).cast("int").alias("part"), F.lit(None).cast("long").alias("row"),
            F.lit(True).alias("is_node"), *(F.lit(None).cast("double").alias(f"x{i}") for i in range(k)), "tree", "region",
            *(c for c, _ in NODE_TYPES))
        return (nodes.union(rows).repartitionById(groups * ways, "part").sortWithinPartitions("part", F.desc("is_node"))
                .mapInArrow(score, "row long, total double"))

    def _by_regions(self, found: DataFrame) -> DataFrame:
        """(row, total) of each part that a row falls into."""
        spark, k = found.sparkSession, len(self.features)
        keys = _Keys(self.tops, self.bundles)
        share = spark.sparkContext.broadcast(keys)

        def deal(batches):
            for batch in batches:
                x = _matrix(batch, 1, k)
                for part, rows in share.value.parts_of(x):
                    yield _row_batch(part, batch.column(0).take(pa.array(rows)), x[rows])

        def score(batches):
            for regions, piece in _nodes_then_rows(batches):
                x = _matrix(piece, 3, k)
                total = np.zeros(len(x))
                for *_, nodes in regions:
                    total += nodes.value[nodes.leaf_of(x)]
                yield pa.RecordBatch.from_pydict({"row": piece.column(1), "total": pa.array(total)})

        xs = ", ".join(f"x{i} double" for i in range(k))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        # a part's rows may be dealt over several tasks, each of which has the part's nodes
        ways = max(1, -(-tasks // max(1, keys.count)))
        rows = found.mapInArrow(deal, f"part int, row long, {xs}").select(
            (F.col("part") * ways + F.pmod("row", F.lit(ways))).cast("int").alias("part"), "row", F.lit(False).alias("is_node"),
            *(f"x{i}" for i in range(k)), *(F.lit(None).cast("int").alias(c) for c in ("tree", "region")),
            *(F.lit(None).cast("binary").alias(c) for c, _ in NODE_TYPES))
        nodes = self.regions(spark).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).select(
            (F.col("part") * ways + F.col("way")).cast("int").alias("part"), F.lit(None).cast("long").alias("row"),
            F.lit(True).alias("is_node"), *(F.lit(None).cast("double").alias(f"x{i}") for i in range(k)), "tree", "region",
            *(c for c, _ in NODE_TYPES))
        return (nodes.union(rows).repartitionById(tasks, F.pmod("part", F.lit(tasks)))
                .sortWithinPartitions("part", F.desc("is_node")).mapInArrow(score, "row long, total double"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.regions(spark).write.mode("overwrite").parquet(f"{path}/regions")
        meta = json.dumps({"features": self.features, "tops": [vars(t) for t in self.tops], "bundles": self.bundles,
                           "importances": self.importances})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> ForestModel:
        meta = json.loads(SparkSession.getActiveSession().read.parquet(f"{path}/meta").first()["meta"])
        return cls(meta["features"], [Top(**t) for t in meta["tops"]], meta["bundles"], f"{path}/regions",
                   meta["importances"])


class _Keys:
    """Numbers of the parts: bundles of whole trees first, then one per leaf of a top."""

    def __init__(self, tops: Sequence[Top], bundles: int):
        self.whole = [[] for _ in range(bundles)]
        self.tops, self.first, self.count = {}, {}, bundles
        for t, top in enumerate(tops):
            if len(top.feature) == 1:
                self.whole[t % bundles].append(t)
                continue
            leaves = np.flatnonzero(np.array(top.feature) < 0)
            number = np.full(len(top.feature), -1)
            number[leaves] = self.count + np.arange(len(leaves))
            self.tops[t], self.first[t] = top.nodes(), number
            self.count += len(leaves)
        self.tree_of = {int(p): t for t, number in self.first.items() for p in number[number >= 0]}

    def trees_in(self, part: int) -> list[int]:
        return self.whole[part] if part < len(self.whole) else [self.tree_of[part]]

    def depth_of(self, part: int, tops: Sequence[Top]) -> int:
        if part < len(self.whole):
            return 0
        t = self.tree_of[part]
        return tops[t].depth[int(np.flatnonzero(self.first[t] == part)[0])]

    def parts_of(self, x: np.ndarray, weights=None):
        """(part, rows) of all rows, for every bundle and every split tree.  ``weights(tree)``: rows that count."""
        for part, trees in enumerate(self.whole):
            if trees:
                yield part, np.arange(len(x))
        for t, nodes in self.tops.items():
            rows = np.arange(len(x)) if weights is None else np.flatnonzero(weights(t) > 0)
            number = self.first[t][nodes.leaf_of(x[rows])]
            order = np.argsort(number, kind="stable")
            cuts = np.flatnonzero(np.append(True, number[order][1:] != number[order][:-1]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                if hi > lo:
                    yield int(number[order[lo]]), rows[order[lo:hi]]


def _matrix(batch, first: int, k: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)


def _row_batch(part: int, rows, x: np.ndarray, y=None) -> pa.RecordBatch:
    cols = {"part": pa.array(np.full(len(x), part, np.int32)), "row": rows}
    cols |= {f"x{i}": pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])}
    return pa.RecordBatch.from_pydict(cols if y is None else cols | {"y": pa.array(y)})


def _packer(k: int, label: int | None):
    """Batches of (row, features, label) as blocks; without a label, of the rows' numbers."""
    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                last = own.astype("<i8") if label is None else batch.column(label).to_numpy().astype("<f8")
                yield pa.RecordBatch.from_pydict({
                    "first": pa.array([int(own[0])], pa.int64()), "n": pa.array([len(own)], pa.int32()),
                    "x": [np.ascontiguousarray(_matrix(batch, 1, k).T).tobytes()], "y": [last.tobytes()]})
    return pack


def _gain_batch(tree: int, gains: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([gains.tolist()], pa.list_(pa.float64()))],
                                      names=["tree", "gains"])


def _region_batch(part: int, tree: int, nodes: Nodes) -> pa.RecordBatch:
    packed = [pa.array([getattr(nodes, c).astype(kind).tobytes()], pa.binary()) for c, kind in NODE_TYPES]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.int32()) for v in (part, tree, part)] + packed + [pa.array([nodes.gains.tolist()], pa.list_(pa.float64()))],
        names=["part", "tree", "region", *(c for c, _ in NODE_TYPES), "gains"])


def _total_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["bundle", "first", "n", "own", "totals"])


def _sum_batch(kind: int, rows: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows.astype(np.int64)), pa.array(totals)],
                                      names=["kind", "row", "total"])


def _importances(gains: np.ndarray) -> list[float]:
    """Mean share of each feature in the gains of a tree, from (tree, feature) gains."""
    size = gains.sum(axis=1, keepdims=True)
    mean = np.divide(gains, size, out=np.zeros_like(gains), where=size > 0).sum(axis=0)
    return (mean / mean.sum() if mean.sum() else mean).tolist()


def _unpacked(row: dict) -> Nodes:
    return Nodes(*(np.frombuffer(row[c], kind) for c, kind in NODE_TYPES))


def _nodes_then_rows(batches):
    """([(tree, region, nodes)], rows) for every piece of rows; a part's nodes come before its rows."""
    part, held = None, []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            piece = batch.slice(lo, hi - lo)
            if parts[lo] != part:
                part, held = parts[lo], []
            is_node = piece.column(2).to_numpy(zero_copy_only=False)
            at = int(np.searchsorted(~is_node, True))
            held += [(r["tree"], r["region"], _unpacked(r)) for r in piece.slice(0, at).to_pylist()]
            if at < piece.num_rows:
                yield held, piece.slice(at)


def _groups(batches, names):
    """Rows of consecutive equal parts, whole groups: yields (part, {column: values})."""
    part, held = None, []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and parts[lo] != part:
                yield part, {c: np.concatenate([h[c] for h in held]) for c in names}
                held = []
            part = int(parts[lo])
            held.append({c: batch.column(batch.schema.get_field_index(c)).to_numpy()[lo:hi] for c in names})
    if held:
        yield part, {c: np.concatenate([h[c] for h in held]) for c in names}


def _bin_edges(rows: DataFrame, k: int, bins: int) -> list[np.ndarray]:
    """Distinct quantile thresholds of every feature, one aggregate of fixed size."""
    probs = [j / bins for j in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(f"x{i}", probs, 20 * bins).alias(f"x{i}") for i in range(k))).first()
    return [np.unique(np.array(found[f"x{i}"], float)) for i in range(k)]


def _best_splits(rows: DataFrame, tops: list[Top], open_nodes: list[tuple[int, int]], edges: list[np.ndarray],
                 seed: int, bootstrap: bool, min_instances: int) -> dict[int, tuple]:
    """{index of the open node: (feature, threshold, gain, left rows, right rows)}; None if it cannot be split."""
    spark, k = rows.sparkSession, len(edges)
    width = max(len(e) for e in edges) + 1
    by_tree: dict[int, list[int]] = {}
    for slot, (t, _) in enumerate(open_nodes):
        by_tree.setdefault(t, []).append(slot)
    shared = spark.sparkContext.broadcast((
        {t: (tops[t].nodes(), {open_nodes[s][1]: s for s in slots}) for t, slots in by_tree.items()}, edges))
    slots_n = len(open_nodes)

    def add(batches):
        trees, cuts = shared.value
        total = np.zeros((3, slots_n, k * width))
        for batch in batches:
            ids, y, x = batch.column(0).to_numpy(), batch.column(1 + k).to_numpy(), _matrix(batch, 1, k)
            codes = [np.searchsorted(e, x[:, i], "left") for i, e in enumerate(cuts)]
            for t, (nodes, slot_of) in trees.items():
                w = sample_weights(ids, t, seed, bootstrap)
                held = np.flatnonzero(w > 0)
                leaf = nodes.leaf_of(x[held])
                # a batch is counted over the tree's own nodes alone: the sums of all trees are far larger than a batch
                own = list(slot_of.values())
                place = np.full(len(nodes.feature), -1)
                place[list(slot_of)] = np.arange(len(own))
                place = place[leaf]
                held, place = held[place >= 0], place[place >= 0]
                for i in range(k):
                    at = place * width + codes[i][held]
                    for c, values in enumerate((None, w[held], w[held] * y[held])):
                        total[c, own, i * width:(i + 1) * width] += np.bincount(
                            at, values, minlength=len(own) * width).reshape(len(own), width)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(slots_n, dtype=np.int32)), "cells": pa.array(
            [np.ascontiguousarray(total[:, s]).tobytes() for s in range(slots_n)], pa.binary())})

    def choose(batches):
        sums = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(data).reshape(3, k, width)
                sums[slot] = sums[slot] + cells if slot in sums else cells
        for slot, cells in sums.items():
            n, w, wy = (np.cumsum(c, axis=1) for c in cells)
            wl, yl = w[:, :-1], wy[:, :-1]
            wr, yr = w[:, -1:] - wl, wy[:, -1:] - yl
            fits = (wl >= max(min_instances, 1)) & (wr >= max(min_instances, 1))
            score = np.where(fits, yl ** 2 / np.where(wl > 0, wl, 1) + yr ** 2 / np.where(wr > 0, wr, 1), -np.inf)
            f, b = divmod(int(np.argmax(score)), width - 1)
            if np.isfinite(score[f, b]):
                gain = score[f, b] - wy[f, -1] ** 2 / w[f, -1]
                yield pa.RecordBatch.from_pydict({
                    "slot": [slot], "f": [f], "bin": [b], "gain": [gain],
                    "lefts": [int(n[f, b])], "rights": [int(n[f, -1] - n[f, b])]},
                    schema=pa.schema([("slot", pa.int32()), ("f", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()),
                                      ("lefts", pa.int64()), ("rights", pa.int64())]))

    found = (rows.mapInArrow(add, "slot int, cells binary").repartition("slot")
             .mapInArrow(choose, "slot int, f int, bin int, gain double, lefts long, rights long").collect())
    return {r["slot"]: (r["f"], float(edges[r["f"]][r["bin"]]), r["gain"], r["lefts"], r["rights"]) for r in found}


def _grow_tops(rows: DataFrame, n: int, k: int, tops: list[Top], region_rows: int, bins: int, seed: int, bootstrap: bool,
               max_depth: int | None, min_instances: int) -> np.ndarray:
    """Split nodes until each holds at most ``region_rows`` rows; returns the gains per (tree, feature)."""
    gains = np.zeros((len(tops), k))
    if n <= region_rows:
        return gains
    edges = _bin_edges(rows, k, bins)
    todo = [(t, 0) for t in range(len(tops))]
    step = max(1, MAX_CELLS // (3 * k * bins))
    while todo:
        now, todo = todo[:step], todo[step:]
        found = _best_splits(rows, tops, now, edges, seed, bootstrap, min_instances)
        for slot, (f, threshold, gain, lefts, rights) in found.items():
            t, node = now[slot]
            gains[t, f] += gain
            for child, size in zip(tops[t].split(node, f, threshold), (lefts, rights), strict=True):
                if size > region_rows and (max_depth is None or tops[t].depth[child] < max_depth):
                    todo.append((t, child))
    return gains


def train_forest(df: DataFrame, features: Sequence[str], label: str, num_trees: int = 100, max_depth: int | None = None,
                 min_instances: int = 1, min_split: int = 2, seed: int = 42, bootstrap: bool = True,
                 region_rows: int | None = None, bins: int = BINS) -> ForestModel:
    """M6: a forest of regression trees, every feature tried at every split (scikit-learn's default).

    Rows with a NULL feature or label are dropped.  Up to ``region_rows`` rows (as many as a task holds) splits are exact from the root
    on, and trees are grown when they are first needed.  Beyond, a node that quantile thresholds cannot split (one hot
    value) stays a region whatever its size: its rows are equal in every feature but a few, and are
    finished by one task."""
    spark, features = df.sparkSession, list(features)
    k = len(features)
    data = df.select(*(F.col(q(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)),
                     F.col(q(label)).cast("double").alias("y")).na.drop()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    (data.select(F.monotonically_increasing_id().alias("row"), *(f"x{i}" for i in range(k)), "y")
     .mapInArrow(_packer(k, 1 + k), BLOCK).write.option("compression", "zstd").parquet(f"{path}-rows"))
    held = Rows(f"{path}-rows", seed, bootstrap, max_depth, min_instances, min_split)
    n = held.blocks(spark).agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("no rows without NULL to train on")
    tops = [Top() for _ in range(num_trees)]
    if n <= region_rows if region_rows else n * k <= HELD_CELLS:
        return ForestModel(features, tops, min(num_trees, spark.sparkContext.defaultParallelism), path, None, held)
    region_rows = region_rows or REGION_ROWS

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(k, r["n"])
                yield pa.RecordBatch.from_pydict({"row": np.arange(r["first"], r["first"] + r["n"]), **{f"x{i}": x[i] for i in range(k)},
                                                  "y": np.frombuffer(r["y"])})

    xs = ", ".join(f"x{i} double" for i in range(k))
    rows = held.blocks(spark).mapInArrow(unpack, f"row long, {xs}, y double")
    gains = _grow_tops(rows, n, k, tops, region_rows, bins, seed, bootstrap, max_depth, min_instances)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bundles = min(num_trees, 2 * spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(_Keys(tops, bundles))

    def deal(batches):
        keys = shared.value
        for batch in batches:
            x, ids, y = _matrix(batch, 1, k), batch.column(0), batch.column(1 + k).to_numpy()
            raw = ids.to_numpy()
            for part, held in keys.parts_of(x, lambda t, raw=raw: sample_weights(raw, t, seed, bootstrap)):
                yield _row_batch(part, ids.take(pa.array(held)), x[held], y[held])

    depths = {p: shared.value.depth_of(p, tops) for p in range(shared.value.count)}

    def finish(batches):
        keys = shared.value
        for part, cols in _groups(batches, ["row", *(f"x{i}" for i in range(k)), "y"]):
            order = np.argsort(cols["row"])
            x = np.stack([cols[f"x{i}"][order] for i in range(k)], axis=1)
            y, ids = cols["y"][order], cols["row"][order]
            left = None if max_depth is None else max_depth - depths[part]
            for t in keys.trees_in(part):
                w = sample_weights(ids, t, seed, bootstrap)
                if not (w > 0).any():
                    w = np.ones(len(w))         # a tree that drew no row at all takes each once
                nodes = grow(x, y, w, left, min_instances, min_split)
                yield _region_batch(part, t, nodes)

    (rows.mapInArrow(deal, f"part int, row long, {xs}, y double").repartitionById(tasks, F.pmod("part", F.lit(tasks)))
     .sortWithinPartitions("part").mapInArrow(finish, REGION).write.parquet(path))
    model = ForestModel(features, tops, bundles, path, [])
    per_tree = model.regions(spark).groupBy("tree").agg(*(F.sum(F.col("gains")[i]).alias(f"g{i}") for i in range(k)))
    for r in per_tree.collect():
        gains[r["tree"]] += [r[f"g{i}"] for i in range(k)]
    model.shares = _importances(gains)
    return model
