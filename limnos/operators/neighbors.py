"""Exact k-nearest-neighbour regression without an all-pairs join.

Query rows find their k nearest training rows (Euclidean distance over the
given, already scaled, feature columns; ties broken by training key) and
get the distance-weighted mean of their labels: weight 1/d, and if some
neighbours sit at distance 0 they take all the weight (scikit-learn's
``weights="distance"``).

1. *Collapse*: identical training vectors become one group carrying at
   most k members (the k smallest keys, by a salted two-level top-k), so a
   hot value holding a third of the rows is k rows, not n/3.
2. *Cells*: vectors belong to the nearest of a bounded number of pivots; the
   cells, near ones together, are dealt into fragments of bounded size.
3. *Two rounds*: a query goes to the fragments that hold its nearest cells,
   which bounds its k-th distance, then to those that can hold anything as near.
   A fragment's vectors are held by a task and the queries stream past them.

What moves is a row per query and fragment and a copy of a fragment per task that reads
it, never a row per pair compared; each task sends on at most the k nearest of a query.
Fragments are cut and copied so that both together stay small: beyond a share of the tasks a
fragment is copied only where at least as many queries read it as it has vectors.
No candidate cap is applied: the bounds hold for every vector left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.profile import q
from limnos.operators.ranking import topk_per_group
from limnos.session import written


def _collapsed(tr: DataFrame, tcols: Sequence[str], k: int) -> DataFrame:
    """Distinct vectors with at most k members each (the smallest keys)."""
    members = topk_per_group(tr, tcols, "_tk", k, descending=False, out="_mr")
    return members.groupBy(*tcols).agg(F.collect_list(F.struct("_tk", "_y")).alias("_members"))


def knn_regress(train: DataFrame, query: DataFrame, key: str, features: Sequence[str], label: str, k: int,
                query_key: str | None = None, tie_digits: int = 12) -> DataFrame:
    """Exact distance-weighted kNN regression -> (query_key, prediction, n_neighbors, kth_distance).

    One row per query row: rows are told apart by an internal id, so null and
    repeated keys are answered each on their own.  With fewer than ``k``
    training rows the answer uses all of them.

    ``train`` has ``key``, ``features``, ``label`` (no nulls); ``query`` has
    ``query_key`` (default ``key``) and ``features``.  Neighbours are ranked
    by distance rounded to ``tie_digits`` decimals, then by key: distances
    that are equal in exact arithmetic but differ in the last bits of
    floating point are ties, decided by key on every engine.  Weights use
    the unrounded distance.  The search is ``knn_pivots``'.
    """
    return knn_pivots(train, query, key, features, label, k, query_key, tie_digits, counted=False)


MAX_PIVOTS = 2048
SLICE = 4096            # vectors of a cell that are dealt together
FRAGMENT = 100_000      # vectors that a task holds, about, at most
ASKED = 2000            # queries that make a task worth while
PAIRS = 1 << 20         # distances computed at a time


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) Euclidean distances, a feature at a time: no cancellation, memory rows x pivots."""
    out = np.zeros((len(x), len(pivots)))
    for a, b in zip(x.T, pivots.T, strict=True):
        d = a[:, None] - b[None, :]
        d *= d
        out += d
    return np.sqrt(out, out=out)


def _near_order(points: np.ndarray) -> np.ndarray:
    """An order in which points near each other are close: halved at the median of the widest axis."""
    def halved(ids):
        if len(ids) < 3:
            return [ids]
        axis = int(np.argmax(np.ptp(points[ids], axis=0)))
        ids = ids[np.argsort(points[ids, axis], kind="stable")]
        return halved(ids[:len(ids) // 2]) + halved(ids[len(ids) // 2:])
    return np.concatenate(halved(np.arange(len(points))))


class _Fragment:
    """Vectors of some cells, by cell and distance from its pivot; answers queries."""

    def __init__(self, ids, members, cell, radius, x, centres, least, most):
        order = np.lexsort((radius, cell))
        self.ids, self.members, self.radius, self.x = ids[order], members[order], radius[order], x[order]
        cell = cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])
        self.cells, self.first, self.last = cell[first], first, np.append(first[1:], len(cell))
        self.centres, self.least, self.most = centres[self.cells], least[self.cells], most[self.cells]

    def search(self, x, nearest, within, chosen, k, room):
        """(query, vector, distance, members, queries' numbers of vectors compared).

        ``chosen``: cells a query reads, or None: all that can hold anything within ``within``, ``nearest`` being the distance
        of its nearest pivot.  Kept are the vectors that may be among a query's k nearest members."""
        away = _distances(x, self.centres)
        if chosen is None:
            low = np.maximum(np.maximum(away - self.most, self.least - away), (away - nearest[:, None]) / 2)
            reads = low <= within[:, None]
        else:
            reads = np.stack([np.isin(self.cells, c) for c in chosen])
        compared, bound, found = np.zeros(len(x), np.int64), within.copy(), []
        for c in np.flatnonzero(reads.any(axis=0)):
            asked = np.flatnonzero(reads[:, c])
            asked = asked[np.argsort(away[asked, c], kind="stable")]
            radius = self.radius[self.first[c]:self.last[c]]
            step = max(1, PAIRS // len(radius))
            for lo in range(0, len(asked), step):
                rows = asked[lo:lo + step]
                d0, reach = away[rows, c], within[rows]
                start = np.searchsorted(radius, (d0 - reach).min() - room, "left")
                stop = np.searchsorted(radius, (d0 + reach).max() + room, "right")
                if start == stop:
                    continue
                held = slice(self.first[c] + start, self.first[c] + stop)
                near = np.abs(d0[:, None] - radius[None, start:stop]) <= reach[:, None]
                compared[rows] += near.sum(axis=1)
                d = np.where(near, _distances(x[rows], self.x[held]), np.inf)
                if d.shape[1] > k:      # k vectors hold at least k members
                    bound[rows] = np.minimum(bound[rows], np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + room)
                r, v = np.nonzero(near & (d <= bound[rows][:, None]))
                found.append((rows[r], held.start + v, d[r, v]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        row, at, d = (np.concatenate(f) for f in zip(none, *found, strict=True))
        if not len(row):
            return row, at, d, at, compared
        order = np.lexsort((d, row))
        row, at, d = row[order], at[order], d[order]
        count = self.members[at]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
        total = np.cumsum(count)
        before = total - count - (total[first] - count[first])[group]       # members nearer, in this query
        last = np.maximum.reduceat(np.where(before < k, d, 0.0), first)       # where k members are reached
        keep = d <= last[group] * (1 + 1e-9) + room
        return row[keep], self.ids[at[keep]], d[keep], count[keep], compared


def knn_pivots(train: DataFrame, query: DataFrame, key: str, features: Sequence[str], label: str, k: int,
               query_key: str | None = None, tie_digits: int = 12, pivots: int | None = None,
               counted: bool = True) -> DataFrame:
    """Exact kNN regression -> (query_key, prediction, n_neighbors, kth_distance, n_candidates).

    Ranking, ties, weights and odd rows are those of ``knn_regress``.  Distinct training vectors belong to the nearest of
    ``pivots`` vectors chosen by hash (the square root of their number, 2048 at most), which makes cells of known radii.

    1. A query reads the cells of its nearest pivots until they hold k vectors; the k-th distance t found there
       bounds the true one.
    2. It then reads the cells that can hold anything within t: for a cell of pivot p with radii from a to b, every member is at
       least max(d(q,p) - b, a - d(q,p), (d(q,p) - d(q,p0)) / 2) away, p0 being the query's nearest pivot.  Inside a cell only
       vectors whose own radius is within t of d(q,p) are compared.

    All features enter the bounds, two rounds always suffice, and ``n_candidates`` (left out unless ``counted``) counts the vectors
    compared in the second.  Cells are dealt into fragments of at most about 100,000 vectors, a cell of many vectors in slices by hash."""
    qkey, feats = query_key or key, list(features)
    spark, room = train.sparkSession, 4 * 10.0 ** -tie_digits       # for rounding and for ties
    tcols, qcols = [f"_t{i}" for i in range(len(feats))], [f"_q{i}" for i in range(len(feats))]
    tr = train.select(F.col(q(key)).alias("_tk"), *[F.col(q(f)).cast("double").alias(c) for f, c in zip(feats, tcols)],
                      F.col(q(label)).cast("double").alias("_y")).na.drop(subset=tcols)
    qu = written(query.select(F.col(q(qkey)).alias("_key"), F.monotonically_increasing_id().alias("_qk"),
                              *[F.col(q(f)).cast("double").alias(c) for f, c in zip(feats, qcols)]))
    groups = written(_collapsed(tr, tcols, k).withColumn("_g", F.monotonically_increasing_id()))
    n = groups.count()
    shown = ["n_candidates"] if counted else []
    if n == 0:
        return qu.select(F.col("_key").alias(qkey), F.lit(None).cast("double").alias("prediction"), F.lit(0).cast("bigint").alias("n_neighbors"),
                         F.lit(None).cast("double").alias("kth_distance"), *(F.lit(0).cast("bigint").alias(c) for c in shown))
    wanted = pivots or max(1, min(MAX_PIVOTS, math.isqrt(n)))
    centres = np.array([list(r) for r in groups.select(*tcols).orderBy(F.xxhash64(*tcols), *tcols).limit(wanted).collect()], float)
    centres = centres[_near_order(centres)]

    @F.pandas_udf("struct<p:int,r:double>")
    def nearest(*cols: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(float) for c in cols], axis=1)
        at, best = np.zeros(len(x), np.int32), np.zeros(len(x))
        for lo in range(0, len(x), 512):
            d = _distances(x[lo:lo + 512], centres)
            at[lo:lo + 512], best[lo:lo + 512] = d.argmin(axis=1), d.min(axis=1)
        return pd.DataFrame({"p": at, "r": best})

    placed = written(groups.withColumn("_at", nearest(*tcols)).select(
        "_g", F.size("_members").alias("_m"), F.col("_at.p").alias("_p"), F.col("_at.r").alias("_r"), *tcols))
    cells = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("a"), F.max("_r").alias("b")).collect()
    size, least, most = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for c in cells:
        size[c["_p"]], least[c["_p"]], most[c["_p"]] = c["n"], c["a"], c["b"]
    # with f fragments read by tasks / f tasks each, vectors move tasks / f times and queries f times at most: least in sum at this f
    tasks = spark.sparkContext.defaultParallelism
    cuts = max(-(-n // FRAGMENT), math.isqrt(-(-tasks * n // max(1, qu.count()))))
    fragment = min(FRAGMENT, max(SLICE, -(-n // cuts)))
    # the slices of a cell follow each other; a fragment takes slices until it holds enough vectors
    slices = np.maximum(1, -(-size // SLICE))
    share = np.repeat(size / slices, slices)
    of_slice = (np.cumsum(share) - share).astype(np.int64) // fragment
    before = np.cumsum(slices) - slices
    fragments = [np.unique(of_slice[b:b + s]) for b, s in zip(before, slices, strict=True)]     # of a cell
    last = int(of_slice[-1]) + 1
    vectors_in = np.bincount(of_slice, weights=share, minlength=last)
    ways = spark.createDataFrame([(int(p), int(s), of_slice[b:b + s].tolist()) for p, (s, b) in enumerate(zip(slices, before, strict=True))],
                                 "_p int, _n int, _of array<long>")
    dealt = placed.join(F.broadcast(ways), "_p").withColumn(
        "_fragment", F.get("_of", F.pmod(F.xxhash64(*tcols), F.col("_n")).cast("int")).cast("int")).drop("_n", "_of")
    holds = np.zeros((len(centres), last), bool)
    for p, f in enumerate(fragments):
        holds[p, f] = size[p] > 0

    def first_cells(d, _):
        order = np.argsort(d, axis=1, kind="stable")
        nearer = np.cumsum(size[order], axis=1) - size[order]       # vectors in the nearer cells
        keep = np.zeros(d.shape, bool)
        np.put_along_axis(keep, order, (nearer < k) & (size[order] > 0), axis=1)
        return keep

    def all_cells(d, within):
        low = np.maximum(np.maximum(d - most, least - d), (d - d.min(axis=1, keepdims=True)) / 2)
        return (low <= within[:, None]) & (size > 0)

    routed = ["_fragment", "_qk", "_nearest", "_within", "_cells", *qcols]
    numbers = ", ".join(f"{c} double" for c in qcols)
    asked = f"_fragment int, _qk long, _nearest double, _within double, _cells array<int>, {numbers}"

    def routes(choose, named: bool):
        """Queries with the fragments of their cells (named in the first round), 512 rows' distances to all pivots at a time."""
        def route(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    piece = batch.slice(lo, 512)
                    x = np.stack([piece.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(qcols))], axis=1)
                    d = _distances(x, centres)
                    reads = choose(d, piece.column(1).to_numpy(zero_copy_only=False))
                    row, at = np.nonzero(reads.astype(np.float32) @ holds.astype(np.float32))
                    names = ([np.flatnonzero(reads[r] & holds[:, f]).tolist() for r, f in zip(row, at, strict=True)] if named
                             else [None] * len(row))
                    taken = piece.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at.astype(np.int32)), taken.column(0), pa.array(d.min(axis=1)[row]), taken.column(1),
                         pa.array(names, pa.list_(pa.int32())), *(taken.column(2 + i) for i in range(len(qcols)))], names=routed)
        return route

    def answers(queries: DataFrame, choose, named: bool) -> DataFrame:
        """(_qk, _g, _d, _m) of the nearest found in each fragment; a row without _g gives the vectors compared in _m."""
        asks = written(queries.select("_qk", "_within", *qcols).na.drop(subset=qcols).mapInArrow(routes(choose, named), asked))
        load = {r["_fragment"]: r["n"] for r in asks.groupBy("_fragment").agg(F.count(F.lit(1)).alias("n")).collect()}
        step = max(ASKED, -(-sum(load.values()) // tasks))
        cut = [(f, max(-(-c // step), int(c // max(vectors_in[f], ASKED)))) for f, c in sorted(load.items())]
        first = np.cumsum([0] + [c for _, c in cut]).tolist()
        parts = spark.createDataFrame([(f, a, c) for (f, c), a in zip(cut, first)], "_fragment int, _first int, _ways int")
        none = {c: F.lit(None) for c in ("_nearest", "_within", "_cells", "_m", "_p", "_r")}
        vectors = dealt.join(F.broadcast(parts), "_fragment").withColumn("_way", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).select(
            (F.col("_first") + F.col("_way")).alias("part"), F.lit(False).alias("asks"), F.col("_g").alias("id"), F.col("_m").alias("m"),
            F.col("_p").alias("p"), F.col("_r").alias("r"), none["_within"].cast("double").alias("within"),
            none["_cells"].cast("array<int>").alias("cells"), *[F.col(t).alias(f"x{i}") for i, t in enumerate(tcols)])
        rows = asks.join(F.broadcast(parts), "_fragment").select(
            (F.col("_first") + F.pmod(F.xxhash64("_qk"), F.col("_ways"))).cast("int").alias("part"), F.lit(True).alias("asks"),
            F.col("_qk").alias("id"), none["_m"].cast("int").alias("m"), none["_p"].cast("int").alias("p"), F.col("_nearest").alias("r"),
            F.col("_within").alias("within"), F.col("_cells").alias("cells"), *[F.col(t).alias(f"x{i}") for i, t in enumerate(qcols)])

        def search(batches):
            part, held, fragment = None, [], None
            for batch in batches:
                parts_ = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
                ends = [0, *(np.flatnonzero(parts_[1:] != parts_[:-1]) + 1).tolist(), len(parts_)]
                for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                    if lo == hi:
                        continue
                    piece = batch.slice(lo, hi - lo)
                    if parts_[lo] // 2 != part:
                        part, held, fragment = parts_[lo] // 2, [], None
                    ids, r = piece.column(2).to_numpy(), piece.column(5).to_numpy()
                    x = np.stack([piece.column(8 + i).to_numpy(zero_copy_only=False) for i in range(len(feats))], axis=1)
                    if not parts_[lo] % 2:
                        held.append((ids, piece.column(3).to_numpy(), piece.column(4).to_numpy(), r, x))
                        continue
                    if fragment is None and held:
                        fragment = _Fragment(*(np.concatenate(h) for h in zip(*held, strict=True)), centres, least, most)
                        held = []
                    within = piece.column(6).to_numpy()
                    for at in range(0, len(ids), 2048):
                        some = slice(at, at + 2048)
                        chosen = [np.array(c) for c in piece.column(7).slice(at, 2048).to_pylist()] if named else None
                        here = ids[some]
                        nothing = (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64), np.zeros(len(here), np.int64))
                        row, vec, d, m, compared = (fragment.search(x[some], r[some], within[some], chosen, k, room)
                                                    if fragment else nothing)       # slices by hash may be empty
                        told = np.flatnonzero(compared) if counted else np.zeros(0, np.int64)
                        yield pa.RecordBatch.from_pydict({
                            "_qk": pa.array(np.concatenate([here[row], here[told]])), "_g": pa.array(
                                np.concatenate([vec, np.zeros(len(told), np.int64)]), mask=np.arange(len(row) + len(told)) >= len(row)),
                            "_d": pa.array(np.concatenate([d, np.zeros(len(told))])),
                            "_m": pa.array(np.concatenate([m, compared[told]]).astype(np.int64))})

        return (vectors.union(rows).repartitionById(max(1, first[-1]), "part").sortWithinPartitions("part", "asks")
                .mapInArrow(search, "_qk long, _g long, _d double, _m long"))

    w_d = Window.partitionBy("_qk").orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    start = answers(qu.withColumn("_within", F.lit(float("inf"))), first_cells, True).where(F.col("_g").isNotNull())
    bound = start.withColumn("_all", F.sum("_m").over(w_d)).groupBy("_qk").agg(
        F.min(F.when(F.col("_all") >= k, F.col("_d"))).alias("_t"))
    # fewer than k found: every cell is read
    reach = F.coalesce(F.col("_t") * (1 + 1e-9) + room, F.lit(float("inf")))
    second = qu.drop("_key").join(bound.hint("merge"), "_qk").withColumn("_within", reach)
    near = written(answers(second, all_cells, False))
    # a vector has a member at least, so later ones than the k nearest (and their ties) never count
    w_v = Window.partitionBy("_qk").orderBy(F.round("_d", tie_digits))
    nearest_vectors = near.where(F.col("_g").isNotNull()).withColumn("_rank", F.rank().over(w_v)).where(F.col("_rank") <= k)
    members = nearest_vectors.join(groups.select("_g", "_members").hint("merge"), "_g").select(
        "_qk", "_d", F.explode("_members").alias("_mem"))
    w_q = Window.partitionBy("_qk").orderBy(F.round("_d", tie_digits), F.col("_mem._tk"))
    zero = F.col("_d") == 0
    out = members.withColumn("_rank", F.row_number().over(w_q)).where(F.col("_rank") <= k).groupBy("_qk").agg(
        F.count(F.lit(1)).alias("n_neighbors"), F.max("_d").alias("kth_distance"), F.count_if(zero).alias("_nz"),
        F.sum(F.when(zero, F.col("_mem._y"))).alias("_yz"), F.sum(F.when(~zero, F.col("_mem._y") / F.col("_d"))).alias("_yw"),
        F.sum(F.when(~zero, F.lit(1.0) / F.col("_d"))).alias("_w"))
    pred = F.when(F.col("_nz") > 0, F.col("_yz") / F.col("_nz")).otherwise(F.col("_yw") / F.col("_w"))
    found = qu.select("_qk", "_key").join(out.hint("merge"), "_qk")
    if counted:
        counts = near.where(F.col("_g").isNull()).groupBy("_qk").agg(F.sum("_m").alias("n_candidates"))
        found = found.join(counts.hint("merge"), "_qk")
    return found.select(F.col("_key").alias(qkey), pred.alias("prediction"), F.col("n_neighbors").cast("bigint").alias("n_neighbors"),
                        "kth_distance", *shown)
