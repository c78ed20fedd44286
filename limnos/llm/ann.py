"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample (``fit_rows`` vectors, chosen by a
hash): each inner node splits its vectors at the median of their projections on
the difference of two of them, until ``leaf_rows`` are left.  Every vector is
then routed to one leaf of each tree.  A query goes down all trees through one
priority queue ordered by the smallest margin on the way, and visits the first
``probes`` leaves; the vectors there are ranked by their exact distance.
``probes`` is fitted as well: the smallest number that finds ``recall`` of the
exact neighbours of sample queries in the sample.

Equal vectors are one entry carrying its smallest ids, as many as an answer can
hold, so a very common vector is one candidate; no answer is lost by it.  Work
is dealt by leaf; a leaf with many queries or vectors is dealt to several tasks.

Defined results: vectors that are NULL, zero, of another length than most of
the sample, or hold NULL or non-finite components take no part, neither as
queries nor as candidates; rows that repeat an id with the same vector count
once; an id with several vectors is searched for with its first one (by hash)
and never finds itself; ties go to the smaller id; fewer than ``k`` candidates
give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.runtime import cut_lineage, ship

TREES, LEAF_ROWS, FIT_ROWS = 8, 64, 20_000
RECALL, FIT_QUERIES = 0.95, 200
LEAF_TASK = 20_000      # vectors, or queries, of a leaf handled at once


class Forest:
    """Nodes of all trees in flat arrays: direction, offset, children (negative: leaf -1 - id)."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.direction, self.offset, self.child = [], [], []
        self.leaf_tree, self.members, self.roots = [], [], []
        for t in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf_rows, t))
        dim = sample.shape[1]
        self.direction = np.array(self.direction, np.float64).reshape(-1, dim)
        self.offset = np.array(self.offset, np.float64)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)
        self.n_leaves = len(self.members)
        del self.rng

    def _grow(self, x, rows, leaf_rows, tree) -> int:
        if len(rows) > leaf_rows:
            for _ in range(5):
                a, b = x[self.rng.choice(rows, 2, replace=False)]
                way = a - b
                p = x[rows] @ way
                middle = float(np.median(p))
                left = p <= middle
                if 0 < left.sum() < len(rows):
                    k = len(self.offset)
                    norm = np.linalg.norm(way)
                    self.direction.append(way / norm)
                    self.offset.append(middle / norm)
                    self.child.append([0, 0])
                    self.child[k] = [self._grow(x, rows[left], leaf_rows, tree), self._grow(x, rows[~left], leaf_rows, tree)]
                    return k
        self.members.append(rows)
        self.leaf_tree.append(tree)
        return -len(self.members)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                far = np.einsum("ij,ij->i", x[inner], self.direction[node]) > self.offset[node]
                at[inner] = self.child[node, far.astype(int)]
            out[:, t] = -1 - at
        return out

    def visit(self, q: np.ndarray, probes: int) -> list[int]:
        """The first ``probes`` leaves in the order of the shared queue."""
        margin = (self.direction @ q - self.offset).tolist() if len(self.offset) else []
        child = self._children()
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out = []
        while queue and len(out) < probes:
            cost, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            m = margin[node]
            near, far = (1, 0) if m > 0 else (0, 1)
            heapq.heappush(queue, (cost, child[node][near]))
            heapq.heappush(queue, (max(cost, abs(m)), child[node][far]))
        return out

    def _children(self):
        if not hasattr(self, "_child_list"):
            self._child_list = self.child.tolist()
        return self._child_list


def fit_probes(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, queries: int = FIT_QUERIES) -> int:
    """Leaves to visit so that sample queries find ``recall`` of their exact neighbours."""
    rng = np.random.default_rng(3)
    chosen = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    leaf_of = forest.route(sample)
    needed = []
    for q in chosen.tolist():
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[:min(k, len(sample) - 1)]
        place = np.empty(forest.n_leaves, np.int64)
        place[forest.visit(sample[q], forest.n_leaves)] = np.arange(forest.n_leaves)
        needed.append(place[leaf_of[true]].min(axis=1))
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(1, np.int64)
    if not len(needed):
        return forest.n_leaves
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (doubles) and its hashes, without invalid vectors and repeated rows."""
    vec = rows[vec_col].cast("array<double>")
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (rows.select(rows[id_col].cast("long").alias("vec_id"), vec.alias("vec"))
            .where("vec_id IS NOT NULL AND vec IS NOT NULL").where(fine.isNotNull())
            .where(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
            .where(F.exists("vec", lambda x: x != 0))
            .withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec")))


def distinct_vectors(valid: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 smallest ids."""
    own = Window.partitionBy("h1", "h2").orderBy("vec_id")
    return (valid.withColumn("rn", F.dense_rank().over(own)).where(F.col("rn") <= k + 1)
            .groupBy("h1", "h2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("vec").alias("vec")))


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _best(ids, dist, query, k):
    """The k nearest (distance, id) without the query's own id."""
    keep = ids != query
    ids, dist = ids[keep], dist[keep]
    if len(ids) > 4 * k:
        cut = np.partition(dist, k - 1)[k - 1]
        ids, dist = ids[dist <= cut], dist[dist <= cut]
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order]


def _leaf_search(k: int):
    """Rows sorted by (leaf, part, kind): queries (0), then vectors (1) of a leaf's part."""

    def run(batches):
        key, queries, best = None, [], {}

        def search(ids, x):
            base_ids = np.concatenate(ids)
            rows = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            for query, q in queries:
                d = np.sqrt(((x - q) ** 2).sum(axis=1))[rows]
                got_ids, got = _best(base_ids, d, query, k)
                if query in best:
                    both = np.concatenate([best[query][0], got_ids]), np.concatenate([best[query][1], got])
                    _, once = np.unique(both[0], return_index=True)
                    got_ids, got = _best(both[0][once], both[1][once], query, k)
                best[query] = (got_ids, got)

        def flush():
            n = [len(v[0]) for v in best.values()]
            out = pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.repeat(np.array(list(best), np.int64), n)),
                "vec_id": pa.array(np.concatenate([v[0] for v in best.values()]).astype(np.int64)),
                "score": pa.array(np.concatenate([v[1] for v in best.values()]).astype(np.float64))})
            best.clear()
            return out

        for batch in batches:
            leaf, part, kind = (batch.column(c).to_numpy() for c in range(3))
            if not batch.num_rows:
                continue
            turn = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            bounds = [0, *turn.tolist(), batch.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if (leaf[lo], part[lo]) != key:
                    key, queries = (leaf[lo], part[lo]), []
                x = _matrix(batch.column(4).slice(lo, hi - lo))
                ids = [np.array(i, np.int64) for i in batch.column(3).slice(lo, hi - lo).to_pylist()]
                if kind[lo] == 0:
                    queries += [(int(i[0]), v) for i, v in zip(ids, x, strict=True)]
                elif queries:
                    search(ids, x)
            if len(best) > 20_000:
                yield flush()
        if best:
            yield flush()

    return run


def nearest(rows: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS,
            recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query.

    ``queries`` is a condition on vec_id that says which rows are queries."""
    spark = rows.sparkSession
    ship(spark)
    valid = valid_vectors(rows, id_col, vec_col)
    order = F.xxhash64(F.lit("forest"), "vec_id")
    sample = [r["vec"] for r in valid.orderBy(order, "vec_id").limit(fit_rows).select("vec").collect()]
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    sizes, n = np.unique([len(v) for v in sample], return_counts=True)
    dim = int(sizes[n.argmax()])
    x = np.unique(np.array([v for v in sample if len(v) == dim]), axis=0)
    forest = Forest(x, trees, leaf_rows)
    probes = fit_probes(forest, x, k, recall)
    shared = spark.sparkContext.broadcast(forest)      # bounded by fit_rows
    valid = valid.where(F.size("vec") == dim)
    base = cut_lineage(distinct_vectors(valid, k).select("ids", "vec"))
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("h1", "h2"))
    asked = cut_lineage(valid.where(queries).withColumn("rn", first).where("rn = 1").select(
        F.array("vec_id").alias("ids"), "vec"))

    def place(kind):
        def run(batches):
            f = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column(1))
                leaves = [f.visit(v, probes) for v in m] if kind == 0 else f.route(m).tolist()
                row = np.repeat(np.arange(len(m)), [len(v) for v in leaves])
                leaf = np.concatenate([np.array(v, np.int32) for v in leaves])
                yield pa.RecordBatch.from_arrays([
                    pa.array(leaf.astype(np.int32)), batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row))], names=["leaf", "ids", "vec"])
        return run

    schema = "leaf int, ids array<long>, vec array<double>"
    vectors, seekers = base.mapInArrow(place(1), schema), asked.mapInArrow(place(0), schema)
    # a leaf's parts: as many as its vectors and its queries need; one row per leaf of the forest
    many = vectors.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_TASK).cast("int").alias("vp"))
    asks = seekers.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_TASK).cast("int").alias("qp"))
    parts = F.broadcast(cut_lineage(many.join(asks, "leaf")))
    own = F.xxhash64("ids")
    v = (vectors.join(parts, "leaf").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qp") - 1)))
         .select("leaf", (F.pmod(own, F.col("vp")) * F.col("qp") + F.col("q")).cast("int").alias("part"),
                 F.lit(1).alias("kind"), "ids", "vec"))
    s = (seekers.join(parts, "leaf").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("vp") - 1)))
         .select("leaf", (F.col("p") * F.col("qp") + F.pmod(own, F.col("qp"))).cast("int").alias("part"),
                 F.lit(0).alias("kind"), "ids", "vec"))
    found = (s.union(v).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")
             .mapInArrow(_leaf_search(k), "query_id long, vec_id long, score double"))
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
