"""Connected components of an edge table: forests per task, then smallest labels and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.runtime import cut_lineage, ship

TASK_EDGES = 1_000_000      # edges of a forest built by one task


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined to it) for the edges a-b."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[:len(a)], back[len(a):]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, old[x], low)
        np.minimum.at(label, old[y], low)
        label = label[label]
        if (label == old).all():
            return nodes, nodes[label]


def _forest(batches):
    """Edges of one task -> (smallest node, node) of each of its trees."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if a:
        node, root = local_roots(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_pydict({"a": root, "b": node})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (a, b).

    Tasks of at most about ``TASK_EDGES`` edges each replace them by the edges of a
    forest, as long as that makes them notably fewer; what fits one task is done
    with it.  The rest goes on in rounds over all tasks: each node takes the
    smallest label among its neighbours, then follows the label once.  Every step
    is written; hub nodes are summed before a shuffle."""
    ship(edges.sparkSession)
    edges = cut_lineage(edges.select("a", "b"))
    n = edges.count()
    while True:
        tasks = max(1, -(-n // TASK_EDGES))
        edges = cut_lineage(edges.repartition(tasks).mapInArrow(_forest, "a long, b long"))
        if tasks == 1:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
        before, n = n, edges.count()
        if n > 0.7 * before:
            return _rounds(edges)


def _rounds(edges: DataFrame) -> DataFrame:
    own = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(own.withColumn("label", F.col("node")))
    while True:
        seen = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(
            F.min("label").alias("near"))
        hooked = labels.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("lower"))
        over = labels.select(F.col("node").alias("lower"), F.col("label").alias("next"))
        jumped = cut_lineage(hooked.join(over, "lower").select("node", "label", F.least("lower", "next").alias("now")))
        changed = jumped.where("now <> label").limit(1).count()
        labels = jumped.select("node", F.col("now").alias("label"))
        if not changed:
            return labels
