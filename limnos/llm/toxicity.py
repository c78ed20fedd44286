"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word gives its own hash and those of its character n-grams of 3 to 5 (with the
space before and behind), all hashed to buckets, so a misspelling never seen
shares most vectors with the word it comes from.  A bag is the mean of its
subwords' vectors; a linear softmax over two classes reads it.  Vectors and
softmax are trained jointly in numpy (Adagrad).  Bags are runs of ``RUN`` words,
and a document's score is that of its highest run, so a few words count in a
long text as much as in a short one.  Training starts from whole documents;
then a toxic document stands for its highest run, a clean one for its highest
runs and some others.  At most ``max_train`` labelled documents are learnt from,
chosen by a hash, half of each class if there are enough; an offset fitted on
documents held back puts the decision at 0.5, with classes weighted as in all
labels.

Defined results: NULL and empty texts score like a clean bag without evidence; rows
without a label, with a NULL id or a NULL label are not learnt from; an id
labelled twice counts as toxic if any label says so; if one class is missing,
every score is 0 (no toxic label) or 1; texts above about a quarter million
characters are cut at a space and their runs start anew there; repeated rows
each get a row; other columns are carried by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.ngrams import Chars, bucket, groups
from limnos.llm.runtime import cut_lineage, ship

BITS, ORDERS, RUN, DIM = 17, (3, 4, 5), 4, 8
MAX_TRAIN = 3000


def _runs(pieces):
    """(piece, run, bucket) of every subword of a group of pieces, in order of piece and run."""
    chars = Chars(pieces, digits=True)
    ids, at = [], []
    for h, a in [chars.words(), *(chars.grams(n) for n in ORDERS)]:
        ids.append(bucket(h, BITS))
        at.append(a)
    ids, at = np.concatenate(ids), np.concatenate(at)
    return chars.piece[at], chars.word[at] // RUN, ids


class Model:
    """Evidence of each bucket (its vector through the softmax), offset and slope of the logit."""

    def __init__(self, evidence: np.ndarray, offset: float, slope: float = 1.0):
        self.evidence, self.offset, self.slope = evidence, offset, slope
        #: What a text without words scores like: clean, or what every text is if one class is missing.
        self.blank = 0.0 if offset < 0 or not evidence.any() else -2 * offset

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (top + self.offset), -60, 60)))


def _bag_ids(flat, starts, ends, chosen):
    """The subwords of the chosen bags, one after the other, and where each bag starts."""
    size = ends[chosen] - starts[chosen]
    shift = np.cumsum(size) - size
    return flat[np.repeat(starts[chosen] - shift, size) + np.arange(size.sum())], shift, size


class Trainer:
    """Joint training of subword vectors and softmax on bags of subwords."""

    def __init__(self, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.e = self.rng.normal(0, 0.1, (1 << BITS, DIM))
        self.u = self.rng.normal(0, 0.5, (DIM, 2))
        self.b = np.zeros(2)
        self.ge, self.gu, self.gb = np.full(1 << BITS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)

    def evidence(self) -> np.ndarray:
        return self.e @ (self.u[:, 1] - self.u[:, 0])

    def epoch(self, flat, starts, ends, bags, y, weight, rate=0.5, batch=64) -> None:
        for part in np.array_split(self.rng.permutation(len(bags)), max(1, len(bags) // batch)):
            ids, shift, size = _bag_ids(flat, starts, ends, bags[part])
            uniq, back = np.unique(ids, return_inverse=True)
            mean = np.add.reduceat(self.e[ids], shift) / size[:, None]
            s = mean @ self.u + self.b
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None] / len(part)
            per_id = np.repeat((p @ self.u.T) / size[:, None], size, axis=0)
            g = np.stack([np.bincount(back, weights=per_id[:, d], minlength=len(uniq)) for d in range(DIM)], axis=1)
            gu, gb = mean.T @ p, p.sum(axis=0)
            self.ge[uniq] += (g * g).mean(axis=1)
            self.gu += gu * gu
            self.gb += gb * gb
            self.e[uniq] -= rate * g / np.sqrt(self.ge[uniq])[:, None]
            self.u -= 0.1 * rate * gu / np.sqrt(self.gu)
            self.b -= 0.1 * rate * gb / np.sqrt(self.gb)


def _highest(evidence, flat, starts, ends):
    """Mean evidence of each bag."""
    out, lo = np.empty(len(starts)), 0
    while lo < len(starts):           # a million subwords at once
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), "right")))
        out[lo:hi] = np.add.reduceat(evidence[flat[starts[lo]:ends[hi - 1]]], starts[lo:hi] - starts[lo])
        lo = hi
    return out / (ends - starts)


def fit(flat: np.ndarray, size: np.ndarray, n_runs: np.ndarray, y: np.ndarray, prior: float, epochs: int = 8,
        seed: int = 11) -> Model:
    """flat: subword buckets of all runs, ``size`` of them in each run, ``n_runs`` runs in each document;
    y: its label; prior: share of toxic documents among all labels."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 60.0 if len(y) and y[0] else -60.0)
    ends = np.cumsum(size)
    starts = ends - size
    first = np.cumsum(n_runs) - n_runs
    last = first + n_runs
    held = np.zeros(len(y), bool)
    if min(np.bincount(y)) >= 50:
        held[::5] = True
    learn = np.flatnonzero(~held)
    trainer, rng = Trainer(seed), np.random.default_rng(seed)
    even = len(learn) / (2 * np.bincount(y[learn], minlength=2))
    # whole documents first
    for _ in range(2):
        trainer.epoch(flat, starts[first], ends[last - 1], learn, y[learn], even[y[learn]], batch=16)
    for _ in range(epochs):
        top = _highest(trainer.evidence(), flat, starts, ends)
        bags, labels = [], []
        for d in learn.tolist():
            own = np.arange(first[d], last[d])
            best = own[np.argsort(-top[own], kind="stable")]
            take = best[:1] if y[d] else np.unique(np.concatenate([best[:3], rng.choice(own, min(3, len(own)), False)]))
            bags.append(take)
            labels.append(np.full(len(take), y[d]))
        bags, labels = np.concatenate(bags), np.concatenate(labels)
        weight = len(labels) / (2 * np.bincount(labels, minlength=2))
        trainer.epoch(flat, starts, ends, bags, labels, weight[labels])
    evidence = trainer.evidence()
    top = np.maximum.reduceat(_highest(evidence, flat, starts, ends), first)
    use = held if held.any() else ~held
    cut = _decision(top[use], y[use], prior)
    spread = max(float(np.abs(top[use] - cut).mean()), 1e-9)
    return Model(evidence, -cut, 4.0 / spread)


def _decision(top: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The threshold with the least weighted error; the middle of the best gap."""
    order = np.argsort(top, kind="stable")
    t, lab = top[order], y[order]
    w1, w0 = prior / max(lab.sum(), 1), (1 - prior) / max((1 - lab).sum(), 1)
    missed = np.concatenate([[0.0], np.cumsum(lab * w1)])
    false = np.concatenate([np.cumsum(((1 - lab) * w0)[::-1])[::-1], [0.0]])
    cost = missed + false
    edge = np.concatenate([[t[0] - 1], t, [t[-1] + 1]])
    gap = edge[1:] - edge[:-1]
    best = np.flatnonzero((cost <= cost.min() + 1e-12) & (gap > 0))
    k = best[np.argmax(gap[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``max_train`` labelled documents; ``labels`` holds the ids that may be learnt from."""
    ship(docs.sparkSession)
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("doc_id"))
             .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    half = max_train // 2
    picked = None
    for y in (0, 1):
        room = max(half, max_train - n.get(1 - y, 0)) if n.get(1 - y, 0) < half else half
        some = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(room)
        picked = some if picked is None else picked.union(some)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    chosen = narrow.join(F.broadcast(picked), "doc_id")          # at most max_train rows

    def run(batches):
        for batch in batches:
            doc, text, y = (batch.column(k).to_pylist() for k in range(3))
            for own, pieces in groups(text):
                piece, run_of, ids = _runs(pieces)
                order = np.lexsort((run_of, piece))
                piece, run_of, ids = piece[order], run_of[order], ids[order]
                cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
                rows = []
                for k, row in enumerate(own):
                    b, r = ids[cut[k]:cut[k + 1]], run_of[cut[k]:cut[k + 1]]
                    if len(b):
                        rows.append((doc[row], y[row], b.astype("<u4").tobytes(),
                                     np.bincount(r).astype("<u4").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
                            pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                        names=["doc_id", "y", "ids", "sizes"])

    if not n.get(0) or not n.get(1):
        return Model(np.zeros(1 << BITS), 60.0 if n.get(1) else -60.0)
    # written first, then read a partition at a time: the driver holds the sample once
    found = cut_lineage(chosen.select("doc_id", "text", "y").mapInArrow(
        run, "doc_id long, y int, ids binary, sizes binary"))
    got = [(r["doc_id"], r["y"], bytes(r["ids"]), bytes(r["sizes"])) for r in found.toLocalIterator()]
    got.sort(key=lambda r: (r[0], len(r[2]), r[3]))
    doc = np.array([r[0] for r in got])
    opens = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if got else np.zeros(0, int)
    sizes = [np.frombuffer(r[3], "<u4") for r in got]
    sizes = [s[s > 0] for s in sizes]
    flat = np.frombuffer(b"".join(r[2] for r in got), "<u4")
    y = np.array([got[k][1] for k in opens], int)
    n_runs = np.add.reduceat([len(s) for s in sizes], opens) if got else np.zeros(0, int)
    del got
    return fit(flat, np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, int), n_runs, y,
               n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted, and with ``keep`` the text and a struct of the columns named."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            top = np.full(batch.num_rows, -np.inf)
            for own, pieces in groups(batch.column(1).to_pylist()):
                piece, run_of, ids = _runs(pieces)
                if not len(ids):
                    continue
                most = int(run_of.max()) + 1
                key = piece * most + run_of
                size = np.bincount(key, minlength=len(pieces) * most)
                total = np.bincount(key, weights=m.evidence[ids], minlength=len(pieces) * most)
                mean = np.full(len(size), -np.inf)
                np.divide(total, size, out=mean, where=size > 0)
                np.maximum.at(top, np.array(own), mean.reshape(len(pieces), most).max(axis=1))
            s = m.score(np.where(np.isfinite(top), top, m.blank))
            cols = [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            names = ["doc_id", "score", "predicted"]
            if keep is not None:
                cols, names = [*cols, batch.column(1), batch.column(2)], [*names, "text", "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    cols = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    schema = "doc_id long, score double, predicted int"
    if keep is not None:
        cols.append(F.struct(*(docs[c] for c in keep)).alias("kept"))
    narrow = docs.select(*cols)
    if keep is not None:
        schema += ", text string, kept " + narrow.schema["kept"].dataType.simpleString()
    return narrow.mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted clean, with all their columns."""
    others = [c for c in docs.columns if c != text_col]
    found = score(docs, model, id_col, text_col, keep=others).where("predicted = 0")
    return found.select(*(F.col("text" if c == text_col else f"kept.`{c}`").alias(c) for c in docs.columns))
