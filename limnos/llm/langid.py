"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 letters inside words; a text's weight of
a feature is its share of the text's n-grams times ln((1 + N) / (1 + df)) + 1
(and a constant), with N and df counted over every learning row.  The weights of the labels are
learnt by follow-the-regularised-leader with elastic-net penalties (so most
stay exactly zero) on a sample of at most ``max_train`` learning rows, chosen by
a hash and evened out over the labels; a quarter of it is held back to fit one
temperature, which calibrates the probabilities.  Prediction is a scan.

Defined results: NULL texts and texts without a letter are ``und`` with score 0;
rows with a NULL label or NULL id are never learnt from; a single label is
always predicted, with score 1; no learnable rows: every text is ``und``; ties
go to the label that sorts first; repeated rows count each; other columns may
be carried by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.ngrams import Chars, bucket, groups
from limnos.llm.runtime import ship, sum_parts, vector_parts

BITS, ORDERS, PARTS = 16, (1, 2, 3), 16
MAX_TRAIN, MAX_LABELS = 4000, 1000
SCALE, STEPS = 20.0, 12_000      # of the shares; documents seen in training, at least


def _counts(texts, n_rows: int):
    """Yield (row, buckets, counts) of each text with letters; pieces of a text come together."""
    held: dict[int, list] = {}

    def done(row):
        flat = np.concatenate(held.pop(row))
        if len(flat):
            yield (row, *np.unique(flat, return_counts=True))

    for rows, pieces in groups(texts):
        chars, own = Chars(pieces), [[] for _ in pieces]
        for n in ORDERS:
            h, at = chars.grams(n)
            piece = chars.piece[at]
            cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
            b = bucket(h, BITS)
            for k in range(len(pieces)):
                own[k].append(b[cut[k]:cut[k + 1]])
        for row, x in zip(rows, own, strict=True):
            for old in [r for r in held if r != row]:
                yield from done(old)
            held.setdefault(row, []).extend(x)
    for row in list(held):
        yield from done(row)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each bucket, and texts, over all rows of (text)."""

    def run(batches):
        df, n = np.zeros((1 << BITS) + PARTS, np.int64), 0
        for batch in batches:
            for _, b, _ in _counts(batch.column(0).to_pylist(), batch.num_rows):
                df[b] += 1
                n += 1
        df[-1] = n
        yield vector_parts(df, PARTS)

    total = sum_parts(rows.select("text").mapInArrow(run, "part int, counts binary"), PARTS, (1 << BITS) + PARTS)
    return total[:1 << BITS], int(total[-1])


class Model:
    """Labels, weights (features x labels, idf folded in), bias and temperature."""

    def __init__(self, labels, weights, bias, temperature=1.0):
        self.labels, self.weights, self.bias, self.temperature = labels, weights, bias, temperature

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def ftrl(samples, n_labels: int, alpha=0.5, beta=1.0, l1=0.002, l2=0.01) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal for multinomial logistic loss.  samples: (features, values, label)."""
    size = (1 << BITS) + 1                       # the last feature is the bias
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))

    def weights(f):
        zf = z[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)
        w[np.abs(zf) <= l1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(max(3, -(-STEPS // max(len(samples), 1)))):
        for k in order.permutation(len(samples)):
            f, x, y = samples[k]
            f, x = np.append(f, size - 1), np.append(x, 1.0)
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        top = s.max(axis=1)
        return float(np.mean(np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(labels)), labels]))

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(learn: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on rows (doc_id, text, label); every row counts for df, at most ``max_train`` for the weights."""
    ship(learn.sparkSession)
    per = {r["label"]: r["count"] for r in learn.groupBy("label").count().limit(MAX_LABELS + 1).collect()}
    if len(per) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = sorted(per)
    if not labels:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    df, n = document_frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 1
    # a uniform hash times the label's rows: the smallest ones are as many of each label
    rows = F.create_map(*(x for k in labels for x in (F.lit(k), F.lit(float(per[k])))))
    order = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40)) * F.element_at(rows, F.col("label"))
    picked = learn.withColumn("order", order).select("doc_id", "order", "label").orderBy("order", "doc_id").limit(max_train)
    chosen = learn.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id")   # at most max_train ids

    def run(batches):
        for batch in batches:
            lab, doc = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = [(doc[r], lab[r], b.astype("<u4").tobytes(), c.astype("<u4").tobytes())
                   for r, b, c in _counts(batch.column(1).to_pylist(), batch.num_rows)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)],
                    names=["doc_id", "label", "b", "c"])

    got = chosen.select("label", "text", "doc_id").mapInArrow(run, "doc_id long, label string, b binary, c binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["b"])))
    samples = []
    for r in got:
        b, c = np.frombuffer(r["b"], "<u4").astype(np.int64), np.frombuffer(r["c"], "<u4")
        samples.append((b, SCALE * idf[b] * c / c.sum(), labels.index(r["label"])))
    held = samples[::4] if len(samples) >= 40 else []
    fit = [s for k, s in enumerate(samples) if not held or k % 4]
    w, bias = ftrl(fit, len(labels))
    logits = np.array([x @ w[b] + bias for b, x, _ in held]).reshape(len(held), len(labels))
    t = fit_temperature(logits, np.array([y for _, _, y in held], int))
    return Model(labels, SCALE * w * idf[:, None], bias, t)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # fixed size: buckets x labels

    def run(batches):
        m = shared.value
        k = len(m.labels)
        table = m.weights.astype(np.float64)
        for batch in batches:
            rows = batch.num_rows
            total, grams = np.zeros((rows, k)), np.zeros(rows)
            for own, pieces in groups(batch.column(1).to_pylist()):
                chars = Chars(pieces)
                own = np.array(own)
                for n in ORDERS:
                    h, at = chars.grams(n)
                    row = own[chars.piece[at]]
                    b = bucket(h, BITS)
                    grams += np.bincount(row, minlength=rows)
                    for c in range(k):
                        total[:, c] += np.bincount(row, weights=table[b, c], minlength=rows)
            known = grams > 0
            label, score = np.full(rows, "und", object), np.zeros(rows)
            if k and known.any():
                p = m.probabilities(total[known] / grams[known, None] + m.bias)
                best = p.argmax(axis=1)
                label[known] = np.array(m.labels, object)[best]
                score[known] = p[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label.tolist(), pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
