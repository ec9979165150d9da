"""A quality classifier without labels: weak labels by a vote model train a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.llm import rules, signals
from arborlog.llm.common import pinned, sliced, small_batches
from arborlog.llm.rules import _SLICE

#: Features: hashed words, word shapes, and bins of document counts.
DIM = 1 << 15
#: About so many rows are fitted on, picked by a hash of doc_id and text, and so many features of them at most (a feature takes
#: 8 bytes); documented bounds of what reaches the driver, whatever the rows are.
FIT_ROWS, FIT_FEATURES = 4096, 8 << 20
_CLASS = np.zeros(256, dtype=np.uint64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?!'\"()", b"#*$%&|<>"), start=1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 6
#: Share of a document's weight that its words, their shapes and its bins have.
_WEIGHT = (0.2, 0.4, 0.4)
_SCALE = 8.0


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


def features(column: pa.Array):
    """(text, bucket, weight) of each feature, texts ascending in each kind, and the counts. Weights of a text add up to 1 at most."""
    c, w, h = signals.counts(column)
    owner = w.owner()
    shape = np.zeros(len(h), dtype=np.uint64)
    if len(h):
        shape = (_CLASS[w.data[w.starts]] * np.uint64(8) + _CLASS[w.data[w.ends - 1]]) * np.uint64(16) + np.minimum(w.ends - w.starts, 15).astype(np.uint64)
    share = 1.0 / np.maximum(1, w.counts)
    text, bucket, weight = [owner, owner], [_bucket(h, 1), _bucket(shape, 2)], [_WEIGHT[0] * share[owner], _WEIGHT[1] * share[owner]]
    n = np.maximum(1, c["n_words"])
    shares = [c["word_chars"] / n / 12, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(1, c["n_lines"]), c["n_repeat_words"] / n, c["n_upper"] / np.maximum(1, c["n_letters"]), c["n_small"] / n, c["n_stops"] / n, np.log2(n) / 16]
    for k, x in enumerate(shares):
        text.append(np.arange(len(n)))
        bucket.append(_bucket(np.minimum(15, np.sqrt(np.maximum(0, x)) * 16).astype(np.uint64) + np.uint64(100 * k), 3))
        weight.append(np.full(len(n), _WEIGHT[2] / len(shares)))
    return text, bucket, weight, c


class Scorer:
    """sigmoid(scale * weighted mean of bucket weights + bias)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def __call__(self, column: pa.Array) -> np.ndarray:
        text, bucket, weight, _ = features(column)
        total = np.zeros(len(column))
        for t, b, x in zip(text, bucket, weight):
            total += np.bincount(t, weights=self.weights[b] * x, minlength=len(column))
        return 1 / (1 + np.exp(-(_SCALE * total + self.bias)))


def train(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, label: np.ndarray, steps: int = 300, l2: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels; both classes weigh the same. Accelerated gradient, from zero: reruns agree."""
    n = max(1, len(label))
    w, bias = np.zeros(DIM), 0.0
    if len(label) == 0 or label.max() - label.min() < 1e-9:
        return Scorer(w, 4.0 if len(label) == 0 or label.mean() >= 0.5 else -4.0)
    balance = np.where(label >= 0.5, 0.5 / max(1e-9, label.mean()), 0.5 / max(1e-9, 1 - label.mean())) / n
    v, vb, t = w.copy(), bias, 1.0
    rate = 8.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(_SCALE * np.bincount(row, weights=v[bucket] * weight, minlength=n) + vb)))
        err = (p - label) * balance
        w2 = v - rate * (_SCALE * np.bincount(bucket, weights=err[row] * weight, minlength=DIM) + l2 * v)
        b2 = vb - rate * 0.25 * err.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    return Scorer(w, bias)


def picked(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows by a hash of doc_id and text, at most twice as many, and some if there are any.

    A share of all is picked by threshold. Where rows are so alike that their hashes are all on one side, the bound holds on
    the one, and on the other the first rows stand in.
    """
    if total <= rows:
        return docs
    below = max(1, int(rows / total * (1 << 30)))
    seen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1 << 30)) < below).limit(2 * rows)
    return docs.limit(rows) if seen.isEmpty() else seen


def fit(docs: DataFrame, rows: int = FIT_ROWS, most: int = FIT_FEATURES) -> Scorer:
    """Labels by the vote model of all rows' heuristics; the scorer on a sample of rows (``picked``), up to ``most`` features of them."""
    small_batches(docs.sparkSession)
    table = pinned(rules.vote_table(docs).select("votes"))
    model, _ = rules.fit_votes(table)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    seen = picked(text, rows, table.count()).select("text")

    def run(batches):
        for b in batches:
            for piece in sliced(b, 0, _SLICE):
                text, bucket, weight, c = features(piece.column(0))
                key, back = np.unique(np.concatenate(text) * DIM + np.concatenate(bucket), return_inverse=True)
                sums = np.bincount(back, weights=np.concatenate(weight))
                cut = np.searchsorted(key, np.arange(piece.num_rows + 1) * DIM)
                good = model(signals.votes(c))
                rows = [((key[i:j] % DIM).astype("<i4").tobytes(), sums[i:j].astype("<f4").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.binary()) for k in range(2)] + [pa.array(good, pa.float64())], ["bucket", "weight", "label"])

    bucket, weight, label, size = [], [], [], []
    for r in seen.mapInArrow(run, "bucket binary, weight binary, label double").toLocalIterator():
        if sum(size) + len(r["bucket"]) // 4 > most and size:
            break
        bucket.append(np.frombuffer(r["bucket"], dtype="<i4"))
        weight.append(np.frombuffer(r["weight"], dtype="<f4"))
        label.append(r["label"])
        size.append(len(bucket[-1]))
    joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
    return train(np.repeat(np.arange(len(label)), size), joined(bucket, np.int64), joined(weight, float), np.array(label))


def score(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """(doc_id, score, kept) for each row of docs(doc_id, text, ...), from the whole text.

    Null or empty text: score 0, not kept. Null doc_id and repeated rows: a row each. Empty table: no rows. A score of exactly
    ``least`` is kept. Other columns are ignored.
    The scorer (DIM numbers) is broadcast.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            for part in sliced(b, 1, _SLICE):
                some = np.array([bool(t and t.strip()) for t in part.column(1).to_pylist()], dtype=bool)
                p = np.where(some, shared.value(part.column(1)), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= least)], ["doc_id", "score", "kept"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, kept boolean")
