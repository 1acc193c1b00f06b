"""Toxicity by a chain of linear models (operator 5).

The categories of the label table are predicted one after the other by logistic regressions; each
model also sees the probabilities of the categories before it. For training these come from
models that have not seen the row (five folds), for prediction from the models fitted on all rows.

* Features are words and the first four, five and six bytes of words (inflected forms share
  them), those that differ most between the classes by a chi-squared test.
* The models are fitted on at most ``MAX_LABELLED`` labelled documents, those with the least
  seeded hash of their ids. Candidates are counted by Spark; what the driver holds is bounded by
  that number. All documents are scored, whole, where they lie, without a shuffle.

Results: null, empty and wordless texts have no features and get the base rate. Labels that are
null are left out, of repeated ones the largest counts, of repeated documents the first text.
Without labels of both classes a category's probability is the smoothed share of its ones
(0.5 without any label). Repeated rows and null ids are scored like others; an input column named
like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tables import append, slices, whole_texts
from .text import ALNUM, HashTable, Words, mix

MAX_LABELLED = 10_000
FEATURES = 512
FOLDS = 5
PREFIXES = (4, 5, 6)
PENALTY = 2e-5
STEPS = 400
THRESHOLD = 0.5


@dataclass
class Chain:
    """Categories in order, the features' hashes, and per category its weights (one a feature,
    one for each earlier category) and bias."""

    categories: list[str]
    vocabulary: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def probabilities(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
        """Of n documents, given their features as (row, column, value)."""
        out: list[np.ndarray] = []
        k = len(self.vocabulary)
        for w, b in zip(self.weights, self.biases):
            z = np.bincount(rows, weights=values * w[columns], minlength=n) + b
            for i, p in enumerate(out):
                z += w[k + i] * _link(p)
            out.append(_sigmoid(z))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _link(p: np.ndarray) -> np.ndarray:
    """How an earlier category's probability enters a model: its log odds, scaled."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) for every word and every prefix of a batch."""
    words = Words(column, ALNUM, prefixes=PREFIXES)
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    docs, keys = [doc], [words.hashes]
    for k in PREFIXES:
        has = words.prefixes[k] != 0
        docs.append(doc[has])
        keys.append(mix(words.prefixes[k][has] + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(keys)


def _counted(column, table: HashTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the vocabulary's features in a batch; the value is log(1 + count)."""
    words = Words(column, ALNUM, prefixes=PREFIXES)
    n, size = len(words.first) - 1, max(1, len(table.keys))
    pairs = []
    for keys in (words.hashes, *(mix(words.prefixes[k] + np.uint64(k)) for k in PREFIXES)):
        at, value = table.find(keys)
        pairs.append((np.searchsorted(words.first, at, "right") - 1) * size + value)
    pair, count = np.unique(np.concatenate(pairs), return_counts=True)
    return pair // size, pair % size, np.log1p(count)


def _fit(rows, columns, values, dense: np.ndarray, y: np.ndarray, k: int, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty, by accelerated gradient steps."""
    n, d = len(y), k + dense.shape[1]
    base = float(np.clip((y.sum() + 1) / (n + 2), 1e-4, 1 - 1e-4))
    bias0 = np.log(base / (1 - base))
    if not n or y.min(initial=1) == y.max(initial=0):
        return np.zeros(d), bias0

    def forward(w):
        return np.bincount(rows, weights=values * w[columns], minlength=n) + dense @ w[k:d] + w[d]

    def backward(r):
        return np.concatenate((np.bincount(columns, weights=values * r[rows], minlength=k), dense.T @ r, [r.sum()])) / n

    v = np.ones(d + 1)
    for _ in range(15):
        v /= np.linalg.norm(v) or 1.0
        v = backward(forward(v))
    step = 1 / (0.3 * np.linalg.norm(v) + penalty + 1e-9)
    w = np.zeros(d + 1)
    w[d] = bias0
    ahead, t = w, 1.0
    ridge = np.full(d + 1, penalty)
    ridge[d] = 0
    for _ in range(steps):
        new = ahead - step * (backward(_sigmoid(forward(ahead)) - y) + ridge * ahead)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w[:d], float(w[d])


def _chain(categories, vocabulary, rows, columns, values, labels: np.ndarray, folds: np.ndarray, penalty: float, steps: int) -> Chain:
    chain, k, n = Chain(categories, vocabulary), len(vocabulary), len(labels)
    earlier = np.zeros((n, 0))
    fold_of = folds[rows]
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        w, b = _fit(rows, columns, values, earlier, y, k, penalty, steps)
        chain.weights.append(w)
        chain.biases.append(b)
        if c + 1 < len(categories):
            out = np.zeros(n)
            for f in range(FOLDS):
                use = folds != f
                position = np.cumsum(use) - 1
                own = fold_of != f
                wf, bf = _fit(position[rows[own]], columns[own], values[own], earlier[use], y[use], k, penalty, steps)
                z = np.bincount(rows[~own], weights=values[~own] * wf[columns[~own]], minlength=n) + earlier @ wf[k:] + bf
                out[~use] = _sigmoid(z[~use])
            earlier = np.column_stack((earlier, _link(out)))
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], max_labelled: int = MAX_LABELLED, features: int = FEATURES, seed: int = 5) -> Chain:
    """A chain for 0/1 ``categories`` (columns of ``labels``, which is keyed by doc_id), in this order."""
    known = labels.filter(" and ".join(f"`{c}` is not null" for c in ["doc_id", *categories])).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
    ys = [f"y{i}" for i in range(len(categories))]
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    # the side sent to all tasks has max_labelled rows at most
    rows = whole_texts(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(y).alias(y) for y in ys])
    rows = cut(rows, "labelled")
    totals = rows.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
    n, ones = totals[0], [t or 0 for t in totals[1:]]
    vocabulary = _vocabulary(rows, ys, n, ones, features)
    table = HashTable(vocabulary)

    def counted(batches):
        for batch in slices(batches):
            row, column, value = _counted(batch.column("text"), table)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(y) for y in ys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(column.astype(np.int32))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))],
                names=["doc_id", *ys, "columns", "values"],
            )

    got = rows.select("doc_id", "text", *ys).mapInArrow(counted, "doc_id long, " + ", ".join(f"{y} int" for y in ys) + ", columns array<int>, values array<double>")
    got = got.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(FOLDS))).orderBy("doc_id").drop("doc_id").toArrow()
    y = np.column_stack([got[c].to_numpy() for c in ys]) if n else np.zeros((0, len(ys)))
    columns, values = (got[c].combine_chunks() for c in ("columns", "values"))
    at = np.repeat(np.arange(n), np.diff(columns.offsets.to_numpy())) if n else np.zeros(0, dtype=np.int64)
    return _chain(categories, vocabulary, at, columns.flatten().to_numpy(), values.flatten().to_numpy(), y, got["fold"].to_numpy(), PENALTY, STEPS)


def _vocabulary(rows: DataFrame, ys: list[str], n: int, ones: list[int], features: int) -> np.ndarray:
    """For each category the ``features`` hashes whose documents differ most between its classes."""
    sums = [f"s{i}" for i in range(len(ys))]

    def count(batches):
        for batch in slices(batches):
            doc, key = _features(batch.column("text"))
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            doc, key = doc[new], key[new]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
            n_docs = np.diff(np.append(head, len(key)))
            sums_ = [np.add.reduceat(batch.column(y).to_numpy()[doc].astype(np.int64), head) if len(head) else n_docs for y in ys]
            yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(n_docs), *map(pa.array, sums_)], names=["key", "n", *sums])

    parts = rows.select("text", *ys).mapInArrow(count, "key long, n long, " + ", ".join(f"{s} long" for s in sums))
    counts = parts.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).filter("n > 2")
    keys: list[int] = []
    counts = cut(counts, "features")
    for s, one in zip(sums, ones):
        if 0 < one < n:
            surprise = F.col(s) - F.col("n") * (one / n)
            score = surprise * surprise / (F.col("n") * (1 - F.col("n") / (n + 1)))
            keys += [r.key for r in counts.orderBy(score.desc(), "key").limit(features).collect()]
    return np.unique(np.array(keys, dtype=np.int64)).view(np.uint64)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` (text) with p_<category> for each category of the chain."""
    table = HashTable(chain.vocabulary)

    def run(batch):
        row, column, value = _counted(batch.column("text"), table)
        return [pa.array(p) for p in chain.probabilities(row, column, value, batch.num_rows)]

    return append(docs, run, ", ".join(f"`p_{c}` double" for c in chain.categories))


def remove_toxic(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose last category has at least ``threshold`` probability."""
    chain = fit(docs, labels, categories)
    rows = docs.select(F.struct(*docs.columns).alias("document"), "text")
    return score(rows, chain).filter(F.col(f"p_{categories[-1]}") < threshold).select("document.*")
