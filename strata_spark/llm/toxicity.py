"""Toxicity by a classifier chain of linear models.

The categories of ``CHAIN`` are predicted one after the other; each later model also sees the log odds that the earlier
ones give. In training those are out-of-fold predictions (``FOLDS`` models on the other folds), so a later model learns
how far an unseen document's earlier probabilities can be trusted. Features are the words of the whole text and their
first 4 to 8 bytes, present or not; the ``FEATURES`` most associated with each category are kept. A feature's size grows
with the strength of that association, so that the ridge penalty holds back the weak ones, which are mostly chance.

The models are fitted on at most about ``SAMPLE`` labelled documents, taken by a hash of ``doc_id``; feature counts are
summed by Spark, the selected features of the sample (a few numbers a document) are fitted on the driver. Every document
is scored on its whole text in one pass without a shuffle.

Defined cases: a null text is empty and is scored by the intercepts; labels that are null or of unknown documents are
not used, of several labels of a document the larger toxic and the smaller quality count; without any example of a
category its probability is 0; equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark.llm.tasks import map_arrow
from strata_spark.llm.words import Spans, blocks, utf8, word_bounds
from strata_spark.session import written

CHAIN = ("low_quality", "toxic")
PREFIXES = (4, 5, 6, 7, 8)
SAMPLE = 20_000
FEATURES = 1500
MIN_COUNT = 3
FOLDS = 5
STEPS = 300
RIDGE = 0.2
#: Log-likelihood ratio below which an association is taken for chance.
CHANCE = 3.3
THRESHOLD = 0.5
#: Low bits of a 64-bit integer that hold the row of a block; the rest holds the feature.
_ROW_BITS, _ROW_MASK = np.uint64(20), np.uint64((1 << 20) - 1)


def all_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows: first row, row and hash (44 bits) of each word and of its starts, as often as they occur."""
    raw_all, offsets_all = utf8(texts)
    for lo, hi in blocks(offsets_all):
        offsets = offsets_all[lo: hi + 1] - offsets_all[lo]
        raw = raw_all[offsets_all[lo]: offsets_all[hi]]
        starts, ends, first = word_bounds(raw, offsets)
        spans, row = Spans(raw), np.repeat(np.arange(hi - lo), np.diff(first))
        rows, hashes = [row], [spans.hashes(starts, ends)]
        for n in PREFIXES:
            long = np.flatnonzero(ends - starts > n)
            rows.append(row[long])
            hashes.append(spans.hashes(starts[long], starts[long] + n) * np.uint64(2 * n + 1))
        yield lo, np.concatenate(rows), np.concatenate(hashes) >> _ROW_BITS


def once_a_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of row (of a block) and feature once, sorted by feature."""
    both = np.unique((value << _ROW_BITS) | row.astype(np.uint64))
    return (both & _ROW_MASK).astype(np.int64), both >> _ROW_BITS


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, low_quality, toxic)`` of about ``sample`` labelled documents at most."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic")))
    part = min(1.0, sample / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each feature in a batch, and those of each category."""
    for batch in batches:
        y = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
        for lo, row, value in all_features(batch.column(0)):
            row, value = once_a_row(row, value)
            found, at = np.unique(value, return_inverse=True)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.bincount(at, minlength=n)),
                 *[pa.array(np.bincount(at, weights=x[lo + row], minlength=n).astype(np.int64)) for x in y]],
                names=["feature", "n", *CHAIN])


def select_features(sample: DataFrame, n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the features that tell most about a category, and their size in each category's model."""
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHAIN]).first()
    all_ = float(totals.n or 0)
    counts = map_arrow(
        sample.select("text", *CHAIN), _feature_counts, "feature bigint, n bigint, low_quality bigint, toxic bigint")
    counts = (counts.groupBy("feature").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", *CHAIN)])
              .where(F.col("n") >= MIN_COUNT))
    picked: dict[int, list[float]] = {}
    known = [c for c in CHAIN if 0 < (totals[c] or 0) < all_]
    for c in known:
        counts = counts.withColumn(f"ratio_{c}", _ratio(F.col("n"), F.col(c), all_, float(totals[c])))
    counts = written(counts, "toxicity-features")
    for c in known:
        best = counts.orderBy(F.col(f"ratio_{c}").desc(), "feature").limit(n_features)
        for r in best.collect():
            picked[r.feature] = [r[f"ratio_{k}"] if k in known else 0.0 for k in CHAIN]
    features = np.array(list(picked), np.int64).view(np.uint64)
    ratios = np.array(list(picked.values()), float).reshape(-1, len(CHAIN))
    order = np.argsort(features)
    sizes = np.sqrt(np.where(ratios < CHANCE, 0.0, ratios) / np.maximum(ratios.max(axis=0, initial=0.0), CHANCE))
    return features[order], sizes[order].T


def _ratio(n: Column, k: Column, all_: float, yes: float) -> Column:
    """Log-likelihood ratio of a feature in ``n`` of all documents, ``k`` of them of the category."""
    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    no = all_ - yes
    return (term(k, n * yes / all_) + term(n - k, n * no / all_) + term(yes - k, (all_ - n) * yes / all_)
            + term(no - (n - k), (all_ - n) * no / all_))


def selected_pairs(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every selected feature found."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(features):
        maybe = np.zeros(1 << 20, bool)
        maybe[(features & _ROW_MASK).astype(np.int64)] = True
        for lo, row, value in all_features(texts):
            likely = np.flatnonzero(maybe[(value & _ROW_MASK).astype(np.int64)])
            at = np.minimum(np.searchsorted(features, value[likely]), len(features) - 1)
            same = features[at] == value[likely]
            row, value = once_a_row(row[likely][same], at[same].astype(np.uint64))
            order = np.argsort(row, kind="stable")
            rows.append(row[order] + lo)
            found.append(value[order].astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Linear:
    """A logistic model: intercept, weights of the selected features, weights of the earlier log odds."""

    intercept: float
    weights: np.ndarray
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_odds(self, n: int, row: np.ndarray, feature: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        z = self.intercept + np.bincount(row, weights=self.weights[feature], minlength=n)[:n]
        for w, x in zip(self.earlier, before):
            z = z + w * x
        return z


def fit_linear(n: int, row: np.ndarray, feature: np.ndarray, sizes: np.ndarray, before: list[np.ndarray], y: np.ndarray,
               use: np.ndarray) -> Linear:
    """Logistic regression with a ridge penalty on the rows of ``use``, by gradient steps of adapted length."""
    n_features = len(sizes)
    model = Linear(-30.0, np.zeros(n_features), np.zeros(len(before)))
    yes = float(y[use].sum())
    if yes == 0:
        return model
    at = use[row]
    row, feature = row[at], feature[at]
    model.intercept = float(np.log((yes + 0.5) / (use.sum() - yes + 0.5)))
    size = 1 + n_features + len(before)
    first, second, own = np.zeros(size), np.zeros(size), np.zeros(n_features)
    for step in range(1, STEPS + 1):
        z = np.clip(model.log_odds(n, row, feature, before), -30, 30)
        error = np.where(use, 1 / (1 + np.exp(-z)) - y, 0.0)
        gradient = np.concatenate([[error.sum()], np.bincount(feature, weights=error[row], minlength=n_features) * sizes,
                                   [(error * x).sum() for x in before]])
        gradient[1:] += RIDGE * np.concatenate([own, model.earlier])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.intercept -= move[0]
        own = own - move[1: 1 + n_features]
        model.weights = own * sizes
        model.earlier = model.earlier - move[1 + n_features:]
    return model


@dataclass
class Chain:
    """Selected features and one model a category."""

    features: np.ndarray
    models: list[Linear]

    def log_odds(self, texts: pa.Array) -> list[np.ndarray]:
        row, feature = selected_pairs(texts, self.features)
        out: list[np.ndarray] = []
        for model in self.models:
            out.append(np.clip(model.log_odds(len(texts), row, feature, out), -30, 30))
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Chain:
    """Chain fitted on a bounded sample of the labelled documents."""
    taken = labelled_sample(docs, labels, sample)
    features, sizes = select_features(taken, n_features)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = selected_pairs(batch.column(1), features)
            lists = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[batch.column(i) for i in (2, 3)], pa.array([x.tobytes() for x in lists[: batch.num_rows]], pa.binary())],
                names=["doc_id", *CHAIN, "found"])

    rows = map_arrow(
        taken.select("doc_id", "text", *CHAIN), pairs, "doc_id bigint, low_quality int, toxic int, found binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.found))
    n = len(rows)
    found = [np.frombuffer(r.found, np.int32) for r in rows]
    row = np.repeat(np.arange(n), [len(x) for x in found])
    feature = np.concatenate([np.zeros(0, np.int32), *found])
    fold = np.array([r.doc_id for r in rows], np.int64) % FOLDS
    models, before = [], []
    for c, size in zip(CHAIN, sizes):
        y = np.array([r[c] for r in rows], float)
        out = np.zeros(n)
        for k in range(FOLDS):
            held = fold == k
            model = fit_linear(n, row, feature, size, before, y, ~held)
            out[held] = np.clip(model.log_odds(n, row, feature, before), -30, 30)[held]
        models.append(fit_linear(n, row, feature, size, before, y, np.ones(n, bool)))
        before.append(out)
    return Chain(features, models)


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """``(doc_id, p_low_quality, p_toxic)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [pa.array(1 / (1 + np.exp(-z))) for z in chain.log_odds(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *p], names=["doc_id", "p_low_quality", "p_toxic"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, p_low_quality double, p_toxic double")


def keep_non_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the chain calls toxic, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = chain.log_odds(batch.column(at))[-1]
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) < threshold))

    return map_arrow(docs, run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Probabilities of both categories for all documents, and whether a document is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit_chain(docs, labels))
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
