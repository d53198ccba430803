"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each later model also sees
the log-odds that the earlier models give. For training those log-odds are
out of fold: the rows of a fold are predicted by models that never saw them.

Features: the words of a text (ASCII lower case) and their first 4 and 5
bytes, hashed; a text has a feature or not. Of the features seen in a
training part, the ``kept`` with the largest chi-squared are used. Each model
is a ridge logistic regression, fitted by Newton steps.

Training reads at most ``sample`` labelled documents (those with the smallest
hashed id, so the choice does not depend on the partitions). Their features are
counted and chosen by Spark; the driver gets only the chosen ones, at most
``kept`` for each category and training part, however long the documents are.
Labels of ids that no document has take no
place in it, and repeated labels of one id count as one: in each category the
answer of most of them, NULLs left out, a tie as yes. Every document is scored, by one pass
without a shuffle. The threshold maximises F1 on the out-of-fold predictions.

Edge cases: NULL or empty text has no features; a NULL label leaves a row out
of that category's fit; a category whose sample lacks one class gets a
constant probability and no decision. Repeated rows are scored each, and a
repeated id is trained on once. Columns of the input stay; columns with the
names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.session import materialize

from ._words import U64, Words, chunks, rows_of, small_batches

SPACE_BITS = 22
FOLDS = 3
LEAST_CHI = 15.0  # chi-squared below which a feature is taken for noise


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, sorted."""
    words = Words(texts, lower=True)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    mask = U64((1 << SPACE_BITS) - 1)
    ids = [(words.hashes(limit) + U64(salt)) & mask for salt, limit in enumerate((None, 4, 5))]
    pairs = np.unique(np.concatenate([(text.astype(U64) << U64(SPACE_BITS)) | i for i in ids])) if len(text) else np.empty(0, U64)
    return (pairs >> U64(SPACE_BITS)).astype(np.int64), (pairs & mask).astype(np.int64)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the last one the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Link:
    """One model of the chain."""

    name: str
    features: np.ndarray  # sorted feature ids
    weights: np.ndarray  # of the features, then of the earlier log-odds, then the intercept
    threshold: float


def _dense(rows: np.ndarray, ids: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((n, len(chosen)))
    if len(chosen) and len(ids):
        at = np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)
        hit = chosen[at] == ids
        x[rows[hit], at[hit]] = 1
    return x


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def fit_chain(rows: np.ndarray, ids: np.ndarray, fold: np.ndarray, labels: dict[str, np.ndarray], chosen_of: dict[tuple[str, int], np.ndarray]) -> list[Link]:
    """rows, ids: (row, feature) pairs; fold: of each row; labels: 0, 1 or NaN of each row, in the order of the chain.

    chosen_of: sorted features by category and the fold left out (``FOLDS``: none).
    """
    n, chain = len(fold), []
    earlier = np.zeros((n, 0))
    for name, y in labels.items():
        known = ~np.isnan(y)
        y = np.nan_to_num(y)

        def fit(use, left_out):
            if use.sum() == 0 or y[use].min() == y[use].max():
                rate = (y[use].sum() + 0.5) / (use.sum() + 1)
                return np.empty(0, np.int64), np.concatenate((np.zeros(earlier.shape[1]), [np.log(rate / (1 - rate))]))
            chosen = chosen_of[name, left_out]
            return chosen, fit_logistic(np.column_stack([_dense(rows, ids, n, chosen), earlier])[use], y[use])

        def predict(chosen, w):
            return _logit(np.column_stack([_dense(rows, ids, n, chosen), earlier]), w)

        outside = np.zeros(n)
        for k in range(FOLDS):
            outside[fold == k] = predict(*fit(known & (fold != k), k))[fold == k]
        chosen, w = fit(known, FOLDS)
        p = 1 / (1 + np.exp(-outside[known]))
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[known][order])
        threshold = 2.0
        if len(chosen):
            f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
            best = int(np.argmax(f1))
            below = p[order][best + 1] if best + 1 < len(p) else 0.0
            threshold = float((p[order][best] + below) / 2)
        chain.append(Link(name, chosen, w, threshold))
        earlier = np.column_stack([earlier, outside])
    return chain


def apply_chain(chain: list[Link], texts: list[bytes | None]) -> list[np.ndarray]:
    """Probability of each category for each text."""
    rows, ids = features(texts)
    earlier, out = np.zeros((len(texts), 0)), []
    for link in chain:
        logit = np.full(len(texts), link.weights[-1])
        if len(link.features) and len(ids):
            at = np.minimum(np.searchsorted(link.features, ids), len(link.features) - 1)
            hit = link.features[at] == ids
            logit += np.bincount(rows[hit], link.weights[at[hit]], minlength=len(texts))
        logit += earlier @ link.weights[len(link.features):-1]
        logit = np.clip(logit, -30, 30)
        earlier = np.column_stack([earlier, logit])
        out.append(1 / (1 + np.exp(-logit)))
    return out


def _feature_task(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32()))])
    for batch in batches:
        for part in chunks(rows_of(batch, "doc_id", "text"), lambda r: len(r[1] or b"") + 64):
            rows, ids = features([r[1] for r in part])
            begin = np.searchsorted(rows, np.arange(len(part) + 1))
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), lists], schema=schema)


def choose(seen: DataFrame, answers: list[str], kept: int) -> dict[tuple[int, int], np.ndarray]:
    """By number of the category and fold left out (``FOLDS``: none): the ``kept`` features of largest chi-squared in the rest, sorted.

    seen: fold, features and the columns ``answers`` of the training rows.
    """
    cells = [(i, y, f) for i, y in enumerate(answers) for f in range(FOLDS)]

    def counts() -> list[Column]:
        inside = [(i, f, (F.col("fold") == f) & F.col(y).isNotNull(), F.col(y)) for i, y, f in cells]
        return [F.count(F.when(on, 1)).alias(f"n{i}_{f}") for i, f, on, _ in inside] + [F.count(F.when(on & (y == 1), 1)).alias(f"p{i}_{f}") for i, f, on, y in inside]

    whole = seen.agg(*counts()).first()
    by_feature = materialize(seen.select("fold", *answers, F.explode("features").alias("feature")).groupBy("feature").agg(*counts()), "feature-counts")
    best = []
    for i in range(len(answers)):
        for left_out in range(FOLDS + 1):
            used = [f for f in range(FOLDS) if f != left_out]
            n, positive = (sum(whole[f"{c}{i}_{f}"] for f in used) for c in "np")
            if not 0 < positive < n:
                continue  # no class to tell apart
            total, with_label = (sum((F.col(f"{c}{i}_{f}") for f in used), F.lit(0)).cast("double") for c in "np")
            expected = total * float(positive) / float(n)
            spread = F.greatest(expected * (1 - total / float(n)) * (1 - positive / n), F.lit(1e-9))
            chi = (with_label - expected) * (with_label - expected) / spread
            scored = by_feature.select("feature", total.alias("total"), chi.alias("chi")).filter((F.col("total") >= 3) & (F.col("chi") >= LEAST_CHI))
            best.append(scored.orderBy(F.desc("chi"), "feature").limit(kept).select(F.lit(i).alias("category"), F.lit(left_out).alias("left_out"), "feature"))
    found: dict[tuple[int, int], list[int]] = {(i, f): [] for i in range(len(answers)) for f in range(FOLDS + 1)}
    for r in reduce(DataFrame.unionByName, best).collect() if best else []:  # at most kept * categories * (FOLDS + 1) rows
        found[r["category"], r["left_out"]].append(r["feature"])
    return {part: np.sort(np.array(ids, np.int64)) for part, ids in found.items()}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]], sample: int = 6000, kept: int = 512) -> list[Link]:
    """categories: name -> (label column, value that means yes), in the order of the chain."""
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    answers = [f"y{i}" for i in range(len(categories))]
    chosen = materialize(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"y{i}") for i, (c, v) in enumerate(categories.values())))
        .groupBy("doc_id")
        .agg(*((F.avg(y) >= 0.5).cast("double").alias(y) for y in answers))
        .join(present, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample),
        "labelled",
    )
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    seen = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(_feature_task, "doc_id long, features array<int>").dropDuplicates(["doc_id"])
    seen = materialize(seen.join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))), "toxicity-sample")
    best = choose(seen, answers, kept)
    wanted = np.unique(np.concatenate(list(best.values())))
    some = F.array(*map(F.lit, wanted.tolist())).cast("array<int>")
    rows = sorted(seen.withColumn("features", F.array_intersect("features", some)).collect(), key=lambda r: r["doc_id"])
    ids = [np.array(r["features"], np.int64) for r in rows]
    return fit_chain(
        np.repeat(np.arange(len(rows)), [len(i) for i in ids]) if rows else np.empty(0, np.int64),
        np.concatenate(ids) if rows else np.empty(0, np.int64),
        np.array([r["fold"] for r in rows], np.int64),
        {name: np.array([np.nan if r[f"y{i}"] is None else r[f"y{i}"] for r in rows], float) for i, name in enumerate(categories)},
        {(name, f): best[i, f] for i, name in enumerate(categories) for f in range(FOLDS + 1)},
    )


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """``docs`` with p_<name> and the decision <name> of each category."""
    new = [f"p_{c.name}" for c in chain] + [c.name for c in chain]
    kept = small_batches(docs).drop(*new)
    out = T.StructType([*kept.schema.fields, *(T.StructField(f"p_{c.name}", T.DoubleType()) for c in chain), *(T.StructField(c.name, T.BooleanType()) for c in chain)])

    def run(batches):
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text").cast(pa.binary()))
            done = [apply_chain(chain, part) for part in chunks(texts, lambda t: len(t or b"") + 64)]
            values = [np.concatenate(v) for v in zip(*done, strict=True)] if done else [np.empty(0)] * len(chain)
            for link, p in zip(chain, values, strict=True):
                batch = batch.append_column(f"p_{link.name}", pa.array(p))
            for link, p in zip(chain, values, strict=True):
                batch = batch.append_column(link.name, pa.array(p >= link.threshold))
            yield batch

    return kept.mapInArrow(run, out)


#: The chain of the registered query: quality is judged first and informs toxicity.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
