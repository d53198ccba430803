"""Exact top-k search by Fagin's threshold algorithm.

Vectors become integers, floor(256 x) per component; the score is their
inner product. Candidates are dealt into blocks by hashed id, queries into
groups; each (query group, candidate block) pair is one small Spark group. In
it every dimension's candidates are sorted once. For a query, sorted access
walks all lists together, from the end that its component favours; newly
seen candidates are scored at once. The sum of the next entries' products
bounds every unseen score, and the walk stops when that bound is below the
k-th best score found (equal scores can still win by a smaller id, so a tie
goes on). Each pair returns its best, and a window keeps the best k per query.

Equal rows (id and vector) travel and are searched as one row with their
number, so copies cost nothing however many there are. A query's own row is one
of its copies; the others are candidates like any other row.

The work is |queries| x |candidates| in blocks, as the stated query set
implies; what travels is each vector once per block of the other side.

Edge cases: vectors that are NULL or hold a NULL or non-finite component take
no part, and only vectors of equal length meet; empty vectors meet each other,
with score 0. Every row is a query or candidate of its own: rows of one id and
different vectors are each other's candidates and get k rows each, and so do
equal rows. (Queries of one id are told apart by a 64-bit hash of the vector.) Fewer than k
candidates: all of them. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.session import materialize

SCALE = 256
STEP = 32  # entries read from every list before the bound is first looked at; then twice as many, and so on


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector of longs, dim) of the rows that take part."""
    x = F.col(vector_column)
    fine = x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return (
        rows.filter(fine & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(SCALE * v.cast("double")).cast("long")).alias("vector"))
        .withColumn("dim", F.size("vector"))
    )


def threshold_search(query: np.ndarray, fit: np.ndarray, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, sorted_values: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, place) of a block's candidates, highest score first, then smallest id.

    fit: which candidates take part; order, sorted_values: per dimension, the candidates by ascending component.
    """
    n = len(ids)
    unseen = fit.copy()
    best_score, best = np.empty(0, vectors.dtype), np.empty(0, np.int64)
    active = np.flatnonzero(query)
    q = query[active]
    up, down = active[q < 0], active[q > 0]  # a negative component favours the smallest values
    at, last = 0, min(STEP, n)
    while True:
        found = np.zeros(n, bool)
        if len(active):
            found[order[up, at:last]] = True
            found[order[down, n - last:n - at]] = True
        else:
            found[:] = True
        new = np.flatnonzero(found & unseen)
        unseen[new] = False
        score = vectors[new] @ query
        if len(best_score) == k:
            fair = score >= best_score[-1]
            new, score = new[fair], score[fair]
        if len(new):
            score, place = np.concatenate((best_score, score)), np.concatenate((best, new))
            if len(score) > 4 * k:
                fair = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, place = score[fair], place[fair]
            top = np.lexsort((ids[place], -score))[:k]
            best_score, best = score[top], place[top]
        if last == n or not len(active):
            break
        bound = np.dot(query[up], sorted_values[up, last]) + np.dot(query[down], sorted_values[down, n - 1 - last])
        if len(best_score) == k and bound < best_score[-1]:
            break
        at, last = last, min(n, 2 * last)
    return [(int(s), int(i)) for s, i in zip(best_score, best, strict=True)]


def _numbers(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, dim)


def _kind(a: np.ndarray, b: np.ndarray, dim: int):
    """The fastest type in which every inner product is exact."""
    most = dim * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


FOUND = "query_id long, query_mark long, queries long, score long, vec_id long, copies long"


def _pair_task(k: int):
    names = [c.split()[0] for c in FOUND.split(", ")]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(key, queries, candidates):
        out = {name: [] for name in names}
        if queries.num_rows and candidates.num_rows:
            dim = key[-1].as_py()
            ids, copies, vectors, wanted = candidates.column("vec_id").to_numpy(), candidates.column("copies").to_numpy(), _numbers(candidates, dim), _numbers(queries, dim)
            kind = _kind(vectors, wanted, dim)
            vectors = vectors.astype(kind)
            order = np.argsort(vectors, axis=0, kind="stable").T.copy()
            sorted_values = np.take_along_axis(vectors.T, order, axis=1).copy()
            for own, mark, times, query in zip(*(queries.column(c).to_pylist() for c in ("vec_id", "mark", "copies")), wanted.astype(kind), strict=True):
                left = copies.copy()
                same = np.flatnonzero(ids == own)
                left[same[(vectors[same] == query).all(axis=1)]] -= 1  # the query's own row
                for score, at in threshold_search(query, left > 0, ids, vectors, order, sorted_values, k):
                    for name, value in zip(names, (own, mark, times, score, int(ids[at]), int(left[at])), strict=True):
                        out[name].append(value)
        return pa.Table.from_pydict(out, schema=schema)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, group_rows: int = 512) -> DataFrame:
    """Rows of (query_id, rank, vec_id, score); both inputs as ``integer_vectors`` gives them, ``queries`` being rows of ``candidates``."""
    every = [materialize(rows.groupBy("vec_id", "vector", "dim").agg(F.count(F.lit(1)).alias("copies")).withColumn("mark", F.xxhash64("vector")), "top-k-rows") for rows in (candidates, queries)]
    candidates, queries = every
    blocks = max(1, -(-candidates.count() // block_rows))
    groups = max(1, -(-queries.count() // group_rows))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n)).cast("int")
        return rows.select("vec_id", "vector", "dim", "copies", "mark", place.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    key = ["group", "block", "dim"]
    pairs = dealt(queries, "group", groups, "block", blocks).groupBy(*key).cogroup(dealt(candidates, "block", blocks, "group", groups).groupBy(*key))
    found = pairs.applyInArrow(_pair_task(k), FOUND)
    one = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id"))
    best = one.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("query", F.explode(F.sequence(F.lit(1).cast("long"), "queries"))).select("query_id", "rank", "vec_id", "score")
