"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Fingerprint: ASCII letters lower-cased, shingles of ``shingle`` words, XXH64
(seed 42) of each; a bit is set when more than half of the hashes set it.

Two fingerprints at most 3 bits apart share a value that is at most 2 bits
from the one and at most 1 bit from the other. So every distinct fingerprint
emits all values within 2 bits (far) and within 1 bit (near), and the two
meet in a shuffle on the value. The shuffle deals values by their leading
bits: the 2,081 far values of a fingerprint share few prefixes, so only the
fingerprint travels, once per prefix (56 copies for 9 bits), and its values
under that prefix are formed in the bucket. Collisions are verified there by
counting differing bits, and each bucket returns a spanning forest of its
links, never all pairs, so a group of near copies costs a line of links.
Components come from ``connected_components``.

Exact copies are one fingerprint (map-side combined), and the last join, from
documents to fingerprints, has one row per fingerprint on its right, so a
fingerprint held by a third of all documents can be split by AQE.

Edge cases: NULL or empty text has no shingle and fingerprint 0, which links
like any other. A NULL doc_id is never the smallest unless all of its
component are NULL. Repeated rows each get their row. Extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.session import materialize

from ._words import U64, Words, chunks, rows_of, small_batches
from .components import connected_components

SEED = 42
LAST_ID = (1 << 63) - 1
OWN_PER_BUCKET = 512
ONES = np.array([1 << k for k in range(64)], U64)


def fingerprints_of(texts: list[bytes | None], shingle: int) -> np.ndarray:
    words = Words(texts, lower=True)
    size = np.diff(words.first)
    shingles = np.where(size > 0, np.maximum(size - shingle + 1, 1), 0)
    first = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(shingles)[:-1])), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + shingle, np.repeat(words.first[1:], shingles))
    text, h = words.text, xxhash.xxh64_intdigest
    hashes = np.array([h(text[i:j], SEED) for i, j in zip(words.offset[first].tolist(), (words.offset[last] - 1).tolist(), strict=True)], U64)
    out = np.zeros(len(texts), U64)
    full = np.flatnonzero(shingles)
    if len(full):
        starts = (np.cumsum(shingles) - shingles)[full]
        for k in range(64):
            on = np.add.reduceat((hashes >> U64(k)) & U64(1), starts)
            out[full] |= (2 * on > shingles[full].astype(U64)).astype(U64) << U64(k)
    return out


def _fingerprint_task(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in chunks(rows_of(batch, "doc_id", "mark", "text"), lambda r: len(r[2] or b"") + 64):
                found = fingerprints_of([r[2] for r in part], shingle).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in part], pa.int64()) for k in (0, 1)), pa.array(found)], schema=schema)

    return run


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, fp) for every row of ``docs``; mark: a hash of its text."""
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_fingerprint_task(shingle), "doc_id long, mark long, fp long")


def masks(bits: range, most: int) -> np.ndarray:
    """All values that set at most ``most`` of ``bits``."""
    return np.array([sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(bits, n)], U64)


def _to_buckets(prefix: int, far: int, near: int):
    """Distinct fingerprints to each prefix bucket that some value of theirs falls in."""
    schema = pa.schema([("bucket", pa.int32()), ("far", pa.binary()), ("near", pa.binary())])
    shift = U64(64 - prefix)
    moves = [masks(range(prefix), n) for n in (far, near)]

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(U64)
            bucket = own >> shift
            parts: dict[int, list[bytes]] = {}
            for side, move in enumerate(moves):
                to = (bucket[:, None] ^ move[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, who = to[order], np.repeat(own, len(move))[order]
                cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                for b, v in zip(to[cut].tolist(), np.split(who, cut[1:]), strict=True):
                    parts.setdefault(b, [b"", b""])[side] = v.tobytes()
            if parts:
                yield pa.RecordBatch.from_pydict({"bucket": list(parts), "far": [p[0] for p in parts.values()], "near": [p[1] for p in parts.values()]}, schema=schema)

    return run


class _Forest:
    """Union of nodes 0..n-1, keeping the links that joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        la, lb = self.label[a], self.label[b]
        _, first = np.unique(np.minimum(la, lb) * len(self.label) + np.maximum(la, lb), return_index=True)
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for i in first.tolist():
            x, y = root(int(la[i])), root(int(lb[i]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        if parent:
            to = np.arange(len(self.label))
            for x in parent:
                to[x] = root(x)
            self.label = to[self.label]


def bucket_links(bucket: int, far_from: np.ndarray, near_from: np.ndarray, prefix: int, far: int, near: int) -> np.ndarray:
    """Spanning links (pairs of fingerprints) of the values that meet under one prefix."""
    nodes = np.unique(np.concatenate((far_from, near_from)))
    shift, low = U64(64 - prefix), range(64 - prefix)
    moved = np.bitwise_count((nodes >> shift) ^ U64(bucket)).astype(np.int64)
    under = (nodes & U64((1 << (64 - prefix)) - 1)) | (U64(bucket) << shift)  # the node with this bucket's prefix
    values, owner = [], []
    for t in range(near + 1):
        own = np.flatnonzero(moved == t)
        for mask in masks(low, near - t) if len(own) else ():
            values.append(under[own] ^ mask)
            owner.append(own)
    if not values:
        return np.empty((0, 2), U64)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    forest = _Forest(len(nodes))
    same = np.flatnonzero(values[1:] == values[:-1])
    forest.link(owner[same], owner[same + 1])
    for t in range(far + 1):
        own = np.flatnonzero(moved == t)
        for mask in masks(low, far - t) if len(own) else ():
            meant = under[own] ^ mask
            at = np.minimum(np.searchsorted(values, meant), len(values) - 1)
            hit = values[at] == meant
            if hit.any():
                a, b = own[hit], owner[at[hit]]
                close = np.bitwise_count(nodes[a] ^ nodes[b]) <= far + near
                forest.link(a[close], b[close])
    return nodes[np.array(forest.links, np.int64).reshape(-1, 2)]


def _in_bucket(prefix: int, far: int, near: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, table):
        far_from, near_from = (np.frombuffer(b"".join(table.column(n).to_pylist()), U64) for n in ("far", "near"))
        links = bucket_links(key[0].as_py(), far_from, near_from, prefix, far, near).astype(np.int64)
        return pa.Table.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], schema=schema)

    return run


def links(distinct: DataFrame, distance: int, prefix: int | None = None) -> DataFrame:
    """Spanning links (a, b) between fingerprints (column fp, distinct) at most ``distance`` bits apart."""
    far, near = (distance + 1) // 2, distance // 2
    if prefix is None:
        prefix = min(24, max(3, (distinct.count() // OWN_PER_BUCKET).bit_length()))
    return (
        distinct.select("fp").mapInArrow(_to_buckets(prefix, far, near), "bucket int, far binary, near binary")
        .groupBy("bucket")
        .applyInArrow(_in_bucket(prefix, far, near), "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, mark, fp (signed long), root (its component's smallest fp), component_id (the smallest doc_id reachable)."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(connected_components(links(distinct, distance)), "roots")
    of_fp = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of_fp.join(of_root, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "mark", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (then the smallest hash of the text).

    The helper column is longer than every name of ``docs``, so it clashes with none.
    """
    row = "row" + "_" * max(len(c) for c in docs.columns)
    found = near_duplicates(docs, shingle, distance)

    def place(mark: Column) -> Column:
        return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), mark.alias("mark"))

    # Only places of more than one row can hold equal rows; all others need no window.
    places = found.groupBy("root", place(F.col("mark")).alias("place")).agg(F.count(F.lit(1)).alias("rows"))
    least = places.groupBy("root").agg(F.min(F.struct("place", "rows")).alias("least"))
    chosen = materialize(least.groupBy(F.col("least.place").alias(row)).agg(F.sum("least.rows").alias("rows")), "chosen")
    marked = docs.withColumn(row, place(F.xxhash64("text")))

    def kept(places: DataFrame) -> DataFrame:
        # the places are hashed, so the texts are streamed past them and never sorted
        return marked.join(places.select(row).hint("shuffle_hash"), row, "left_semi")

    single, repeated = kept(chosen.filter("rows = 1")).select(*docs.columns), chosen.filter("rows > 1")
    if repeated.isEmpty():
        return single
    again = F.row_number().over(Window.partitionBy(row).orderBy(row))  # equal rows
    numbered = kept(repeated).select(*docs.columns, F.struct(again.alias("again")).alias(row))
    return single.unionByName(numbered.filter(F.col(row)["again"] == 1).select(*docs.columns))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple], shingle: int = 3, distance: int = 3) -> list[tuple]:
    """The same result by comparing all pairs, for tests."""
    prints = []
    for _, text in rows:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hashes) > len(hashes)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        if doc_id is not None:
            least[x] = min(least.get(x, doc_id), doc_id)
    return [(doc_id, f"{p:016x}", least.get(x)) for (doc_id, _), p, x in zip(rows, prints, label, strict=True)]
