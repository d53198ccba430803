"""Removal of word passages that repeat across documents (super-k-mers).

A window is ``window`` consecutive words of one document. A word goes when
a window over it also stands in a document with a smaller id; windows are
judged on the input.

How the windows meet: of the ``m``-word grams inside a window, the one with
the smallest hash is its minimiser. Consecutive windows with one minimiser
travel as one packed string (their words, once) to the minimiser's bucket, so
a word is shipped about three times, not ``window`` times. Equal strings are
combined inside each map task, so copies of one document reach the bucket as
one string per task. In the bucket, windows whose minimiser occurs once are
done; the others are ranked exactly by sorting (ranks of 1, 2, 4, ... words,
then of the window), and each window gets the smallest document id that has
it. Strings with a repeated window go back, by key, to the documents that
hold them. That join has one row per string on one side, so a string shared
by a third of all documents is a skewed join that AQE can split.

Grams that are very frequent would be poor minimisers (a boilerplate line in
a third of all documents would send all its surroundings to one bucket), so
they are ordered after all others. A gram is frequent when it makes up
``1 / frequent_share`` of a sample, hence at most ``frequent_share`` grams,
whatever the input. The order decides where windows meet, never the result.

A bucket is one task's group, so their number grows with the bytes of the
texts (``BUCKET_BYTES`` each, and at least four to a shuffle partition).

Edge cases: NULL text has no words. A NULL id counts as larger than every
other id. Rows with the same id never remove each other's words. Fewer words
than ``window``: nothing to remove. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.session import materialize

from ._words import U64, Words, chunks, mix, rolling, rows_of, small_batches

LAST_ID = (1 << 63) - 1
FLUSH_BYTES = 24 << 20
BUCKET_BYTES = 8 << 20  # of texts; their strings are a few times as large
RARE = U64((1 << 63) - 1)


def _minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[:done - width], values[width - done:])
    return values


def _grams(words: Words, m: int) -> np.ndarray:
    return rolling(words.hashes(), m) & RARE


def super_kmers(words: Words, window: int, m: int, frequent: np.ndarray):
    """(first word, number of windows, minimiser) of each super-k-mer of some texts."""
    none = np.empty(0, np.int64)
    begin, end = words.first[:-1], words.first[1:]
    size = np.maximum(end - begin - window + 1, 0)
    if not size.sum():
        return none, none, np.empty(0, U64)
    grams = _grams(words, m)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        grams = np.where(frequent[at] == grams, grams | (U64(1) << U64(63)), grams)
    lowest = _minimum(grams, window - m + 1)
    first = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    lowest = lowest[first]
    new = np.ones(len(first), bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    return first[at], np.diff(np.append(at, len(first))), lowest[at]


def _texts(batches, limit: int = 2 << 20) -> Iterator[list[tuple]]:
    for batch in batches:
        yield from chunks(rows_of(batch, *batch.schema.names), lambda r: len(r[1] or b"") + 64, limit)


def _pack(strings: dict) -> bytes:
    texts = list(strings)
    lows, low_ids, high_ids = (np.array([strings[t][k] for t in texts], dt) for k, dt in enumerate((np.uint64, np.int64, np.int64)))
    sizes = np.array([len(t) for t in texts], np.int64)
    body = b"".join((lows.tobytes(), low_ids.tobytes(), high_ids.tobytes(), sizes.tobytes(), *texts))
    return struct.pack("<q", len(texts)) + zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(blob: bytes):
    n = struct.unpack_from("<q", blob)[0]
    body = zstandard.ZstdDecompressor().decompress(blob[8:])
    lows, low_ids, high_ids, sizes = (np.frombuffer(body, dt, n, 8 * n * k) for k, dt in enumerate((np.uint64, np.int64, np.int64, np.int64)))
    return lows, low_ids, high_ids, sizes, body[32 * n:]


def _to_buckets(window: int, m: int, buckets: int, frequent: np.ndarray):
    """Texts to (bucket, packed strings): each string once, with its smallest and largest document id."""
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])

    def run(batches):
        held: dict[int, dict] = {}
        size = 0

        def flush():
            full = sorted(held)
            for part in range(0, len(full), 64):
                own = full[part:part + 64]
                yield pa.RecordBatch.from_pydict({"bucket": own, "packed": [_pack(held[b]) for b in own]}, schema=schema)
            held.clear()

        for rows in _texts(batches):
            words = Words([r[1] for r in rows])
            first, count, low = super_kmers(words, window, m, frequent)
            doc = np.searchsorted(words.first, first, "right") - 1
            a, z = words.offset[first], words.offset[first + count + window - 1] - 1
            text = words.text
            for a_, z_, low_, bucket, d in zip(a.tolist(), z.tolist(), low.tolist(), (mix(low) % U64(buckets)).tolist(), doc.tolist(), strict=True):
                packed, own = text[a_:z_], held.setdefault(bucket, {})
                ident = rows[d][0]
                if (old := own.get(packed)) is None:
                    own[packed] = (low_, ident, ident)
                    size += z_ - a_ + 120
                elif ident < old[1] or ident > old[2]:
                    own[packed] = (low_, min(ident, old[1]), max(ident, old[2]))
            if size > FLUSH_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """For each start, a number that is equal for equal windows of ids, and for no others."""
    rank, width = ids, 1

    def join(left, right):
        return np.unique(left.astype(U64) << U64(32) | right.astype(U64), return_inverse=True)[1]

    while width * 2 <= window:
        rank = join(rank[:-width], rank[width:])
        width *= 2
    if width < window:
        rank = join(rank[:width - window], rank[window - width:])
    return rank


def first_holders(strings: list[bytes], low_ids: np.ndarray, window: int):
    """(windows of each string, smallest id of each window), the windows in order of the strings."""
    words = Words(strings)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words.text.split()), np.int64, len(words))
    size = np.diff(words.first) - window + 1
    at = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    rank = _ranks(ids, window)[at]
    holder = np.repeat(low_ids, size)
    order = np.argsort(rank, kind="stable")
    lead = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
    least = np.minimum.reduceat(holder[order], lead)
    first = np.empty(len(rank), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(lead, len(rank))))
    return size, first


def _key(packed: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(packed))


REPEATS = "k1 long, k2 long, counts array<int>, firsts array<long>"


def _in_bucket(window: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("counts", pa.list_(pa.int32())), ("firsts", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in table.column("packed").to_pylist()]
        lows = np.concatenate([p[0] for p in parts])
        _, inverse, times = np.unique(lows, return_inverse=True, return_counts=True)
        several = np.concatenate([p[2] != p[1] for p in parts])  # held by more than one id; a difference could overflow
        some = np.bincount(inverse, several)[inverse] > 0
        wanted = (times[inverse] > 1) | some
        strings: dict[bytes, list[int]] = {}
        done = 0
        for low, low_ids, high_ids, sizes, body in parts:
            end = np.cumsum(sizes)
            for i in np.flatnonzero(wanted[done:done + len(low)]).tolist():
                packed, a, z = body[end[i] - sizes[i]:end[i]], int(low_ids[i]), int(high_ids[i])
                old = strings.get(packed)
                strings[packed] = [a, z] if old is None else [min(a, old[0]), max(z, old[1])]
            done += len(low)
        out = {name: [] for name in schema.names}
        texts = list(strings)
        if texts:
            held = np.array([strings[t] for t in texts], np.int64)
            size, first = first_holders(texts, held[:, 0], window)
            end = np.cumsum(size)
            lowest = np.minimum.reduceat(first, end - size)
            for i in np.flatnonzero(lowest < held[:, 1]).tolist():
                own = first[end[i] - size[i]:end[i]]
                at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                for name, value in zip(schema.names, (*_key(texts[i]), np.diff(np.append(at, len(own))), own[at]), strict=True):
                    out[name].append(value)
        return pa.Table.from_pydict(out, schema=schema)

    return run


PLACES = "id long, mark long, k1 long, k2 long, first int"


def _places(window: int, m: int, frequent: np.ndarray):
    """Texts to the places of their super-k-mers."""
    names = ("id", "mark", "k1", "k2", "first")
    schema = pa.schema([(n, pa.int32() if n == "first" else pa.int64()) for n in names])

    def run(batches):
        for rows in _texts(batches):
            words = Words([r[1] for r in rows])
            first, count, _ = super_kmers(words, window, m, frequent)
            if not len(first):
                continue
            doc = np.searchsorted(words.first, first, "right") - 1
            a, z, text = words.offset[first].tolist(), (words.offset[first + count + window - 1] - 1).tolist(), words.text
            digest = xxhash.xxh3_128_digest
            keys = np.frombuffer(b"".join([digest(text[i:j]) for i, j in zip(a, z, strict=True)]), np.int64).reshape(-1, 2)
            ids, marks = (np.array([r[k] for r in rows], np.int64)[doc] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, marks, keys[:, 0].copy(), keys[:, 1].copy(), (first - words.first[doc]).astype(np.int32))], schema=schema)

    return run


def removed_words(ident: int, n: int, window: int, repeats: list[dict]) -> np.ndarray:
    """Which of ``n`` words stand in a window that a smaller id holds."""
    edge = np.zeros(n + 1, np.int64)
    for r in repeats:
        counts, firsts = np.array(r["counts"], np.int64), np.array(r["firsts"], np.int64)
        start = r["first"] + np.cumsum(counts) - counts
        hit = firsts < ident
        np.add.at(edge, start[hit], 1)
        np.add.at(edge, start[hit] + counts[hit] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


KEPT = "doc_id long, n_words long, n_removed long, kept_text binary"


def _cut(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in chunks(rows_of(batch, "id", "text", "doc_id", "repeats"), lambda r: len(r[1] or b"") + 64):
                out = []
                for ident, text, doc_id, repeats in part:
                    own = (text or b"").split()
                    gone = 0
                    if repeats:
                        drop = removed_words(ident, len(own), window, repeats)
                        gone, n = int(drop.sum()), len(own)
                        kept = [own[i] for i in np.flatnonzero(~drop).tolist()]
                        out.append((doc_id, n, gone, b" ".join(kept)))
                    else:
                        out.append((doc_id, len(own), 0, b" ".join(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def frequent_grams(docs: DataFrame, m: int, share: int, fraction: float) -> np.ndarray:
    """Grams that make up 1 / share of a sample's; at most ``share`` of them, sorted."""

    def grams(batches):
        for rows in _texts(batches):
            words = Words([r[1] for r in rows])
            found, times = np.unique(_grams(words, m), return_counts=True)
            often = times > 1  # a gram that is frequent overall repeats within some task
            yield pa.RecordBatch.from_pydict({"gram": found[often].astype(np.int64), "n": times[often], "all": np.where(np.arange(often.sum()) == 0, times.sum(), 0)})

    counted = docs.sample(fraction, seed=7).mapInArrow(grams, "gram long, n long, all long")
    total = counted.agg(F.sum("all")).first()[0] or 0
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") * share > max(total, share * 20)).select("gram").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(U64))


def remove_repeats(docs: DataFrame, window: int = 50, m: int = 12, buckets: int | None = None, frequent_share: int = 20_000,
                   sample_fraction: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (UTF-8 bytes of the kept words, joined by one space)."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("text").cast("binary").alias("text"),
                        F.xxhash64("text").alias("mark"), F.col("doc_id").cast("long").alias("doc_id"))
    source = texts.select("id", "text", "mark")
    if buckets is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    frequent = frequent_grams(source, m, frequent_share, sample_fraction)
    repeats = (
        source.mapInArrow(_to_buckets(window, m, buckets, frequent), "bucket int, packed binary")
        .groupBy("bucket")
        .applyInArrow(_in_bucket(window), REPEATS)
    )
    repeats = materialize(repeats, "repeats")
    places = source.mapInArrow(_places(window, m, frequent), PLACES)
    found = (
        places.join(repeats, ["k1", "k2"])
        .filter(F.exists("firsts", lambda f: f < F.col("id")))
        .groupBy("id", "mark")
        .agg(F.collect_set(F.struct("first", "counts", "firsts")).alias("repeats"))  # equal rows have equal places
    )
    return texts.join(found, ["id", "mark"], "left").mapInArrow(_cut(window), KEPT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = 50) -> list[tuple]:
    """The same result by a dictionary of all windows, for tests."""
    first: dict[tuple, int] = {}
    split = [(LAST_ID if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    for ident, _, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, ident), ident)
    out = []
    for ident, doc_id, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < ident:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
