"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become word sequences (ASCII lower case, ASCII
punctuation as space). Seeds of ``shortest`` words that a document shares with an item propose
the pair, if the words under shared seeds could cover ``coverage`` of the
item. Such a pair is tiled: the longest common run of unmarked words is
marked in both, again and again, down to ``shortest`` words; candidates for
runs are found by rolling hashes (Karp and Rabin), a span of the text at a time. The tiles need not be in
the same order in both, so a passage whose sentences were moved is still
covered. A document is contaminated by an item when its tiles cover at least
``coverage`` of the item's words.

The seeds join is a hash join against the benchmark's seed index. The
benchmark is a stated test set, but its size is still checked: it is taken in
blocks of about ``block_bytes``, at least one item. Each block is one pass over
the documents whose finds are written before the next one is read, so a large
benchmark costs passes, and memory for one block. Texts are shuffled only to
bring the finds of several blocks back to their rows.

Edge cases: NULL or empty text shares nothing; an item of fewer than
``shortest`` words is matched whole, as a run of its own length; one without
words matches nothing; equal items are judged
each. Columns of the input stay, whatever their names; a column named ``leaks`` is replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.session import materialize

from ._words import U64, Words, chunks, rolling, small_batches

PUNCTUATION = bytes(32 if not (chr(c).isalnum() or c >= 128) else c for c in range(256))
LEAK = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())])


def _words(texts: list[bytes | None]) -> Words:
    return Words([(t or b"").translate(PUNCTUATION) for t in texts], lower=True)


def _within(words: Words, n: int) -> np.ndarray:
    """Starts of the runs of ``n`` words that stay inside one text."""
    size = np.maximum(np.diff(words.first) - n + 1, 0)
    return np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


@dataclass
class Index:
    """Seeds of a block of benchmark items."""

    shortest: int
    ids: list[int]
    tokens: list[np.ndarray]
    seeds: np.ndarray  # distinct, sorted
    begin: np.ndarray  # of each seed's places
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def by_length(items: list[tuple[int, bytes | None]], shortest: int) -> list[Index]:
        """One index of the items of ``shortest`` words or more, and one for each smaller number of words."""
        sizes = np.minimum(np.diff(_words([t for _, t in items]).first), shortest)
        return [Index.of([items[i] for i in np.flatnonzero(sizes == n).tolist()], int(n)) for n in np.unique(sizes[sizes > 0])]

    @staticmethod
    def of(items: list[tuple[int, bytes | None]], shortest: int) -> Index:
        words = _words([t for _, t in items])
        hashes = words.hashes()
        at = _within(words, shortest)
        seeds = rolling(hashes, shortest)[at] if len(at) else np.empty(0, U64)
        item = np.searchsorted(words.first, at, "right") - 1
        order = np.argsort(seeds, kind="stable")
        found, begin = np.unique(seeds[order], return_index=True)
        tokens = [hashes[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
        return Index(shortest, [i for i, _ in items], tokens, found, np.append(begin, len(seeds)), item[order], (at - words.first[item])[order])


def common_runs(a: np.ndarray, b: np.ndarray, shortest: int, most: int = 1 << 18) -> list[tuple[int, int, int]]:
    """All longest common runs (place in a, place in b, length) of ``shortest`` words or more.

    Seeds are matched for a span of ``b`` at a time, about ``most`` pairs of
    places, and put together along each diagonal; runs go on over spans.
    """
    seeds = rolling(a, shortest)
    order = np.argsort(seeds, kind="stable")
    seeds, theirs = seeds[order], rolling(b, shortest)
    begin = np.searchsorted(seeds, theirs, "left")
    times = np.searchsorted(seeds, theirs, "right") - begin
    places = np.flatnonzero(times)
    total = np.concatenate(([0], np.cumsum(times[places])))
    out: list[tuple[int, int, int]] = []
    going: dict[int, tuple[int, int, int]] = {}  # diagonal -> a run that reaches the end of the span
    at, last = 0, -1
    while at < len(places):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        n = times[places[at:end]]
        j = np.repeat(places[at:end], n)
        i = order[np.repeat(begin[places[at:end]] - (total[at:end] - total[at]), n) + np.arange(len(j))]
        same = np.ones(len(j), bool)
        for k in range(shortest):  # equal hashes are not yet equal words
            same &= a[i + k] == b[j + k]
        i, j = i[same], j[same]
        line = np.lexsort((j, j - i))
        i, j = i[line], j[line]
        new = np.flatnonzero((np.diff(j - i, prepend=-len(a) - 1) != 0) | (np.diff(j, prepend=-2) != 1))
        size = np.diff(np.append(new, len(j)))
        first, begun, going = int(places[at]), going if places[at] == last + 1 else _close(going, out), {}
        last, at = int(places[end - 1]), end
        for i0, j0, count in zip(i[new].tolist(), j[new].tolist(), size.tolist(), strict=True):
            final = j0 + count - 1
            if j0 == first and j0 - i0 in begun:
                i0, j0, _ = begun.pop(j0 - i0)
            run = i0, j0, final - j0 + shortest
            if final == last:
                going[j0 - i0] = run
            else:
                out.append(run)
        _close(begun, out)
    _close(going, out)
    return out


def _close(runs: dict[int, tuple[int, int, int]], out: list) -> dict:
    out += runs.values()
    return {}


def tiles(a: np.ndarray, b: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two token sequences: (place in a, place in b, length), longest first."""
    heap = [(-n, i, j) for i, j, n in common_runs(a, b, shortest)]
    heapq.heapify(heap)
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(used_a[i:i + n] | used_b[j:j + n])
        if free.all():
            used_a[i:i + n] = used_b[j:j + n] = True
            out.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= shortest:
                heapq.heappush(heap, (s - e, i + s, j + s))
    return out


def leaks_of(index: Index, texts: list[bytes | None], coverage: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in texts]
    words = _words(texts)
    at = _within(words, index.shortest)
    if not len(at) or not len(index.seeds):
        return out
    hashes = words.hashes()
    seeds = rolling(hashes, index.shortest)[at]
    slot = np.minimum(np.searchsorted(index.seeds, seeds), len(index.seeds) - 1)
    hit = index.seeds[slot] == seeds
    if not hit.any():
        return out
    slot = slot[hit]
    doc = np.searchsorted(words.first, at[hit], "right") - 1
    pairs = np.unique(doc * len(index.seeds) + slot)  # each seed of a document once
    doc, slot = pairs // len(index.seeds), pairs % len(index.seeds)
    times = index.begin[slot + 1] - index.begin[slot]
    spot = np.repeat(index.begin[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    doc, item, place = np.repeat(doc, times), index.item[spot], index.place[spot]
    order = np.lexsort((place, item, doc))
    doc, item, place = doc[order], item[order], place[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    step = np.minimum(np.diff(place, append=0), index.shortest)
    step[np.append(new[1:], len(doc)) - 1] = index.shortest
    covered = np.add.reduceat(step, new)
    for k in np.flatnonzero(covered >= coverage * np.array([len(index.tokens[i]) for i in item[new]])).tolist():
        d, i = int(doc[new[k]]), int(item[new[k]])
        own = tiles(index.tokens[i], hashes[words.first[d]:words.first[d + 1]], index.shortest)
        share = sum(n for _, _, n in own) / len(index.tokens[i])
        if share >= coverage:
            out[d].append({"item_id": index.ids[i], "coverage": share, "tiles": len(own)})
    return out


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.LongType())]))


def _search(indexes: list[Index], coverage: float, text: str, into: str):
    """Batches with the column ``into`` filled with the leaks of the column ``text``."""

    def run(batches):
        for batch in batches:
            texts = (t.as_py() for t in batch.column(text).cast(pa.binary()))
            found = []
            for part in chunks(texts, lambda t: len(t or b"") + 64):
                found += [sum(several, []) for several in zip(*(leaks_of(index, part, coverage) for index in indexes), strict=True)] if indexes else [[] for _ in part]
            yield batch.append_column(into, pa.array(found, pa.list_(LEAK)))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, shortest: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``leaks``: array of (item_id, coverage, tiles) of the items that contaminate a document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def indexes(b: int) -> list[Index]:
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        return Index.by_length([(r["item_id"], r["text"]) for r in block], shortest)

    kept = small_batches(docs).drop("leaks")
    if blocks == 1:
        return kept.mapInArrow(_search(indexes(0), coverage, "text", "leaks"), T.StructType([*kept.schema.fields, T.StructField("leaks", LEAKS)]))
    row = "row" + "_" * max(len(c) for c in docs.columns)  # longer than every name of the documents
    numbered = materialize(kept.withColumn(row, F.monotonically_increasing_id()), "leaks-documents")
    texts = small_batches(numbered.select(row, F.col("text").alias("text")))
    found = [
        materialize(texts.mapInArrow(_search(indexes(b), coverage, "text", "leaks"), f"{row} long, text string, leaks {LEAKS.simpleString()}").filter(F.size("leaks") > 0).select(row, "leaks"), f"leaks-{b}")
        for b in range(blocks)
    ]
    every = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    return numbered.join(every, row, "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS))).drop(row)


def digest(found: DataFrame) -> DataFrame:
    """One row per contaminated document and item."""
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def brute_force(rows: list[tuple], items: list[tuple], coverage: float = 0.8, shortest: int = 5) -> list[tuple]:
    """(doc_id, item_id, coverage) of the greedy tiling done by its definition, for tests."""

    def words(text: str | None) -> list[bytes]:
        return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode().translate(PUNCTUATION)).split()

    out = []
    for doc_id, text in rows:
        b = words(text)
        for item_id, item in items:
            a = words(item)
            least = min(shortest, len(a))
            used_a, used_b = set(), set()
            while a:
                n, i, j = 0, 0, 0
                for x in range(len(a)):
                    for y in range(len(b)):
                        size = 0
                        while x + size < len(a) and y + size < len(b) and a[x + size] == b[y + size] and x + size not in used_a and y + size not in used_b:
                            size += 1
                        if size > n:
                            n, i, j = size, x, y
                if n < least:
                    break
                used_a |= set(range(i, i + n))
                used_b |= set(range(j, j + n))
            if a and len(used_a) >= coverage * len(a):
                out.append((doc_id, item_id, len(used_a) / len(a)))
    return out
