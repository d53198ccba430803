"""Language-model scores of documents by a weighted backoff automaton.

Model: n-grams up to ``order`` of the training texts, an end token closing
each text. Add-one unigrams, P(w) = (c(w) + 1) / (N + V + 1); for a longer
history h with last words h', P(w | h) = (c(h w) + mu P(w | h')) / (c(h) + mu)
(Dirichlet smoothing; the probabilities of one history sum to one). As an
automaton: a state per known history, an arc per known n-gram weighing
log10 P(w | h), and from each state a failure arc to the state of its
shorter history weighing log10(mu / (c(h) + mu)). A text is scored by one
traversal from left to right that carries the state and adds up weights.

Distribution: documents are dealt by hashed id into blocks of a few MB. A
block lists its distinct n-grams with their training counts, packed per
bucket of hashed n-grams; the buckets add up the counts of all blocks and
return, to each block, the corpus count of each n-gram it listed, in its
order. A block then builds the part of the automaton that its own texts can
reach, which scores them as the whole automaton would, and traverses its
texts side by side. Nothing is pruned or broadcast; a bucket receives each
n-gram once per block however frequent it is.

Words and n-grams are held as 64-bit hashes.

Edge cases: NULL text counts as empty (one end token); a NULL doc_id trains
(its remainder is unknown, so it isn't held out); repeated rows count each;
no training text: N = V = 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.session import materialize

from ._words import BASE, U64, Words, chunks, mix, small_batches

END = U64(0x656E64)  # the end token
NONE = U64(0)


def token_sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts, an end after each, and where each text starts (one entry more)."""
    words = Words(texts, lower=True)
    first = words.first + np.arange(len(texts) + 1)
    tokens = np.empty(first[-1], U64)
    ends = first[1:] - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = words.hashes()
    tokens[ends] = END
    return tokens, first


def ngram_ids(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n-gram that ends at each token; 0 where the text has no n tokens yet."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    out = [mix(tokens + U64(1))]
    for n in range(2, order + 1):
        ids = np.zeros(len(tokens), U64)
        ids[1:] = mix(out[-1][:-1] * U64(BASE) + out[0][1:] + U64(n))
        ids[place < n - 1] = NONE
        out.append(ids)
    return out


def listed(ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of a block, sorted, as counts return; and for each n the index of every token's n-gram in them (-1: none)."""
    flat = np.concatenate(ids)
    order = np.argsort(flat)
    ordered = flat[order]
    new = ordered != NONE  # the smallest value, so what it counts to is -1
    new[1:] &= ordered[1:] != ordered[:-1]
    at = np.empty(len(flat), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], np.split(at, len(ids))


def _cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket, a range of the hash, that holds some of the sorted keys."""
    if not len(keys):
        return []
    bucket = (keys >> U64(32)) * U64(buckets) >> U64(32)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return list(zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(keys)).tolist(), strict=True))


def _press(*arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<q", len(arrays[0])) + zstandard.ZstdCompressor(level=1).compress(body)


def _open(blob: bytes, *kinds) -> list[np.ndarray]:
    n = struct.unpack_from("<q", blob)[0]
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class _Block:
    """Tokens of a block's rows, in a fixed order."""

    def __init__(self, table: pa.Table, order: int):
        held = table.select(["doc_id", "held_out", "mark", "text"]).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        self.doc_id, self.held_out = held.column("doc_id"), held.column("held_out").to_numpy()
        parts = [token_sequences(part) for part in chunks(held.column("text").to_pylist(), lambda t: len(t or b"") + 64)]
        starts = np.cumsum([0] + [p[1][-1] for p in parts])
        self.tokens = np.concatenate([p[0] for p in parts])
        self.first = np.concatenate([p[1][:-1] + s for p, s in zip(parts, starts[:-1], strict=True)] + [starts[-1:]])
        self.ids = ngram_ids(self.tokens, self.first, order)


def _count_task(order: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("packed", pa.binary())])

    def run(key, table):
        block = _Block(table, order)
        keys, at = listed(block.ids)
        trains = np.repeat(~block.held_out, np.diff(block.first))
        counts = sum(np.bincount(i[trains & (i >= 0)], minlength=len(keys)) for i in at)
        single = np.zeros(len(keys), bool)
        single[at[0]] = True
        rows = [(b, key[0].as_py(), _press(keys[a:z], counts[a:z], single[a:z])) for b, a, z in _cuts(keys, buckets)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[], [], []], schema.types, strict=True)], schema=schema)

    return run


def _sum_task(buckets: int):
    """A bucket's packed lists to (block, counts in the block's order); one row more with block -1: tokens and distinct words."""
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])

    def run(key, table):
        bucket = key[0].as_py()
        lists = [_open(p, np.uint64, np.int64, np.bool_) for p in table.column("packed").to_pylist()]
        keys, place = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total = np.bincount(place, np.concatenate([x[1] for x in lists]), len(keys)).astype(np.int64)  # exact below 2**53
        single = np.zeros(len(keys), bool)
        single[place[np.concatenate([x[2] for x in lists])]] = True
        rows, at = [(-1, bucket, None, int(total[single].sum()), int((total[single] > 0).sum()))], 0
        for block, own in zip(table.column("block").to_pylist(), lists, strict=True):
            rows.append((block, bucket, _press(total[place[at:at + len(own[0])]]), None, None))
            at += len(own[0])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


class Automaton:
    """The part of the backoff automaton that the texts of one block can reach.

    A state is the index of a trained n-gram shorter than ``order`` (-1: the
    empty history). ``arcs``: state * words + word, sorted, with ``weights``;
    ``fail`` and ``fail_weight``: of each state.
    """

    def __init__(self, at: list[np.ndarray], count: list[np.ndarray], unigram: np.ndarray, size: int, order: int, mu: float):
        """at, count: per n, the index and corpus count of the n-gram that ends at each token (-1, 0: none)."""
        self.order, self.size = order, size
        self.fail = np.full(size, -1)
        held = np.zeros(size, np.int64)
        for n in range(order, 0, -1):
            on = at[n - 1] >= 0
            held[at[n - 1][on]] = count[n - 1][on]
            if n > 1:
                self.fail[at[n - 1][on]] = at[n - 2][on]
        self.fail_weight = np.where(held > 0, np.log10(mu / (held + mu)), 0.0)
        p = 10.0 ** unigram
        arcs, weights = [np.empty(0, np.int64)], [np.empty(0)]
        for n in range(2, order + 1):
            on = np.flatnonzero(at[n - 1] >= 0)
            history = at[n - 2][on - 1]
            before = held[history]
            p[on] = np.where(before > 0, (count[n - 1][on] + mu * p[on]) / (before + mu), p[on])
            known = on[count[n - 1][on] > 0]
            of_arc = np.full(size, -1)  # a token at which each n-gram ends
            of_arc[at[n - 1][known]] = known
            of_arc = of_arc[of_arc >= 0]
            arcs.append(at[n - 2][of_arc - 1] * size + at[0][of_arc])
            weights.append(np.log10(p[of_arc]))
        sort = np.argsort(np.concatenate(arcs), kind="stable")
        self.arcs, self.weights = np.concatenate(arcs)[sort], np.concatenate(weights)[sort]

    def step(self, state: np.ndarray, word: np.ndarray, root_weight: np.ndarray) -> np.ndarray:
        """Weight of reading ``word`` in ``state``, along failure arcs where there is no arc; ``root_weight``: in the empty history."""
        out, state = root_weight.copy(), state.copy()
        walking = np.flatnonzero(state >= 0)
        while len(walking):
            now = state[walking]
            want = now * self.size + word[walking]
            slot = np.minimum(np.searchsorted(self.arcs, want), max(len(self.arcs) - 1, 0))
            hit = self.arcs[slot] == want if len(self.arcs) else np.zeros(len(walking), bool)
            done = walking[hit]
            out[done] += self.weights[slot[hit]] - root_weight[done]
            walking, now = walking[~hit], now[~hit]
            out[walking] += self.fail_weight[now]
            state[walking] = self.fail[now]
            walking = walking[state[walking] >= 0]
        return out


def score_block(block: _Block, at: list[np.ndarray], counts: np.ndarray, total: int, distinct: int, order: int, mu: float) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, model score) of each text of a block."""
    count = [np.where(a >= 0, counts[np.maximum(a, 0)], 0) for a in at]
    unigram = np.log10((count[0] + 1) / (total + distinct + 1))
    automaton = Automaton(at, count, unigram, len(counts), order, mu)
    after = np.full(len(block.tokens), -1)  # the state after each token
    for n in range(1, order):
        known = count[n - 1] > 0
        after[known] = at[n - 1][known]
    length = np.diff(block.first)
    by_length = np.argsort(-length, kind="stable")
    first, length = block.first[:-1][by_length], length[by_length]
    weight = np.empty(len(block.tokens))
    state, active = np.full(len(first), -1), len(first)
    for t in range(int(length[0])):  # all texts that are longer than t read their token t
        active = int(np.searchsorted(-length[:active], -t, "left"))
        token = first[:active] + t
        weight[token] = automaton.step(state[:active], at[0][token], unigram[token])
        state = after[token]
    sums = [np.add.reduceat(x, block.first[:-1]) for x in ((count[0] > 0).astype(np.int64), unigram, weight)]
    return np.diff(block.first), *sums


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_task(order: int, mu: float, total: int, distinct: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key, table, returned):
        if not table.num_rows:
            return schema.empty_table()
        block = _Block(table, order)
        _, at = listed(block.ids)
        parts = returned.sort_by("bucket").column("packed").to_pylist()
        counts = np.concatenate([_open(p, np.int64)[0] for p in parts])
        n, known, base, score = score_block(block, at, counts, total, distinct, order, mu)
        return pa.Table.from_arrays([block.doc_id.combine_chunks(), pa.array(block.held_out), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, order: int = 2, mu: float = 50.0, held_out_of: int = 7, held_out: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    source = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == held_out, F.lit(False)).alias("held_out"),
        F.xxhash64("text").alias("mark"),
        F.col("text").cast("binary").alias("text"),
    )
    size = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // (block_bytes // 2)))
    placed = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("block").applyInArrow(_count_task(order, buckets), "bucket int, block int, packed binary")
    returned = materialize(
        counts.groupBy("bucket").applyInArrow(_sum_task(buckets), "block int, bucket int, packed binary, tokens long, words long"), "ngram-counts"
    )
    totals = returned.filter("block = -1").agg(F.sum("tokens"), F.sum("words")).first()
    to_blocks = returned.filter("block >= 0").select("block", "bucket", "packed")
    scored = placed.groupBy("block").cogroup(to_blocks.groupBy("block"))
    return scored.applyInArrow(_score_task(order, mu, totals[0] or 0, totals[1] or 0), SCORES)


def brute_force(rows: list[tuple], order: int = 2, mu: float = 50.0) -> list[tuple]:
    """The same result from plain dictionaries, for tests."""
    split = []
    for doc_id, text in rows:
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        split.append((doc_id, held, [*words, None]))
    counts: Counter = Counter()
    for _, held, words in split:
        if not held:
            for n in range(1, order + 1):
                counts.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(1 for g in counts if len(g) == 1)

    def p(history, word):
        if not history:
            return (counts[(word,)] + 1) / (total + distinct + 1)
        lower = p(history[1:], word)
        return (counts[(*history, word)] + mu * lower) / (counts[history] + mu) if counts[history] else lower

    out = []
    for doc_id, held, words in split:
        base = sum(math.log10(p((), w)) for w in words)
        model = sum(math.log10(p(tuple(words[max(0, i - order + 1):i]), w)) for i, w in enumerate(words))
        out.append((doc_id, held, len(words), sum(counts[(w,)] > 0 for w in words), total, base, model))
    return out
