"""Byte-level BPE encoding and decoding with a minimal acyclic transducer.

Pre-tokens (words) are counted over all texts. The frequent ones, each at
least 1 / ``lexicon`` of all pre-tokens and so at most ``lexicon`` of them,
are merged once, and compiled into a minimal acyclic automaton: states with
equal continuations are one state, so words share their suffixes as well as
their prefixes. Its arcs carry integer outputs that add up to a word's
number, under which its ids are stored. The automaton is a flat file that
Spark ships to the executors (``addFile``) and tasks map into memory.

A text is first split at single spaces, where a word always begins, so that
only the distinct units between them are cut into words by the pattern. A task
looks up the new distinct words of a few MB of text by walking all of them
through the automaton together; words it does not hold are merged exactly, also
side by side, and kept for the task's next texts up to a bound (a heap of pairs takes over for words of more than 64
bytes, where it is the faster one). Texts never leave their task; the only
shuffle is that of the word counts.

Added tokens of the vocabulary file are cut out of the text first, as the
tokenizers library does. Decoding joins the bytes of the ids; bytes that are
not UTF-8 become U+FFFD.

Edge cases: NULL or empty text has no ids and decodes to an empty text; equal
rows each get their row; extra columns stay, columns named as the results are
replaced; a table without text has an empty lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.session import materialize

from ._words import chunks, small_batches

#: White space as the tokenizers library sees it (Unicode White_Space).
WS = r"\t-\r\x20\x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
RUN = re.compile(rf"[{WS}]{{2,}}")
LONG = 64
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary as arrays."""

    of_byte: np.ndarray  # id of each single byte
    pair: np.ndarray  # (left id << 32 | right id), sorted
    rank: np.ndarray  # of each pair
    made: np.ndarray  # id that each pair becomes
    text: list[bytes]  # of each id
    added: dict[str, int]  # tokens that are cut out of the text

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, ids = byte_letters(), data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        text = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            text[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            text[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        pair = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(pair, kind="stable")
        of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            of_byte[b] = ids[letter]
        return Vocabulary(of_byte, pair[order], order.astype(np.int32), made[order], text, added)

    def fields(self) -> tuple:
        return self.of_byte, self.pair, self.rank, self.made, self.text, self.added

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in ``pair`` and rank of each pair of ids; an id below 0 pairs with nothing."""
        want = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        good = (self.pair[at] == want) & (left >= 0) & (right >= 0)
        return at, np.where(good, self.rank[at], NO_RANK)


def _merge_long(v: Vocabulary, word: bytes) -> list[int]:
    ids = v.of_byte[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    after[-1] = -1
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i):
        j = after[i]
        if i >= 0 and j >= 0:
            at, rank = v.ranks(np.array([ids[i]]), np.array([ids[j]]))
            if rank[0] != NO_RANK:
                heapq.heappush(heap, (int(rank[0]), i, ids[i], ids[j], int(v.made[at[0]])))

    at, rank = v.ranks(np.array(ids[:-1]), np.array(ids[1:]))
    heap = [(r, i, ids[i], ids[i + 1], int(v.made[a])) for i, (a, r) in enumerate(zip(at.tolist(), rank.tolist(), strict=True)) if r != NO_RANK]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = after[i] if ids[i] == left else -1
        if j < 0 or ids[j] != right:
            continue
        ids[i], ids[j] = made, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


def _merge_short(v: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Ids of words of at most LONG bytes, a row each, padded with -1."""
    size = np.array([len(w) for w in words])
    wide = int(size.max())
    ids = np.full((len(words), wide + 1), -1, np.int32)
    row = np.repeat(np.arange(len(words)), size)
    column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ids[row, column] = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    at, rank = v.ranks(ids[:, :-1], ids[:, 1:])
    todo = np.arange(len(words))
    spread = np.arange(wide)
    while len(todo):
        best = rank[todo].argmin(axis=1)
        go = rank[todo, best] != NO_RANK
        todo, best = todo[go], best[go]
        if not len(todo):
            break
        made = v.made[at[todo, best]]
        take = spread + (spread > best[:, None])  # drop the column after the merged one
        ids[todo, :wide] = np.take_along_axis(ids[todo], take, 1)
        ids[todo, wide] = -1
        ids[todo, best] = made
        pairs = np.minimum(take, wide - 1)
        at[todo] = np.take_along_axis(at[todo], pairs, 1)
        rank[todo] = np.take_along_axis(rank[todo], pairs, 1)
        rank[todo, wide - 1] = NO_RANK
        for side in (best, best - 1):
            ok = side >= 0
            t, s = todo[ok], side[ok]
            at[t, s], rank[t, s] = v.ranks(ids[t, s], ids[t, s + 1])
    return ids


def _spots(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def merge(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of ids of each), by the vocabulary's merges in their order."""
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    short = int(np.searchsorted(length[order], LONG, "right"))
    size, parts = np.zeros(len(words), np.int64), [np.empty(0, np.int32)]
    for a in range(0, short, 8192):
        own = order[a:min(a + 8192, short)]
        ids = _merge_short(v, [words[i] for i in own.tolist()])
        size[own] = (ids >= 0).sum(axis=1)
        parts.append(ids[ids >= 0])
    for i in order[short:].tolist():
        parts.append(np.array(_merge_long(v, words[i]), np.int32))
        size[i] = len(parts[-1])
    by_length = np.concatenate(parts)
    begin = np.zeros(len(words), np.int64)
    begin[order] = np.cumsum(size[order]) - size[order]
    return by_length[_spots(begin, size)], size


class Lexicon:
    """A minimal acyclic transducer from words to ids, in one flat buffer.

    Arc: (state << 8 | byte) -> target state and output; the outputs along a
    word add up to its number. Layout: five lengths, then the arrays.
    """

    KINDS = (np.int64, np.int32, np.int32, np.int32, np.int32)  # arc, target, output, begin of each word's ids, ids

    def __init__(self, buffer):
        sizes = struct.unpack_from("<5q?", buffer)
        at, parts = 48, []
        for kind, n in zip(self.KINDS, sizes[:5], strict=True):
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.arc, self.target, self.output, self.begin, self.ids = parts
        self.final = np.frombuffer(buffer, np.bool_, -1, at)

    @staticmethod
    def open(path: str) -> Lexicon:
        with open(path, "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def compile(words: list[bytes], ids: np.ndarray, size: np.ndarray) -> bytes:
        """``words``: sorted, distinct, not empty; ``ids``: of all words in a row, ``size`` of each."""
        # Sorted insertion: the path of the last word is open; what leaves it is registered and shared.
        register: dict[tuple, int] = {}
        arcs_of: list[tuple[tuple[int, int], ...]] = []
        final_of: list[bool] = []
        words_under: list[int] = []
        path: list[tuple[list, bool]] = [([], False)]  # arcs (byte, state) and final of the open states

        def close(length: int, word: bytes) -> None:
            while len(path) > length:
                arcs, final = path.pop()
                key = (final, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(arcs_of)
                    arcs_of.append(key[1])
                    final_of.append(final)
                    words_under.append(final + sum(words_under[s] for _, s in arcs))
                if path:
                    path[-1][0].append((word[len(path) - 1], state))

        last = b""
        for word in words:
            common = len(os.path.commonprefix((last, word)))
            close(common + 1, last)
            for _ in word[common:]:
                path.append(([], False))
            path[-1] = (path[-1][0], True)
            last = word
        close(0, last)
        root = len(arcs_of) - 1
        arc, target, output = [], [], []
        for state, arcs in enumerate(arcs_of):
            number = int(final_of[state])
            for byte, to in arcs:
                arc.append((root - state) << 8 | byte)  # the root becomes state 0
                target.append(root - to)
                output.append(number)
                number += words_under[to]
        order = np.argsort(np.array(arc, np.int64), kind="stable")
        arrays = [np.array(arc, np.int64)[order], np.array(target, np.int32)[order], np.array(output, np.int32)[order],
                  np.concatenate(([0], np.cumsum(size))).astype(np.int32), ids.astype(np.int32)]
        return struct.pack("<5q8x", *(len(a) for a in arrays)) + b"".join(a.tobytes() for a in arrays) + np.array(final_of[::-1], np.bool_).tobytes()

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton does not hold it; all words walk together."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        number, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(size > 0) if len(self.arc) else np.empty(0, np.int64)
        number[size == 0] = -1
        if not len(self.arc):
            number[:] = -1
        at = 0
        while len(alive):
            want = state[alive] << 8 | flat[begin[alive] + at]
            slot = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1)
            hit = self.arc[slot] == want
            number[alive[~hit]] = -1
            alive, slot = alive[hit], slot[hit]
            state[alive] = self.target[slot]
            number[alive] += self.output[slot]
            at += 1
            ended = size[alive] == at
            out = alive[ended]
            number[out[~self.final[state[out]]]] = -1
            alive = alive[~ended]
        return number


def _cutter(added: dict[str, int]):
    return regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None


#: What lies between two cuts of a text: a string stands for itself after a space, a 1-tuple for its
#: string, a 2-tuple for an added token and its id.
Unit = str | tuple[str] | tuple[str, int]


def _units_of_line(text: str) -> list[Unit]:
    """Units of a text in which no two white-space characters are neighbours, but for a run that is all of it."""
    own: list[Unit] = text.split(" ")
    own[0] = (own[0],)
    return own


def units(text: str, added: dict[str, int], cut) -> list[Unit]:
    """A text cut where words always begin: words in a row are those of its units.

    No word reaches from other characters into white space, and of a longer
    white-space run only the last character can belong to what follows.
    """
    out: list[Unit] = []
    for i, part in enumerate(cut.split(text) if any(t in text for t in added) else [text]):
        if i % 2:
            out.append((part, added[part]))
            continue
        at = 0
        for run in RUN.finditer(part):
            begin, end = run.span()
            split = end - 1 if end < len(part) else end
            if begin > at:
                out += _units_of_line(part[at:begin])
            out.append((part[begin:split],))
            at = split
        if at < len(part):
            out += _units_of_line(part[at:])
    return out


def words_of(unit: Unit) -> list[str]:
    """Words of a unit; an added token stands for itself."""
    if isinstance(unit, str):
        return WORD.findall(" " + unit)
    return [unit[0]] if len(unit) == 2 else WORD.findall(unit[0])


def word_counts(docs: DataFrame, added: dict[str, int], column: str = "text", flush: int = 300_000) -> DataFrame:
    """(word as bytes, n) over all texts."""
    cut = _cutter(added)

    def run(batches):
        held: Counter = Counter()

        def out():
            words: Counter = Counter()
            for unit, n in held.items():
                for word in words_of(unit):
                    words[word] += n
            return pa.RecordBatch.from_pydict({"word": [w.encode() for w in words], "n": list(words.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

        for batch in batches:
            for text in batch.column(0):
                held.update(units(text.as_py() or "", added, cut))
                if len(held) > flush:
                    yield out()
                    held.clear()
        yield out()

    return small_batches(docs).select(F.col(column).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, added: dict[str, int], lexicon: int) -> list[bytes]:
    """Words that make up 1 / lexicon of all pre-tokens; at most ``lexicon`` of them."""
    counts = materialize(word_counts(docs, added), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") * lexicon >= total).select("word").collect()
    return sorted({bytes(r["word"]) for r in rows} - {t.encode() for t in added} - {b""})


def ship_lexicon(docs: DataFrame, vocabulary: Vocabulary, lexicon: int = 1 << 21) -> str:
    """Compile the lexicon of ``docs`` and send it to the executors; the name under which tasks find it."""
    words = frequent_words(docs, vocabulary.added, lexicon)
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, name)
        with open(path, "wb") as f:
            f.write(Lexicon.compile(words, *merge(vocabulary, words)))
        staged = os.path.join(SparkFiles.getRootDirectory(), name)
        with open(path, "rb") as source, open(staged, "wb") as to:
            to.write(source.read())
    docs.sparkSession.sparkContext.addFile(staged)
    return name


class Encoder:
    """Encodes lists of texts, keeping the ids of the distinct units and words it has met.

    What it keeps is bounded: with more than ``keep`` units, or ``keep_ids`` ids of
    units and words, it begins anew before the next list.
    """

    def __init__(self, v: Vocabulary, lexicon: Lexicon, keep: int = 400_000, keep_ids: int = 4_000_000):
        self.v, self.lexicon, self.keep, self.keep_ids = v, lexicon, keep, keep_ids
        self.cut = _cutter(v.added)
        self.clear()

    def clear(self) -> None:
        self.unit_index: defaultdict[Unit, int] = defaultdict(count().__next__)  # numbers the distinct units
        self.word_index: defaultdict[str, int] = defaultdict(count().__next__)  # numbers their distinct words
        self.word_ids, self.word_end = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.unit_ids, self.unit_end = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn_words(self, new: list[str]) -> None:
        """Append the ids of words, numbered in this order, from the lexicon or by merging."""
        words = [w.encode() for w in new]
        number = self.lexicon.find(words)
        if self.v.added:
            for i, w in enumerate(new):
                if w in self.v.added:
                    number[i] = -2 - self.v.added[w]
        unseen = np.flatnonzero(number == -1)
        merged, merged_size = merge(self.v, [words[i] for i in unseen.tolist()])
        # All sources in a row: the lexicon's ids, the merged ids, the ids 0, 1, ... that added tokens are.
        lexicon, known, added = self.lexicon, np.flatnonzero(number >= 0), np.flatnonzero(number < -1)
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[known], size[known] = lexicon.begin[number[known]], lexicon.begin[number[known] + 1] - lexicon.begin[number[known]]
        begin[unseen], size[unseen] = np.cumsum(merged_size) - merged_size, merged_size
        begin[added], size[added] = -2 - number[added], 1
        ids = np.empty(size.sum(), np.int32)
        end = np.cumsum(size)
        for at, source in ((known, lexicon.ids), (unseen, merged), (added, np.arange(len(self.v.text), dtype=np.int32))):
            ids[_spots(end[at] - size[at], size[at])] = source[_spots(begin[at], size[at])]
        self.word_ids, self.word_end = np.concatenate((self.word_ids, ids)), np.concatenate((self.word_end, self.word_end[-1] + end))

    def _learn_units(self, new: list[Unit]) -> None:
        in_units, words_per_unit, known = [], [], len(self.word_index)
        for unit in new:
            own = words_of(unit)
            in_units += map(self.word_index.__getitem__, own)
            words_per_unit.append(len(own))
        self._learn_words(list(islice(self.word_index, known, None)))
        in_units = np.array(in_units, np.int64)
        size = np.diff(self.word_end)[in_units]
        ids = self.word_ids[_spots(self.word_end[in_units], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(np.array(words_per_unit, np.int64))]
        self.unit_ids, self.unit_end = np.concatenate((self.unit_ids, ids)), np.concatenate((self.unit_end, self.unit_end[-1] + ends))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, one entry more)."""
        if len(self.unit_index) > self.keep or len(self.unit_ids) + len(self.word_ids) > self.keep_ids:
            self.clear()
        known, used, lengths = len(self.unit_index), [np.empty(0, np.int64)], []
        for text in texts:
            own = units(text or "", self.v.added, self.cut)
            used.append(np.fromiter(map(self.unit_index.__getitem__, own), np.int64, len(own)))
            lengths.append(len(own))
        self._learn_units(list(islice(self.unit_index, known, None)))
        used = np.concatenate(used)
        size = np.diff(self.unit_end)[used]
        end = np.concatenate(([0], np.cumsum(size)))
        return self.unit_ids[_spots(self.unit_end[used], size)], end[np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))]


def encode_texts(texts: list[str | None], v: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    return Encoder(v, lexicon).encode(texts)


def encode(docs: DataFrame, vocabulary: Vocabulary, lexicon_name: str, column: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the text; the text itself goes unless ``keep_text``."""
    kept = small_batches(docs).drop("ids")
    stay = [f for f in kept.schema.fields if keep_text or f.name != column]
    schema = T.StructType([*stay, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.fields())  # plain values: workers need not be able to import the class

    def run(batches):
        encoder = Encoder(Vocabulary(*shipped.value), Lexicon.open(SparkFiles.get(lexicon_name)))
        for batch in batches:
            texts, rest = (t.as_py() for t in batch.column(column)), batch.select([f.name for f in stay])
            at = 0
            for part in chunks(texts, lambda t: len(t or "") + 64):
                ids, begin = encoder.encode(part)
                yield rest.slice(at, len(part)).append_column("ids", pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())))
                at += len(part)

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, into: str = "decoded") -> DataFrame:
    """``rows`` with the text that their ``ids`` stand for."""
    kept = small_batches(rows).drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary.text)

    def run(batches):
        text = shipped.value
        for batch in batches:
            column = batch.column("ids")
            ids, begin = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
            out = [b"".join([text[i] for i in ids[a:z].tolist()]).decode("utf-8", "replace") for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield batch.append_column(into, pa.array(out, pa.string()))

    return kept.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
