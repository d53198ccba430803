"""Document fingerprints by a randomised edit embedding.

**The embedding.** A text is read along a random walk that all texts share: at
step j the walk stands on a character, and a random bit of (j, character) says
whether it goes on to the next one. After an edit the walks of two texts
drift apart by a few characters and soon fall into step again, so a small edit
distance becomes a small Hamming distance between what the walks read, wherever
the edit is. A character that is reached at step j is left behind at the next
step whose bit is 1, so each costs one table look-up. The texts of a chunk are walked
side by side: one array operation takes all of them a character on, until few are left.

**Bit sampling.** A fingerprint has ``BITS`` bits. Each reads the walk at one step:
for a walk of L steps the one of least rank below L, in an order of its own, so
texts of nearly equal length read nearly the same steps. The bit is a hash
of the ``GRAM`` characters there. Texts that agree in a share s of their walks agree
in about (1 + s) / 2 of the bits; ``likeness`` turns that back into s.

**Banding and verification.** ``near_groups`` draws random sets of bits (bands).
Their number and size follow from the number of distinct fingerprints and the
``likeness`` asked for: unrelated fingerprints meet about ``FALSE`` times each,
those just alike enough share no band with probability ``MISS``. Equal fingerprints are one. In
every band each bucket has two leaders, its smallest and its largest fingerprint by
hash; every member is verified against both, and alike ones are linked. In buckets whose
members are then still in several groups, every two members of different groups
are verified too, so no bucket is capped: all alike fingerprints that share a bucket are one
group. A bucket's largest group is not compared with itself, and a large bucket is cut into
cells of at most ``CELL`` times ``CELL`` comparisons, spread over the tasks.

**Edited texts.** ``with_successor`` is the use case of the registered query: the
documents are sorted by id over all tasks, and each is compared with the next
document and with an edit of itself that ends in the next one's beginning. The
walk over the part that stays is not walked again. Only the first and
last rows of each partition are kept to be paired over its borders.

Edge cases: a NULL text is empty; an empty text has the fingerprint zero and
likeness 1 to empty texts; equal texts have equal fingerprints; among equal ids the
order is that of the texts' hashes, and NULL ids come last; a single document is its own
next one; an empty table gives no rows; a task holds texts of about 4 million
characters at a time, or one longer text, at about 50 bytes a character with its edit. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit.session import materialize

from ._words import chunks, mix, rows_of, small_batches
from .components import connected_components

BITS = 512
GRAM = 4
PERIOD_BITS = 12
PERIOD = 1 << PERIOD_BITS  # the walk's random bits repeat after so many steps
KINDS = 256  # characters are told apart in the walk by so many classes
FALSE, MISS = 0.05, 0.02
CELL = 8192  # fingerprints of one bucket on either side of a comparison
SIDE_BY_SIDE = 64  # fewer texts are walked one by one, which takes as long
U64 = np.uint64


def _numbers(name: str, n: int) -> np.ndarray:
    """n fixed random 64-bit numbers."""
    seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _stays() -> bytes:
    """[class * PERIOD + step]: how many steps a walk that gets to a character at this step spends on it."""
    go = (_numbers("walk", KINDS * PERIOD) >> U64(63)).astype(bool).reshape(KINDS, PERIOD)
    out = np.zeros((KINDS, PERIOD), np.uint8)
    left = np.zeros(KINDS, np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):
        left = np.where(go[:, step % PERIOD], 1, left + 1)
        out[:, step % PERIOD] = left
    return out.tobytes()


def _records() -> np.ndarray:
    """Per bit, the steps of least rank among all steps up to them, ascending; the last one below L is uniform on 0 to L - 1.

    After step r the next such step exceeds m with probability (r + 1) / (m + 1).
    """
    rows = 96
    chance = (_numbers("records", BITS * rows).astype(np.float64) + 1) / 2.0**64
    out = np.zeros((BITS, rows), np.float64)
    for i in range(1, rows):
        out[:, i] = np.minimum(np.maximum(np.ceil((out[:, i - 1] + 1) / chance[i::rows][:BITS]) - 1, out[:, i - 1] + 1), 2.0**62)
    return out.astype(np.int64)


def _kind(chars: np.ndarray) -> np.ndarray:
    return (mix(chars.astype(U64) + U64(1)) & U64(KINDS - 1)).astype(np.uint8)


STAYS, RECORDS, SEEDS = _stays(), _records(), _numbers("bits", BITS)
EARLIEST = RECORDS.min(axis=0)  # ascending
KIND = _kind(np.arange(1 << 16, dtype=np.uint32))  # of the characters in common use


def _step(at: int, kind: int) -> int:
    return at + STAYS[kind * PERIOD + at % PERIOD]


class Walk:
    """The walk over a text: its characters, and the step at which each is reached (and the last one left)."""

    def __init__(self, chars: np.ndarray, stem: Walk | None = None, kept: int = 0):
        """``stem``: a walk over a text with the same first ``kept`` characters, which are not walked again."""
        self.chars = chars
        self.reached = _reached([(chars, stem, kept)])[0]

    @classmethod
    def of_many(cls, texts: list[tuple[np.ndarray, Walk | None, int]]) -> list[Walk]:
        """The walks over many texts, each (characters, stem, kept), side by side."""
        out = []
        for (chars, _, _), reached in zip(texts, _reached(texts), strict=True):
            walk = cls.__new__(cls)
            walk.chars, walk.reached = chars, reached
            out.append(walk)
        return out

    def fingerprint(self) -> bytes:
        return prints([self])[0]


def _reached(texts: list[tuple[np.ndarray, Walk | None, int]]) -> list[np.ndarray]:
    """Per text, the step at which each character is reached. All texts take their next character at once, while many have one left."""
    parts = [chars[kept:] for chars, _, kept in texts]
    size = np.array([len(c) for c in parts], np.int64)
    at = np.array([0 if stem is None else stem.reached[kept] for _, stem, kept in texts], np.int64)
    kinds = np.concatenate([_kinds(c) for c in parts] or [np.empty(0, np.uint8)])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))  # of a text among the kinds; its steps begin one place later for each text before it
    steps = np.empty(len(kinds) + len(parts), np.int64)
    order = np.argsort(-size, kind="stable")
    number, left, at = order, size[order], at[order]
    read = first[order]
    write = read + order
    longest = -left  # ascending
    stays = np.frombuffer(STAYS, np.uint8)
    place, many = 0, int(np.searchsorted(longest, 0))
    while many >= SIDE_BY_SIDE:
        now = at[:many]
        steps[write[:many] + place] = now
        now += stays[(kinds[read[:many] + place].astype(np.int64) << PERIOD_BITS) + (now & (PERIOD - 1))]
        place += 1
        many = int(np.searchsorted(longest, -place))
    for i in range(len(parts)):  # the ends of the longest texts, and the last step of all
        begin, end = int(read[i]) + min(place, int(left[i])), int(read[i] + left[i])
        here = int(write[i]) + begin - int(read[i])
        steps[here:here + end - begin + 1] = np.fromiter(accumulate(kinds[begin:end].tobytes(), _step, initial=int(at[i])), np.int64, end - begin + 1)
    out = []
    for i, (_, stem, kept) in enumerate(texts):
        own = steps[first[i] + i:first[i] + i + size[i] + 1]
        out.append(own if stem is None else np.concatenate((stem.reached[:kept], own)))
    return out


def _kinds(chars: np.ndarray) -> np.ndarray:
    """The class of each character."""
    return KIND[chars] if not len(chars) or chars.max() < len(KIND) else _kind(chars)


def prints(walks: list[Walk]) -> list[bytes]:
    """The fingerprint of each walk."""
    out = []
    for i in range(0, len(walks), 64):
        some = walks[i:i + 64]
        chars = np.empty((len(some), BITS, GRAM), U64)  # 1 more than each character read, or 0 behind the end
        for row, walk in zip(chars, some, strict=True):
            if not len(walk.chars):
                continue
            end = walk.reached[-1]
            steps = RECORDS[np.arange(BITS), (RECORDS[:, :np.searchsorted(EARLIEST, end)] < end).sum(axis=1) - 1]
            at = np.searchsorted(walk.reached, steps, "right")[:, None] + np.arange(-1, GRAM - 1)
            np.add(walk.chars[np.minimum(at, len(walk.chars) - 1)], U64(1), out=row)
            row[at >= len(walk.chars)] = 0
        value = np.broadcast_to(SEEDS, (len(some), BITS))
        for j in range(GRAM):
            value = mix(value + chars[:, :, j])
        bits = np.packbits((value >> U64(63)).astype(np.uint8), axis=1)
        out += [b.tobytes() if len(w.chars) else bytes(BITS // 8) for b, w in zip(bits, some, strict=True)]
    return out


def characters(text: str | None) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str | None) -> bytes:
    return Walk(characters(text)).fingerprint()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of their walks in which two texts agree, from 0 to 1."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, 1 - 2 * differ / BITS)


def fingerprints(docs: DataFrame, column: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of their text, as bytes."""
    kept = small_batches(docs).drop(into)

    def run(batches):
        for batch in batches:
            walks = Walk.of_many([(characters(t.as_py()), None, 0) for t in batch.column(column)])
            yield batch.append_column(into, pa.array(prints(walks), pa.binary()))

    return kept.mapInArrow(run, kept.withColumn(into, F.lit(b"")).schema)


# -- bands -------------------------------------------------------------------


def band_bits(distinct: int, near: float) -> list[list[int]]:
    """The bits of each band, for so many distinct fingerprints."""
    agree = (1 + near) / 2
    size = max(8, ceil(log(max(2.0, distinct / FALSE)) / log(1 / 0.55)))  # unrelated texts agree in little over half of the bits
    bands = ceil(log(MISS) / log(1 - agree**size))
    rank = _numbers("bands", bands * BITS).reshape(bands, BITS)
    return [np.argsort(r)[:size].tolist() for r in rank]


def likeness_column(a: Column, b: Column) -> Column:
    """``likeness`` of fingerprints as arrays of longs."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    return F.greatest(F.lit(0.0), 1 - 2 * differ / F.lit(BITS))


def _between_groups(members: DataFrame, roots: DataFrame, known: DataFrame, near: float) -> DataFrame:
    """(a, b): roots of groups that hold two alike members of one bucket.

    ``members``: (bucket, node), each bucket's leaders verified against all its members;
    ``roots``: (node, root) of linked nodes; any other node is a group of its own.
    """
    words = BITS // 64
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("groups"))
    # of three members at most one is no leader, so all their pairs are verified
    mixed = sizes.filter("groups > 1 and size > 3").select("bucket", F.col("main.root").alias("main"),
                                                           F.ceil(F.col("size") / CELL).cast("int").alias("wide"), F.ceil((F.col("size") - F.col("main.n")) / CELL).cast("int").alias("high"))
    rest = rooted.join(materialize(mixed, "prints-mixed"), "bucket").join(known.select("node", *[F.col("words")[i].alias(f"w{i}") for i in range(words)]), "node")
    rest = materialize(rest, "prints-rest")

    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Each row once for every cell of the bucket that it is compared in."""
        at = {own: F.pmod(F.xxhash64("node"), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        cell = [at["high"].alias("y"), at["wide"].alias("x")]
        return rows.select("bucket", *cell, F.col("root").alias(f"{name}_root"), *([F.col("main")] if name == "a" else []), *[F.col(f"w{i}").alias(f"{name}{i}") for i in range(words)])

    a, b = side(rest.filter("root <> main"), "a", "high", "wide"), side(rest, "b", "wide", "high")
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(words)), F.lit(0))
    met = a.join(b, ["bucket", "y", "x"]).filter((F.col("b_root") == F.col("main")) | (F.col("a_root") < F.col("b_root")))
    alike = met.filter(F.greatest(F.lit(0.0), 1 - 2 * differ / F.lit(BITS)) >= near)
    return alike.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()


def near_groups(prints: DataFrame, key: str = "doc_id", column: str = "fingerprint", near: float = 0.9) -> DataFrame:
    """(fingerprint, group_id): the smallest key reachable over links between fingerprints of likeness ``near`` or more.

    Fingerprints that only one row has, and that no other one is near to, are left out.
    """
    words = BITS // 64
    schema = f"{column} binary, node long, words array<long>"

    def number(batches):
        for batch in batches:
            prints = batch.column(column).to_pylist()
            longs = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
            node = mix(longs.astype(U64).reshape(-1, words) + SEEDS[:words]).sum(axis=1, dtype=U64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(column), pa.array(node), pa.ListArray.from_arrays(pa.array(np.arange(0, len(longs) + 1, words), pa.int32()), pa.array(longs))],
                                             names=[column, "node", "words"])

    distinct = materialize(prints.groupBy(column).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")), "prints-distinct")
    known = materialize(distinct.select(column).mapInArrow(number, schema), "prints-words")  # node: a 64-bit hash of the fingerprint
    bands = band_bits(distinct.count(), near)

    def deal(batches):
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8)).reshape(-1, BITS)
            for i, band in enumerate(bands):
                value = np.full(len(bits), SEEDS[i % BITS] + U64(i // BITS))
                for packed in np.packbits(bits[:, band], axis=1).T:
                    value = mix(value + packed.astype(U64) + U64(1))
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), batch.column("node")], names=["bucket", "node"])

    dealt = known.mapInArrow(deal, "bucket long, node long")
    buckets = dealt.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    members = materialize(dealt.join(materialize(buckets, "prints-leaders"), "bucket"), "prints-members")
    pairs = members.select("node", F.explode(F.array("first", "last")).alias("leader")).filter("node <> leader").distinct()
    a, b = known.select("node", F.col("words").alias("a")), known.select(F.col("node").alias("leader"), F.col("words").alias("b"))
    alike = materialize(pairs, "prints-pairs").join(a, "node").join(b, "leader").filter(likeness_column(F.col("a"), F.col("b")) >= near)
    links = materialize(alike.select(F.col("node").alias("a"), F.col("leader").alias("b")), "prints-links")
    copied = distinct.filter("copies > 1").select(column, F.col("first").alias("group_id"))
    roots = materialize(connected_components(links), "prints-roots") if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    more = materialize(_between_groups(members.select("bucket", "node"), roots, known, near), "prints-between")
    if not more.isEmpty():
        top = materialize(connected_components(more), "prints-top")
        own = roots.unionByName(top.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti"))
        roots = own.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    elif links.isEmpty():
        return copied
    linked = materialize(known.select(column, "node").join(roots, "node").select(column, "root").join(distinct, column), "prints-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("group_id"))
    grouped = linked.join(smallest, "root").select(column, "group_id")
    return grouped.unionByName(copied.join(linked.select(column), column, "left_anti"))


# -- each document against an edit of itself and the next document -------------


def edited(chars: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, int]:
    """(the text with its last third replaced by the first as many characters of the next one, how many stay)."""
    kept = len(chars) - len(chars) // 3
    return np.concatenate((chars[:kept], following[:len(chars) // 3])), kept


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, "
       "part int, place long, text string")


def _read(rows) -> list[tuple]:
    """(id, text, walk, fingerprint) of (id, text) rows."""
    walks = Walk.of_many([(characters(text), None, 0) for _, text in rows])
    return [(doc_id, text, walk, own) for (doc_id, text), walk, own in zip(rows, walks, prints(walks), strict=True)]


def _compared(read: list[tuple], following: list[tuple]):
    """A row of OUT for each row that was read and the one that follows it."""
    edits = [(*edited(a[2].chars, b[2].chars), a[2]) for a, b in zip(read, following, strict=True)]
    walks = Walk.of_many([(changed, stem, kept) for changed, kept, stem in edits])
    for (doc_id, _, walk, own), (_, _, _, other), edit, of_edit in zip(read, following, walks, prints(walks), strict=True):
        sha = hashlib.sha256(edit.chars.tobytes().decode("utf-32-le", "surrogatepass").encode()).hexdigest()
        yield doc_id, len(walk.chars), sha, own, of_edit, likeness(own, of_edit), likeness(own, other), None, None, None


def _batches(rows, size: int = 512):
    """Rows of OUT as Arrow batches."""
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.string()]
    held: list[tuple] = []

    def out():
        columns = zip(*held, strict=True) if held else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        if len(held) >= size or row[-1] is not None:
            yield out()
            held.clear()
    yield out()


def with_successor(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), next meaning the next smaller id, the largest after the smallest."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.as_py().encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(packed, pa.binary())], names=["doc_id", "mark", "packed"])

    # texts travel packed; the last sort column only spreads equal rows
    packed = rows.mapInArrow(pack, "doc_id long, mark long, packed binary")
    ordered = packed.orderBy(F.col("doc_id").desc_nulls_last(), "mark", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())

    def run(batches):
        part, unpacker = [], zstandard.ZstdDecompressor()

        def texts():
            for batch in batches:
                part[:] = [batch.column("part")[0].as_py()] if len(batch) else part
                for doc_id, packed in rows_of(batch, "doc_id", "packed"):
                    yield doc_id, unpacker.decompress(packed).decode()

        def pairs():
            before = None  # the last row read
            for some in chunks(texts(), lambda row: len(row[1])):
                read = _read(some)
                if before is None:  # the row before the first one is in another partition
                    doc_id, text, walk, own = read[0]
                    yield doc_id, len(walk.chars), None, own, None, None, None, part[0], 0, text
                else:
                    read.insert(0, before)
                yield from _compared(read[:-1], read[1:])
                before = read[-1]
            if before is not None:
                yield before[0], len(before[2].chars), None, before[3], None, None, None, part[0], 1, before[1]

        return _batches(pairs())

    found = materialize(ordered.mapInArrow(run, OUT), "prints-rows")
    # Borders: every partition's last row (place 1) with the first one (place 0) of the next partition that has rows.
    borders = found.filter(F.col("place").isNotNull()).select("part", "place", "doc_id", "text")
    parts = sorted(r["part"] for r in found.filter("place = 0").select("part").collect())  # one number per partition
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    first = borders.filter("place = 0").select(F.col("part").alias("after"), F.col("text").alias("following"))
    last = borders.filter("place = 1").join(after, "part").join(first, "after").select("doc_id", "text", "following")

    def pair(batches):
        def rows():
            for batch in batches:
                for doc_id, text, following in rows_of(batch, "doc_id", "text", "following"):
                    row, after = _read([(doc_id, text), (None, following)])
                    yield from _compared([row], [after])

        return _batches(rows())

    inner = found.filter(F.col("place").isNull())
    return inner.unionByName(materialize(last.mapInArrow(pair, OUT), "prints-borders")).drop("part", "place", "text")


def digest(rows: DataFrame) -> DataFrame:
    def text(c):
        return F.lower(F.hex(c)).alias(c)

    return rows.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next", *[c for c in rows.columns if c == "group_id"])
