"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (runs of ASCII letters, other code points singly).
Two hashed numbers of the row's id choose where the prefix and the middle end;
further ones choose the form: ``psm`` (prefix, suffix, middle), ``spm``
(suffix, prefix, middle) or ``plain``, the unchanged text.

Per Arrow batch, for all texts together: the texts are split into list arrays
of units (views of the batch's own bytes, cut where a unit begins); these are
flattened, with the parent index of every unit; a unit's ordinal, its place in
its text, gives its role. For each role the units are filtered, rebuilt as lists and
joined to one piece per text, and the pieces are joined between the markers.

``restore`` takes the pieces apart at the markers and rebuilds the text. That
is exact because a text that holds a marker stays plain, and because markers
begin with ``<`` and end with ``>``, which occur in them nowhere else: no piece
and marker side by side can spell another marker.

Only rows and their own texts meet, so there is no shuffle, and a task holds
one batch of a few MB, or one text if that is longer.

Edge cases: a NULL or empty text is plain, with no units; a NULL id hashes as
an empty one; equal rows each get their row, with the same result; extra
columns stay, columns named as the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARKER = "<[PSM]>"
CHUNK_BYTES = 1 << 20
OUT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def draws(seed: str, key: Column, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: the first groups of 8 hex digits of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def unit_lists(raw: pa.LargeBinaryArray) -> pa.LargeListArray:
    """The units of each text: letters in a row, or another code point with the bytes that continue it."""
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
    text = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.empty(0, np.uint8)
    letter = LETTER[text]
    begins = (text & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[(at[:-1] - at[0])[at[:-1] < at[-1]]] = True  # letters of two texts side by side
    begin = np.append(np.flatnonzero(begins), len(text))
    units = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(text)])
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(begin, at - at[0])), units)


def _pieces(units: pa.Array, parents: np.ndarray, role: np.ndarray, texts: int) -> pa.Array:
    """The units of a role, joined per text."""
    own = pc.filter(units, pa.array(role))
    offsets = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(parents[role], minlength=texts), out=offsets[1:])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), own), pa.scalar(b"", own.type))


def transform_texts(texts: pa.Array, h: list[np.ndarray], plain_percent: int, spm_percent: int) -> dict[str, pa.Array]:
    """The columns of ``OUT`` for strings without NULLs; ``h``: the four drawn numbers of each."""
    rows = len(texts)
    raw = texts.cast(pa.large_binary())
    lists = unit_lists(raw)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    n = np.bincount(parents, minlength=rows)
    ordinal = np.arange(len(parents)) - (np.cumsum(n) - n)[parents]
    cuts = np.sort(np.stack((h[0] % (n + 1), h[1] % (n + 1))), axis=0)
    first, second = cuts[0][parents], cuts[1][parents]
    prefix, middle, suffix = (_pieces(units, parents, role, rows) for role in (ordinal < first, (ordinal >= first) & (ordinal < second), ordinal >= second))
    plain = (n == 0) | (h[2] % 100 >= 100 - plain_percent) | pc.match_substring_regex(texts, MARKER).to_numpy(zero_copy_only=False)
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))

    def row_of(*parts) -> pa.Array:
        return pc.binary_join_element_wise(*(pa.scalar(p.encode(), pa.large_binary()) if isinstance(p, str) else p for p in parts), pa.scalar(b"", pa.large_binary()))

    out = pc.if_else(pa.array(plain), raw, pc.if_else(pa.array(form == SPM), row_of(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
                                                      row_of(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))

    def chars(piece: pa.Array) -> pa.Array:
        length = pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64())
        return pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), length)

    return {"n": pa.array(n, pa.int64()), "form": pa.array(form.astype(object), pa.string()), "prefix_chars": chars(prefix), "middle_chars": chars(middle),
            "output": out.cast(pa.large_string())}


def restore_texts(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that ``transform_texts`` was given."""
    plain, spm = pc.equal(form, PLAIN), pc.equal(form, SPM)
    output = output.cast(pa.large_string())
    marked = pc.if_else(plain, pa.scalar(PREFIX + SUFFIX + MIDDLE, pa.large_string()), output)
    parts = pc.split_pattern_regex(marked, MARKER)  # empty, first piece, second piece, middle
    first, second, middle = (pc.list_element(parts, i) for i in (1, 2, 3))
    none = pa.scalar("", pa.large_string())
    return pc.if_else(plain, output, pc.binary_join_element_wise(pc.if_else(spm, second, first), middle, pc.if_else(spm, first, second), none))


def _slices(column: pa.Array):
    """Slices of a batch of about CHUNK_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    cut = np.flatnonzero(np.diff(size // CHUNK_BYTES, prepend=0))
    begin = 0
    for end in [*cut.tolist(), len(column)]:
        if end > begin:
            yield begin, end - begin
            begin = end


def transform(docs: DataFrame, key: str = "doc_id", column: str = "text", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """``docs`` with the columns of ``OUT``."""
    kept = small_batches(docs).drop(*OUT)
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(", ".join(f"`{c}` {t}" for c, t in OUT.items())).fields])
    names, place = kept.columns, kept.columns.index(column)
    drawn = kept.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(*[h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col(f"`{key}`")))]).alias("drawn"))

    def run(batches):
        for batch in batches:
            rows, h = batch.column("row").flatten(), [x.to_numpy(zero_copy_only=False) for x in batch.column("drawn").flatten()]
            for begin, size in _slices(rows[place]):
                texts = pc.fill_null(rows[place].slice(begin, size).cast(pa.large_string()), "")
                made = transform_texts(texts, [x[begin:begin + size] for x in h], plain_percent, spm_percent)
                made["output"] = made["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(r.slice(begin, size) for r in rows), *made.values()], names=[*names, *made])

    return drawn.mapInArrow(run, schema)


def restore(rows: DataFrame, into: str = "restored") -> DataFrame:
    """``rows`` (columns ``output`` and ``form``) with the original text."""
    kept = small_batches(rows).drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            for begin, size in _slices(batch.column("output")):
                part = batch.slice(begin, size)
                yield part.append_column(into, restore_texts(part.column("output"), part.column("form")).cast(pa.string()))

    return kept.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """Digest columns of ``restore(transform(...))``."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
