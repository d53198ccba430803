"""Secrets in texts, with weak candidates linked across the parts of a credential.

Base spans (code points, end excluded) come from three patterns: assigned
passwords and keys, access identifiers, long hex strings. Weaker parts are
collected beside them: identifiers (16 or more capitals and digits, both
present), secrets (32 to 64 key characters of high entropy) and endpoints
(URLs). On its own a weak part is no finding. An interval join looks, within
``scope`` code points of one text, for an identifier and a secret; both are
then reported, and so is an endpoint within the scope of a linked secret.
Base access identifiers count as identifiers.

The join is an equi-join on (document, scope-sized bin) and a distance test:
the earlier part of a pair stands in the bin of its end and in the next, the
later part in the bin of its start, however long they are, so the cost is
bound by the parts that fit in a scope. Only parts are shuffled, never texts,
and only from texts that hold both an identifier and a secret.

Edge cases: NULL text counts as empty; equal rows each get their row; rows
with the same id and other text stay apart; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.session import materialize

from ._words import chunks, rows_of, small_batches


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = re.compile(rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA and a run of at least 16: the run is always taken whole
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

KEY = "A-Za-z0-9+/_-"
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}+(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(rf"(?<![{KEY}])([{KEY}]{{26,}}+)(?:={{1,6}}+(?![{KEY}]))?")  # with its padding 32 at least
NAME = re.compile(r"(?:[A-Z]+[0-9]{0,2}(?:[_-]+[A-Z]+[0-9]{0,2})+|[a-z]+[0-9]{0,2}(?:[_-]+[a-z]+[0-9]{0,2})+)")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]{4,}")
ENTROPY = 3.6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Parts (kind, start, end, new) of a text that has an identifier and a secret, else none; new: apart from all base spans."""
    secrets = [m.span() for m in WEAK_SECRET.finditer(text) if len(m[0]) >= 32 and entropy(m[0]) >= ENTROPY and not m[0].isalpha()
               and not (text.startswith("=", m.end(1)) and NAME.fullmatch(m[1]))]
    if not secrets:
        return []
    ids = [s[1:] for s in base if s[0] == "access"] + [m.span() for m in WEAK_ID.finditer(text)]
    if not ids:
        return []
    parts = [("weak_id", *s) for s in ids] + [("weak_secret", *s) for s in secrets] + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return sorted({(k, a, z, all(z <= b[1] or b[2] <= a for b in base)) for k, a, z in parts})


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
PART = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("new", pa.bool_())])
SCANNED = "doc_id long, mark long, base array<struct<kind:string,start:int,end:int>>, parts array<struct<kind:string,start:int,end:int,new:boolean>>"


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("base", pa.list_(SPAN)), ("parts", pa.list_(PART))])
    for batch in batches:
        for part in chunks(rows_of(batch, "doc_id", "mark", "text"), lambda r: len(r[2] or "") + 64):
            out = []
            for doc_id, mark, text in part:
                text = text or ""
                base = base_spans(text)
                out.append({"doc_id": doc_id, "mark": mark, "base": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base],
                            "parts": [dict(zip(("kind", "start", "end", "new"), s, strict=True)) for s in weak_parts(text, base)]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _near(left: DataFrame, right: DataFrame, scope: int, overlap: bool = False) -> DataFrame:
    """Pairs of parts of one text with at most ``scope`` code points between them, each pair once; with ``overlap`` also overlapping parts.

    The later part starts between the end of the earlier one (its start, if they may overlap) and ``scope`` beyond that end, so in one of the bins between.
    """
    doc, columns = ["doc_id", "mark"], ("kind", "start", "end", "new")

    def placed(parts: DataFrame, side: str, earlier: bool) -> DataFrame:
        """A part in both roles: ``earlier`` is the value of ``left_first`` in which it is the earlier one."""
        first, last = F.floor(F.col("start" if overlap else "end") / scope), F.floor(F.col("end") / scope) + 1
        as_earlier = F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(earlier).alias("left_first"), b.alias("bin")))
        as_later = F.array(F.struct(F.lit(not earlier).alias("left_first"), F.floor(F.col("start") / scope).alias("bin")))
        places = parts.select(*doc, *columns, F.explode(F.concat(as_earlier, as_later)).alias("place"))
        return places.select(*doc, "place.*", *(F.col(c).alias(f"{side}_{c}") for c in columns))

    one, other = placed(left, "l", True), placed(right, "r", False)
    gap = F.when(one["left_first"], F.col("r_start") - F.col("l_end")).otherwise(F.col("l_start") - F.col("r_end"))
    in_order = F.when(one["left_first"], F.col("r_start") >= F.col("l_start")).otherwise(F.col("l_start") > F.col("r_start")) if overlap else gap >= 0
    same = one["doc_id"].eqNullSafe(other["doc_id"]) & (one["mark"] == other["mark"]) & (one["left_first"] == other["left_first"]) & (one["bin"] == other["bin"])
    return one.join(other, same & (gap <= scope) & in_order).select(one["doc_id"], one["mark"], *(F.col(f"{s}_{c}") for s in "lr" for c in columns))


def _side(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select("doc_id", "mark", *(F.col(f"{side}_{c}").alias(c) for c in ("kind", "start", "end", "new")))


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added spans (kind, start, end), each by start."""
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    scanned = materialize(source.mapInArrow(_scan, SCANNED), "scanned")
    parts = scanned.filter(F.size("parts") > 0).select("doc_id", "mark", F.explode("parts").alias("p")).select("doc_id", "mark", "p.*").distinct()
    ids, secrets, ends = (parts.filter(F.col("kind") == k) for k in ("weak_id", "weak_secret", "endpoint"))
    pairs = materialize(_near(ids, secrets, scope), "linked")
    linked = _side(pairs, "r").distinct()
    added = _side(pairs, "l").unionByName(linked).unionByName(_side(_near(linked, ends, scope, overlap=True), "r"))
    spans = added.filter("new").select("doc_id", "mark", F.struct("start", "kind", "end").alias("s")).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("s")).alias("added"))
    joined = scanned.join(spans, scanned["doc_id"].eqNullSafe(spans["doc_id"]) & (scanned["mark"] == spans["mark"]), "left")
    shaped = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(scanned["doc_id"], "base", F.coalesce(shaped, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def order(s):
        return F.struct(s["start"].alias("start"), F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    every = F.array_sort(F.transform(F.concat("base", "added"), order))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def brute_force(rows: list[tuple], scope: int = 200) -> list[tuple]:
    """The same result by comparing all parts of a text, for tests."""
    out = []
    for doc_id, text in rows:
        base = base_spans(text or "")
        parts = weak_parts(text or "", base)

        def near(a, b, least=0):
            return least <= max(a[1] - b[2], b[1] - a[2]) <= scope

        kind = {k: [p for p in parts if p[0] == k] for k in KINDS}
        ids = {i for i in kind["weak_id"] for s in kind["weak_secret"] if near(i, s)}
        secrets = {s for i in kind["weak_id"] for s in kind["weak_secret"] if near(i, s)}
        ends = {e for e in kind["endpoint"] for s in secrets if near(e, s, -math.inf)}
        every = sorted([s[:3] for s in ids | secrets | ends if s[3]] + base, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        named = [",".join(f"{k}:{a}:{z}" for k, a, z in spans) for spans in (base, every)]
        out.append((doc_id, *(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(named[0].encode()).hexdigest(), named[1]))
    return out
