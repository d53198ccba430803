"""Personal data by patterns, checksums and context, with Spark expressions only.

Patterns propose spans (code points, end excluded). Validators confirm them:
number ranges for IPv4 addresses, Luhn for cards, digit counts for phones,
mod 97 for IBANs. An IBAN is tried at every place it can start at, and up to
every space of the hit as well as to its end, as words in capitals or numbers
may follow; of the valid ends the one of the country's length counts, else the
longest. Words near a span raise its score. The kinds of ``BASE``
are always reported once confirmed; the added kinds only when their score
reaches ``threshold``: an IBAN by its checksum, a phone without a country
code or an identity number (ddd-dd-dddd) only with a context word nearby.
Added spans that overlap a reported one are left out.

The positions come from splitting a text by the pattern: gaps and matches
alternate. The patterns hold possessive loops and start only at the edge of a
run (or at the end of the match before), which changes no match but keeps
them linear, and without recursion, on long runs.

Edge cases: NULL text is empty and has no spans; empty table, no rows; equal
rows each get their row; columns stay, but one named ``pii`` (or ``_pii_...``) is
replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
Check = Callable[[Column], Column]


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))

    return F.forall(F.split(hit, "[.]"), small)


def luhn(digits: Column) -> Column:
    """Checksum of a string of at most 20 digits."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (F.when(d < 5, 2 * d).otherwise(2 * d - 9) if i % 2 == 0 else d)
    return total % 10 == 0


def _card(hit: Column) -> Column:
    n = F.length(_digits(hit))
    return F.when(n.between(16, 19), luhn(_digits(hit))).otherwise(False)


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN (letters and digits only), 1 if it is valid."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), step)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban(hit: Column) -> Column:
    """The valid IBAN at the start of a hit, else NULL."""
    lengths = F.create_map(*(F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)))
    words = F.split(hit, " ")

    def ending(n: Column) -> Column:
        joined = F.array_join(F.slice(words, 1, n), "")
        fits = F.length(joined).eqNullSafe(F.try_element_at(lengths, F.substring(hit, 1, 2)))
        return F.struct(fits.alias("fits"), n.alias("words"), joined.alias("iban"))

    ends = F.transform(F.sequence(F.lit(1), F.size(words)), ending)
    best = F.array_max(F.filter(ends, lambda e: (F.length(e["iban"]) >= 12) & (mod97(e["iban"]) == 1)))
    return F.when(hit.isNotNull(), F.array_join(F.slice(words, 1, best["words"]), " "))


def _phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(8, 15)


#: kind, pattern, confirmation, score
BASE: list[tuple[str, str, Check, float]] = [
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), 0.9),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", _card, 0.8),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6),
]
ADDED: list[tuple[str, str, Check, float]] = [
    ("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])))[A-Z]",
     lambda h: F.lit(True), 0.9),
    ("local_phone", r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", lambda h: F.lit(True), 0.4),
    ("id_number", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", lambda h: F.lit(True), 0.4),
]
#: Kinds whose pattern matches one character at each place to try, the hit being its group 1, and the part of a hit that counts.
TRIED: dict[str, Check] = {"iban": _iban}
#: Cheap tests that a text can hold a kind at all.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
CONTEXT = {
    "email": "mail|contact|write to", "ip": r"\bip\b|host|address|server", "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto", "local_phone": "phone|call|tel|mobile|fax",
    "id_number": "ssn|social|identity|passport",
}
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.3
CHUNK, BLOCK = 256, 512
SPAN = "struct<kind:string,start:int,end:int,hit:string>"


def _alternating(text: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern, each with the length of the gap before it."""
    tried = TRIED.get(kind, lambda hit: hit)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind in TRIED)))
    pairs = F.when(F.size(hits) > 0, F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), tried(hit).alias("hit"))))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), pairs) if kind in NEEDS else pairs


def _scan(items: Column, zero: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """What ``step`` puts out at each element in turn; it gets the state and the element, and gives the new state and an array to put out.

    Appending to one array costs its length every time, so parts of ``CHUNK`` elements are gathered first. ``items`` is looked up element by element: let it be a column or a bound value.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inner(held: Column, at: Column) -> Column:
        state, out = step(held, F.get(items, at))
        return F.struct(*(state[c].alias(c) for c in zero), F.concat(held["out"], out).alias("out"))

    def outer(held: Column, part: Column) -> Column:
        places = F.sequence(part * CHUNK, F.least((part + 1) * CHUNK, F.size(items)) - 1)
        begin = F.struct(*(held[c].alias(c) for c in zero), empty.alias("out"))
        return F.aggregate(places, begin, inner, lambda h: F.struct(*(h[c].alias(c) for c in zero), F.concat(held["parts"], F.array(h["out"])).alias("parts")))

    start = F.struct(*(v.alias(c) for c, v in zero.items()), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.coalesce(F.when(F.size(items) > 0, F.aggregate(parts, start, outer, lambda held: F.flatten(held["parts"]))), empty)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(text: Column) -> Column:
    """A text cut every ``BLOCK`` code points, so that any place in it is found at once."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to ``end`` (exclusive; the end of the text, if that is less)."""
    first, last = F.floor(begin / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    whole = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(blocks, i)), "")
    return F.when(end > begin, F.substr(whole, begin - first * BLOCK + 1, end - begin)).otherwise("")


def _placed(pairs: Column, kind: str, check: Check) -> Column:
    """Confirmed spans of alternating gaps and matches, none beginning within the one before."""

    def step(held: Column, pair: Column) -> tuple[dict[str, Column], Column]:
        begin = held["at"] + pair["gap"]
        end = begin + F.length(pair["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        fine = F.coalesce(pair["hit"].isNotNull() & check(pair["hit"]), F.lit(False)) & (begin >= held["free"])
        state = {"at": begin + 1 if kind in TRIED else F.coalesce(end, begin), "free": F.when(fine, end).otherwise(held["free"])}
        return state, F.when(fine, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _scan(pairs, {"at": F.lit(0), "free": F.lit(0)}, step, SPAN)


def _apart(added: Column, base: Column) -> Column:
    """The added spans that overlap no base span, in their order: one pass in each direction over all of them by start."""
    kinds = F.array(*(F.lit(k) for k, _, _, _ in ADDED))
    event = "struct<start:int,added:int,end:int,rank:int,kind:string,score:double,hit:boolean>"

    def events(spans: Column, is_added: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_added).alias("added"), s["end"].alias("end"), F.array_position(kinds, s["kind"]).cast("int").alias("rank"),
                                                     s["kind"].alias("kind"), s["score"].alias("score"), F.lit(False).alias("hit")))

    def forward(held: Column, e: Column) -> tuple[dict[str, Column], Column]:
        hit = (e["added"] == 1) & (held["end"] > e["start"])
        return {"end": F.when(e["added"] == 0, F.greatest(held["end"], e["end"])).otherwise(held["end"])}, F.array(e.withField("hit", hit))

    def backward(held: Column, e: Column) -> tuple[dict[str, Column], Column]:
        free = (e["added"] == 1) & ~e["hit"] & (held["start"] >= e["end"])
        return {"start": F.when(e["added"] == 0, e["start"]).otherwise(held["start"])}, F.when(free, F.array(e)).otherwise(F.array().cast(f"array<{event}>"))

    sorted_events = F.array_sort(F.concat(events(base, 0), events(added, 1)))
    seen = _bound(sorted_events, lambda all_: F.reverse(_scan(all_, {"end": F.lit(0)}, forward, event)))
    free = _bound(seen, lambda all_: _scan(all_, {"start": F.lit(2**31 - 1)}, backward, event))
    in_order = F.array_sort(F.transform(free, lambda e: F.struct(e["rank"].alias("rank"), e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"), e["score"].alias("score"))))
    apart = F.transform(in_order, lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))
    return F.when((F.size(added) > 0) & (F.size(base) > 0), apart).otherwise(added)


def find_pii(docs: DataFrame, threshold: float = 0.6, column: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score), by kind as listed, then start."""
    kinds = BASE + ADDED
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    docs = docs.drop("pii", "_pii_text", "_pii_blocks", "_pii_base", "_pii_added", *(f"_pii_{k}" for k, _, _, _ in kinds))
    names = docs.columns
    pairs = docs.select("*", text.alias("_pii_text"), *(_alternating(text, k, p).alias(f"_pii_{k}") for k, p, _, _ in kinds))
    placed = pairs.select(*names, "_pii_text", *(_placed(F.col(f"_pii_{k}"), k, check).alias(f"_pii_{k}") for k, _, check, _ in kinds))
    some = reduce(Column.__or__, (F.size(f"_pii_{k}") > 0 for k, _, _, _ in kinds))
    placed = placed.select(*names, F.when(some, _blocks(F.col("_pii_text"))).alias("_pii_blocks"), *(f"_pii_{k}" for k, _, _, _ in kinds))

    def scored(kind: str, base: float) -> Column:
        def one(span: Column) -> Column:
            near = F.lower(_cut(F.col("_pii_blocks"), F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), span["end"] + CONTEXT_CHARS))
            gain = F.when(near.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
            return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.least(F.lit(base) + gain, F.lit(1.0)).alias("score"))

        return F.transform(f"_pii_{kind}", one)

    found = placed.select(*names, F.concat(*(scored(k, s) for k, _, _, s in BASE)).alias("_pii_base"), F.concat(*(scored(k, s) for k, _, _, s in ADDED)).alias("_pii_added"))
    found = found.select(*names, "_pii_base", F.filter("_pii_added", lambda a: a["score"] >= threshold).alias("_pii_added"))
    return found.select(*names, F.concat("_pii_base", _apart(F.col("_pii_added"), F.col("_pii_base"))).alias("pii"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; where spans overlap, the first stands for all."""
    piece = "struct<at:int,start:int,kind:string>"

    def step(held: Column, span: Column) -> tuple[dict[str, Column], Column]:
        out = F.array(F.struct(held["at"].alias("at"), span["start"].alias("start"), span["kind"].alias("kind")))
        return {"at": F.greatest(held["at"], span["end"])}, F.when(span["start"] >= held["at"], out).otherwise(F.array().cast(f"array<{piece}>"))

    def labelled(blocks: Column, ordered: Column) -> Column:
        pieces = F.transform(_scan(ordered, {"at": F.lit(0)}, step, piece), lambda p: F.concat(_cut(blocks, p["at"], p["start"]), F.lit("<"), F.upper(p["kind"]), F.lit(">")))
        rest = F.coalesce(F.array_max(F.transform(ordered, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(pieces, ""), _cut(blocks, rest, F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return _bound(_blocks(text), lambda blocks: _bound(ordered, lambda spans: labelled(blocks, spans)))


def digest(found: DataFrame) -> DataFrame:
    base = [k for k, _, _, _ in BASE]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )
