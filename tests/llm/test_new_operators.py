"""Fingerprints, hard negatives and fill-in-the-middle against brute force, on rows that hold the awkward cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.llm import fim, fingerprints, hard_negatives

EXTRA = "fingerprint string, words int, node long, part int, place int, row int, drawn int, output string, form string, n int, h0 int"


def _texts():
    rnd = random.Random(11)
    words = [f"word{i}" for i in range(300)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    rows = [(i, prose(rnd.randint(1, 60))) for i in range(30)]
    rows += [(100, prose(20_000)), (101, None), (102, ""), (103, " \n\t"), (None, prose(9)), (None, None), (3, rows[3][1]), (3, "other"), (104, rows[5][1]), (105, rows[5][1])]
    rows += [(106, "a<P>b"), (107, "<S>"), (108, "<M> x"), (109, "<"), (110, "<<P"), (111, "P>S><S"), (112, "é世界 \x00\x7f\U0001f600!Zz"), (113, "abc"), (-7, "neg ative")]
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    """The rows, with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "f", 1, 2, 3, 4, 5, 6, "o", "psm", 7, 8) for r in ROWS], f"doc_id long, text string, {EXTRA}").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# -- fill in the middle --------------------------------------------------------


def _fim_brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "plain" if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), out, text


def test_fill_in_middle(docs, empty):
    made = fim.restore(fim.transform(docs))
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    want = [_fim_brute(*r) for r in ROWS]
    assert _sorted(found) == _sorted(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert {r["row"] for r in made.collect()} == {5}  # other columns stay
    sha = [(*w[:5], *(hashlib.sha256(t.encode()).hexdigest() for t in w[5:])) for w in want]
    assert _sorted(fim.digest(made).collect()) == _sorted(sha)
    assert fim.digest(fim.restore(fim.transform(empty))).count() == 0


def test_every_form_restores(docs):
    for plain, spm in ((0, 0), (0, 100), (100, 0)):
        made = fim.restore(fim.transform(docs, plain_percent=plain, spm_percent=spm, seed="x"))
        assert _sorted(made.select("doc_id", F.col("restored")).collect()) == _sorted((i, t or "") for i, t in ROWS)


# -- hard negatives ------------------------------------------------------------


def _negatives_brute(rows, anchors, k=5):
    """rows: (vec_id, label, tuple of ints), repeats included."""
    out = []
    for i, (a, label, v) in enumerate(rows):
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other == label) for j, (b, other, w) in enumerate(rows) if i != j and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2]][:k]:
            hits = [(b, -s) for s, b, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(a, p, r, b, -ps, s) for r, (b, s) in enumerate(hits, 1)]
    return out


def _vectors(rnd, n=260):
    middles = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, rnd.randrange(4), [x + rnd.gauss(0, 0.3) for x in rnd.choice(middles)]) for i in range(n)]
    rows += [(n + i, i % 3, rows[5][2]) for i in range(40)]  # a very common vector
    rows += [rows[0]] * 7 + [(0, 1, rows[3][2]), (0, 2, rows[0][2]), (20, 1, rows[20][2]), (20, 1, rows[21][2])]  # repeated rows and ids
    rows += [(600 + i, i % 2, [float(i), 1.0]) for i in range(30)] + [(700 + i, i % 2, []) for i in range(20)] + [(800, 9, [0.0] * 6), (820, 1, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("size", [{}, {"block_rows": 20, "cell_rows": 30, "sample": 50, "group_rows": 7}, {"block_rows": 1000, "cell_rows": 15}])
def test_hard_negatives(spark, size):
    rows = _vectors(random.Random(2))
    void = [(None, 1, [1.0] * 6), (40, None, [1.0] * 6), (60, 1, None), (80, 1, [None] * 6), (100, 2, [float("nan")] * 6), (120, 2, [float("inf")] * 6)]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows + void], "vec_id long, label int, embedding array<float>, n int, dim int, anchor string")
    found = hard_negatives.mine(hard_negatives.prepare(table), F.col("vec_id") % 20 == 0, **size)
    whole = [(i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, label, v in rows]
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _negatives_brute(whole, lambda a: a % 20 == 0)
    assert _sorted(found.collect()) == _sorted(want) and len(want) > 200
    if not size:
        assert hard_negatives.mine(hard_negatives.prepare(table.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_cover_tree_radii_and_bounds():
    rnd = np.random.default_rng(1)
    middles = rnd.integers(-3000, 3000, (12, 8))
    vectors = np.concatenate((*(m + rnd.integers(-200, 200, (150, 8)) for m in middles), rnd.integers(-3, 3, (300, 8)), np.zeros((50, 8), np.int64)))
    top = float(np.sqrt((vectors**2).sum(axis=1).max())) * (1 + 1e-12)
    ids = np.arange(len(vectors))
    tree = hard_negatives.CoverTree.load(hard_negatives.CoverTree.build(vectors, ids, ids % 3, np.ones(len(ids), np.int64), top), top)
    assert sorted(tree.ids.tolist()) == ids.tolist()
    assert 1 < tree.leaves < len(tree.centre) - 20  # more than two levels

    def points(node):
        if node >= tree.leaves:
            return list(range(tree.begin[node], tree.end[node]))
        return [p for child in range(tree.begin[node], tree.end[node]) for p in points(child)]

    for query in rnd.integers(-300, 300, (5, 8)).astype(float):
        norm = float(np.sqrt(query @ query))
        for node in range(len(tree.centre)):
            own = tree.vectors[points(node)] @ query
            low, high = hard_negatives.bounds(tree.centres[node:node + 1] @ query, tree.angle[node:node + 1], norm, top)
            assert low[0] <= own.min() and own.max() <= high[0]
            assert tree.low[node] == tree.labels[points(node)].min() and tree.high[node] == tree.labels[points(node)].max()
    assert points(0) == list(range(len(ids)))


def test_best_first_search_opens_few_leaves():
    """Clustered points: a search near one cluster leaves the others closed."""
    rnd = np.random.default_rng(4)
    middles = rnd.integers(-2000, 2000, (40, 16))
    vectors = np.concatenate([m + rnd.integers(-20, 20, (100, 16)) for m in middles])
    top = float(np.sqrt((vectors**2).sum(axis=1).max()))
    ids = np.arange(len(vectors))
    tree = hard_negatives.CoverTree.load(hard_negatives.CoverTree.build(vectors, ids, ids * 0, np.ones(len(ids), np.int64), top), top)
    scored = []
    tree.labels = type("Labels", (), {"__getitem__": lambda self, at: scored.append(len(at)) or np.zeros(len(at), np.int64)})()
    got = tree.search(middles[7] * 3, (-1, 0), True, [hard_negatives.LEAST], [-1 - hard_negatives.LEAST], 5)[0]
    best = np.lexsort((ids, -(vectors @ (middles[7] * 3))))[:5]
    assert [i for _, i in got] == best.tolist() and sum(scored) < len(ids) / 2


# -- fingerprints --------------------------------------------------------------


def _walk_brute(text):
    """The character read at each step, one step at a time."""
    go = (fingerprints._numbers("walk", fingerprints.KINDS * fingerprints.PERIOD) >> np.uint64(63)).reshape(fingerprints.KINDS, -1)
    kinds = [int(fingerprints.mix(np.array([ord(c) + 1], np.uint64))[0]) % fingerprints.KINDS for c in text]
    read, at, step = [], 0, 0
    while at < len(text):
        read.append(at)
        at += int(go[kinds[at], step % fingerprints.PERIOD])
        step += 1
    return read


def test_walk_is_the_step_by_step_walk():
    for text in ("", "a", "the quick brown fox " * 90, "é世界\x00\U0001f600"):
        walk = fingerprints.Walk(fingerprints.characters(text))
        read = _walk_brute(text)
        assert walk.reached[-1] == len(read)
        assert np.repeat(np.arange(len(text)), np.diff(walk.reached)).tolist() == read
        for kept in (0, len(text) // 2, len(text)):
            again = fingerprints.Walk(fingerprints.characters(text[:kept] + "changed"), walk, kept)
            assert again.reached.tolist() == fingerprints.Walk(fingerprints.characters(text[:kept] + "changed")).reached.tolist()


def test_sampled_steps_are_spread_evenly_and_stable():
    for length in (10, 1000, 123_457):
        steps = fingerprints.RECORDS[np.arange(fingerprints.BITS), (fingerprints.RECORDS < length).sum(axis=1) - 1]
        assert steps.max() < length and abs(steps.mean() / length - 0.5) < 0.06
        longer = fingerprints.RECORDS[np.arange(fingerprints.BITS), (fingerprints.RECORDS < length * 1.05).sum(axis=1) - 1]
        assert (steps == longer).mean() > 0.9
    assert (np.diff(fingerprints.RECORDS, axis=1) >= 0).all()


def test_likeness_follows_edits_not_positions():
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefghij klmnop") for _ in range(6000))
    other = "".join(rnd.choice("abcdefghij klmnop") for _ in range(6000))
    own = fingerprints.fingerprint(text)
    assert fingerprints.likeness(own, own) == 1 and fingerprints.likeness(own, fingerprints.fingerprint(other)) < 0.25
    # one edit of a few characters near the start, after which every position differs
    seen = sorted(fingerprints.likeness(own, fingerprints.fingerprint(text[:i] + "new" + text[i + cut:])) for i in range(0, 600, 40) for cut in (0, 10))
    assert seen[len(seen) // 2] > 0.8 and seen[2] > 0.3
    changed, kept = fingerprints.edited(fingerprints.characters(text), fingerprints.characters(other))
    assert kept == 4000 and 0.5 < fingerprints.likeness(own, fingerprints.Walk(changed).fingerprint()) < 0.85


def test_walks_side_by_side():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \u4e16\U0001f600") for _ in range(rnd.choice((0, 1, 5, 300, 2000)))) for _ in range(3 * fingerprints.SIDE_BY_SIDE)]
    chars = [fingerprints.characters(t) for t in texts]
    walks = fingerprints.Walk.of_many([(c, None, 0) for c in chars])
    alone = [fingerprints.Walk(c) for c in chars]
    assert [w.reached.tolist() for w in walks] == [w.reached.tolist() for w in alone]
    assert fingerprints.prints(walks) == [w.fingerprint() for w in alone]
    edits = [fingerprints.edited(a, b) for a, b in zip(chars, chars[1:] + chars[:1], strict=True)]
    again = fingerprints.Walk.of_many([(c, w, kept) for (c, kept), w in zip(edits, walks, strict=True)])
    assert [w.reached.tolist() for w in again] == [fingerprints.Walk(c).reached.tolist() for c, _ in edits]
    assert fingerprints.Walk.of_many([]) == [] and fingerprints.prints([]) == []


def test_with_successor(docs, empty, spark):
    found = fingerprints.with_successor(docs).collect()
    assert len(found) == len(ROWS)
    # among equal ids the order is that of the texts' hashes
    hashed = {r[0]: r[1] for r in spark.createDataFrame(sorted({(t or "",) for _, t in ROWS}), "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 3
        change = t[:len(t) - h] + after[:h]
        own, new = fingerprints.fingerprint(t), fingerprints.fingerprint(change)
        want.append((i, len(t), hashlib.sha256(change.encode()).hexdigest(), own, new, fingerprints.likeness(own, new), fingerprints.likeness(own, fingerprints.fingerprint(after))))
    assert _sorted((*r[:3], bytes(r[3]), bytes(r[4]), *r[5:]) for r in found) == _sorted(want)
    assert fingerprints.with_successor(empty).count() == 0
    (alone,) = fingerprints.with_successor(docs.filter("doc_id = 113")).collect()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()


def test_near_groups(spark):
    rnd = random.Random(21)

    def prose(n):
        return "".join(rnd.choice("abcdefghijklmnop rstuvwxyz") for _ in range(n))

    texts = [prose(2000) for _ in range(30)]
    copies = [t for t in texts[:6] for _ in range(5)] + [t[:900] + prose(8) + t[910:] for t in texts[:10] for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts + copies)] + [(500, None), (501, ""), (None, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = fingerprints.fingerprints(table)
    for near in (0.8, 0.6):
        groups = {bytes(r["fingerprint"]): r["group_id"] for r in fingerprints.near_groups(prints, near=near).collect()}
        known = {i: fingerprints.fingerprint(t) for i, t in rows}
        label = {i: i for i in known if i is not None}
        for a in label:
            for b in label:
                if a < b and label[a] != label[b] and fingerprints.likeness(known[a], known[b]) >= near:
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = {k: new if v == old else v for k, v in label.items()}
        assert {i: groups.get(known[i], i) for i in label} == label
        alone = [i for i in label if sum(x == label[i] for x in label.values()) == 1 and known[i] != known[None]]
        assert len(alone) > 15 and not any(known[i] in groups for i in alone)
    assert fingerprints.near_groups(prints.limit(0)).count() == 0
    assert fingerprints.near_groups(prints.filter("doc_id = 500")).count() == 0


@pytest.mark.parametrize("cell", [8192, 3])
def test_members_alike_only_to_each_other_are_linked(spark, monkeypatch, cell):
    """One bucket per band, whose leaders are alike to no one: every other pair is verified too, in one cell or in many."""
    monkeypatch.setattr(fingerprints, "band_bits", lambda distinct, near: [[511], [510]])
    monkeypatch.setattr(fingerprints, "CELL", cell)
    rnd = random.Random(5)
    families = []
    for _ in range(12):
        whole = rnd.getrandbits(509) << 3
        families.append([whole ^ sum(1 << b for b in rnd.sample(range(3, 512), 4 * k)) for k in range(4)])
    rows = [(i, p.to_bytes(64, "big")) for i, p in enumerate(p for f in families for p in f)]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint binary").repartition(3)
    groups = {bytes(r["fingerprint"]): r["group_id"] for r in fingerprints.near_groups(prints, near=0.9).collect()}
    assert groups == {p: i - i % 4 for i, p in rows}
