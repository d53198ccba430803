"""Hard negatives for labelled vectors, by cover trees over norm-augmented candidates.

For an anchor, the positives are the k rows of its label with the highest
inner products, and the negatives of a positive the best k rows of other labels
whose score lies in a window below the positive's score.

**Norm augmentation.** With M the largest norm, a candidate x gets one more
component, sqrt(M^2 - |x|^2), so all candidates lie on a sphere, and a query
(with 0 there) has the same inner products as before. What lies within
distance r of a centre is within the angle 2 asin(r / 2M) of it, which bounds its
inner products with the query from both sides.

**The tree.** Its upper net is fitted on a bounded sample (at most ``sample``
rows, a centre for every ``cell_rows`` rows and at most ``cells``): every row goes to the cell of its nearest centre, and
each cell's covering radius is taken over all its rows. A cell of more than
``block_rows`` rows is dealt into blocks. In a block, farthest-first
insertion gives nested nets whose covering radius halves from level to level;
each node keeps its actual covering radius. Trees are stored, one row each.

**The search** goes best-first, first over cells, then over nodes: the node with
the highest bound is opened next, nodes outside every window are skipped (as
are nodes without a wanted label), and the points of leaves are scored
exactly. A search ends when no bound left reaches its k-th best score. For the
positives, each anchor searches its best cell first; the score reached there
prunes the other cells. Anchors meet a block in groups of at most
``group_rows`` on average, so a task holds one tree and one group.

Rows that are equal in id, label and vector are one candidate with a count, so
a row that occurs a million times is one point; it counts as often in every
result, and an anchor that occurs twice has its results twice. Equal vectors of
different ids are spread over the blocks of their cell.

Edge cases: rows with a NULL id, label or vector, or a NULL or non-finite
component take no part; only vectors of one length meet, empty vectors with score 0;
fewer than k rows: all of them; no positive, or no row in a window: no result
rows; an empty table gives no rows. Extra columns are ignored. Scores have to fit a long.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.session import materialize

from ._words import small_batches

SCALE = 256
LEAF = 64  # points per leaf, on average
NO_CELL = -1
LEAST = -(1 << 63)


def prepare(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, label, vector, n) of the distinct rows that take part, n being how often each occurs."""
    x = F.col(vector_column)
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    own = rows.filter(fine & F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(SCALE * v.cast("double")).cast("long")).alias("vector"))
    return own.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("n"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def augment(vectors: np.ndarray, top: float) -> np.ndarray:
    """The vectors with one more component that brings their norms to ``top``."""
    x = vectors.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))[:, None]))


def bounds(product: np.ndarray, angle: np.ndarray, norm: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of points within ``angle`` of centres whose product with the query is given."""
    scale = norm * top
    to_centre = np.arccos(np.clip(product / scale, -1, 1)) if scale else np.zeros(len(product))
    slack = 1e-6 * scale + 0.5
    return scale * np.cos(np.minimum(to_centre + angle, np.pi)) - slack, scale * np.cos(np.maximum(to_centre - angle, 0)) + slack


def angle_of(distance: np.ndarray, top: float) -> np.ndarray:
    return 2 * np.arcsin(np.clip(distance / (2 * top), 0, 1)) if top else np.zeros(len(distance))


def farthest_first(points: np.ndarray, limit: int):
    """Nested nets: (centres in order of insertion, per level each point's nearest centre).

    A level's net is complete when every point is within its radius, half
    the radius of the level before, or when there are ``limit`` centres.
    """
    def distance(centre):
        return np.sqrt(np.maximum(((points - points[centre]) ** 2).sum(axis=1), 0))

    centres, near, away = [0], np.zeros(len(points), np.int64), distance(0)
    levels, radius = [near.copy()], away.max(initial=0) / 2
    while len(centres) < limit and away.max(initial=0) > 0:
        held = len(centres)
        while len(centres) < limit and away.max() > radius:
            centre = int(away.argmax())
            own = distance(centre)
            own[centre] = 0
            closer = own < away
            near[closer], away = len(centres), np.minimum(own, away)
            centres.append(centre)
        if len(centres) > held:
            levels.append(near.copy())
        radius /= 2
    return np.array(centres), levels


class CoverTree:
    """The tree of one block as arrays; nodes and points lie in the order of their parents.

    Per node: ``centre``, ``angle`` (of its covering radius), ``low`` and
    ``high`` label, and ``begin`` to ``end``: its children, or in the last level its points.
    """

    ARRAYS = ("centre", "angle", "low", "high", "begin", "end", "vectors", "ids", "labels", "counts")

    def __init__(self, arrays: dict, top: float):
        self.top = top
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.leaves = int(arrays["leaves"])  # the first node of the last level
        self.centres = self.vectors[self.centre].astype(np.float64)
        if top * top < 1 << 53:  # then products of doubles are exact, and faster
            self.vectors = self.vectors.astype(np.float64)

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, counts: np.ndarray, top: float) -> bytes:
        points = augment(vectors, top)
        centres, nearest = farthest_first(points, max(1, len(points) // LEAF))
        # Ancestors: the nearest centre in the last level, then of each centre its own nearest one level up.
        above = [nearest[-1]]
        for near in nearest[-2::-1]:
            above.insert(0, near[centres[above[0]]])
        order = np.lexsort(above[::-1])  # points by their path from the root
        points, above = points[order], [a[order] for a in above]
        parts: dict[str, list] = {name: [] for name in ("centre", "angle", "low", "high", "begin", "end")}
        nodes, place = 0, np.argsort(order)
        starts = [np.flatnonzero(np.diff(np.stack(above[:i + 1]), axis=1, prepend=-1).any(axis=0)) for i in range(len(above))]
        for level, start in enumerate(starts):
            own = above[level][start]
            centre = place[centres[own]]
            spread = np.sqrt(((points - np.repeat(points[centre], np.diff(np.append(start, len(points))), axis=0)) ** 2).sum(axis=1))
            nodes += len(start)
            if level + 1 < len(starts):
                child = np.append(np.searchsorted(starts[level + 1], start), len(starts[level + 1])) + nodes
            else:
                child = np.append(start, len(points))
            parts["centre"].append(centre)
            parts["angle"].append(angle_of(np.maximum.reduceat(spread, start), top))
            parts["low"].append(np.minimum.reduceat(labels[order], start))
            parts["high"].append(np.maximum.reduceat(labels[order], start))
            parts["begin"].append(child[:-1])
            parts["end"].append(child[1:])
        out = io.BytesIO()
        np.savez(out, leaves=nodes - len(starts[-1]), vectors=vectors[order], ids=ids[order], labels=labels[order], counts=counts[order],
                 **{name: np.concatenate(part) for name, part in parts.items()})
        return out.getvalue()

    @staticmethod
    def load(data: bytes, top: float) -> CoverTree:
        return CoverTree(np.load(io.BytesIO(data)), top)

    def search(self, query: np.ndarray, own: tuple[int, int], same: bool, lows: list[int], highs: list[int], k: int) -> list[list[tuple[int, int]]]:
        """Per window lows[i] <= score <= highs[i], the k best (score, id): highest score first, then smallest id.

        ``own``: id and label of the query's row, which is left out once. ``same``: rows of its label, else rows of the others.
        """
        wide, exact, place = query.astype(np.float64), query.astype(self.vectors.dtype), np.arange(len(self.ids))
        norm = float(np.sqrt(wide @ wide))
        need, most = np.array(lows, np.int64), np.array(highs, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(lows)
        held: list[int] = []  # leaves to score together: one, then two, four, ...
        chunk = 1
        heap = [(-np.inf, -np.inf, 0)]

        def score_held():
            spans = [slice(self.begin[n], self.end[n]) for n in held]
            held.clear()
            score = np.concatenate([self.vectors[s] @ exact for s in spans]).astype(np.int64)
            worth = np.flatnonzero((score >= need.min()) & (score <= most.max()))
            at, score = np.concatenate([place[s] for s in spans])[worth], score[worth]
            wanted = (self.labels[at] == own[1]) == same
            at, score = at[wanted], score[wanted]
            name, count = self.ids[at], self.counts[at]
            itself = np.flatnonzero(name == own[0]) if same else []
            if len(itself):
                count[itself] -= (self.vectors[at[itself]] == query).all(axis=1)
            for w in range(len(lows)):
                fit = np.flatnonzero((score >= need[w]) & (score <= most[w]) & (count > 0))
                if len(fit):
                    times = np.minimum(count[fit], k)
                    s, n = np.concatenate((found[w][0], np.repeat(score[fit], times))), np.concatenate((found[w][1], np.repeat(name[fit], times)))
                    best = np.lexsort((n, -s))[:k]
                    found[w] = s[best], n[best]
                    if len(best) == k:
                        need[w] = max(need[w], found[w][0][-1])

        while heap or held:
            if not heap:
                score_held()
                continue
            bound, least, node = heapq.heappop(heap)
            if -bound < need.min():
                heap.clear()  # no bound left is higher
                continue
            if len(lows) > 1 and not ((-bound >= need) & (least <= most)).any():
                continue
            if node >= self.leaves:
                held.append(node)
                if len(held) >= chunk:
                    score_held()
                    chunk = min(2 * chunk, 64)
                continue
            a, z = int(self.begin[node]), int(self.end[node])
            lower, upper = bounds(self.centres[a:z] @ wide, self.angle[a:z], norm, self.top)
            if same:
                fit = (self.low[a:z] <= own[1]) & (self.high[a:z] >= own[1])
            else:
                fit = (self.low[a:z] != own[1]) | (self.high[a:z] != own[1])
            fit &= ((upper[:, None] >= need) & (lower[:, None] <= most)).any(axis=1)
            for i in np.flatnonzero(fit).tolist():
                heapq.heappush(heap, (-upper[i], lower[i], a + i))
        return [list(zip(s.tolist(), n.tolist(), strict=True)) for s, n in found]


class Index:
    """Cover trees of all candidates: ``trees`` (cell, salt, dim, tree), and the cells as plain values for the tasks."""

    def __init__(self, trees: DataFrame, top: float, cells: list[tuple]):
        self.trees, self.top, self.cells = trees, top, cells  # cells: (cell, centre or None, radius, low, high label, blocks)


def _centres(rows: DataFrame, top: float, sample: int, cells: int) -> dict[int, np.ndarray]:
    """Per vector length, the centres that farthest-first insertion takes from a sample (the rows of the smallest hashes)."""
    some = rows.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(sample).collect()
    by_length: dict[int, list] = {}
    for (v,) in some:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for dim, vectors in by_length.items():
        points = augment(np.array(vectors, np.int64).reshape(len(vectors), dim), top)
        share = max(1, cells * len(vectors) // len(some))
        out[dim] = points[farthest_first(points, share)[0]]
    return out


def build_index(rows: DataFrame, block_rows: int = 8192, cell_rows: int = 2048, cells: int = 256, sample: int = 4096) -> Index:
    """Index every row of ``prepare`` (with ``dim``, its vector's length)."""
    norm = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    most, count = rows.agg(F.max(norm), F.count(F.lit(1))).first()
    top = float(np.sqrt(most or 0.0)) * (1 + 1e-12)
    centres = _centres(rows, top, sample, min(cells, -(-count // cell_rows)))
    first = dict(zip(centres, np.cumsum([0, *(len(c) for c in centres.values())]).tolist(), strict=False))

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, away = np.full(len(dims), NO_CELL, np.int32), np.full(len(dims), np.inf)
            for dim in np.unique(dims).tolist():
                if dim in centres:
                    at = np.flatnonzero(dims == dim)
                    points = augment(matrix(batch.column("vector").take(pa.array(at)), dim), top)
                    product = points @ centres[dim].T
                    best = product.argmax(axis=1)  # all norms are equal, so the highest product is the nearest centre
                    cell[at] = first[dim] + best
                    away[at] = np.sqrt(((points - centres[dim][best]) ** 2).sum(axis=1))
            yield batch.append_column("cell", pa.array(cell)).append_column("away", pa.array(away))

    placed = materialize(rows.mapInArrow(place, "vec_id long, label long, vector array<long>, n long, dim int, cell int, away double"), "negatives-placed")
    # at most one row per centre, and one for vectors of lengths that the sample lacks
    found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high")).collect()
    flat = [c for own in centres.values() for c in own]
    table = [(c["cell"], None if c["cell"] == NO_CELL else flat[c["cell"]], c["radius"], c["low"], c["high"], -(-c["rows"] // block_rows)) for c in found]
    blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in table for x in (c[0], c[5])]), F.col("cell")), F.lit(1)) if table else F.lit(1)
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "label", "vector"), blocks).cast("int"))

    def plant(key, block):
        columns = [block.column(c).to_numpy() for c in ("vec_id", "label", "n")]
        tree = CoverTree.build(matrix(block.column("vector"), key[2].as_py()), *columns, top)
        return pa.table({"cell": [key[0]], "salt": [key[1]], "dim": [key[2]], "tree": pa.array([tree], pa.binary())})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = dealt.repartition(tasks, "cell", "salt", "dim").groupBy("cell", "salt", "dim").applyInArrow(plant, "cell int, salt int, dim int, tree binary")
    return Index(materialize(trees, "negatives-trees"), top, table)


SEARCH = "anchor long, window int, score long, vec_id long"


def _route(searches: DataFrame, index: Index, same: bool, best_only: bool) -> DataFrame:
    """(search, cell) rows: of cells that may hold a wanted row, the one of the highest bound, or all but that one."""
    cells, top = index.cells, index.top

    def run(batches):
        number = np.array([c[0] for c in cells], np.int32)
        low, high = (np.array([c[i] for c in cells], np.int64) for i in (3, 4))
        dims = np.array([NO_CELL if c[1] is None else len(c[1]) - 1 for c in cells])
        angle = angle_of(np.array([c[2] for c in cells], np.float64), top)
        of_dim = {d: np.array([c[1][:-1] for c in cells if c[1] is not None and len(c[1]) == d + 1]) for d in set(dims.tolist()) - {NO_CELL}}
        for batch in batches:
            rows, found = [], []
            for i, (vector, label, lows, highs, first_cell) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vector", "label", "lows", "highs", "first_cell")), strict=True)):
                query = np.array(vector, np.float64)
                least, most = np.full(len(cells), -np.inf), np.full(len(cells), np.inf)
                at = np.flatnonzero(dims == len(query))
                if len(at):
                    least[at], most[at] = bounds(of_dim[len(query)] @ query, angle[at], float(np.sqrt(query @ query)), top)
                fit = (dims == len(query)) | (dims == NO_CELL)
                fit &= (low <= label) & (label <= high) if same else (low != label) | (high != label)
                if best_only:
                    own = [int(np.where(fit, most, -np.inf).argmax())] if fit.any() else []
                else:
                    fit &= ((most[:, None] >= np.array(lows, np.int64)) & (least[:, None] <= np.array(highs, np.int64))).any(axis=1)
                    own = np.flatnonzero(fit & (number != (NO_CELL - 1 if first_cell is None else first_cell))).tolist()
                rows += [i] * len(own)
                found += number[own].tolist()
            own = batch.drop_columns("first_cell").take(pa.array(rows, pa.int64()))
            yield own.append_column("cell", pa.array(found, pa.int32()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in searches.schema.fields if f.name != "first_cell") + ", cell int"
    return searches.mapInArrow(run, schema)


def _search(routed: DataFrame, index: Index, same: bool, k: int, groups: int) -> DataFrame:
    """Rows of SEARCH: of every routed search and block, the k best of each window."""
    blocks = F.element_at(F.create_map(*[F.lit(x) for c in index.cells for x in (c[0], c[5])]), F.col("cell")) if index.cells else F.lit(1)
    asked = routed.withColumn("salt", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    trees = index.trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    top, names = index.top, ("anchor", "vector", "vec_id", "label", "lows", "highs")

    def run(key, searches, tree):
        out: dict[str, list] = {"anchor": [], "window": [], "score": [], "vec_id": []}
        if searches.num_rows and tree.num_rows:
            own = CoverTree.load(tree.column("tree")[0].as_py(), top)
            for anchor, vector, vec_id, label, lows, highs in zip(*(searches.column(c).to_pylist() for c in names), strict=True):
                for window, best in enumerate(own.search(np.array(vector, np.int64), (vec_id, label), same, lows, highs, k)):
                    for score, name in best:
                        for c, x in zip(out, (anchor, window, score, name), strict=True):
                            out[c].append(x)
        return pa.Table.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())]))

    key = ("cell", "salt", "dim", "part")
    tasks = int(index.trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as a few bytes can mean much work
    return asked.repartition(tasks, *key).groupBy(*key).cogroup(trees.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, SEARCH)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, k: int = 5, low_percent: int = 80, high_percent: int = 100, group_rows: int = 4096, **index) -> DataFrame:
    """Rows of (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` as ``prepare`` gives them, ``is_anchor`` says which of them to mine for. A negative has
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.
    """
    rows = materialize(small_batches(rows).withColumn("dim", F.size("vector")), "negatives-rows")
    built = build_index(rows, **index)
    anchors = materialize(rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    groups = max(1, -(-anchors.count() // group_rows))
    everything = {"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(-1 - LEAST))}
    searches = anchors.drop("n").withColumns(everything).withColumn("first_cell", F.lit(None).cast("int"))

    first = materialize(_route(searches, built, True, True), "negatives-first")
    found = materialize(_best(_search(first, built, True, k, groups), k), "negatives-near")
    reached = found.groupBy("anchor").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached"))
    rest = (
        searches.drop("first_cell").join(first.select("anchor", F.col("cell").alias("first_cell")), "anchor").join(reached, "anchor", "left")
        .withColumn("lows", F.array(F.coalesce("reached", F.lit(LEAST)))).select(*searches.columns)
    )
    more = _search(_route(rest, built, True, False), built, True, k, groups)
    positives = materialize(_best(found.select("anchor", "window", "score", "vec_id").unionByName(more), k), "negatives-positives")

    # one search per anchor with a window for each of its positives, in the order of their ranks
    ranked = F.array_sort(F.collect_list(F.struct("rank", "score")))
    low, high = F.expr(f"-floor(-{low_percent} * cast(p.score as decimal(20, 0)) / 100)"), F.expr(f"floor({high_percent} * cast(p.score as decimal(20, 0)) / 100)")
    per = positives.groupBy("anchor").agg(ranked.alias("ps"))
    windows = per.select("anchor", F.posexplode("ps").alias("i", "p")).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("i", low.cast("long").alias("low"), high.cast("long").alias("high")))).alias("w"))
    asked = anchors.drop("n").join(windows, "anchor").select(
        *anchors.drop("n").columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.lit(None).cast("int").alias("first_cell"))
    negatives = _best(_search(_route(asked, built, False, False), built, False, k, groups), k)

    own = anchors.select("anchor", F.col("vec_id").alias("anchor_id"), "n")
    of = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(of, ["anchor", "window"]).join(own, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
                      F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_again")).drop("_again")
