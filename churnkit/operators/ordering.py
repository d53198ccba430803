"""Exact whole-table orderings without a single-task step.

A window with an ORDER BY and no PARTITION BY (a dense surrogate key, an
NTILE over all rows, an exact percentile over all rows) makes Spark move
every row into one task. The same results are computed here with a
distributed sort:

1. Add a unique tie-break ``_tb`` (``monotonically_increasing_id`` on a
   scan of written files, hence the same on every evaluation), so equal
   order values, NULLs and exact copies are spread over many ranges
   instead of landing in one task.
2. Sort globally (range partitioning chosen by Spark from a sample, then
   a sort inside each partition), and number rows inside each partition
   with ``spark_partition_id`` and ``monotonically_increasing_id``.
3. Write that once to the shared folder, so that the counts and the rows
   below come from the same physical ordering.
4. Count rows per (partition, group): at most partitions + groups rows.
   A running sum over that small table gives each partition's offset; the
   table is written once too, as several steps read it.
5. Join the offsets back (broadcast after a size check, a shuffle join
   otherwise): row number = offset + position inside the partition.

Groups (``by``) are optional; rows are ranked inside each group, and a
group may span many partitions, so a hot group is split like any other
range. The number of groups only affects the size of the offset table.

Exact percentiles need only two ranks per group: they are read from a
narrow value band that a bounded sketch proposes and an exact count
verifies, so only the band (with equal values combined) is sorted; a group
whose band misses uses the full sort above. Sums per tile work likewise:
only the rows near a tile's edge are sorted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.session import materialize

_HELPER = ("_tb", "_p", "_m")


def _ordered(df: DataFrame, order: Sequence[Column], by: Sequence[str], stable_input: bool,
             unique_order: bool = False) -> DataFrame:
    if unique_order:
        # no two rows share (by, order): the sort itself is deterministic, no tie-break needed
        src, tail = df.withColumn("_tb", F.lit(0).cast("long")), []
    else:
        src = df if stable_input else materialize(df, "rank-input")
        src, tail = src.withColumn("_tb", F.monotonically_increasing_id()), [F.col("_tb").asc()]
    sort_cols = [F.col(b).asc_nulls_first() for b in by] + list(order) + tail
    ordered = (
        src.orderBy(*sort_cols)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_m", F.monotonically_increasing_id())
    )
    return materialize(ordered, "rank-ordered")


def _offsets(ordered: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = ordered.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_p")
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_off", F.coalesce(before, F.lit(0)))


def _join_offsets(ordered: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    renamed = offsets.select(
        F.col("_p").alias("_op"),
        *[F.col(b).alias(f"_ob{i}") for i, b in enumerate(by)],
        "_off",
        "_m0",
        "_n",
    )
    # names are distinct on the two sides, so conditions can refer to them by name
    cond = F.col("_p") == F.col("_op")
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_ob{i}"))
    # Without groups the table has one row per sort partition, a bound fixed
    # by the shuffle partition count; with groups its size is checked first.
    small = F.broadcast(renamed) if not by else renamed
    return ordered.join(small, cond, "inner")


def _rank(df, order, by, name, stable_input, unique_order=False):
    ordered = _ordered(df, order, by, stable_input, unique_order)
    # small (partitions + groups rows), written once: the size check, the
    # group sizes and the join below all read it instead of recomputing it
    offsets = materialize(_offsets(ordered, by), "rank-offsets")
    joined = _join_offsets(ordered, offsets, by)
    out = joined.withColumn(name, (F.col("_off") + F.col("_m") - F.col("_m0") + 1).cast("long"))
    out = out.drop(*_HELPER, "_op", "_off", "_m0", "_n", *[f"_ob{i}" for i in range(len(by))])
    return out, offsets


def rank_rows(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rn",
    stable_input: bool = False,
    unique_order: bool = False,
) -> DataFrame:
    """Exact ``row_number() over (partition by <by> order by <order>)``.

    ``order`` are sort expressions (``F.col(x).desc_nulls_last()`` ...).
    Rows equal on ``by`` + ``order`` are numbered in an arbitrary but fixed
    order. Pass ``stable_input=True`` when ``df`` is a scan of written
    files (possibly filtered or projected); otherwise it is written first.
    ``unique_order`` says that rows equal on ``by`` + ``order`` are equal in
    every column: the order is then fixed without either.
    """
    return _rank(df, order, by, name, stable_input, unique_order)[0]


def _with_sizes(ranked: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the group size ``_size``, summed from the small offset table."""
    sizes = offsets.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if not by:
        total = sizes.first()
        return ranked.withColumn("_size", F.lit(total[0] if total else 0).cast("long"))
    renamed = sizes.select(*[F.col(b).alias(f"_sb{i}") for i, b in enumerate(by)], "_size")
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_sb{i}"))
    return ranked.join(renamed, cond).drop(*[f"_sb{i}" for i in range(len(by))])


def ntile(
    df: DataFrame,
    k: int,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "tile",
    stable_input: bool = False,
) -> DataFrame:
    """Exact ``ntile(k) over (partition by <by> order by <order>)``.

    The first ``n mod k`` tiles get one row more than the others, as in SQL.
    """
    ranked, offsets = _rank(df, order, by, "_rn", stable_input)
    ranked = _with_sizes(ranked, offsets, by)
    return ranked.withColumn(name, _tile(F.col("_rn"), F.col("_size"), k)).drop("_rn", "_size")


def _tile(rn: Column, n: Column, k: int) -> Column:
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    tile = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1).otherwise(F.floor((rn - 1 - big) / q) + r + 1)
    return tile.cast("int")


def _sketched_edges(sketch: DataFrame, middles: Sequence[float], k: int) -> tuple[int, list[tuple[float, float]]]:
    """(rows, value band around each share of the rows); NULLs are the lowest values, as -inf."""
    row = sketch.first()
    if row is None:
        return 0, []
    rows, known = row["_rows"], row["_n"]
    half = next((w for w in KLL_WIDTHS if known * w >= BAND_RANKS + k), KLL_WIDTHS[-1])
    wanted = [((m * rows - (rows - known)) / known + side) for m in middles for side in (-half, half)]
    values = sketch.select(_quantiles([min(1.0, max(0.0, w)) for w in wanted])).first()[0]
    ends = [float("-inf") if w < 0 else v for w, v in zip(wanted, values, strict=True)]
    return rows, list(zip(ends[::2], ends[1::2], strict=True))


def ntile_sums(
    df: DataFrame,
    value: str,
    tiebreak: str,
    k: int,
    name: str = "tile",
    count_name: str = "n",
    sum_name: str = "total",
    stable_input: bool = False,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Rows and sum of ``value`` per ``ntile(k)`` tile, ordering only the rows near a tile's edge.

    Tiles go by ``value`` descending, NULLs last, ties by ``tiebreak``.

    1. A bounded sketch gives a value band around each of the k - 1 edges
       (``sketch``: the stored ``merged_sketch`` of the same rows, if there is one).
    2. One pass counts and sums the rows of each zone: a band, or what lies
       between two bands. The counts are exact, so every zone's first and
       last rank is known. (At most 2k - 1 zones come to the driver.)
    3. A zone within one tile adds its sum to that tile, whether or not its
       band was meant to hold an edge. Only zones that an edge crosses are
       ranked, with the distributed sort.
    """
    rows = df.select(F.col(tiebreak).alias("_t"), F.col(value).cast("double").alias("_v"))
    if not stable_input:
        rows = materialize(rows, "ntile-input")
    key = F.coalesce("_v", F.lit(float("-inf")))  # NULLs sort last
    middles = [1 - j / k for j in range(1, k)]
    shares = [s for m in middles for w in BAND_WIDTHS for s in (max(0.0, m - w), min(1.0, m + w))]
    if sketch is None:
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, shares or [0.5], BAND_ACCURACY).alias("q")).first()
        n = found["n"]
        width = next((i for i, w in enumerate(BAND_WIDTHS) if n * w >= BAND_RANKS + k), len(BAND_WIDTHS) - 1)
        ends = [found["q"][2 * (j * len(BAND_WIDTHS) + width):][:2] for j in range(k - 1 if n else 0)]
    else:
        n, ends = _sketched_edges(sketch, middles, k)
    bands: list[tuple[float, float]] = []  # from the largest values down, disjoint
    for low, high in ends:
        if bands and high >= bands[-1][0]:
            low, high = min(low, bands[-1][0]), bands.pop()[1]
        bands.append((low, high))
    zone = F.lit(2 * len(bands))
    for i, (low, high) in reversed(list(enumerate(bands))):
        zone = F.when(key > high, 2 * i).when(key >= low, 2 * i + 1).otherwise(zone)
    rows = rows.withColumn("_zone", zone)

    sums = rows.groupBy("_zone").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"))
    q, r = divmod(n, k)
    last_of = [j * q + min(j, r) for j in range(1, k + 1)]  # last rank of each tile
    whole, crossed, before = [], {}, 0
    for z in sorted(sums.collect(), key=lambda z: z["_zone"]):
        tile = bisect_left(last_of, before + 1)
        if before + z["n"] <= last_of[tile]:
            whole.append((tile + 1, z["n"], z["total"]))
        else:
            crossed[z["_zone"]] = before
        before += z["n"]
    parts = df.sparkSession.createDataFrame(whole, f"{name} int, _n long, _s double")
    if crossed:
        edges = rows.filter(F.col("_zone").isin(list(crossed)))
        ranked = rank_rows(edges, [F.col("_v").desc_nulls_last(), F.col("_t").asc()], by=["_zone"], name="_rn",
                           stable_input=True)
        rank = F.col("_rn")
        for z, start in crossed.items():
            rank = F.when(F.col("_zone") == z, F.col("_rn") + start).otherwise(rank)
        parts = parts.unionByName(ranked.groupBy(_tile(rank, F.lit(n), k).alias(name)).agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s")))
    return parts.groupBy(name).agg(F.sum("_n").alias(count_name), F.sum("_s").alias(sum_name))


def weighted_running_sum(
    df: DataFrame,
    order: Sequence[Column],
    weight: str,
    by: Sequence[str] = (),
    name: str = "_cum",
    stable_input: bool = False,
    unique_order: bool = False,
) -> DataFrame:
    """Running sum of ``weight`` in ``order`` within groups, without a single task.

    Same distributed sort as ``rank_rows``; each partition's starting sum
    comes from a small written table of per-partition totals, and the sum
    inside a partition is a window over that partition's rows only.
    ``unique_order`` declares that no two rows share the group and order
    values (no tie-break, no copy of the input needed).
    """
    ordered = _ordered(df, order, by, stable_input, unique_order)
    totals = ordered.groupBy("_p", *by).agg(F.sum(weight).alias("_w"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_p")
    before = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(totals.withColumn("_off", F.coalesce(before, F.lit(0))), "cumsum-offsets")
    renamed = offsets.select(F.col("_p").alias("_op"), *[F.col(b).alias(f"_ob{i}") for i, b in enumerate(by)], "_off")
    cond = F.col("_p") == F.col("_op")
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_ob{i}"))
    small = F.broadcast(renamed) if not by else renamed
    joined = ordered.join(small, cond, "inner")
    inside = Window.partitionBy("_p", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn(name, F.col("_off") + F.sum(weight).over(inside))
    return out.drop(*_HELPER, "_op", "_off", *[f"_ob{i}" for i in range(len(by))])


# Sketch accuracy of the band around a percentile (rank error about n / accuracy).
BAND_ACCURACY = 100_000
# Half-widths of a band as shares of a group; a group takes the narrowest that spans BAND_RANKS ranks.
BAND_WIDTHS = (3 / BAND_ACCURACY, 1e-3, 3e-2, 1.0)
BAND_RANKS = 3


def _group_cond(by: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


# Items per level of a stored quantile sketch, and the half-widths of a band taken from one. The narrowest is a
# little over twice the rank error that 99 % of sketches of this size keep (2.3 / k ** 0.9).
KLL_ITEMS = 1024
KLL_WIDTHS = (0.01, 0.05, 0.3, 1.0)


def quantile_sketches(df: DataFrame, keys: Mapping[str, Column], values: Sequence[str]) -> DataFrame:
    """One row per combination of ``keys``: row count ``_n``, and per value its non-NULL count and a mergeable sketch.

    One pass over ``df`` serves every quantile of ``values`` over any grouping or
    selection by ``keys`` (``merged_sketch``). A sketch holds a bounded number of items.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for v in values:
        aggs += [F.count(v).alias(f"_n_{v}"), F.expr(f"kll_sketch_agg_double(cast(`{v}` as double), {KLL_ITEMS})").alias(f"_kll_{v}")]
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*aggs)


def merged_sketch(sketches: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, _n, _sketch): one merged sketch per group that has values; ``rows`` counts the others too."""
    known = F.expr(f"kll_merge_agg_double(_kll_{value}) FILTER (WHERE _n_{value} > 0)")
    merged = sketches.groupBy(*by).agg(F.sum("_n").alias("_rows"), F.sum(f"_n_{value}").alias("_n"), known.alias("_sketch"))
    return merged.filter("_n > 0")


def _quantiles(shares: Sequence[float]) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double(_sketch, array({', '.join(f'{s!r}D' for s in shares)}))")


def _sketched_bands(sketch: DataFrame, p: float, by: Sequence[str]) -> DataFrame:
    """(by, _n, _blo, _bhi): per group a value band around ``p``, at least BAND_RANKS ranks each way."""
    shares = [max(0.0, p - w) for w in KLL_WIDTHS] + [min(1.0, p + w) for w in KLL_WIDTHS]
    width = F.lit(len(KLL_WIDTHS) - 1)
    for i in reversed(range(len(KLL_WIDTHS) - 1)):
        width = F.when(F.col("_n") * KLL_WIDTHS[i] >= BAND_RANKS, i).otherwise(width)
    ends = sketch.withColumn("_q", _quantiles(shares))
    return ends.select(*by, "_n", F.get("_q", width).alias("_blo"), F.get("_q", width + len(KLL_WIDTHS)).alias("_bhi"))


def _percentile_by_band(vals: DataFrame, p: float, by: Sequence[str], name: str, sketch: DataFrame | None = None) -> DataFrame:
    """Exact percentile from a verified band around the target ranks; only groups whose band misses are sorted.

    1. One pass: per group, the row count and two approximate quantiles
       around ``p`` (a bounded sketch per group) give a value band. A stored
       ``sketch`` of the same rows (``merged_sketch``) saves this pass.
    2. One pass: rows below the band and inside it are counted, which
       checks exactly that the target ranks fall inside the band.
    3. One pass: the band's rows, with equal values combined (so a value
       shared by many rows is one row with a weight), get a running weight
       sum; the target ranks are read off it.
    No step sorts or gathers all values of a group.
    """
    shares = [max(0.0, p - w) for w in BAND_WIDTHS] + [min(1.0, p + w) for w in BAND_WIDTHS]
    v = F.col("_v")
    pos = F.lit(1.0) + F.lit(float(p)) * (F.col("_n") - 1)
    width = F.lit(len(BAND_WIDTHS) - 1)
    for i in reversed(range(len(BAND_WIDTHS) - 1)):
        width = F.when(F.col("_n") * BAND_WIDTHS[i] >= BAND_RANKS, i).otherwise(width)
    if sketch is None:
        bands = vals.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx(v, shares, BAND_ACCURACY).alias("_q"),
        ).withColumns({"_blo": F.get("_q", width), "_bhi": F.get("_q", width + len(BAND_WIDTHS))})
    else:
        bands = _sketched_bands(sketch, p, by)
    bands = materialize(bands.select(
        *[F.col(b).alias(f"_gb{i}") for i, b in enumerate(by)], "_n", "_blo", "_bhi",
        pos.alias("_pos"), F.floor(pos).alias("_r1"), F.ceil(pos).alias("_r2"),
    ), "percentile-bands")
    tagged = vals.join(bands, _group_cond(by, "_gb"), "inner")
    in_band = (v >= F.col("_blo")) & (v <= F.col("_bhi"))
    gkeys = [f"_gb{i}" for i in range(len(by))]
    counts = tagged.groupBy(*gkeys, "_r1", "_r2", "_pos").agg(
        F.count(F.when(v < F.col("_blo"), F.lit(1))).alias("_below"),
        F.count(F.when(in_band, F.lit(1))).alias("_inband"),
    )
    checks = materialize(counts.select(
        *gkeys, "_pos", "_r1",
        (F.col("_r1") - F.col("_below")).alias("_k1"), (F.col("_r2") - F.col("_below")).alias("_k2"),
        ((F.col("_below") < F.col("_r1")) & (F.col("_below") + F.col("_inband") >= F.col("_r2"))).alias("_ok"),
    ), "percentile-checks")
    missed = checks.filter(~F.col("_ok")).select(*[F.col(g).alias(f"_cb{i}") for i, g in enumerate(gkeys)])
    again = missed.count()  # rows of ``checks``: one per group
    checks = checks.filter("_ok")
    weighted = tagged.filter(in_band).groupBy(*gkeys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    cum = weighted_running_sum(weighted, [F.col("_v").asc()], "_w", by=gkeys, name="_cum", unique_order=True)
    renamed = checks.select(*[F.col(g).alias(f"_cb{i}") for i, g in enumerate(gkeys)], "_pos", "_r1", "_k1", "_k2")
    picked = cum.join(renamed, _group_cond(gkeys, "_cb"), "inner")
    start = F.col("_cum") - F.col("_w")
    agg = picked.groupBy(*gkeys).agg(
        F.max(F.when((start < F.col("_k1")) & (F.col("_k1") <= F.col("_cum")), v)).alias("_vlo"),
        F.max(F.when((start < F.col("_k2")) & (F.col("_k2") <= F.col("_cum")), v)).alias("_vhi"),
        F.max("_pos").alias("_pos"),
        F.max("_r1").alias("_r1"),
    )
    result = F.col("_vlo") + (F.col("_pos") - F.col("_r1")) * (F.col("_vhi") - F.col("_vlo"))
    out = agg.select(*[F.col(f"_gb{i}").alias(b) for i, b in enumerate(by)], result.alias(name))
    if again:
        cond = F.lit(True)
        for i, b in enumerate(by):
            cond = cond & F.col(b).eqNullSafe(F.col(f"_cb{i}"))
        rest = vals.join(missed, cond, "left_semi")
        out = out.unionByName(percentile_by_sort(rest, "_v", p, by, name))
    return out


def percentile_exact(
    df: DataFrame,
    value: str,
    p: float,
    by: Sequence[str] = (),
    name: str = "percentile",
    stable_input: bool = False,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Exact ``percentile_cont(p) within group (order by value)`` per group.

    Non-NULL values only; position ``1 + p*(n-1)`` with linear
    interpolation between its floor and ceiling rows. Returns one row per
    group (``by`` columns + ``name``); no row when a group has no values.
    Unlike an aggregate that gathers a group's distinct values in one task,
    this reads the values in three passes and only ranks a narrow verified
    band around the target (``_percentile_by_band``); the groups whose band
    misses, and only those, are ranked with the distributed sort
    (``percentile_by_sort``). ``sketch``: the ``merged_sketch`` of the same rows and
    groups, if there is one; its error only decides how wide the band is. Either way a group's size is not bounded by one
    task's memory.
    """
    vals = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    src = vals if stable_input else materialize(vals, "percentile-input")
    # without groups, one constant group key: every lookup stays an equi-join
    keys = list(by) if by else ["_g0"]
    if sketch is not None and not by:
        sketch = sketch.withColumn("_g0", F.lit(0))
    banded = _percentile_by_band(src if by else src.withColumn("_g0", F.lit(0)), p, keys, name, sketch)
    return banded if by else banded.drop("_g0")


def percentile_by_sort(
    df: DataFrame,
    value: str,
    p: float,
    by: Sequence[str] = (),
    name: str = "percentile",
    stable_input: bool = False,
) -> DataFrame:
    """Exact percentile by ranking every value with the distributed sort."""
    vals = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ranked, offsets = _rank(vals, [F.col("_v").asc()], by, "_rn", stable_input)
    picked = _with_sizes(ranked, offsets, by)
    pos = F.lit(1.0) + F.lit(float(p)) * (F.col("_size") - 1)
    picked = picked.withColumn("_pos", pos).withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos))
    picked = picked.filter((F.col("_rn") == F.col("_lo")) | (F.col("_rn") == F.col("_hi")))
    agg = picked.groupBy(*by).agg(
        F.max(F.when(F.col("_rn") == F.col("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_rn") == F.col("_hi"), F.col("_v"))).alias("_vhi"),
        F.max("_pos").alias("_pos"),
        F.max("_lo").alias("_lo"),
    )
    frac = F.col("_pos") - F.col("_lo")
    result = F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))
    # a global aggregate over no rows still yields one row: drop it
    return agg.filter(F.col("_pos").isNotNull()).select(*by, result.alias(name))
