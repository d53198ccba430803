"""Key joins that stay balanced when one key holds a large share of the rows.

A shuffle join sends every row of a key to one task, so a key holding a
third of a table makes one task do a third of the join. ``skew_join``
salts such hot keys:

* Hot keys come from a frequent-items sketch (Spark's ``approx_top_k``, merged
  across tasks). A stored layer takes the sketch while it is written
  (``observed_keys``), so finding its hot keys reads nothing again; for any
  other frame one pass over the key column takes it (``hot_keys``).
* They are a small table, at most ``HOT_PER_PARTITION`` per shuffle partition,
  of each key and the number of parts its rows are dealt into, about
  one average partition each. It is broadcast to both sides: a row of a hot key on the
  large side gets one of the key's parts, the other side's rows of that key (one per
  customer in every use here) are repeated once per part.
* One join on key and part follows. Each side is read once; without hot keys it
  is the plain join.

A row meets the other side's rows of its key in its own part, all of them,
once: the result is exactly the plain join, whichever keys the sketch names
and whatever its error; the sketch only decides speed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than 1 / HOT_PER_PARTITION of an average shuffle
# partition's share, so there are at most HOT_PER_PARTITION hot keys per partition.
HOT_PER_PARTITION = 4
# A key with fewer rows than this makes no task slow.
HOT_MIN_ROWS = 10_000


@dataclass(frozen=True)
class HotKeys:
    """Hot keys of one column: (key value, number of parts), at most HOT_PER_PARTITION per shuffle partition."""

    rows: tuple[tuple, ...] = ()

    def table(self, like: DataFrame, key: str) -> DataFrame:
        """The keys as a small table: ``key`` (typed as in ``like``) and ``_parts``."""
        return like.sparkSession.createDataFrame(list(self.rows), f"`{key}` {like.schema[key].dataType.simpleString()}, _parts int")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_metrics(spark: SparkSession, key: str) -> dict[str, Column]:
    """Aggregates that find the hot values of ``key``, for ``DataFrame.observe`` or ``agg``; bounded in memory."""
    most = min(HOT_PER_PARTITION * _partitions(spark), 50_000)
    tracked = min(max(1024, 16 * most), 1_000_000)  # the most that approx_top_k takes
    return {f"rows_with_{key}": F.count(key), f"hot_{key}": F.expr(f"approx_top_k(`{key}`, {most}, {tracked})")}


def observed_keys(spark: SparkSession, metrics: dict, key: str, min_rows: int | None = None) -> HotKeys:
    """The hot keys that ``key_metrics`` found.

    The threshold is relative to the rows and to the shuffle partitions, with
    the floor ``HOT_MIN_ROWS``. The sketch counts too high if at all, by less than a threshold.
    """
    share = metrics[f"rows_with_{key}"] / _partitions(spark)
    least = max(HOT_MIN_ROWS if min_rows is None else min_rows, share / HOT_PER_PARTITION)
    found = [(i["item"], i["count"]) for i in metrics[f"hot_{key}"] or [] if i["item"] is not None and i["count"] >= least]
    return HotKeys(tuple((item, max(2, int(n / max(share, 1)) + 1)) for item, n in found))


def hot_keys(df: DataFrame, key: str, min_rows: int | None = None) -> HotKeys:
    """The hot keys of a frame that was not observed: one pass over its key column, no shuffle of its rows."""
    spark = df.sparkSession
    metrics = df.select(key).agg(*[c.alias(n) for n, c in key_metrics(spark, key).items()]).first()
    return observed_keys(spark, metrics.asDict(), key, min_rows)


def skew_join(big: DataFrame, other: DataFrame, key: str, how: str = "inner", hot: HotKeys | None = None) -> DataFrame:
    """``big.join(other, key, how)`` with the hot keys of ``big`` dealt into parts.

    ``how`` is one of inner, left, left_semi, left_anti (joins that keep
    ``big``'s rows on the left). ``hot``: what a stored layer observed;
    otherwise ``hot_keys(big, key)`` looks for them.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type for skew_join: {how}")
    hot = hot_keys(big, key) if hot is None else hot
    if not hot.rows:
        return big.join(other, key, how)
    # The table's size has a bound fixed by the shuffle partitions (see HotKeys).
    table = F.broadcast(hot.table(big, key))
    parts = F.coalesce("_parts", F.lit(1))
    # On a scan of files the row number is the same on every evaluation; it only chooses the part.
    dealt = big.join(table, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts")
    repeated = other.join(table, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")
