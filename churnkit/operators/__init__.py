"""Table operators: deduplication, quality checks, skew-aware joins,
distributed ordering, segment analyses and the reporting model."""

from churnkit.operators.dedupe import dedupe_first
from churnkit.operators.joins import HotKeys, hot_keys, skew_join
from churnkit.operators.ordering import ntile, percentile_exact, rank_rows
from churnkit.operators.quality import (
    before_anchor,
    count_where,
    distinct_count,
    duplicate_keys,
    null_profile,
    orphans,
    pair_check,
    quality_log,
    range_check,
    row_count,
    row_counts,
    value_counts,
)
from churnkit.operators.segments import (
    counts_by,
    ntile_share,
    outlier_sensitivity,
    period_change,
    rate_by,
    share_of_total,
    skew_gap,
    summary_by,
    top_n,
    with_share,
)

__all__ = [
    "before_anchor", "count_where", "counts_by", "dedupe_first", "distinct_count", "duplicate_keys", "HotKeys", "hot_keys",
    "ntile", "ntile_share", "null_profile", "orphans", "outlier_sensitivity", "pair_check", "percentile_exact",
    "period_change", "range_check",
    "quality_log", "rank_rows", "rate_by", "row_count", "row_counts", "share_of_total", "skew_gap", "skew_join",
    "summary_by", "top_n", "value_counts", "with_share",
]
