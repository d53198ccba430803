"""Run the pipeline from the command line.

    python -m churnkit --customers PATH --products PATH --activity PATH \\
        --out ROOT [--reference-date 2024-12-31] [--inception-date 2015-01-01] \\
        [--buckets N] [--fold-text] [--show eda_02_rate_by_province ...]

Loads the three CSV exports, builds every layer, publishes the finished tables
under ``--out`` as one version (``sinks.read_published`` reads the current one) and writes the quality log and every
analysis result, sorted for reading, under ``--out/reports/<query>``. ``--show`` prints the named
results as well. Intermediate tables go to the session's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from churnkit.config import BANK
from churnkit.plans.queries import QUERIES, listing
from churnkit.plans.warehouse import Warehouse
from churnkit.sources.sinks import write_table

REPORT_PREFIXES = ("dq_", "v_", "eda_")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="churnkit", description=__doc__.split("\n")[0])
    ap.add_argument("--customers", required=True)
    ap.add_argument("--products", required=True)
    ap.add_argument("--activity", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--reference-date", default=BANK.reference_date)
    ap.add_argument("--inception-date", default=BANK.inception_date)
    ap.add_argument("--buckets", type=int, default=None)
    ap.add_argument("--fold-text", action="store_true", help="compare text without regard to case and trailing spaces")
    ap.add_argument("--show", nargs="*", default=[])
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("churnkit").getOrCreate()
    cfg = BANK.with_dates(args.reference_date, args.inception_date)
    if args.fold_text:
        cfg = cfg.with_folded_text()
    wh = Warehouse.from_csv(spark, {"customers": args.customers, "products": args.products,
                                    "activity": args.activity}, cfg, args.buckets)
    out = args.out.rstrip("/")
    for name, path in wh.publish(out).items():
        print(f"wrote {name} -> {path}")
    for name in QUERIES:
        if name.startswith(REPORT_PREFIXES) and name not in ("eda_00_base",):
            write_table(listing(wh, name), f"{out}/reports/{name}")
    for name in args.show:
        print(f"== {name}")
        listing(wh, name).show(50, truncate=False)
    wh.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
