"""Summarise a Spark event log by job group: jobs, stages, tasks, busy time.

Usage: python tools/eventlog_summary.py <event log dir or file>

Pair with ``BENCH_EVENT_LOG_DIR=<dir> python bench.py``, which tags every
query's jobs with a job group named after the query.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main() -> None:
    target = sys.argv[1]
    files = [target] if os.path.isfile(target) else sorted(
        f for f in glob.glob(os.path.join(target, "**", "*"), recursive=True)
        if os.path.isfile(f) and os.path.basename(f).startswith(("events", "local-", "app-")))
    jobs: dict[int, dict] = {}
    stages: dict[int, tuple[int, int]] = {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id") or "(none)"
                jobs[e["Job ID"]] = {"group": group, "start": e["Submission Time"], "stages": e["Stage IDs"]}
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]]["end"] = e["Completion Time"]
            elif ev == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                stages[info["Stage ID"]] = (info["Number of Tasks"],
                                            info.get("Completion Time", 0) - info.get("Submission Time", 0))
    per = collections.defaultdict(lambda: [0, 0, 0, 0])
    for j in jobs.values():
        p = per[j["group"]]
        p[0] += 1
        p[1] += j.get("end", j["start"]) - j["start"]
        for s in j["stages"]:
            if s in stages:
                p[2] += 1
                p[3] += stages[s][0]
    print(f"{'group':40s} {'jobs':>5s} {'stages':>6s} {'tasks':>6s} {'busy_ms':>8s}")
    for group, (n_jobs, busy, n_stages, n_tasks) in sorted(per.items(), key=lambda x: -x[1][1]):
        print(f"{group:40s} {n_jobs:5d} {n_stages:6d} {n_tasks:6d} {busy:8d}")
    print(f"{'total':40s} {sum(p[0] for p in per.values()):5d} {'':6s} {'':6s} {sum(p[1] for p in per.values()):8d}")


if __name__ == "__main__":
    main()
