"""Summarize a Spark event log written by ``BENCH_EVENT_LOG=<dir> python
bench.py``: per bench query (job group) the number of jobs and stages,
wall time of its jobs, and its slowest stages with task counts.

Usage: python tools/eventlog_summary.py <event-log-dir> [top_stages]
"""

from __future__ import annotations

import glob
import io
import json
import sys
from collections import defaultdict


def events(path: str):
    for f in sorted(glob.glob(f"{path}/**/events*", recursive=True) + glob.glob(f"{path}/*.inprogress")):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            if line.strip():
                yield json.loads(line)


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 2
    group, jobs, stage_of_job, stages = {}, {}, {}, {}
    for e in events(path):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            group[e["Job ID"]] = (e.get("Properties") or {}).get("spark.jobGroup.id")
            jobs[e["Job ID"]] = [e["Submission Time"], None]
            for s in e["Stage IDs"]:
                stage_of_job[s] = e["Job ID"]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            if "Submission Time" in i and "Completion Time" in i:
                stages[i["Stage ID"]] = (i["Completion Time"] - i["Submission Time"], i["Number of Tasks"])
    per = defaultdict(lambda: {"jobs": 0, "ms": 0, "stages": []})
    for j, (s, c) in jobs.items():
        g = group.get(j) or "(none)"
        per[g]["jobs"] += 1
        per[g]["ms"] += (c - s) if c else 0
    for sid, (ms, tasks) in stages.items():
        g = group.get(stage_of_job.get(sid)) or "(none)"
        per[g]["stages"].append((ms, tasks, sid))
    print(f"{'query':30s} {'jobs':>5s} {'stages':>6s} {'job ms':>8s}  slowest stages (ms/tasks)")
    for g, d in sorted(per.items(), key=lambda x: -x[1]["ms"]):
        slow = sorted(d["stages"], reverse=True)[:top]
        print(f"{g:30s} {d['jobs']:5d} {len(d['stages']):6d} {d['ms']:8d}  "
              + ", ".join(f"{ms}/{t}" for ms, t, _ in slow))


if __name__ == "__main__":
    main()
