"""Per-stage task sizes from a Spark event log (no UI needed).

usage: python scripts/task_sizes.py <event log folder or file>

Prints, per stage with shuffle input: the job description, task count, non-empty tasks, the
largest and total shuffle records read — the numbers that show whether one task carries a hot
key. Run a job with spark.eventLog.enabled=true and spark.eventLog.dir=<scratch folder>.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        yield from raw.decode().splitlines()


def main():
    path = sys.argv[1]
    if os.path.isdir(path) and not glob.glob(os.path.join(path, "events_*")):
        path = sorted(glob.glob(os.path.join(path, "eventlog_v2_*")))[-1]
    tasks = collections.defaultdict(list)
    job_of_stage = {}
    for line in _lines(path):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            desc = (e.get("Properties") or {}).get("spark.job.description", "")
            for sid in e.get("Stage IDs", []):
                job_of_stage[sid] = desc
        elif e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            tasks[e["Stage ID"]].append((m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
    for sid, recs in sorted(tasks.items()):
        if max(recs) > 0:
            print(f"{job_of_stage.get(sid, '')!s:12} stage {sid:4d} tasks {len(recs):4d} "
                  f"non-empty {sum(1 for r in recs if r):4d} max {max(recs):10d} total {sum(recs):12d}")


if __name__ == "__main__":
    main()
