"""Summarise a Spark event log (JSON lines): per job, its stages with
wall time, task count, summed task time and shuffle bytes.  Use with
``BENCH_EVENTLOG_DIR=<scratch dir> python bench.py``.

usage: python tools/stage_times.py <event log file or folder> [top_n]
"""

from __future__ import annotations

import io
import json
import os
import sys


def event_lines(path: str):
    """Lines of an event log: a plain file, or a rolling log folder
    (events_<n>_<app> parts, zstd-compressed or not)."""
    parts = [path]
    if os.path.isdir(path):
        parts = sorted((os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda f: int(os.path.basename(f).split("_")[1]))
    for part in parts:
        if part.endswith(".zstd"):
            import zstandard
            with open(part, "rb") as fh:
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
                yield from reader
        else:
            with open(part, encoding="utf-8") as fh:
                yield from fh


def main() -> None:
    path = sys.argv[1]
    top_n = int(sys.argv[2]) if len(sys.argv) > 2 else 25
    stages = {}
    tasks = {}
    label = {}  # stage id -> job description (bench query name)
    for line in event_lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description") or ""
            for sid in ev.get("Stage IDs", []):
                label.setdefault(sid, desc)
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            sid = (info["Stage ID"], info["Stage Attempt ID"])
            stages[sid] = {
                "name": info["Stage Name"].split(" at ")[0][:30],
                "tasks": info["Number of Tasks"],
                "wall_s": (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000,
            }
        elif kind == "SparkListenerTaskEnd":
            sid = (ev["Stage ID"], ev["Stage Attempt ID"])
            m = ev.get("Task Metrics") or {}
            acc = tasks.setdefault(sid, {"run_s": 0.0, "shuffle_w": 0, "shuffle_r": 0})
            acc["run_s"] += m.get("Executor Run Time", 0) / 1000
            acc["shuffle_w"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            r = m.get("Shuffle Read Metrics") or {}
            acc["shuffle_r"] += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
    rows = []
    per_query = {}
    for sid, st in stages.items():
        t = tasks.get(sid, {"run_s": 0.0, "shuffle_w": 0, "shuffle_r": 0})
        q = label.get(sid[0], "") or "-"
        rows.append((st["wall_s"], sid[0], q, st["tasks"], t["run_s"], t["shuffle_w"], t["shuffle_r"]))
        agg = per_query.setdefault(q, [0, 0.0, 0.0, 0])
        agg[0] += 1
        agg[1] += t["run_s"]
        agg[2] += (t["shuffle_w"] + t["shuffle_r"]) / 1e6
        agg[3] += st["tasks"]
    print(f"{'query':24s} {'stages':>6} {'tasks':>6} {'task s':>8} {'shuffle MB':>11}")
    for q, (n, run, shuf, ntask) in sorted(per_query.items(), key=lambda kv: -kv[1][1]):
        print(f"{q:24s} {n:6d} {ntask:6d} {run:8.2f} {shuf:11.2f}")
    rows.sort(reverse=True)
    print()
    print(f"{'wall s':>7} {'stage':>6} {'tasks':>6} {'task s':>8} {'shuf W MB':>10} {'shuf R MB':>10}  query")
    for wall, sid, name, ntask, run, sw, sr in rows[:top_n]:
        print(f"{wall:7.2f} {sid:6d} {ntask:6d} {run:8.2f} {sw / 1e6:10.2f} {sr / 1e6:10.2f}  {name}")
    print(f"stages: {len(rows)}, total wall {sum(r[0] for r in rows):.1f} s, "
          f"total task {sum(r[4] for r in rows):.1f} s")


if __name__ == "__main__":
    main()
