"""Stage times of registered queries from Spark's event log.

Usage: python scripts/stage_times.py [sf_dir] QUERY [QUERY ...]

Runs each query once to warm up and once timed (into the ``noop`` sink) with
the event log written to a fresh scratch folder, then prints, per query, every
stage of the timed run: its task count, wall time and whether it scans or
reads a shuffle.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(folder: str):
    import zstandard

    for f in sorted(glob.glob(f"{folder}/*/events*") + glob.glob(f"{folder}/events*")):
        with open(f, "rb") as fh:
            stream = zstandard.ZstdDecompressor().stream_reader(fh) if f.endswith(".zstd") else fh
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                yield json.loads(line)


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.1"
    names = args or ["net_changes"]
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")

    from pyspark.sql import SparkSession

    from changeflow.plans.registry import QUERIES

    spark = (SparkSession.builder.master("local[8]").appName("stage-times")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", folder).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    walls = {}
    for name in names:
        spark.sparkContext.setJobGroup("warmup", "warmup")
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        walls[name] = time.perf_counter() - t0
    spark.stop()

    group, stages = {}, {}
    for e in _events(folder):
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e["Stage IDs"]:
                group[sid] = g
        elif e["Event"] == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            if "Completion Time" in info and "Submission Time" in info:
                rdds = " ".join(r["Name"] for r in info.get("RDD Info", []))
                kind = "scan" if "FileScan" in rdds else ("shuffle read" if "Shuffled" in rdds else "")
                stages[info["Stage ID"]] = (info["Number of Tasks"],
                                            info["Completion Time"] - info["Submission Time"], kind)
    print(f"event log: {folder}")
    for name in names:
        rows = sorted((sid, *v) for sid, v in stages.items() if group.get(sid) == name)
        print(f"== {name}: wall {walls[name]:.2f} s, {len(rows)} stages, "
              f"sum of stage time {sum(r[2] for r in rows)} ms")
        for sid, tasks, ms, kind in rows:
            print(f"   stage {sid:4d}  tasks {tasks:4d}  {ms:6d} ms  {kind}")


if __name__ == "__main__":
    main()
