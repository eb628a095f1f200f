"""Per-stage profile of registered queries from Spark's event log.

    python tools/stages.py <sf_dir> <query> [<query> ...]

Runs each query through the ``noop`` sink in a session whose event log goes
to a fresh scratch folder, then prints per-stage wall time, task count and
shuffle bytes read / written, slowest first.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession

    from kartlens.plans import registry
    from kartlens.session import DEFAULTS, ensure_checkpoint_dir

    sf_dir, names = argv[0], [a for a in argv[1:] if not a.startswith("--")]
    if names == ["all"]:
        from kartlens.plans import registry as _r

        names = list(_r.QUERIES)
    log_dir = tempfile.mkdtemp(prefix="run-")
    builder = SparkSession.builder.master("local[8]").appName("kartlens-stages")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": "16", "spark.driver.memory": "8g",
                 "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                 "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    tables = registry.tables_for(spark, sf_dir)
    marks = []
    for i, name in enumerate(names):
        group = f"{i}:{name}"  # one job group per run, even for a repeated query
        spark.sparkContext.setJobGroup(group, name)
        t0 = time.time()
        registry.QUERIES[name](tables).write.format("noop").mode("overwrite").save()
        marks.append((group, round(time.time() - t0, 2)))
    spark.stop()

    files = sorted(f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f))
    stages, job_group = {}, {}
    for line in (ln for f in files for ln in open(f, encoding="utf-8")):
        if line.strip():
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    job_group[sid] = group
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                if "Completion Time" not in info or "Submission Time" not in info:
                    continue
                acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
                stages[info["Stage ID"]] = {
                    "name": info["Stage Name"][:60],
                    "ms": info["Completion Time"] - info["Submission Time"],
                    "tasks": info["Number of Tasks"],
                    "shuffle_read": acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0)
                    + acc.get("internal.metrics.shuffle.read.localBytesRead", 0),
                    "shuffle_write": acc.get("internal.metrics.shuffle.write.bytesWritten", 0),
                }
    for name, secs in marks:
        own = {sid: s for sid, s in stages.items() if job_group.get(sid) == name}
        writes = [s["shuffle_write"] for s in own.values() if s["shuffle_write"]]
        dup = sorted({w for w in writes if writes.count(w) > 1})
        print(f"== {name}: {secs}s, {len(own)} stages, stage wall sum {sum(s['ms'] for s in own.values())} ms"
              + (f"  POSSIBLE DUPLICATE SHUFFLES (bytes): {dup}" if dup else ""))
        if "--brief" in sys.argv:
            continue
        for sid, s in sorted(own.items(), key=lambda kv: -kv[1]["ms"])[:12]:
            print(f"  stage {sid:4d} {s['ms']:6d} ms tasks {s['tasks']:4d} "
                  f"shuffle r/w {s['shuffle_read']:>10}/{s['shuffle_write']:>10}  {s['name']}")


if __name__ == "__main__":
    main(sys.argv[1:])
