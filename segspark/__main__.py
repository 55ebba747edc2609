"""python -m segspark {compact,retire,export,check,cycle} --root FOLDER ...; settings also from SEGSPARK_* variables."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from segspark.lifecycle import MaintenanceLoop, run_cycle
from segspark.operators.maintenance import check_consistency, export, retire_expired, run_compaction_cycle
from segspark.store import SegmentStore


def parser() -> argparse.ArgumentParser:
    env = os.environ.get
    p = argparse.ArgumentParser(prog="segspark")
    p.add_argument("command", choices=("compact", "retire", "export", "check", "cycle"))
    p.add_argument("--root", default=env("SEGSPARK_ROOT"), help="the store's folder")
    p.add_argument("--max-segments", type=int, default=int(env("SEGSPARK_MAX_SEGMENTS", "64")))
    p.add_argument("--min-dirty", type=int, default=int(env("SEGSPARK_MIN_DIRTY", "1")))
    p.add_argument("--limit", type=int, default=int(env("SEGSPARK_LIMIT", "100")))
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--loop", type=float, default=None, help="seconds between cycles; once if not given")
    p.add_argument("--target", default=env("SEGSPARK_TARGET"), help="the export's folder")
    p.add_argument("--format", default=env("SEGSPARK_FORMAT", "ndjson"), choices=("ndjson", "parquet", "roaring"))
    p.add_argument("--namespace", default=env("SEGSPARK_NAMESPACE"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if not a.root or (a.command == "export" and not a.target):
        print("a folder is missing", file=sys.stderr)
        return 2
    store = SegmentStore(spark or SparkSession.builder.appName("segspark").getOrCreate(), a.root)

    def once() -> tuple[dict, bool]:
        if a.command == "compact":
            outs = run_compaction_cycle(store, a.max_segments, a.min_dirty)
            skipped: dict[str, int] = {}
            for o in outs:
                if not o.compacted:
                    skipped[o.reason or ""] = skipped.get(o.reason or "", 0) + 1
            return {"compacted": sum(o.compacted for o in outs), "skipped": skipped}, not any(r.startswith("error") for r in skipped)
        if a.command == "retire":
            r = retire_expired(store, a.limit, a.dry_run)
            rows = [x.asDict() for x in r["ledger"].collect()]
            return {"eligible": r["eligible"], "limited": r["limited"], "ledger": rows}, not any(x["action"] == "failed" for x in rows)
        if a.command == "cycle":
            r = run_cycle(store, a.max_segments, a.min_dirty)
            return {k: len(v) if isinstance(v, list) else {x: v[x] for x in v if x != "ledger"} if isinstance(v, dict) else v for k, v in r.items()}, True
        if a.command == "export":
            m = export(store, a.target, a.format, a.namespace)
            return m, not m["failed"]
        c = check_consistency(store)
        return c, not c["inconsistent"] and not c["errored"]

    if a.loop:
        loop = MaintenanceLoop(lambda: print(json.dumps(once()[0], default=str), flush=True), a.loop)
        loop.start()
        try:
            loop._thread.join()
        except KeyboardInterrupt:
            loop.stop()
        return 0
    out, ok = once()
    print(json.dumps(out, default=str))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
