"""Command line: run registered queries on a folder of tables.

    python -m changeflow list
    python -m changeflow run QUERY --tables DIR [--out PATH] [--local N]
    python -m changeflow explain QUERY --tables DIR [--local N]

``run`` writes the result as Parquet to ``--out`` (shared storage on a cluster)
or, without ``--out``, prints the row count. Under spark-submit the session
takes the cluster settings; ``--local N`` runs on ``local[N]`` instead.
"""

from __future__ import annotations

import argparse
import sys
import time


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="changeflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--tables", required=True, help="folder holding <table>.parquet")
        p.add_argument("--local", type=int, default=0, help="run on local[N] instead of the cluster")
        if name == "run":
            p.add_argument("--out", help="write the result here as Parquet")
    args = ap.parse_args(argv)

    from changeflow.plans.registry import QUERIES

    if args.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m changeflow list`", file=sys.stderr)
        return 2
    from changeflow.session import build_session, cluster_session

    spark = build_session(f"local[{args.local}]", args.local) if args.local else cluster_session()
    df = QUERIES[args.query](spark, args.tables)
    if args.cmd == "explain":
        df.explain("formatted")
        return 0
    t0 = time.perf_counter()
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(f"{args.query}: written to {args.out} in {time.perf_counter() - t0:.2f}s")
    else:
        print(f"{args.query}: {df.count()} rows in {time.perf_counter() - t0:.2f}s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
