"""Command line: the daily cube build and the streaming refresher.

    python -m cohortflow build   --warehouse DIR --out DIR [--as-of YYYY-MM-DD]
    python -m cohortflow refresh --warehouse DIR --out DIR [--as-of YYYY-MM-DD]

``--warehouse`` holds the canonical tables (players, events partitioned by
date, source_names, countries, exclusions); the cubes are published under
``--out`` partitioned by install_date.  ``--demo SF_DIR`` runs the same build
over the driver's synthetic tables instead.
"""

from __future__ import annotations

import argparse
import json
from datetime import date


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cohortflow")
    ap.add_argument("command", choices=["build", "refresh"])
    ap.add_argument("--warehouse")
    ap.add_argument("--demo", help="driver test-data directory (demo funnel)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--as-of", type=date.fromisoformat, default=None)
    ap.add_argument("--master", default=None)
    ap.add_argument("--checkpoint", help="folder of the refresher's progress (default: under --out)")
    a = ap.parse_args(argv)

    from cohortflow.config import EngineConfig
    from cohortflow.plans.steps import demo_funnel, funnel_72h, main_funnel
    from cohortflow.session import get_session
    from cohortflow.sources import TableSource, TestdataSource
    from cohortflow.streaming import rebuild, refresh_stream

    spark = get_session(a.master)
    if a.demo:
        cfg = EngineConfig.for_testdata()
        make_source = lambda: TestdataSource(spark, a.demo)
        spec, spec72 = demo_funnel(), None
    else:
        if not a.warehouse:
            ap.error("--warehouse or --demo is required")
        cfg = EngineConfig(as_of=a.as_of or date.today())
        make_source = lambda: TableSource(spark, a.warehouse)
        spec, spec72 = main_funnel(), funnel_72h()
    if a.as_of:
        cfg = cfg.with_(as_of=a.as_of)

    if a.command == "build":
        print(json.dumps(rebuild(make_source(), cfg, spec, a.out, spec_72h=spec72)))
        return
    if not a.warehouse:
        ap.error("refresh needs --warehouse (events partitioned by date)")
    events_dir = f"{a.warehouse.rstrip('/')}/events"
    schema = spark.read.parquet(events_dir).schema
    q = refresh_stream(spark, events_dir, schema, make_source, cfg, spec, a.out,
                       a.checkpoint or f"{a.out.rstrip('/')}/_refresh_progress", spec_72h=spec72)
    q.awaitTermination()


if __name__ == "__main__":
    main()
