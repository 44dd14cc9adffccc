"""Daily build and refresh of the funnel and retention cubes.

``rebuild`` makes all cubes from the log in one shared pass
(``operators/shared.py``) and replaces the published tables.

``Refresher`` keeps daily partials of the log beside the cubes
(``streaming/partials.py``).  When events of some dates land, late ones
included, it gathers those dates' events anew, finds the users whose partials
differ from those the published cubes were made of, and replaces the cells of
these users' install dates, computed from the partials: of the log it reads the
changed dates alone.  When the clock has moved on, the bands of all cubes have,
and all install dates are computed, again from the partials.  Every published
table notes the clock and the versions of the partials that it reflects, so a
refresh that stops anywhere is made up for by the next one.

``refresh_stream`` drives it from the event folder with Structured Streaming:
each micro-batch of newly landed files yields its event dates.  Run it with
``trigger(availableNow=True)`` from a scheduler, or with a processing-time
trigger as a long-running refresher.  Its progress lives in the stream's
checkpoint, so a restarted job resumes after the last committed batch; a batch
that runs again gives the same tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.config import EngineConfig
from cohortflow.operators import funnel as fu
from cohortflow.operators import rollup as ro
from cohortflow.operators import shared as sh
from cohortflow.plans.steps import FunnelSpec
from cohortflow.sources import cube_store
from cohortflow.sources.snapshots import SnapshotTable
from cohortflow.streaming import partials as pa


def funnel_runs(cfg: EngineConfig, spec: FunnelSpec, spec_72h: FunnelSpec | None = None) -> list[sh.FunnelRun]:
    runs = [sh.FunnelRun.main(cfg, spec)]
    if spec_72h is not None:
        runs.append(sh.FunnelRun.observed(cfg, spec_72h))
    return runs


def _publish(build: sh.SharedBuild, runs: list[sh.FunnelRun], out_dir: str, note: str,
             dates: list[date] | None = None) -> dict[str, str]:
    """Publish every cube, or its cells of ``dates``.  The counts tables are
    what the analytics operators read (``load_long``), the rollups what the
    reports by version and date do (``load_rollup``)."""
    cubes = {"retention_cube": build.retention} if build.retention is not None else {}
    for r in runs:
        counts = cube_store.materialize(build.counts[r.name], r.name)
        cubes[r.name.replace("funnel", "funnel_cube")] = fu.wide_cube(counts, r.spec)
        cubes[r.name.replace("funnel", "funnel_rollup")] = ro.rollup(fu.long_cube(counts, r.spec))
        cubes[r.name.replace("funnel", "funnel_counts")] = counts
    return {name: cube_store.publish(df, f"{out_dir}/{name}", replace_dates=dates, note=note)
            for name, df in cubes.items()}


def rebuild(src, cfg: EngineConfig, spec: FunnelSpec, out_dir: str,
            spec_72h: FunnelSpec | None = None) -> dict[str, str]:
    """Compute all cubes from the log and replace the published tables."""
    runs = funnel_runs(cfg, spec, spec_72h)
    build = sh.build_all(src, cfg, runs, sh.Retention.of(cfg), cohort_filter=True)
    return _publish(build, runs, out_dir, _note(cfg))


def _note(cfg: EngineConfig, partials: dict[str, int] | None = None) -> str:
    return json.dumps({"as_of": cfg.as_of.isoformat(), "partials": partials}, sort_keys=True)


def load_long(spark: SparkSession, out_dir: str, spec: FunnelSpec, name: str = "funnel_counts") -> DataFrame:
    """The long cube (exact rates per cell and step) of a published build: what
    the comparison, report and alert operators take."""
    return fu.long_cube(cube_store.load(spark, f"{out_dir}/{name}"), spec)


def load_rollup(spark: SparkSession, out_dir: str, name: str = "funnel_rollup") -> DataFrame:
    """The published rollup of a build."""
    return cube_store.load(spark, f"{out_dir}/{name}")


class Refresher:
    """Cubes under ``out_dir``, kept up to date from partials in
    ``out_dir/_partials``."""

    def __init__(self, spark: SparkSession, cfg: EngineConfig, spec: FunnelSpec, out_dir: str,
                 spec_72h: FunnelSpec | None = None):
        self.spark, self.cfg, self.out_dir = spark, cfg, out_dir.rstrip("/")
        self.runs = funnel_runs(cfg, spec, spec_72h)
        self.retention = sh.Retention.of(cfg)
        self.partials = pa.DailyPartials(spark, f"{self.out_dir}/_partials", self.runs)

    def refresh(self, src, dates: list[date], keep: int = 2) -> list[date] | None:
        """Take in the events of ``dates`` and replace what they change.
        Returns the install dates replaced; None stands for all of them.

        With no partials yet, the whole band is gathered once; later the dates
        by which the clock has moved on are, too.  Dates outside the band are
        of no use to any cube and left alone."""
        lo, hi = sh.scan_band(self.cfg, self.runs, self.retention)
        last = self.cfg.as_of - timedelta(days=1)
        through = self.partials.through() or lo - timedelta(days=1)
        self.partials.update(src, sorted({d for d in dates if lo <= d <= hi} |
                                         {d for d in pa.all_dates(lo, last) if d > through}), last)
        now, made = self.partials.versions(), self._made_of()
        changed = None
        if made is not None and made["as_of"] == self.cfg.as_of.isoformat() and made["partials"]:
            changed = pa.changed_install_dates(self.partials, src, made["partials"])
        note = _note(self.cfg, now)
        if changed is None or changed:
            build = pa.build_from_partials(self.partials, src, self.cfg, self.retention, changed)
            _publish(build, self.runs, self.out_dir, note, changed)
        elif made["partials"] != now:
            for t in self._tables():
                t.annotate(note)
        for t in self._tables():
            t.expire(keep)
        self.partials.expire(keep)
        return changed

    def _tables(self) -> list[SnapshotTable]:
        names = ["retention_cube", *[r.name.replace("funnel", f"funnel_{k}") for r in self.runs
                                     for k in ("cube", "rollup", "counts")]]
        return [SnapshotTable(self.spark, f"{self.out_dir}/{n}") for n in names]

    def _made_of(self) -> dict | None:
        """The clock and the partials that all published tables reflect; None
        where they differ or one is not there."""
        manifests = [t.manifest() for t in self._tables()]
        notes = {m.note if m else None for m in manifests}
        note = notes.pop() if len(notes) == 1 else None
        return json.loads(note) if note else None


def refresh_stream(spark: SparkSession, events_dir: str, events_schema,
                   make_source: Callable[[], object], cfg: EngineConfig, spec: FunnelSpec,
                   out_dir: str, checkpoint: str, available_now: bool = True,
                   clock: Callable[[], date] | None = None,
                   spec_72h: FunnelSpec | None = None):
    """Start the refresher over a ``date``-partitioned canonical event folder.

    ``make_source()`` returns the EventSource that the refresh reads (usually a
    TableSource over the same warehouse); ``clock()`` gives the as-of date
    of each run (defaults to the configured one)."""
    stream = (spark.readStream.schema(events_schema).format("parquet").load(events_dir))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # a value per day with new files
        dates = [r[0] for r in batch.select("date").where(F.col("date").isNotNull()).distinct().collect()]
        run_cfg = cfg if clock is None else replace(cfg, as_of=clock())
        Refresher(spark, run_cfg, spec, out_dir, spec_72h).refresh(make_source(), dates)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 day")
    return writer.start()
