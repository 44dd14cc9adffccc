"""cohortflow: declarative funnel, retention and before/after analytics on Spark.

The public entry points live in the sub-packages:

* ``cohortflow.sources``    canonical event log / player dimension readers
* ``cohortflow.plans``      funnel specifications (steps and anchors as data)
* ``cohortflow.operators``  DataFrame jobs: cohort, funnel cube, retention,
                            filters, weighted metrics, before/after, reports, alerts
* ``cohortflow.functions``  column-expression helpers (exact rounding, version
                            parsing, chi-squared significance)
* ``cohortflow.streaming``  scheduled incremental rebuild of the published cubes
"""

from cohortflow.config import EngineConfig
from cohortflow.session import get_session, checkpoint_dir

__all__ = ["EngineConfig", "get_session", "checkpoint_dir"]
