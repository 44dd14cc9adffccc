"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from cohortflow.functions.columns import (
    exact_ratio_e, from_e, version_num, version_sort_key,
    guarded_not, install_hour, DAY_MS,
)
from cohortflow.functions.stats import with_significance

__all__ = ["exact_ratio_e", "from_e", "version_num", "version_sort_key",
           "guarded_not", "install_hour", "DAY_MS", "with_significance"]
