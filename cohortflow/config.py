"""Engine parameters.

Everything the reference hard-codes (clock, exclusion lists, version band,
test start, sample thresholds) is an explicit parameter here so jobs are
deterministic and back-fillable.  ``REFERENCE_*`` values are the ones the
analysed application uses; ``EngineConfig.for_testdata()`` maps them onto the
driver's synthetic tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's for equal results.
# ---------------------------------------------------------------------------
REFERENCE_EXCLUDED_COUNTRIES = ("IL", "UA", "AM")
REFERENCE_US_COUNTRY = "US"
REFERENCE_BUGGY_VERSION_BAND = (0.3731, 0.374)
REFERENCE_MIN_VERSION = 0.38
REFERENCE_CUBE_START = date(2026, 2, 1)
REFERENCE_RETENTION_START = date(2026, 3, 1)
REFERENCE_TEST_START = datetime(2026, 3, 22, 14)
REFERENCE_DEFAULT_VERSION_PREFIX = "0.3811"
REFERENCE_LOOKBACK_DAYS = 90
REFERENCE_INSTALL_LAG_DAYS = 2
REFERENCE_EVENT_LAG_DAYS = 1
REFERENCE_72H_LAG_DAYS = 3
REFERENCE_STEP_WINDOW_MS = 30 * 60 * 1000
REFERENCE_OBSERVATION_MS = 72 * 60 * 60 * 1000
REFERENCE_RETENTION_MAX_DAY = 90
REFERENCE_MIN_SAMPLE_USERS = 100       # uptick / low-sample alerts
REFERENCE_SMALL_VERSION_USERS = 50     # install alerts
REFERENCE_UPTICK_TOLERANCE = 0.0005
REFERENCE_KNOWN_UPTICK_STEPS = (9,)    # "Known / Accepted" upticks
REFERENCE_SIGNIFICANCE_MIN_N = 10
REFERENCE_CHI2_CRITICAL_95 = 3.841458820694124


@dataclass(frozen=True)
class EngineConfig:
    as_of: date
    excluded_countries: tuple[str, ...] = REFERENCE_EXCLUDED_COUNTRIES
    us_country: str = REFERENCE_US_COUNTRY
    buggy_version_band: tuple[float, float] = REFERENCE_BUGGY_VERSION_BAND
    min_version: float = REFERENCE_MIN_VERSION
    cube_start: date = REFERENCE_CUBE_START
    retention_start: date = REFERENCE_RETENTION_START
    test_start: datetime = REFERENCE_TEST_START
    default_version_prefix: str = REFERENCE_DEFAULT_VERSION_PREFIX
    lookback_days: int = REFERENCE_LOOKBACK_DAYS
    install_lag_days: int = REFERENCE_INSTALL_LAG_DAYS
    event_lag_days: int = REFERENCE_EVENT_LAG_DAYS
    lag_72h_days: int = REFERENCE_72H_LAG_DAYS
    observation_ms: int = REFERENCE_OBSERVATION_MS
    retention_max_day: int = REFERENCE_RETENTION_MAX_DAY
    min_sample_users: int = REFERENCE_MIN_SAMPLE_USERS
    small_version_users: int = REFERENCE_SMALL_VERSION_USERS
    uptick_tolerance: float = REFERENCE_UPTICK_TOLERANCE
    known_uptick_steps: tuple[int, ...] = REFERENCE_KNOWN_UPTICK_STEPS
    significance_min_n: int = REFERENCE_SIGNIFICANCE_MIN_N

    def with_(self, **kw) -> "EngineConfig":
        return replace(self, **kw)

    @staticmethod
    def for_testdata() -> "EngineConfig":
        """Parameters mapped onto /root/testdata (events 2024-01-01..01-30)."""
        return EngineConfig(
            as_of=date(2024, 1, 31),
            excluded_countries=("NATION_0", "NATION_1", "NATION_2"),
            us_country="NATION_24",
            buggy_version_band=(0.3811, 0.3812),
            min_version=0.38,
            cube_start=date(2024, 1, 1),
            retention_start=date(2024, 1, 1),
            test_start=datetime(2024, 1, 3, 12),
            default_version_prefix="0.3811",
            min_sample_users=10,
            small_version_users=35,
        )
