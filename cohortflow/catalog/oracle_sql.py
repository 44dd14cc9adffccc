"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: the funnel is spelled out the way
a warehouse job would do it (conditional MIN anchors joined back to the
events, conditional MAX flags, products of flags for monotonic gating).
Tables: the driver's views ``events customer nation region part``.
Rates use exact half-up rounding of the integer quotient, like the engine.
"""

from __future__ import annotations

import re

# Parameters of EngineConfig.for_testdata(), spelled out for SQL.
AS_OF = "DATE '2024-01-31'"
EXCLUDED = "('NATION_0', 'NATION_1', 'NATION_2')"
US = "'NATION_24'"
BAND = (0.3811, 0.3812)
TEST_START_DATE = "DATE '2024-01-03'"
TEST_START_HOUR = 0
WINDOW_MS = 48 * 3600 * 1000
OBS_MS = 72 * 3600 * 1000
K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
DIMS = ("install_date, install_hour, install_week, install_month, install_version, "
        "platform, country, is_low_payers_country, mediasource")
CUBE_DIMS = DIMS + ", media_type"
STEPS = [1, 2, 3, 4, 5, 6, 7, 8]
STEP_NAMES = {1: "signup", 2: "view_after_signup", 3: "click_after_signup",
              4: "click_ch1_hint", 5: "purchase_after_click", 6: "error_after_purchase",
              7: "click_ch2_any_time", 8: "purchase_ch4"}
PREV = {1: None, 2: 1, 3: 2, 4: 3, 5: 3, 6: 5, 7: 6, 8: 7}
GROUPS = {1: "core", 2: "core", 3: "core", 4: "hint", 5: "core", 6: "core", 7: "core", 8: "late"}


def e4(n: str, d: str) -> str:
    """round(n / d, 4) * 10^4 as an exact integer, NULL when d = 0."""
    return f"((2 * ({n}) * 10000 + ({d})) // (2 * NULLIF({d}, 0)))"


def r4(n: str, d: str) -> str:
    return f"(CAST({e4(n, d)} AS DOUBLE) / 10000)"


def s(no: int) -> str:
    return f"step_{no:02d}"


BASE = f"""
ev AS (
  SELECT user_id AS distinct_id, event_type AS mp_event_name, epoch_us(ts) // 1000 AS res_timestamp,
         CAST(ts AS DATE) AS date, CAST({K} // 25 + 1 AS INTEGER) AS chapter,
         CAST({K} AS VARCHAR) AS dialog_id
  FROM events
),
first_signup AS (
  SELECT user_id, min(ts) AS first_ts, arg_min({K}, ts) AS k
  FROM events WHERE event_type = 'signup' GROUP BY user_id
),
players AS (
  SELECT s.user_id AS distinct_id, CAST(s.first_ts AS DATE) AS install_date,
         s.first_ts AS first_event_time,
         '0.38' || CAST(s.k // 25 + 10 AS VARCHAR) AS first_app_version,
         c.c_mktsegment AS first_platform, n.n_name AS first_country,
         CASE WHEN s.user_id % 7 = 0 THEN NULL
              ELSE 'Brand#' || CAST(s.user_id % 30 + 1 AS VARCHAR) END AS first_mediasource
  FROM first_signup s JOIN customer c ON c.c_custkey = s.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
),
srcn AS (
  SELECT p_brand, p_type, CASE WHEN p_brand IN ('Brand#3', 'Brand#13', 'Brand#23') AND p_partkey % 2 = 0
         THEN NULL ELSE p_name END AS p_name FROM part
),
snm AS (SELECT p_brand AS cost_data_name, list(p_name ORDER BY p_name NULLS FIRST)[1] AS final_name
        FROM srcn GROUP BY p_brand),
mtm AS (SELECT lower(p_name) AS mediasource, list(p_type ORDER BY p_type NULLS FIRST)[1] AS media_type
        FROM srcn GROUP BY lower(p_name)),
lpc AS (
  SELECT DISTINCT n_name AS country_code FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'AFRICA'
),
excl AS (SELECT c_custkey AS distinct_id FROM customer WHERE c_acctbal < 0),
pdims AS (
  SELECT p.distinct_id, p.install_date, p.first_event_time,
         CAST(CASE WHEN CAST(p.first_event_time AS DATE) = p.install_date
                   THEN hour(p.first_event_time) ELSE 12 END AS INTEGER) AS install_hour,
         CAST(date_trunc('week', p.install_date) AS DATE) AS install_week,
         CAST(date_trunc('month', p.install_date) AS DATE) AS install_month,
         p.first_app_version AS install_version, p.first_platform AS platform,
         p.first_country AS country, (l.country_code IS NOT NULL) AS is_low_payers_country,
         p.first_mediasource,
         lower(coalesce(m.final_name, p.first_mediasource, 'organic')) AS mediasource,
         coalesce(TRY_CAST(p.first_app_version AS DOUBLE) >= {BAND[0]}
                  AND TRY_CAST(p.first_app_version AS DOUBLE) <= {BAND[1]}, false) AS is_buggy_version
  FROM players p
  LEFT JOIN snm m ON p.first_mediasource = m.cost_data_name
  LEFT JOIN lpc l ON p.first_country = l.country_code
)"""


def cohort_cte(install_lag: int = 2, name: str = "cohort") -> str:
    return f"""
{name} AS (
  SELECT * FROM pdims
  WHERE install_date BETWEEN {AS_OF} - 90 AND {AS_OF} - {install_lag}
    AND country NOT IN {EXCLUDED}
    AND distinct_id NOT IN (SELECT distinct_id FROM excl)
)"""


def funnel_ctes(install_lag: int = 2, event_lag: int = 1, observation: bool = False) -> str:
    obs = (f" AND e.res_timestamp <= (epoch_us(c.first_event_time) // 1000) + {OBS_MS}"
           if observation else "")
    W = WINDOW_MS
    t = "u.res_timestamp"
    return cohort_cte(install_lag) + f""",
uev AS (
  SELECT e.*, c.is_buggy_version, (epoch_us(c.first_event_time) // 1000) AS install_ms
  FROM ev e JOIN cohort c ON e.distinct_id = c.distinct_id
  WHERE e.date >= {AS_OF} - 90 AND e.date <= {AS_OF} - {event_lag}{obs}
),
anc AS (
  SELECT distinct_id, count(*) AS n_events,
         min(CASE WHEN mp_event_name = 'signup' THEN res_timestamp END) AS ts_signup,
         min(CASE WHEN mp_event_name = 'view' THEN res_timestamp END) AS ts_view,
         min(CASE WHEN mp_event_name = 'click' THEN res_timestamp END) AS ts_click,
         min(CASE WHEN mp_event_name = 'purchase' THEN res_timestamp END) AS ts_purchase
  FROM uev GROUP BY distinct_id
),
flags AS (
  SELECT u.distinct_id,
    max(CASE WHEN u.mp_event_name = 'signup' THEN 1 ELSE 0 END) AS step_01,
    max(CASE WHEN u.mp_event_name = 'view' AND a.ts_signup IS NOT NULL AND {t} >= a.ts_signup
              AND {t} - a.ts_signup <= {W} THEN 1 ELSE 0 END) AS step_02,
    max(CASE WHEN u.mp_event_name = 'click' AND a.ts_signup IS NOT NULL AND {t} >= a.ts_signup
              AND {t} - a.ts_signup <= {W} THEN 1 ELSE 0 END) AS step_03,
    max(CASE WHEN u.mp_event_name = 'click' AND u.chapter = 1 AND a.ts_signup IS NOT NULL
              AND {t} >= a.ts_signup AND {t} - a.ts_signup <= {W}
              AND (a.ts_purchase IS NULL OR {t} <= a.ts_purchase) THEN 1 ELSE 0 END) AS step_04,
    max(CASE WHEN u.mp_event_name = 'purchase' AND a.ts_click IS NOT NULL AND {t} >= a.ts_click
              AND {t} - a.ts_click <= {W} THEN 1 ELSE 0 END) AS step_05,
    max(CASE WHEN u.mp_event_name = 'error' AND a.ts_purchase IS NOT NULL AND {t} >= a.ts_purchase
              AND {t} - a.ts_purchase <= {W} THEN 1 ELSE 0 END) AS step_06,
    max(CASE WHEN ((u.is_buggy_version AND u.mp_event_name = 'view' AND u.chapter = 2)
                   OR (NOT u.is_buggy_version AND u.mp_event_name = 'click' AND u.chapter = 2))
              AND a.ts_purchase IS NOT NULL AND {t} >= a.ts_purchase THEN 1 ELSE 0 END) AS step_07,
    max(CASE WHEN u.mp_event_name = 'purchase' AND u.chapter = 4 AND a.ts_view IS NOT NULL
              THEN 1 ELSE 0 END) AS step_08
  FROM uev u LEFT JOIN anc a ON u.distinct_id = a.distinct_id
  GROUP BY u.distinct_id
),
mono AS (
  SELECT distinct_id,
    step_01,
    step_02 * step_01 AS step_02,
    step_03 * step_02 * step_01 AS step_03,
    step_04 * step_03 * step_02 * step_01 AS step_04,
    step_05 * step_03 * step_02 * step_01 AS step_05,
    step_06 * step_05 * step_03 * step_02 * step_01 AS step_06,
    step_07 * step_06 * step_05 * step_03 * step_02 * step_01 AS step_07,
    step_08 * step_07 * step_06 * step_05 * step_03 * step_02 * step_01 AS step_08
  FROM flags
),
counts AS (
  SELECT {', '.join('c.' + d.strip() for d in DIMS.split(','))},
         count(DISTINCT m.distinct_id) AS total_users,
         {', '.join(f'CAST(sum(m.{s(n)}) AS BIGINT) AS {s(n)}' for n in STEPS)}
  FROM mono m JOIN cohort c ON m.distinct_id = c.distinct_id
  GROUP BY {', '.join('c.' + d.strip() for d in DIMS.split(','))}
),
cube_w AS (
  SELECT v.*, coalesce(mt.media_type, CASE WHEN v.mediasource = 'organic' THEN 'organic'
                                          ELSE 'none' END) AS media_type
  FROM counts v LEFT JOIN mtm mt ON v.mediasource = mt.mediasource
  WHERE coalesce(v.step_01, 0) <> 0
),
cube_l AS (
  {' UNION ALL '.join(
      f"SELECT {CUBE_DIMS}, total_users, step_01 AS raw_step_01, {n} AS step_no, "
      f"{s(n)} AS users, {('CAST(NULL AS BIGINT)' if PREV[n] is None else s(PREV[n]))} AS prev_users "
      f"FROM cube_w" for n in STEPS)}
),
cube AS (
  SELECT *, {e4('users', 'raw_step_01')} AS pct_e4, {r4('users', 'raw_step_01')} AS pct,
         CASE WHEN prev_users IS NULL THEN CAST(10000 AS BIGINT) ELSE {e4('users', 'prev_users')} END AS ratio_e4,
         CASE WHEN prev_users IS NULL THEN 1.0::DOUBLE ELSE {r4('users', 'prev_users')} END AS ratio
  FROM cube_l
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def q(body: str, *ctes: str) -> str:
    return with_(BASE, *ctes) + "\n" + body


FUNNEL = funnel_ctes()
WIDE_COLS = (", ".join(f"{r4(s(n), 'step_01')} AS pct_{n:02d}_{STEP_NAMES[n]}" for n in STEPS)
             + ", " + ", ".join(
                 ("1.0::DOUBLE AS ratio_01_to_prev" if PREV[n] is None else
                  f"{r4(s(n), s(PREV[n]))} AS ratio_{n:02d}_to_{PREV[n]:02d}") for n in STEPS))

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- cohort
ORACLE["players_cohort"] = q(f"SELECT distinct_id, {DIMS}, is_buggy_version FROM cohort",
                             cohort_cte())
ORACLE["low_payer_flag"] = q("SELECT distinct_id, country, is_low_payers_country FROM pdims")
ORACLE["mediasource_normalised"] = q(
    "SELECT distinct_id, first_mediasource, mediasource FROM pdims")
ORACLE["version_band_flag"] = q(
    "SELECT DISTINCT install_version, TRY_CAST(install_version AS DOUBLE) AS version_num, "
    "is_buggy_version FROM pdims")
ORACLE["fraud_anti_join"] = q(
    "SELECT distinct_id, install_date FROM players "
    "WHERE distinct_id NOT IN (SELECT distinct_id FROM excl)")
ORACLE["source_name_dedupe"] = q("SELECT cost_data_name, final_name FROM snm")
ORACLE["media_type_dedupe"] = q("SELECT mediasource, media_type FROM mtm")
ORACLE["media_type_lookup"] = q(
    "SELECT DISTINCT c.mediasource, coalesce(m.media_type, CASE WHEN c.mediasource = 'organic' "
    "THEN 'organic' ELSE 'none' END) AS media_type FROM cohort c "
    "LEFT JOIN mtm m ON c.mediasource = m.mediasource", cohort_cte())

# ---------------------------------------------------------------- events
ORACLE["events_in_window"] = q(
    f"SELECT e.distinct_id, e.mp_event_name, e.chapter, e.res_timestamp, e.dialog_id, "
    f"{', '.join('c.' + d.strip() for d in DIMS.split(','))} "
    f"FROM ev e JOIN cohort c ON e.distinct_id = c.distinct_id "
    f"WHERE e.date BETWEEN {AS_OF} - 90 AND {AS_OF} - 1", cohort_cte())
ORACLE["events_observation_window"] = q(
    "SELECT distinct_id, mp_event_name, res_timestamp, install_ms FROM uev",
    funnel_ctes(install_lag=3, event_lag=3, observation=True))
ORACLE["first_event_ts"] = q(
    "SELECT distinct_id, min(res_timestamp) AS first_purchase_ts FROM uev "
    "WHERE mp_event_name = 'purchase' GROUP BY distinct_id", FUNNEL)

# ---------------------------------------------------------------- funnel
ORACLE["funnel_anchors"] = q("SELECT * FROM anc", FUNNEL)
ORACLE["funnel_user_flags"] = q("SELECT * FROM flags", FUNNEL)
ORACLE["funnel_monotonic"] = q(
    "SELECT distinct_id, CAST(step_01 + step_02 + step_03 + step_05 + step_06 + step_07 + step_08 "
    f"AS INTEGER) AS depth, {', '.join(f'CAST({s(n)} AS INTEGER) AS {s(n)}' for n in STEPS)} "
    "FROM mono", FUNNEL)
ORACLE["funnel_cube_counts"] = q(f"SELECT {CUBE_DIMS}, total_users, step_no, users FROM cube",
                                 FUNNEL)
ORACLE["funnel_cube_pct"] = q(
    f"SELECT {CUBE_DIMS}, total_users, raw_step_01, step_no, users, pct_e4, pct FROM cube", FUNNEL)
ORACLE["funnel_cube_ratio"] = q(
    f"SELECT {CUBE_DIMS}, step_no, users, prev_users, ratio_e4, ratio FROM cube", FUNNEL)

WIDE = "cube_wide AS (SELECT " + CUBE_DIMS + ", total_users, step_01 AS raw_step_01, " + WIDE_COLS + " FROM cube_w)"
PCT_SHOWN = [n for n in STEPS if GROUPS[n] != "hint"]


def wcw(num: str, w: str = "raw_step_01", e: str = "pct_e4") -> str:
    """Step-1 weighted mean of an e4 rate (exact integer ratio)."""
    return (f"CASE WHEN sum({w}) > 0 THEN CAST(sum(coalesce({e}, 0) * {w}) AS DOUBLE) / "
            f"CAST(sum({w}) * 10000 AS DOUBLE) ELSE coalesce(avg({num}), 0.0) END")


ORACLE["funnel_unpivot"] = q(
    f"SELECT {CUBE_DIMS}, total_users, raw_step_01, metric, value FROM "
    f"(UNPIVOT cube_wide ON {', '.join(f'pct_{n:02d}_{STEP_NAMES[n]}' for n in PCT_SHOWN)} "
    f"INTO NAME metric VALUE value)", FUNNEL, WIDE)

_STEP_VALUES = ", ".join(
    f"({n}, '{STEP_NAMES[n]}', '{ev}', {str(GROUPS[n] == 'hint').upper()}, '{GROUPS[n]}', "
    f"{'NULL' if PREV[n] is None else PREV[n]})"
    for n, ev in zip(STEPS, ["signup", "view", "click", "click", "purchase", "error", "click",
                             "purchase"]))
ORACLE["step_reference"] = q(
    "SELECT d.step_no, lpad(CAST(d.step_no AS VARCHAR), 2, '0') || ': ' || d.step_name AS step_label, "
    "d.step_name, d.event, d.is_branch, d.step_group, d.prev_spine_no, t.users, t.weighted_pct "
    "FROM sdim d LEFT JOIN (SELECT step_no, CAST(sum(users) AS BIGINT) AS users, "
    f"{wcw('pct')} AS weighted_pct FROM cube GROUP BY step_no) t ON d.step_no = t.step_no",
    FUNNEL, "sdim AS (SELECT CAST(c1 AS INTEGER) AS step_no, c2 AS step_name, c3 AS event, "
    "c4 AS is_branch, c5 AS step_group, CAST(c6 AS INTEGER) AS prev_spine_no FROM (VALUES "
    + _STEP_VALUES.replace("(", "(", 1) + ") v(c1, c2, c3, c4, c5, c6))")
ORACLE["step_subset"] = q(
    f"SELECT install_version, step_no, {wcw('pct')} AS value FROM cube "
    "WHERE starts_with(install_version, '0.3811') AND step_no BETWEEN 2 AND 6 "
    "GROUP BY install_version, step_no", FUNNEL)
ORACLE["cube_load"] = q(
    "SELECT * FROM cube_wide WHERE install_date >= DATE '2024-01-01' "
    "AND TRY_CAST(install_version AS DOUBLE) >= 0.38 AND platform <> 'none'", FUNNEL, WIDE)
ORACLE["cube_load_72h"] = q(
    "SELECT * FROM cube_wide WHERE install_date >= DATE '2024-01-01' "
    f"AND install_date < {AS_OF} - 3 "
    "AND TRY_CAST(install_version AS DOUBLE) >= 0.38 AND platform <> 'none'",
    funnel_ctes(install_lag=3, event_lag=3, observation=True), WIDE)
ORACLE["cube_roundtrip"] = q("SELECT * FROM cube_wide", FUNNEL, WIDE)

# ---------------------------------------------------------------- retention
RET = f"""
rcohort AS (
  SELECT distinct_id, install_date, CAST(first_app_version AS VARCHAR) AS install_version,
         CAST(CASE WHEN first_country = {US} THEN 1 ELSE 0 END AS INTEGER) AS is_usa,
         first_platform AS platform
  FROM players
  WHERE install_date >= DATE '2024-01-01' AND install_date <= {AS_OF}
    AND first_country NOT IN {EXCLUDED}
    AND distinct_id NOT IN (SELECT distinct_id FROM excl)
),
dact AS (
  SELECT e.distinct_id, CAST(make_timestamp(e.res_timestamp * 1000) AS DATE) AS activity_date
  FROM ev e JOIN rcohort c ON e.distinct_id = c.distinct_id
  WHERE e.date >= DATE '2024-01-01' AND e.date <= {AS_OF} + 91
  GROUP BY 1, 2
),
days AS (SELECT CAST(range AS INTEGER) AS day_num FROM range(0, 91)),
cdays AS (
  SELECT c.*, d.day_num AS days_since_install, c.install_date + d.day_num AS activity_date
  FROM rcohort c CROSS JOIN days d
  WHERE c.install_date + d.day_num < {AS_OF}
),
rcube AS (
  SELECT cd.install_date, cd.install_version, cd.platform, cd.is_usa, cd.days_since_install,
         count(DISTINCT cd.distinct_id) AS cohort_size, count(DISTINCT da.distinct_id) AS users_active
  FROM cdays cd LEFT JOIN dact da
    ON cd.distinct_id = da.distinct_id AND cd.activity_date = da.activity_date
  GROUP BY ALL
)"""


def wret(cond: str = "TRUE") -> str:
    cs = f"sum(CASE WHEN ({cond}) AND users_active > 0 THEN cohort_size END)"
    ua = f"sum(CASE WHEN ({cond}) AND users_active > 0 THEN users_active END)"
    return f"CASE WHEN {cs} > 0 THEN CAST({ua} AS DOUBLE) / CAST({cs} AS DOUBLE) ELSE 0.0 END"


PERIOD = f"CASE WHEN install_date < {TEST_START_DATE} THEN 'before' ELSE 'after' END"

ORACLE["retention_cohort"] = q("SELECT * FROM rcohort", RET)
ORACLE["daily_activity"] = q("SELECT * FROM dact", RET)
ORACLE["retention_cube"] = q("SELECT * FROM rcube", RET)
ORACLE["retention_weighted"] = q(
    f"SELECT install_version, days_since_install, {wret()} AS retention, "
    "CAST(sum(cohort_size) AS BIGINT) AS cohort_size, CAST(sum(users_active) AS BIGINT) AS users_active "
    "FROM rcube WHERE days_since_install <= 14 GROUP BY 1, 2", RET)
ORACLE["retention_matrix"] = q(
    "SELECT platform, install_version, "
    "CAST(sum(CASE WHEN days_since_install = 0 THEN cohort_size END) AS BIGINT) AS cohort, "
    + ", ".join(f"CASE WHEN sum(CASE WHEN days_since_install = {d} THEN cohort_size END) > 0 "
                f"THEN {wret(f'days_since_install = {d}')} END AS d{d}" for d in range(1, 15))
    + " FROM rcube WHERE days_since_install <= 14 GROUP BY 1, 2 "
    "HAVING coalesce(sum(CASE WHEN days_since_install = 0 THEN cohort_size END), 0) > 0", RET)
ORACLE["retention_curve"] = q(
    "SELECT platform, install_version, days_since_install, "
    "CAST(sum(users_active) AS DOUBLE) / CAST(sum(cohort_size) AS DOUBLE) AS retention, "
    "CAST(sum(cohort_size) AS BIGINT) AS cohort FROM rcube "
    "WHERE days_since_install <= 14 AND users_active > 0 GROUP BY 1, 2, 3", RET)
ORACLE["retention_curve_split"] = q(
    f"SELECT platform, install_version, {PERIOD} AS period, days_since_install, "
    "CAST(sum(users_active) AS DOUBLE) / CAST(sum(cohort_size) AS DOUBLE) AS retention, "
    "CAST(sum(cohort_size) AS BIGINT) AS cohort FROM rcube "
    "WHERE days_since_install <= 14 AND users_active > 0 GROUP BY 1, 2, 3, 4", RET)
ORACLE["daily_retention"] = q(
    "SELECT r.install_date, r.install_version, r.days_since_install, r.retention, d0.cohort FROM "
    "(SELECT install_date, install_version, days_since_install, "
    "CAST(sum(users_active) AS DOUBLE) / CAST(sum(cohort_size) AS DOUBLE) AS retention FROM rcube "
    "WHERE days_since_install BETWEEN 1 AND 14 AND users_active > 0 GROUP BY 1, 2, 3) r "
    "LEFT JOIN (SELECT install_date, install_version, CAST(sum(cohort_size) AS BIGINT) AS cohort "
    "FROM rcube WHERE days_since_install = 0 GROUP BY 1, 2) d0 "
    "ON r.install_date = d0.install_date AND r.install_version = d0.install_version", RET)
ORACLE["filter_retention"] = q(
    "SELECT * FROM rcube WHERE install_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-08' "
    "AND platform IN ('BUILDING', 'MACHINERY') AND is_usa = 0", RET)

# ---------------------------------------------------------------- filters / metrics
ORACLE["filter_date_hour"] = q(
    "SELECT * FROM cube_wide WHERE install_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-05' "
    "AND NOT coalesce(install_date = DATE '2024-01-02' AND install_hour < 6, false) "
    "AND NOT coalesce(install_date = DATE '2024-01-05' AND install_hour > 18, false)", FUNNEL, WIDE)
ORACLE["filter_dimensions"] = q(
    "SELECT * FROM cube_wide WHERE platform IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') "
    "AND install_month IN (DATE '2024-01-01') AND is_low_payers_country = false", FUNNEL, WIDE)
VKEY = "coalesce(TRY_CAST(install_version AS DOUBLE), 0.0)"
ORACLE["versions_at_least"] = q(
    f"SELECT DISTINCT install_version FROM cube_wide WHERE {VKEY} >= 0.3812", FUNNEL, WIDE)
ORACLE["versions_ordered"] = q(
    f"SELECT install_version, {VKEY} AS version_key FROM (SELECT install_version FROM cube_wide "
    "UNION SELECT install_version FROM rcube) ORDER BY 2, 1", FUNNEL, WIDE, RET)
ORACLE["versions_retention_only"] = q(
    "SELECT install_version FROM rcube EXCEPT SELECT install_version FROM cube_wide",
    FUNNEL, WIDE, RET)
ORACLE["weighted_conversion"] = q(
    f"SELECT install_version, step_no, {wcw('pct')} AS value, "
    "CAST(sum(total_users) AS BIGINT) AS users, CAST(sum(raw_step_01) AS BIGINT) AS step1 "
    "FROM cube GROUP BY 1, 2", FUNNEL)
ORACLE["monotonic_cap"] = q(
    "SELECT install_version, step_no, value, min(value) OVER (PARTITION BY install_version "
    "ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped FROM "
    f"(SELECT install_version, step_no, {wcw('pct')} AS value FROM cube "
    "WHERE step_no IN (1, 2, 3, 5, 6, 7, 8) GROUP BY 1, 2)", FUNNEL)
ORACLE["dimension_counts"] = q(
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, "
        f"CAST(sum(total_users) AS BIGINT) AS users FROM cube_wide WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in ["platform", "country", "media_type", "mediasource", "install_version"]),
    FUNNEL, WIDE)
ORACLE["coverage"] = q(
    "SELECT total_all, total_selected, total_all - total_selected AS total_excluded, "
    "CASE WHEN total_all > 0 THEN total_selected / total_all * 100 ELSE 0.0 END AS pct_selected, "
    "min_date, max_date, has_post_test FROM (SELECT CAST(sum(total_users) AS BIGINT) AS total_all, "
    "CAST(coalesce(sum(CASE WHEN platform IN ('BUILDING', 'MACHINERY') THEN total_users END), 0) "
    "AS BIGINT) AS total_selected, min(install_date) AS min_date, max(install_date) AS max_date, "
    f"bool_or(install_date >= {TEST_START_DATE}) AS has_post_test FROM cube_wide)", FUNNEL, WIDE)

# ---------------------------------------------------------------- before / after
# before: versions >= 0.381, 2024-01-01 h0 .. 2024-01-03 h11
# after:  versions >= 0.3811, 2024-01-03 h12 .. 2024-01-29 h23
BA_WINDOWS = [("before", 0.381, "2024-01-01", 0, "2024-01-03", 11),
              ("after", 0.3811, "2024-01-03", 12, "2024-01-29", 23)]


def tag_sql(src: str, hours: bool = True) -> str:
    parts = []
    for name, mv, sd, sh, ed, eh in BA_WINDOWS:
        cond = f"{VKEY} >= {mv} AND install_date BETWEEN DATE '{sd}' AND DATE '{ed}'"
        if hours:
            cond += (f" AND NOT coalesce(install_date = DATE '{sd}' AND install_hour < {sh}, false)"
                     f" AND NOT coalesce(install_date = DATE '{ed}' AND install_hour > {eh}, false)")
        parts.append(f"SELECT *, '{name}' AS period FROM {src} WHERE {cond}")
    return " UNION ALL ".join(parts)


SHOWN = "(1, 2, 3, 5, 6, 7, 8)"
BA = f"""
tag AS ({tag_sql('cube')}),
baf0 AS (
  SELECT period, step_no, {wcw('pct')} AS raw_value, CAST(sum(total_users) AS BIGINT) AS users,
         CAST(sum(raw_step_01) AS BIGINT) AS step1
  FROM tag WHERE step_no IN {SHOWN} GROUP BY period, step_no
),
baf AS (
  SELECT period, step_no, raw_value,
         min(raw_value) OVER (PARTITION BY period ORDER BY step_no
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
         value AS plot_value, users, step1, false AS is_branch
  FROM baf0
),
sbs AS (
  SELECT coalesce(b.step_no, a.step_no) AS step_no, coalesce(b.is_branch, a.is_branch) AS is_branch,
         b.value AS before, a.value AS after, b.step1 AS n_before, a.step1 AS n_after
  FROM (SELECT * FROM baf WHERE period = 'before') b
  FULL JOIN (SELECT * FROM baf WHERE period = 'after') a ON b.step_no = a.step_no
),
lift AS (
  SELECT step_no, before, after,
         CASE WHEN NOT (is_branch AND coalesce(before, 0.0) = 0) THEN after - before END AS delta,
         CASE WHEN NOT (is_branch AND coalesce(before, 0.0) = 0) THEN (after - before) * 100 END AS lift_pp,
         CASE WHEN NOT (is_branch AND coalesce(before, 0.0) = 0) AND before > 0
              THEN (after - before) / before * 100 END AS rel_lift_pct
  FROM sbs
)"""

_C = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
      1.48851587, -0.82215223, 0.17087277]


def _poly(t: str) -> str:
    p = f"({_C[9]})"
    for c in reversed(_C[1:9]):
        p = f"(({c}) + {t} * {p})"
    return p


SIG = f"""
sig0 AS (
  SELECT *, round_even(before * n_before, 0) AS a, round_even(after * n_after, 0) AS c FROM sbs
),
sig1 AS (SELECT *, round_even(n_before - a, 0) AS b, round_even(n_after - c, 0) AS d FROM sig0),
sig2 AS (
  SELECT *, a + b + c + d AS n,
         (n_before >= 10 AND n_after >= 10 AND before IS NOT NULL AND after IS NOT NULL
          AND least(a, b, c, d) >= 0 AND (a + b) > 0 AND (c + d) > 0 AND (a + c) > 0
          AND (b + d) > 0) AS valid
  FROM sig1
),
sig3 AS (
  SELECT *, n * greatest(0.0, abs(a * d - b * c) - n / 2.0) * greatest(0.0, abs(a * d - b * c) - n / 2.0)
            / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2_raw
  FROM sig2
),
sig4 AS (SELECT *, sqrt(chi2_raw / 2.0) AS z FROM sig3),
sig5 AS (SELECT *, 1.0 / (1.0 + z / 2.0) AS t FROM sig4),
sig6 AS (
  SELECT *, CASE WHEN coalesce(valid, false)
            THEN least(1.0, t * exp((-z) * z + ({_C[0]}) + t * {_poly('t')})) ELSE 1.0 END AS p
  FROM sig5
),
sig AS (
  SELECT step_no, before, after, n_before, n_after,
         CASE WHEN coalesce(before > 0, false) AND coalesce(valid, false) THEN chi2_raw END AS chi2,
         CASE WHEN coalesce(before > 0, false) THEN round(p, 9) ELSE 1.0 END AS p_value,
         CASE WHEN coalesce(before > 0, false)
              THEN coalesce(valid AND chi2_raw > 3.841458820694124, false) ELSE false END AS is_significant,
         CASE WHEN NOT coalesce(before > 0, false) THEN 'N/A'
              WHEN NOT coalesce(valid, false) THEN 'N/A'
              WHEN p < 0.001 THEN 'p<0.001'
              WHEN p < 0.05 THEN printf('p=%.3f', p)
              ELSE printf('p=%.2f', p) END AS p_label
  FROM sig6
)"""

ORACLE["ba_users"] = q(
    "SELECT period, install_version, CAST(sum(total_users) AS BIGINT) AS users, "
    "CAST(sum(raw_step_01) AS BIGINT) AS step1 FROM tag WHERE step_no = 1 GROUP BY 1, 2",
    FUNNEL, BA)
ORACLE["ba_versions"] = q(
    f"SELECT DISTINCT install_version FROM cube_wide WHERE {VKEY} >= 0.381 OR {VKEY} >= 0.3811",
    FUNNEL, WIDE)
ORACLE["ba_funnel"] = q("SELECT * FROM baf", FUNNEL, BA)
ORACLE["ba_lift"] = q(
    "SELECT *, CASE WHEN lift_pp > 0.1 THEN 'up' WHEN lift_pp < -0.1 THEN 'down' "
    "ELSE 'neutral' END AS direction FROM lift", FUNNEL, BA)
ORACLE["ba_significance"] = q("SELECT * FROM sig", FUNNEL, BA, SIG)
ORACLE["ba_lift_summary"] = q(
    "SELECT round(avg(l.lift_pp), 9) AS avg_lift_pp, "
    "CAST(count_if(l.lift_pp > 0.5) AS BIGINT) AS steps_improved, "
    "CAST(count_if(l.lift_pp < -0.5) AS BIGINT) AS steps_declined, "
    "CAST(count_if(l.lift_pp IS NOT NULL) AS BIGINT) AS steps_compared, "
    "arg_max(l.lift_pp, CASE WHEN l.lift_pp IS NOT NULL THEN l.step_no END) AS last_step_lift_pp, "
    "CAST(count_if(s.is_significant) AS BIGINT) AS significant_steps "
    "FROM lift l LEFT JOIN sig s ON l.step_no = s.step_no",
    FUNNEL, BA, SIG)
_NAME_CASE = "CASE l.step_no " + " ".join(f"WHEN {n} THEN '{STEP_NAMES[n]}'" for n in STEPS) + " END"
ORACLE["ba_detail"] = q(
    "SELECT l.step_no, lpad(CAST(l.step_no AS VARCHAR), 2, '0') || ': ' || " + _NAME_CASE +
    " AS step_label, l.before, l.after, "
    "CASE WHEN st = 'compared' THEN l.delta END AS delta, "
    "CASE WHEN st = 'compared' THEN l.lift_pp END AS lift_pp, "
    "CASE WHEN st = 'compared' THEN s.p_label END AS p_label, "
    "CASE WHEN st = 'compared' THEN s.is_significant END AS is_significant, st AS status "
    "FROM (SELECT l.*, CASE WHEN b.is_branch AND coalesce(l.before, 0.0) = 0 THEN 'new' "
    "WHEN l.before > 0 THEN 'compared' ELSE 'na' END AS st FROM lift l JOIN sbs b "
    "ON l.step_no = b.step_no) l LEFT JOIN sig s ON l.step_no = s.step_no", FUNNEL, BA, SIG)
ORACLE["ba_start_finish"] = q(
    "SELECT period, started_users, finish_rate, started_users * finish_rate AS completed_users "
    "FROM (SELECT period, max(users) AS started_users, arg_max(value, step_no) AS finish_rate "
    "FROM baf WHERE NOT is_branch GROUP BY period)", FUNNEL, BA)
ORACLE["dropoff_transitions"] = q(
    "SELECT period, step_no, next_step_no, value, next_value, CASE WHEN value > 0 "
    "THEN (value - next_value) / value ELSE 0.0 END AS drop_rate FROM (SELECT period, step_no, "
    "value, lead(step_no) OVER (PARTITION BY period ORDER BY step_no) AS next_step_no, "
    "lead(value) OVER (PARTITION BY period ORDER BY step_no) AS next_value FROM baf) WHERE next_step_no IS NOT NULL", FUNNEL, BA)

BA_RET = f"""
rtag AS ({tag_sql('rcube', hours=False)}),
hr AS (SELECT DISTINCT install_version, period FROM rtag),
pdy AS (
  SELECT install_version, period, days_since_install, {wret()} AS r,
         sum(CASE WHEN users_active > 0 THEN cohort_size END) AS n
  FROM rtag WHERE days_since_install BETWEEN 1 AND 14 GROUP BY 1, 2, 3
),
grid AS (
  SELECT v.install_version, CAST(d.range AS INTEGER) AS days_since_install
  FROM (SELECT DISTINCT install_version FROM hr) v CROSS JOIN range(1, 15) d
),
gj AS (
  SELECT g.install_version, g.days_since_install,
         CASE WHEN hb.install_version IS NOT NULL THEN coalesce(b.n, 0) END AS nb,
         CASE WHEN ha.install_version IS NOT NULL THEN coalesce(a.n, 0) END AS na,
         coalesce(b.r, 0.0) AS rb, coalesce(a.r, 0.0) AS ra
  FROM grid g
  LEFT JOIN hr hb ON hb.install_version = g.install_version AND hb.period = 'before'
  LEFT JOIN hr ha ON ha.install_version = g.install_version AND ha.period = 'after'
  LEFT JOIN pdy b ON b.install_version = g.install_version AND b.period = 'before'
       AND b.days_since_install = g.days_since_install
  LEFT JOIN pdy a ON a.install_version = g.install_version AND a.period = 'after'
       AND a.days_since_install = g.days_since_install
)"""
ORACLE["ba_retention"] = q(
    "SELECT install_version, days_since_install AS day, CASE WHEN nb > 0 THEN rb END AS before, "
    "CAST(nb AS BIGINT) AS cohort_before, CASE WHEN na > 0 THEN ra END AS after, "
    "CAST(na AS BIGINT) AS cohort_after, CASE WHEN nb > 0 AND na > 0 THEN ra - rb END AS delta, "
    "CASE WHEN nb > 0 AND na > 0 AND rb > 0 THEN (ra - rb) / rb END AS relative FROM gj",
    RET, BA_RET)
ORACLE["ba_retention_daily"] = q(
    "SELECT install_version, days_since_install AS day, "
    "CASE WHEN coalesce(nb, 0) > 0 THEN rb END AS before, "
    "CASE WHEN coalesce(na, 0) > 0 THEN ra END AS after, "
    "CASE WHEN coalesce(nb, 0) > 0 AND coalesce(na, 0) > 0 THEN ra - rb END AS delta FROM ("
    f"SELECT install_version, days_since_install, {wret(f'install_date < {TEST_START_DATE}')} AS rb, "
    f"sum(CASE WHEN install_date < {TEST_START_DATE} AND users_active > 0 THEN cohort_size END) AS nb, "
    f"{wret(f'install_date >= {TEST_START_DATE}')} AS ra, "
    f"sum(CASE WHEN install_date >= {TEST_START_DATE} AND users_active > 0 THEN cohort_size END) AS na "
    "FROM rcube WHERE days_since_install BETWEEN 1 AND 14 GROUP BY 1, 2)", RET)

# ---------------------------------------------------------------- reports
VS = f"""
vs AS (
  SELECT install_version, step_no, {wcw('pct')} AS value, CAST(sum(total_users) AS BIGINT) AS users
  FROM cube WHERE step_no IN {SHOWN} GROUP BY 1, 2
),
vsu AS (
  SELECT v.*, u.users AS vusers FROM vs v
  JOIN (SELECT install_version, users FROM vs WHERE step_no = 1) u ON v.install_version = u.install_version
)"""


def vsl(min_users: int) -> str:
    return f"""
vsl{min_users} AS (
  SELECT *, lag(step_no) OVER w AS prev_step_no, lag(value) OVER w AS prev_value
  FROM vsu WHERE vusers >= {min_users}
  WINDOW w AS (PARTITION BY install_version ORDER BY step_no)
)"""


def split_sql(group: str, metric: str = "pct") -> str:
    b = f"install_date < {TEST_START_DATE}"
    nb = f"NOT ({b})"

    def side(c: str, tag: str) -> str:
        den = f"sum(CASE WHEN {c} THEN raw_step_01 END)"
        num = f"sum(CASE WHEN {c} THEN coalesce({metric}_e4, 0) * raw_step_01 END)"
        return (f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} * 10000 AS DOUBLE) "
                f"ELSE coalesce(avg(CASE WHEN {c} THEN {metric} END), 0.0) END AS {tag}")
    g = f"{group}, " if group else ""
    return (f"SELECT {g}step_no, {side(b, 'before')}, {side(nb, 'after')}, "
            f"CAST(coalesce(sum(CASE WHEN {b} THEN total_users END), 0) AS BIGINT) AS users_before, "
            f"CAST(coalesce(sum(CASE WHEN {nb} THEN total_users END), 0) AS BIGINT) AS users_after "
            f"FROM cube WHERE step_no IN {SHOWN} GROUP BY {g}step_no")


ORACLE["version_funnel"] = q(
    "SELECT install_version, max(CASE WHEN step_no = 1 THEN users END) AS users, "
    + ", ".join(f"max(CASE WHEN step_no = {n} THEN value END) AS s{n:02d}" for n in PCT_SHOWN)
    + " FROM vs GROUP BY install_version", FUNNEL, VS)
ORACLE["version_funnel_split"] = q(
    f"SELECT install_version, {PERIOD} AS period, step_no, {wcw('pct')} AS value, "
    f"CAST(sum(total_users) AS BIGINT) AS users FROM cube WHERE step_no IN {SHOWN} "
    "GROUP BY 1, 2, 3", FUNNEL)
for _name, _col in (("step_trend_day", "install_date"), ("step_trend_week", "install_week"),
                    ("step_trend_month", "install_month")):
    ORACLE[_name] = q(
        f"SELECT {_col} AS period, step_no, {wcw('pct')} AS value, "
        f"CAST(sum(total_users) AS BIGINT) AS users FROM cube WHERE step_no IN {SHOWN} "
        "GROUP BY 1, 2 HAVING sum(total_users) > 0", FUNNEL)
ORACLE["trend_averages"] = q(
    f"SELECT step_no, round(avg(CASE WHEN period < {TEST_START_DATE} THEN value END), 9) AS avg_before, "
    f"round(avg(CASE WHEN period >= {TEST_START_DATE} THEN value END), 9) AS avg_after FROM ("
    f"SELECT install_date AS period, step_no, {wcw('pct')} AS value FROM cube "
    f"WHERE step_no IN {SHOWN} GROUP BY 1, 2 HAVING sum(total_users) > 0) GROUP BY step_no", FUNNEL)
ORACLE["trend_ba_summary"] = q(
    "SELECT step_no, before, CASE WHEN users_after > 0 THEN after END AS after, "
    "CASE WHEN users_after > 0 THEN after - before END AS delta, "
    "CASE WHEN users_after > 0 THEN CASE WHEN before > 0 THEN (after - before) / before * 100 "
    "ELSE 0.0 END END AS pct_change FROM (" + split_sql("") + ")", FUNNEL)
ORACLE["daily_steps"] = q(
    f"SELECT install_date, install_version, step_no, {wcw('pct')} AS value, "
    f"CAST(sum(total_users) AS BIGINT) AS users FROM cube WHERE step_no IN {SHOWN} "
    "GROUP BY 1, 2, 3", FUNNEL)
ORACLE["daily_ba_summary"] = q(split_sql("install_version"), FUNNEL)
for _name, _col, _lim in (("installs_by_version", "install_version", ""),
                          ("installs_by_media_type", "media_type", ""),
                          ("top_media_sources", "mediasource", " LIMIT 15")):
    ORACLE[_name] = q(
        f"SELECT {_col}, CAST(sum(total_users) AS BIGINT) AS users FROM cube_wide "
        f"WHERE {_col} IS NOT NULL GROUP BY 1 ORDER BY users DESC, {_col}{_lim}", FUNNEL, WIDE)
ORACLE["install_summary"] = q(
    "SELECT install_version, total_installs, days_with_data, "
    "round(total_installs / sum(total_installs) OVER () * 100, 1) AS share_pct FROM ("
    "SELECT install_version, CAST(sum(total_users) AS BIGINT) AS total_installs, "
    "count(DISTINCT install_date) AS days_with_data FROM cube_wide GROUP BY 1)", FUNNEL, WIDE)
LAST = PCT_SHOWN[-1]
V_LAST = f"""
vlast AS (
  SELECT install_version, {wcw('pct')} AS value, CAST(sum(total_users) AS BIGINT) AS users,
         {VKEY} AS vkey
  FROM cube WHERE step_no = {LAST} GROUP BY install_version
),
bw AS (
  SELECT (SELECT install_version FROM vlast ORDER BY value DESC, vkey ASC, install_version DESC LIMIT 1) AS best_version,
         max(value) AS best_value,
         (SELECT install_version FROM vlast ORDER BY value ASC, vkey ASC, install_version ASC LIMIT 1) AS worst_version,
         min(value) AS worst_value, count(*) AS n_versions, max(value) - min(value) AS gap
  FROM vlast
)"""
ORACLE["best_worst_version"] = q("SELECT * FROM bw", FUNNEL, V_LAST)

# ---------------------------------------------------------------- anomalies / alerts
MIN_SAMPLE = 10
SMALL = 35
LOW_SAMPLE = 10
ORACLE["anomaly_upticks"] = q(
    "SELECT install_version, step_no, prev_step_no, value, prev_value, "
    "(value - prev_value) * 100 AS uptick_pct, CASE WHEN step_no IN (9) THEN 'Known / Accepted' "
    f"ELSE 'Investigate' END AS status FROM vsl{MIN_SAMPLE} "
    "WHERE prev_value IS NOT NULL AND value > prev_value + 0.0005",
    FUNNEL, VS, vsl(MIN_SAMPLE))


def drops_sql(min_users: int) -> str:
    return (f"SELECT install_version, prev_step_no, step_no, prev_value AS from_value, "
            f"value AS to_value, prev_value - value AS drop_abs, "
            f"(prev_value - value) / prev_value * 100 AS drop_pct FROM vsl{min_users} "
            f"WHERE prev_value > 0")


ORACLE["biggest_dropoffs"] = q(
    "SELECT *, CASE WHEN drop_pct > 10 THEN 'red' WHEN drop_pct > 5 THEN 'yellow' ELSE 'green' "
    "END AS severity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY install_version "
    f"ORDER BY drop_abs DESC, step_no) AS INTEGER) AS rank FROM ({drops_sql(MIN_SAMPLE)})) "
    "WHERE rank <= 5", FUNNEL, VS, vsl(MIN_SAMPLE))
ORACLE["top3_drops"] = q(
    "SELECT install_version, rank, step_no, drop_pct, to_value FROM (SELECT *, "
    "CAST(row_number() OVER (PARTITION BY install_version ORDER BY drop_pct DESC, step_no) AS INTEGER) "
    f"AS rank FROM ({drops_sql(0)}) WHERE install_version = (SELECT install_version FROM "
    f"(SELECT DISTINCT install_version FROM cube) ORDER BY {VKEY}, install_version LIMIT 1)) "
    "WHERE rank <= 3", FUNNEL, VS, vsl(0))
ORACLE["alerts_funnel"] = q(
    "SELECT 'low_sample_version' AS alert, 'yellow' AS severity, install_version AS subject, "
    f"CAST(users AS DOUBLE) AS value FROM vlast WHERE users > 0 AND users < {LOW_SAMPLE} "
    "UNION ALL SELECT 'best_worst_gap', 'red', best_version || ' vs ' || worst_version, gap FROM bw "
    "WHERE best_value > 0 AND worst_value > 0 AND gap > 0.1 "
    "UNION ALL SELECT 'low_completion', 'yellow', install_version, 1 - value FROM ("
    "SELECT * FROM vlast WHERE value > 0 AND value < 0.5 ORDER BY vkey, install_version LIMIT 1)",
    FUNNEL, V_LAST)
ORACLE["alerts_trend"] = q(
    "SELECT 'biggest_improvement' AS alert, 'green' AS severity, CAST(g.step_no AS VARCHAR) AS subject, "
    "g.change_pct AS value FROM (SELECT step_no, change_pct FROM ch ORDER BY change_pct DESC, step_no "
    "LIMIT 1) g, ok WHERE ok.ok AND g.change_pct > 1 UNION ALL "
    "SELECT 'biggest_regression', 'red', CAST(d.step_no AS VARCHAR), d.change_pct FROM ("
    "SELECT step_no, change_pct FROM ch ORDER BY change_pct ASC, step_no LIMIT 1) d, ok "
    "WHERE ok.ok AND d.change_pct < -1", FUNNEL,
    "ss AS (" + split_sql("") + "), ch AS (SELECT step_no, (after - before) / before * 100 AS "
    "change_pct FROM ss WHERE before > 0), ok AS (SELECT max(users_before) > 0 AND "
    "max(users_after) > 0 AS ok FROM ss)")
ORACLE["alerts_installs"] = q(
    "SELECT 'dominant_version' AS alert, 'yellow' AS severity, install_version AS subject, "
    "users / t * 100 AS value FROM bv, (SELECT sum(users) AS t FROM bv) tv WHERE users / t * 100 > 80 "
    f"UNION ALL SELECT 'small_version', 'yellow', install_version, CAST(users AS DOUBLE) FROM bv "
    f"WHERE users < {SMALL} UNION ALL "
    "SELECT 'dominant_media_type', 'yellow', media_type, users / t * 100 FROM ("
    "SELECT media_type, users FROM bm ORDER BY users DESC, media_type ASC LIMIT 1), "
    "(SELECT sum(users) AS t FROM bm) tm WHERE t > 0 AND users / t * 100 > 70", FUNNEL, WIDE,
    "bv AS (SELECT install_version, CAST(sum(total_users) AS BIGINT) AS users FROM cube_wide "
    "GROUP BY 1), bm AS (SELECT media_type, CAST(sum(total_users) AS BIGINT) AS users FROM "
    "cube_wide WHERE media_type IS NOT NULL GROUP BY 1)")
_B = f"install_date < {TEST_START_DATE}"
ORACLE["alerts_retention"] = q(
    "SELECT 'd1_retention_improved' AS alert, 'green' AS severity, install_version AS subject, "
    "ra - rb AS value FROM d1, post WHERE post.post AND nb > 0 AND na > 0 AND ra - rb > 0.02 "
    "UNION ALL SELECT 'd1_retention_dropped', 'red', install_version, ra - rb FROM d1, post "
    "WHERE post.post AND nb > 0 AND na > 0 AND ra - rb < -0.02 UNION ALL "
    "SELECT 'small_cohort', 'yellow', install_version, CAST(cd0 AS DOUBLE) FROM ("
    "SELECT install_version, sum(cohort_size) AS cd0 FROM rcube WHERE days_since_install = 0 "
    f"GROUP BY 1) WHERE cd0 > 0 AND cd0 < {LOW_SAMPLE}", RET,
    f"d1 AS (SELECT install_version, {wret(_B)} AS rb, "
    f"coalesce(sum(CASE WHEN {_B} THEN cohort_size END), 0) AS nb, {wret('NOT (' + _B + ')')} AS ra, "
    f"coalesce(sum(CASE WHEN NOT ({_B}) THEN cohort_size END), 0) AS na FROM rcube "
    "WHERE days_since_install = 1 GROUP BY 1), "
    f"post AS (SELECT bool_or(NOT ({_B})) AS post FROM rcube)")

ORACLE["ba_funnel_ratio"] = q(
    "SELECT period, step_no, raw_value, min(raw_value) OVER (PARTITION BY period ORDER BY step_no "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, value AS plot_value, users, step1, "
    "false AS is_branch "
    f"FROM (SELECT period, step_no, {wcw('ratio', e='ratio_e4')} AS raw_value, "
    "CAST(sum(total_users) AS BIGINT) AS users, CAST(sum(raw_step_01) AS BIGINT) AS step1 "
    f"FROM tag WHERE step_no IN {SHOWN} GROUP BY period, step_no)", FUNNEL, BA)
# The same with the optional step 4 shown: it keeps its own value, the spine is capped.
BA_HINTS = BA.replace(f" WHERE step_no IN {SHOWN}", "").replace(
    "PARTITION BY period ORDER BY", "PARTITION BY period, step_no = 4 ORDER BY").replace(
    "false AS is_branch", "step_no = 4 AS is_branch").replace(
    "value AS plot_value", "CASE WHEN step_no <> 4 OR value > 0 THEN value END AS plot_value")
ORACLE["ba_funnel_hints"] = q("SELECT * FROM baf", FUNNEL, BA_HINTS)
for _name in ("ba_lift", "ba_significance", "ba_detail", "dropoff_transitions"):
    ORACLE[f"{_name}_hints"] = ORACLE[_name].replace(BA.strip(), BA_HINTS.strip())
# ... and with the conversion against the previous step.
BA_RATIO = BA.replace(wcw('pct'), wcw('ratio', e='ratio_e4'))
for _name in ("ba_lift", "ba_significance", "ba_detail"):
    ORACLE[f"{_name}_ratio"] = ORACLE[_name].replace(BA.strip(), BA_RATIO.strip())

_RATIO = (wcw('pct'), wcw('ratio', e='ratio_e4'))
ORACLE["version_funnel_ratio"] = ORACLE["version_funnel"].replace(*_RATIO)
ORACLE["step_trend_day_ratio"] = ORACLE["step_trend_day"].replace(*_RATIO)
ORACLE["daily_ba_summary_ratio"] = q(split_sql("install_version", "ratio"), FUNNEL)
ORACLE["version_delta"] = q(
    "SELECT install_version, step_no, before, after, CASE WHEN before > 0 AND after > 0 THEN after - before "
    f"END AS delta FROM ({split_sql('install_version')})", FUNNEL)
_FUNNEL_72H = funnel_ctes(install_lag=3, event_lag=3, observation=True)
ORACLE["ba_funnel_72h"] = ORACLE["ba_funnel"].replace(FUNNEL.strip(), _FUNNEL_72H.strip())
ORACLE["ba_lift_72h"] = ORACLE["ba_lift"].replace(FUNNEL.strip(), _FUNNEL_72H.strip())
_CHOSEN = ("(SELECT * FROM cube WHERE platform IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') "
           "AND install_version IN ('0.3811', '0.3812', '0.3813'))")
ORACLE["ba_funnel_filtered"] = q("SELECT * FROM baf", FUNNEL, BA.replace(tag_sql('cube'), tag_sql(_CHOSEN)))

# ---------------------------------------------------------------- documented modes
ORACLE["cube_load_72h_strict"] = q(
    "SELECT * FROM cube_wide WHERE install_date >= DATE '2024-01-01' "
    "AND TRY_CAST(install_version AS DOUBLE) >= 0.38 AND platform <> 'none'",
    funnel_ctes(install_lag=4, event_lag=1, observation=True), WIDE)
ORACLE["weighted_conversion_exact"] = q(
    "SELECT install_version, step_no, "
    "CASE WHEN sum(raw_step_01) > 0 THEN CAST(sum(users) AS DOUBLE) / CAST(sum(raw_step_01) AS DOUBLE) END AS pct_exact, "
    "CAST(sum(total_users) AS BIGINT) AS users, "
    "CASE WHEN count(prev_users) = 0 THEN 1.0 WHEN sum(prev_users) > 0 THEN "
    "CAST(sum(CASE WHEN prev_users IS NOT NULL THEN users END) AS DOUBLE) / CAST(sum(prev_users) AS DOUBLE) "
    "END AS ratio_exact FROM cube GROUP BY 1, 2", FUNNEL)
ORACLE["retention_weighted_all_cells"] = q(
    "SELECT install_version, days_since_install, CASE WHEN sum(cohort_size) > 0 THEN "
    "CAST(sum(users_active) AS DOUBLE) / CAST(sum(cohort_size) AS DOUBLE) ELSE 0.0 END AS retention, "
    "CAST(sum(cohort_size) AS BIGINT) AS cohort_size, CAST(sum(users_active) AS BIGINT) AS users_active "
    "FROM rcube WHERE days_since_install <= 14 GROUP BY 1, 2", RET)
ORACLE["ba_funnel_hints_reference_cap"] = q(
    "SELECT period, step_no, raw_value, capped AS value, CASE WHEN step_no = 4 AND capped = 0 THEN NULL "
    "ELSE capped END AS plot_value, users, step1, step_no = 4 AS is_branch FROM ("
    "SELECT *, min(raw_value) OVER (PARTITION BY period ORDER BY step_no ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND CURRENT ROW) AS capped FROM ("
    f"SELECT period, step_no, {wcw('pct')} AS raw_value, CAST(sum(total_users) AS BIGINT) AS users, "
    "CAST(sum(raw_step_01) AS BIGINT) AS step1 FROM tag GROUP BY period, step_no))", FUNNEL, BA)

# the onboarding funnels, over the scripted log: the module adds its entries to ORACLE
ORACLE["retention_d1_extremes"] = q(
    f"SELECT platform, count(*) AS n_versions, arg_min(install_version, (-d1, {VKEY}, install_version)) "
    "FILTER (d1 IS NOT NULL) AS best_version, max(d1) AS best_d1, "
    f"arg_min(install_version, (d1, {VKEY}, install_version)) FILTER (d1 IS NOT NULL) AS lowest_version, "
    "min(d1) AS lowest_d1 FROM (SELECT platform, install_version, "
    f"CASE WHEN sum(CASE WHEN days_since_install = 1 THEN cohort_size END) > 0 THEN {wret('days_since_install = 1')} "
    "END AS d1 FROM rcube WHERE days_since_install <= 1 GROUP BY 1, 2 "
    "HAVING coalesce(sum(CASE WHEN days_since_install = 0 THEN cohort_size END), 0) > 0) GROUP BY 1", RET)
ORACLE["tracking_summary"] = q(
    "SELECT " + ", ".join(
        f"(SELECT count(DISTINCT install_date) FROM {t}) AS {p}_days, "
        f"(SELECT count(DISTINCT install_version) FROM {t}) AS {p}_versions, "
        f"(SELECT coalesce(bool_or(install_date >= {TEST_START_DATE}), false) FROM {t}) AS {p}_post_test"
        for t, p in (("cube_wide", "funnel"), ("rcube", "retention"))), FUNNEL, WIDE, RET)
ORACLE["versions_retention_only_chosen"] = q(
    f"SELECT install_version FROM rcube EXCEPT SELECT install_version FROM cube_wide WHERE {VKEY} >= 0.3812",
    FUNNEL, WIDE, RET)
ORACLE["alerts_installs_one_day"] = ORACLE["alerts_installs"].replace(
    "FROM cube_wide", "FROM (SELECT * FROM cube_wide WHERE install_date = DATE '2024-01-10')")

# a view: the same reports over the rows that it has
_VIEW_BOTH = ("install_date >= DATE '2024-01-01' AND install_date <= DATE '2024-01-06' "
              "AND platform IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') "
              f"AND install_version IN ('0.3810', '0.3812', '0.3813') AND {VKEY} >= 0.3811")
_VIEW_FUNNEL = (_VIEW_BOTH + " AND NOT coalesce(install_date = DATE '2024-01-01' AND install_hour < 6, false) "
                "AND NOT coalesce(install_date = DATE '2024-01-06' AND install_hour > 18, false) "
                "AND NOT is_low_payers_country")
_OVER = {"cube": f"(SELECT * FROM cube WHERE {_VIEW_FUNNEL})",
         "cube_wide": f"(SELECT * FROM cube_wide WHERE {_VIEW_FUNNEL})",
         "rcube": f"(SELECT * FROM rcube WHERE {_VIEW_BOTH} AND is_usa = 0)"}


def of_view(name: str, table: str) -> str:
    """A report's statement over the view's rows of ``table``: every use but
    the table's own definition."""
    return re.sub(rf"FROM\s+{table}\b", f"FROM {_OVER[table]}", ORACLE[name])


ORACLE["view_version_funnel"] = of_view("version_funnel", "cube")
ORACLE["view_step_trend_day"] = of_view("step_trend_day", "cube")
ORACLE["view_dimension_counts"] = of_view("dimension_counts", "cube_wide")
ORACLE["view_biggest_dropoffs"] = of_view("biggest_dropoffs", "cube").replace(f"vsl{MIN_SAMPLE}", "vsl1").replace(
    vsl(MIN_SAMPLE).strip("\n").replace(f"vsl{MIN_SAMPLE}", "vsl1"), vsl(1).strip("\n"))
ORACLE["view_retention_matrix"] = of_view("retention_matrix", "rcube")
ORACLE["view_alerts_installs"] = of_view("alerts_installs", "cube_wide")
ORACLE["view_coverage"] = ORACLE["coverage"].replace("platform IN ('BUILDING', 'MACHINERY')", _VIEW_FUNNEL)

import cohortflow.catalog.main_oracle  # noqa: E402,F401
