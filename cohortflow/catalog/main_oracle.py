"""DuckDB SQL of the 50- and 48-step funnels over the scripted log.

The rules are spelled out as text, apart from the engine's own step objects.
A rule: step number, event (``@`` chapter, ``#`` dialog; a second one after
``|`` is for versions of the band), then ``has`` an anchor, ``ge`` not before
it, ``in`` at most the window after it, ``lt`` / ``le`` before / not after it
where it exists, ``gap a b``: b at most the window after a.
"""

from __future__ import annotations

from cohortflow.catalog import oracle_sql as o
from cohortflow.operators.alerts import OTHER_UPTICK, UPTICK_CAUSES
from cohortflow.sources.scripted import SCRIPT

# The analysed application's anchors and step rules.
ANCHORS = """
flow1_step0 impression_ftue_flow1_step0
flow1_step1 impression_ftue_flow1_step1
flow1_step2 impression_ftue_flow1_step2
flow1_step3 impression_ftue_flow1_step3
flow1_step4 impression_ftue_flow1_step4
flow1_step5 impression_ftue_flow1_step5
flow1_step6 impression_ftue_flow1_step6
flow1_step7 impression_ftue_flow1_step7
flow2_step0 impression_ftue_flow2_step0
flow2_step1 impression_ftue_flow2_step1
flow2_step2 impression_ftue_flow2_step2
flow2_step5 impression_ftue_flow2_step5
flow2_1_step0 impression_ftue_flow2.1_step0
flow3_step0 impression_ftue_flow3_step0
flow3_step6 impression_ftue_flow3_step6@2
flow3_step8 impression_ftue_flow3_step8@2
privacy impression_privacy
how_to_play impression_how_to_play
board_scapes click_board_button_scapes
first_merge merge
"""
RULES = """
1 impression_privacy
2 impression_scapes@1; has privacy; in privacy; lt flow1_step2
3 board_tasks_new_task; ge privacy; in privacy; lt flow1_step2
4 impression_dialog#1001199; in privacy
5 click_dialog_exit#1001199; in privacy
6 impression_ftue_flow1_step0; in privacy
7 impression_ftue_flow1_step1; has privacy; gap privacy flow1_step0; in flow1_step0
8 click_board_button_scapes; ge flow1_step1; in flow1_step1; le flow1_step2
9 impression_board; ge flow1_step1; ge board_scapes; in flow1_step1; le flow1_step2
10 impression_ftue_flow1_step2; in flow1_step1
11 generation; lt first_merge; ge flow1_step2; in flow1_step2; le flow1_step3
12 impression_ftue_flow1_step3; in flow1_step2
13 merge; ge flow1_step3; in flow1_step3; le flow1_step4
14 impression_ftue_flow1_step4; in flow1_step3
15 board_tasks_task_ready; ge flow1_step4; in flow1_step4; le flow1_step5
16 impression_ftue_flow1_step5; in flow1_step4
17 click_board_tasks_go; ge flow1_step5; in flow1_step5; le flow1_step6
18 rewards_board_task; ge flow1_step5; in flow1_step5; le flow1_step6
19 impression_ftue_flow1_step6; in flow1_step5
20 generation; ge first_merge; ge flow1_step6; in flow1_step6; le flow1_step7
21 impression_ftue_flow1_step7; in flow1_step6
22 impression_how_to_play; ge flow1_step7; in flow1_step7; le flow2_step0
23 click_scapes_button_board; ge how_to_play; le flow2_step0
24 impression_ftue_flow2_step0; ge how_to_play; in how_to_play
25 impression_dialog#10013; has how_to_play; ge flow2_step0; in flow2_step0; le flow2_step1
26 click_scapes_tasks_go_button; has how_to_play; ge flow2_step0; in flow2_step0; le flow2_step1
27 scapes_tasks_cash_deducted; has how_to_play; ge flow2_step0; in flow2_step0; le flow2_step1
28 rewards_scape_task; has how_to_play; ge flow2_step0; in flow2_step0; le flow2_step1
29 click_dialog_exit#10013; has how_to_play; ge flow2_step0; in flow2_step0; le flow2_step1
30 impression_ftue_flow2_step1; has how_to_play; in flow2_step0
31 impression_dialog#10015; has how_to_play; ge flow2_step1; in flow2_step1; le flow2_step2
32 impression_ftue_flow2_step2; has how_to_play; in flow2_step1
33 impression_ship_animation_started; has how_to_play; ge flow2_step2; in flow2_step2; le flow2_step5
34 impression_ftue_flow2_step5; has how_to_play; in flow2_step2
35 impression_ftue_flow2.1_step0; has how_to_play; in flow2_step5
36 impression_ftue_flow2.1_step1; has how_to_play; has flow2_1_step0; in flow2_step5
37 impression_ftue_flow3_step0|impression_ftue_flow3_step1; has how_to_play; in flow2_step5
38 scapes_tasks_new_chapter@2; has how_to_play; ge flow3_step0; in flow3_step0; le flow3_step6
39 impression_ftue_flow3_step1@2|impression_ftue_flow3_step2@2; has how_to_play; in flow3_step0
40 impression_ftue_flow3_step2@2|impression_ftue_flow3_step3@2; has how_to_play; in flow3_step0
41 click_harvest_collect@2; has how_to_play; ge flow3_step0; in flow3_step0; le flow3_step6
42 impression_ftue_flow3_step6@2|impression_ftue_flow3_step7@2; has how_to_play; in flow3_step0
43 click_reward_center; has how_to_play; ge flow3_step6; in flow3_step6; le flow3_step8
44 impression_ftue_flow3_step8@2|impression_ftue_flow3_step9@2; has how_to_play; in flow3_step6
45 impression_ftue_flow12_step0; has how_to_play; ge flow3_step8; in flow3_step8
46 impression_ftue_flow12_step4; has how_to_play; ge flow3_step8; in flow3_step8
47 scapes_tasks_new_chapter@3; has how_to_play; ge flow3_step8
48 click_harvest_collect@3; has how_to_play; ge flow3_step8
49 scapes_tasks_new_chapter@4; has how_to_play
50 scapes_tasks_new_chapter@5; has how_to_play
"""
WINDOW_MS = 30 * 60 * 1000


def _event(text: str, table: str = "") -> str:
    name, _, dialog = text.partition("#")
    name, _, chapter = name.partition("@")
    sql = f"{table}mp_event_name = '{name}'"
    if chapter:
        sql += f" AND {table}chapter = {chapter}"
    if dialog:
        sql += f" AND {table}dialog_id = '{dialog}'"
    return f"({sql})"


def _rule(event: str, conditions: list[str]) -> str:
    normal, _, band = event.partition("|")
    sql = _event(normal, "u.") if not band else (
        f"((u.is_buggy_version AND {_event(band, 'u.')}) OR (NOT u.is_buggy_version AND {_event(normal, 'u.')}))")
    for c in conditions:
        kind, a, *b = c.split()
        sql += " AND " + {"has": f"a.{a} IS NOT NULL", "ge": f"u.res_timestamp >= a.{a}",
                          "in": f"u.res_timestamp - a.{a} <= {WINDOW_MS}",
                          "lt": f"(a.{a} IS NULL OR u.res_timestamp < a.{a})",
                          "le": f"(a.{a} IS NULL OR u.res_timestamp <= a.{a})",
                          "gap": f"a.{b[0] if b else a} - a.{a} <= {WINDOW_MS}"}[kind]
    return sql


def _text(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


SCRIPTED = o.BASE.replace("\nev AS (", "\nev0 AS (") + f""",
script(pos, e, c, d) AS (
  VALUES {', '.join(f"({i}, {_text(e)}, CAST({_text(c)} AS INTEGER), CAST({_text(d)} AS VARCHAR))"
                    for i, (e, c, d) in enumerate(SCRIPT))}
),
ranked AS (
  SELECT distinct_id, mp_event_name AS kind, coalesce(TRY_CAST(dialog_id AS INTEGER), 1) AS k,
         row_number() OVER (PARTITION BY distinct_id ORDER BY res_timestamp, mp_event_name,
                            dialog_id NULLS FIRST) - 1 AS n,
         min(res_timestamp) OVER (PARTITION BY distinct_id) AS base
  FROM ev0
),
timed AS (
  SELECT r.*, s.e, s.c, s.d, base + n * 60000 + k % 40 * 1000 + CASE WHEN k = 95 THEN 2700000 ELSE 0 END
         - CASE WHEN kind = 'error' AND k < 3 THEN 90000 ELSE 0 END AS t
  FROM ranked r JOIN script s ON s.pos = r.n % {len(SCRIPT)}
),
ev AS (
  SELECT distinct_id, CASE WHEN k % 50 = 31 AND n > 0 THEN 'other' ELSE e END AS mp_event_name,
         t AS res_timestamp, CAST(make_timestamp(t * 1000) AS DATE) AS date, c AS chapter, d AS dialog_id
  FROM timed
)"""


def main_ctes(steps: list[tuple[int, str]], branch: tuple[int, ...], install_lag: int, event_lag: int,
              observation_ms: int | None) -> list[str]:
    """The tables up to ``counts`` per cell.  ``steps``: (number, rule text) in order."""
    bound = f" AND e.res_timestamp <= epoch_us(c.first_event_time) // 1000 + {observation_ms}" if observation_ms else ""
    anchors = ", ".join(f"min(CASE WHEN {_event(e)} THEN res_timestamp END) AS {a}"
                        for a, e in (line.split() for line in ANCHORS.split("\n") if line))
    flags, gates, passed, chain = [], [], [], []
    for no, text in steps:
        event, *conditions = [x.strip() for x in text.split(";")]
        flags.append(f"max(CASE WHEN {_rule(event, conditions)} THEN 1 ELSE 0 END) AS f{no}")
        if no in branch:
            chain.append(no)
            gates.append((no, passed + chain))
        else:
            passed.append(no)
            gates.append((no, list(passed)))
    mono = ", ".join(f"{' * '.join(f'f{x}' for x in need)} AS {o.s(no)}" for no, need in gates)
    dims = ", ".join("c." + d.strip() for d in o.DIMS.split(","))
    return [o.cohort_cte(install_lag), f"""
uev AS (
  SELECT e.*, c.is_buggy_version FROM ev e JOIN cohort c ON e.distinct_id = c.distinct_id
  WHERE e.date >= {o.AS_OF} - 90 AND e.date <= {o.AS_OF} - {event_lag}{bound}
),
anc AS (SELECT distinct_id, {anchors} FROM uev GROUP BY distinct_id),
flags AS (SELECT u.distinct_id, {', '.join(flags)} FROM uev u JOIN anc a ON u.distinct_id = a.distinct_id
          GROUP BY u.distinct_id),
mono AS (SELECT distinct_id, {mono} FROM flags),
counts AS (
  SELECT {dims}, count(DISTINCT m.distinct_id) AS total_users,
         {', '.join(f'CAST(sum(m.{o.s(no)}) AS BIGINT) AS {o.s(no)}' for no, _ in steps)}
  FROM mono m JOIN cohort c ON m.distinct_id = c.distinct_id GROUP BY {dims}
)"""]


WITH_MEDIA = """
SELECT v.*, coalesce(mt.media_type, CASE WHEN v.mediasource = 'organic' THEN 'organic' ELSE 'none' END) AS media_type
FROM counts v LEFT JOIN mtm mt ON v.mediasource = mt.mediasource WHERE coalesce(v.step_01, 0) <> 0"""


def main_sql(*spec) -> str:
    """Counts per cell and step (``main_ctes``)."""
    return o.with_(SCRIPTED, *main_ctes(*spec)) + WITH_MEDIA


def _rules() -> list[tuple[int, str]]:
    return [(int(line.partition(" ")[0]), line.partition(" ")[2]) for line in RULES.split("\n") if line]


def _rules_72h() -> list[tuple[int, str]]:
    """Without the optional steps; chapter 3 within the window."""
    out = []
    for no, text in _rules():
        if no not in (35, 36):
            out.append((no if no < 35 else no - 2, text + "; in flow3_step8" if no in (47, 48) else text))
    return out


MAIN = {
    "main_funnel_cube": main_sql(_rules(), (35, 36), 2, 1, None),
    "main_funnel_72h_cube": main_sql(_rules_72h(), (), 3, 3, o.OBS_MS),
}
o.ORACLE.update(MAIN)

# Reports on the 50-step cube: the demo funnel's statements, with this cube in
# place of that one, the optional steps shown, and this funnel's last step.
_NUMBERS = [no for no, _ in _rules()]
_LONG = " UNION ALL ".join(f"SELECT {o.CUBE_DIMS}, total_users, step_01 AS raw_step_01, {n} AS step_no, "
                           f"{o.s(n)} AS users FROM cube_w" for n in _NUMBERS)
_MAIN_CUBE = ",".join(c.strip("\n") for c in [
    *main_ctes(_rules(), (35, 36), 2, 1, None), f"cube_w AS ({WITH_MEDIA})", f"cube_l AS ({_LONG})",
    f"""cube AS (SELECT *, {o.e4('users', 'raw_step_01')} AS pct_e4, {o.r4('users', 'raw_step_01')} AS pct
 FROM cube_l)"""])


def on_main_cube(sql: str, shown: list[int]) -> str:
    for old, new in ((o.BASE.strip("\n"), SCRIPTED.strip("\n")), (o.FUNNEL.strip("\n"), _MAIN_CUBE),
                     (o.SHOWN, "(" + ", ".join(map(str, shown)) + ")"), (f"step_no = {o.LAST}\n", "step_no = 48\n"),
                     (f"step_no = {o.LAST} ", "step_no = 48 ")):
        sql = sql.replace(old, new)
    return sql


_SHOWN = [n for n in _NUMBERS if n <= 48]                   # chapters 4 and 5 are hidden
_SPINE = [n for n in _SHOWN if n not in (35, 36)]
_CAUSE = "CASE step_no " + " ".join(f"WHEN {n} THEN '{cause}'" for n, (cause, _) in UPTICK_CAUSES.items()) + (
    f" ELSE '{OTHER_UPTICK[0]}' END AS root_cause")
_FIX = "CASE step_no " + " ".join(f"WHEN {n} THEN '{fix}'" for n, (_, fix) in UPTICK_CAUSES.items()) + (
    f" ELSE '{OTHER_UPTICK[1]}' END AS suggested_fix")
o.ORACLE["main_upticks"] = on_main_cube(o.ORACLE["anomaly_upticks"], _SHOWN).replace(
    "END AS status FROM", f"END AS status, {_CAUSE}, {_FIX} FROM")
o.ORACLE["main_dropoffs"] = on_main_cube(o.ORACLE["biggest_dropoffs"], _SHOWN)
o.ORACLE["main_funnel_alerts"] = on_main_cube(o.ORACLE["alerts_funnel"], _SPINE)
o.ORACLE["main_trend_alerts"] = on_main_cube(o.ORACLE["alerts_trend"], _SPINE)

# Builds by another way give the cubes of the plain builds.
o.ORACLE["shared_main_cube"] = MAIN["main_funnel_cube"]
o.ORACLE["shared_main_72h_cube"] = MAIN["main_funnel_72h_cube"]
o.ORACLE["shared_retention_cube"] = o.ORACLE["retention_cube"]
o.ORACLE["partials_funnel_counts"] = o.ORACLE["funnel_cube_counts"]
o.ORACLE["partials_retention_cube"] = o.ORACLE["retention_cube"]
