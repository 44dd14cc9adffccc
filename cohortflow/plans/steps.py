"""Declarative funnel specification.

A funnel is a list of *anchors* (per-user first timestamp of an event) and an
ordered list of *steps*.  A user passes a step when ANY of their events
matches the step's event and satisfies every time rule relative to the
anchors (the reference's "anchored funnel": order is enforced by the anchors
and by monotonic gating, not by event order).

Time rules, with ``t`` the event time in epoch milliseconds:

* ``requires=(a,)``      anchor ``a`` exists
* ``after=(a,)``         ``t >= a``                     (needs ``a``)
* ``within=(a,)``        ``t - a <= window_ms``         (needs ``a``; no lower bound)
* ``before=(a,)``        ``a`` is NULL or ``t < a``
* ``until=(a,)``         ``a`` is NULL or ``t <= a``
* ``gap=((a, b),)``      ``b - a <= window_ms``         (anchor to anchor)

``alt`` replaces ``match`` for versions inside the configured version band
(versions that shipped shifted event names).  ``branch=True`` marks optional
steps: they are gated by the spine before them but do not gate later steps.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EventMatch:
    event: str
    chapter: int | None = None
    dialog_id: str | None = None

    def describe(self) -> str:
        s = self.event
        if self.chapter is not None:
            s += f" [chapter {self.chapter}]"
        if self.dialog_id is not None:
            s += f" [dialog {self.dialog_id}]"
        return s


@dataclass(frozen=True)
class Anchor:
    name: str
    match: EventMatch


@dataclass(frozen=True)
class Step:
    no: int
    name: str
    match: EventMatch
    alt: EventMatch | None = None
    requires: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    within: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    until: tuple[str, ...] = ()
    gap: tuple[tuple[str, str], ...] = ()
    branch: bool = False
    group: str = "core"

    @property
    def anchors_used(self) -> set[str]:
        used = set(self.requires) | set(self.after) | set(self.within)
        used |= set(self.before) | set(self.until)
        for a, b in self.gap:
            used |= {a, b}
        return used

    def describe(self, window_ms: int) -> str:
        mins = window_ms / 60000
        win = f"{mins:g} min" if mins < 120 else f"{mins / 60:g} h"
        parts = [self.match.describe()]
        if self.alt is not None:
            parts.append(f"(band versions: {self.alt.describe()})")
        parts += [f"needs {a}" for a in self.requires]
        parts += [f"at/after {a}" for a in self.after]
        parts += [f"within {win} of {a}" for a in self.within]
        parts += [f"before {a}" for a in self.before]
        parts += [f"not after {a}" for a in self.until]
        parts += [f"{b} within {win} of {a}" for a, b in self.gap]
        return "; ".join(parts)


@dataclass(frozen=True)
class FunnelSpec:
    name: str
    anchors: tuple[Anchor, ...]
    steps: tuple[Step, ...]
    window_ms: int
    observation_ms: int | None = None   # keep only events within this time of install
    hidden_groups: tuple[str, ...] = ()  # step groups hidden by default in reports

    def __post_init__(self):
        names = {a.name for a in self.anchors}
        for s in self.steps:
            missing = s.anchors_used - names
            if missing:
                raise ValueError(f"step {s.no} uses unknown anchors {sorted(missing)}")
        nos = [s.no for s in self.steps]
        if nos != sorted(nos) or len(set(nos)) != len(nos):
            raise ValueError("steps must be numbered in increasing order")

    # -- structure ---------------------------------------------------------
    @property
    def spine(self) -> list[Step]:
        return [s for s in self.steps if not s.branch]

    def prev_spine_no(self, step: Step) -> int | None:
        """Previous spine step (the ratio denominator); branches chain."""
        prev = None
        for s in self.steps:
            if s.no >= step.no:
                break
            if step.branch:
                prev = s.no           # a branch step is compared to whatever precedes it
            elif not s.branch:
                prev = s.no
        return prev

    def gate(self, step: Step) -> tuple[int, list[int]]:
        """(number of spine steps that must pass, branch steps that must pass)."""
        spine_before = [s.no for s in self.spine if s.no < step.no]
        if not step.branch:
            return len(spine_before) + 1, []
        chain = []
        for s in self.steps:
            if s.no > step.no:
                break
            if s.branch:
                chain.append(s.no)
            elif s.no < step.no:
                chain = []
        return len(spine_before), chain

    def event_names(self) -> list[str]:
        names = set()
        for a in self.anchors:
            names.add(a.match.event)
        for s in self.steps:
            names.add(s.match.event)
            if s.alt is not None:
                names.add(s.alt.event)
        return sorted(names)

    def step_rows(self) -> list[dict]:
        out = []
        for s in self.steps:
            out.append(dict(
                step_no=s.no, step_name=s.name, event=s.match.event,
                description=s.describe(self.window_ms), is_branch=s.branch,
                step_group=s.group, prev_spine_no=self.prev_spine_no(s),
            ))
        return out


_MIN = 60 * 1000
_HOUR = 60 * _MIN


def _m(event, chapter=None, dialog_id=None):
    return EventMatch(event, chapter, dialog_id)


# ---------------------------------------------------------------------------
# The reference's onboarding funnel (50 steps, 30-minute rule).
# Event names, chapters, dialog ids and anchor names must equal the
# reference's for equal results.
# ---------------------------------------------------------------------------
def _main_anchors(with_hint_anchor: bool) -> tuple[Anchor, ...]:
    a = [
        Anchor("privacy", _m("impression_privacy")),
        Anchor("flow1_step0", _m("impression_ftue_flow1_step0")),
        Anchor("flow1_step1", _m("impression_ftue_flow1_step1")),
        Anchor("flow1_step2", _m("impression_ftue_flow1_step2")),
        Anchor("flow1_step3", _m("impression_ftue_flow1_step3")),
        Anchor("flow1_step4", _m("impression_ftue_flow1_step4")),
        Anchor("flow1_step5", _m("impression_ftue_flow1_step5")),
        Anchor("flow1_step6", _m("impression_ftue_flow1_step6")),
        Anchor("flow1_step7", _m("impression_ftue_flow1_step7")),
        Anchor("flow2_step0", _m("impression_ftue_flow2_step0")),
        Anchor("flow2_step1", _m("impression_ftue_flow2_step1")),
        Anchor("flow2_step2", _m("impression_ftue_flow2_step2")),
        Anchor("flow2_step5", _m("impression_ftue_flow2_step5")),
        Anchor("flow3_step0", _m("impression_ftue_flow3_step0")),
        Anchor("flow3_step6_ch2", _m("impression_ftue_flow3_step6", 2)),
        Anchor("flow3_step8_ch2", _m("impression_ftue_flow3_step8", 2)),
        Anchor("how_to_play", _m("impression_how_to_play")),
        Anchor("click_board_scapes", _m("click_board_button_scapes")),
        Anchor("first_merge", _m("merge")),
    ]
    if with_hint_anchor:
        a.append(Anchor("flow2_1_step0", _m("impression_ftue_flow2.1_step0")))
    return tuple(a)


def _flow_steps_1_to_34() -> list[Step]:
    S = Step
    return [
        S(1, "impression_privacy", _m("impression_privacy")),
        S(2, "impression_scapes_ch1", _m("impression_scapes", 1),
          requires=("privacy",), within=("privacy",), before=("flow1_step2",)),
        S(3, "board_tasks_new_task", _m("board_tasks_new_task"),
          after=("privacy",), within=("privacy",), before=("flow1_step2",)),
        S(4, "impression_dialog_1001199", _m("impression_dialog", dialog_id="1001199"),
          within=("privacy",)),
        S(5, "click_dialog_exit_1001199", _m("click_dialog_exit", dialog_id="1001199"),
          within=("privacy",)),
        S(6, "ftue_flow1_step0", _m("impression_ftue_flow1_step0"), within=("privacy",)),
        S(7, "ftue_flow1_step1", _m("impression_ftue_flow1_step1"),
          requires=("flow1_step0", "privacy"), gap=(("privacy", "flow1_step0"),),
          within=("flow1_step0",)),
        S(8, "click_board_button_scapes", _m("click_board_button_scapes"),
          after=("flow1_step1",), within=("flow1_step1",), until=("flow1_step2",)),
        S(9, "impression_board", _m("impression_board"),
          after=("flow1_step1", "click_board_scapes"), within=("flow1_step1",),
          until=("flow1_step2",)),
        S(10, "ftue_flow1_step2", _m("impression_ftue_flow1_step2"), within=("flow1_step1",)),
        S(11, "generation_before_merge", _m("generation"), before=("first_merge",),
          after=("flow1_step2",), within=("flow1_step2",), until=("flow1_step3",)),
        S(12, "ftue_flow1_step3", _m("impression_ftue_flow1_step3"), within=("flow1_step2",)),
        S(13, "first_merge", _m("merge"),
          after=("flow1_step3",), within=("flow1_step3",), until=("flow1_step4",)),
        S(14, "ftue_flow1_step4", _m("impression_ftue_flow1_step4"), within=("flow1_step3",)),
        S(15, "board_tasks_task_ready", _m("board_tasks_task_ready"),
          after=("flow1_step4",), within=("flow1_step4",), until=("flow1_step5",)),
        S(16, "ftue_flow1_step5", _m("impression_ftue_flow1_step5"), within=("flow1_step4",)),
        S(17, "click_board_tasks_go", _m("click_board_tasks_go"),
          after=("flow1_step5",), within=("flow1_step5",), until=("flow1_step6",)),
        S(18, "rewards_board_task", _m("rewards_board_task"),
          after=("flow1_step5",), within=("flow1_step5",), until=("flow1_step6",)),
        S(19, "ftue_flow1_step6", _m("impression_ftue_flow1_step6"), within=("flow1_step5",)),
        S(20, "generation_after_merge", _m("generation"),
          after=("first_merge", "flow1_step6"), within=("flow1_step6",), until=("flow1_step7",)),
        S(21, "ftue_flow1_step7", _m("impression_ftue_flow1_step7"), within=("flow1_step6",)),
        S(22, "impression_how_to_play", _m("impression_how_to_play"),
          after=("flow1_step7",), within=("flow1_step7",), until=("flow2_step0",)),
        S(23, "click_scapes_button_board", _m("click_scapes_button_board"),
          after=("how_to_play",), until=("flow2_step0",)),
        S(24, "ftue_flow2_step0", _m("impression_ftue_flow2_step0"),
          after=("how_to_play",), within=("how_to_play",)),
        S(25, "impression_dialog_10013", _m("impression_dialog", dialog_id="10013"),
          requires=("how_to_play",), after=("flow2_step0",), within=("flow2_step0",),
          until=("flow2_step1",)),
        S(26, "click_scapes_tasks_go_button", _m("click_scapes_tasks_go_button"),
          requires=("how_to_play",), after=("flow2_step0",), within=("flow2_step0",),
          until=("flow2_step1",)),
        S(27, "scapes_tasks_cash_deducted", _m("scapes_tasks_cash_deducted"),
          requires=("how_to_play",), after=("flow2_step0",), within=("flow2_step0",),
          until=("flow2_step1",)),
        S(28, "rewards_scape_task", _m("rewards_scape_task"),
          requires=("how_to_play",), after=("flow2_step0",), within=("flow2_step0",),
          until=("flow2_step1",)),
        S(29, "click_dialog_exit_10013", _m("click_dialog_exit", dialog_id="10013"),
          requires=("how_to_play",), after=("flow2_step0",), within=("flow2_step0",),
          until=("flow2_step1",)),
        S(30, "ftue_flow2_step1", _m("impression_ftue_flow2_step1"),
          requires=("how_to_play",), within=("flow2_step0",)),
        S(31, "impression_dialog_10015", _m("impression_dialog", dialog_id="10015"),
          requires=("how_to_play",), after=("flow2_step1",), within=("flow2_step1",),
          until=("flow2_step2",)),
        S(32, "ftue_flow2_step2", _m("impression_ftue_flow2_step2"),
          requires=("how_to_play",), within=("flow2_step1",)),
        S(33, "ship_animation", _m("impression_ship_animation_started"),
          requires=("how_to_play",), after=("flow2_step2",), within=("flow2_step2",),
          until=("flow2_step5",)),
        S(34, "ftue_flow2_step5", _m("impression_ftue_flow2_step5"),
          requires=("how_to_play",), within=("flow2_step2",)),
    ]


def _flow3_steps(first_no: int, chapter3_within: bool) -> list[Step]:
    """Chapter-2 tutorial through chapter 5, numbered from ``first_no``."""
    S = Step
    n = first_no
    ch3 = ("flow3_step8_ch2",) if chapter3_within else ()
    return [
        S(n, "ftue_flow3_step0", _m("impression_ftue_flow3_step0"),
          alt=_m("impression_ftue_flow3_step1"),
          requires=("how_to_play",), within=("flow2_step5",)),
        S(n + 1, "new_chapter_2", _m("scapes_tasks_new_chapter", 2),
          requires=("how_to_play",), after=("flow3_step0",), within=("flow3_step0",),
          until=("flow3_step6_ch2",)),
        S(n + 2, "ftue_flow3_step1_ch2", _m("impression_ftue_flow3_step1", 2),
          alt=_m("impression_ftue_flow3_step2", 2),
          requires=("how_to_play",), within=("flow3_step0",)),
        S(n + 3, "ftue_flow3_step2_ch2", _m("impression_ftue_flow3_step2", 2),
          alt=_m("impression_ftue_flow3_step3", 2),
          requires=("how_to_play",), within=("flow3_step0",)),
        S(n + 4, "click_harvest_collect_ch2", _m("click_harvest_collect", 2),
          requires=("how_to_play",), after=("flow3_step0",), within=("flow3_step0",),
          until=("flow3_step6_ch2",)),
        S(n + 5, "ftue_flow3_step6_ch2", _m("impression_ftue_flow3_step6", 2),
          alt=_m("impression_ftue_flow3_step7", 2),
          requires=("how_to_play",), within=("flow3_step0",)),
        S(n + 6, "click_reward_center", _m("click_reward_center"),
          requires=("how_to_play",), after=("flow3_step6_ch2",), within=("flow3_step6_ch2",),
          until=("flow3_step8_ch2",)),
        S(n + 7, "ftue_flow3_step8_ch2", _m("impression_ftue_flow3_step8", 2),
          alt=_m("impression_ftue_flow3_step9", 2),
          requires=("how_to_play",), within=("flow3_step6_ch2",)),
        S(n + 8, "ftue_flow12_step0", _m("impression_ftue_flow12_step0"),
          requires=("how_to_play",), after=("flow3_step8_ch2",), within=("flow3_step8_ch2",)),
        S(n + 9, "ftue_flow12_step4", _m("impression_ftue_flow12_step4"),
          requires=("how_to_play",), after=("flow3_step8_ch2",), within=("flow3_step8_ch2",)),
        S(n + 10, "new_chapter_3", _m("scapes_tasks_new_chapter", 3),
          requires=("how_to_play",), after=("flow3_step8_ch2",), within=ch3),
        S(n + 11, "click_harvest_collect_ch3", _m("click_harvest_collect", 3),
          requires=("how_to_play",), after=("flow3_step8_ch2",), within=ch3),
        S(n + 12, "new_chapter_4", _m("scapes_tasks_new_chapter", 4),
          requires=("how_to_play",), group="chapters_4_5"),
        S(n + 13, "new_chapter_5", _m("scapes_tasks_new_chapter", 5),
          requires=("how_to_play",), group="chapters_4_5"),
    ]


def main_funnel(window_ms: int = 30 * _MIN) -> FunnelSpec:
    """The 50-step funnel with the optional hint branch (steps 35, 36)."""
    hint = [
        Step(35, "ftue_flow2_1_step0_NEW", _m("impression_ftue_flow2.1_step0"),
             requires=("how_to_play",), within=("flow2_step5",), branch=True, group="hint"),
        Step(36, "ftue_flow2_1_step1_NEW", _m("impression_ftue_flow2.1_step1"),
             requires=("how_to_play", "flow2_1_step0"), within=("flow2_step5",),
             branch=True, group="hint"),
    ]
    steps = _flow_steps_1_to_34() + hint + _flow3_steps(37, chapter3_within=False)
    return FunnelSpec("main", _main_anchors(True), tuple(steps), window_ms,
                      hidden_groups=("hint", "chapters_4_5"))


def funnel_72h(window_ms: int = 30 * _MIN, observation_ms: int = 72 * _HOUR) -> FunnelSpec:
    """The 48-step variant: no hint branch, events limited to 72 h after install."""
    steps = _flow_steps_1_to_34() + _flow3_steps(35, chapter3_within=True)
    return FunnelSpec("main_72h", _main_anchors(False), tuple(steps), window_ms,
                      observation_ms=observation_ms, hidden_groups=("chapters_4_5",))


# ---------------------------------------------------------------------------
# Funnel over the driver's synthetic event log (signup/view/click/purchase/error).
# Exercises every step kind: entry, within+after, optional branch, attribute
# filter, version-band alias, unbounded "after", requires-only.
# ---------------------------------------------------------------------------
def demo_funnel(window_ms: int = 48 * _HOUR, observation_ms: int | None = None) -> FunnelSpec:
    anchors = (
        Anchor("signup", _m("signup")),
        Anchor("view", _m("view")),
        Anchor("click", _m("click")),
        Anchor("purchase", _m("purchase")),
    )
    S = Step
    steps = (
        S(1, "signup", _m("signup")),
        S(2, "view_after_signup", _m("view"), after=("signup",), within=("signup",)),
        S(3, "click_after_signup", _m("click"), after=("signup",), within=("signup",)),
        S(4, "click_ch1_hint", _m("click", 1), after=("signup",), within=("signup",),
          until=("purchase",), branch=True, group="hint"),
        S(5, "purchase_after_click", _m("purchase"), after=("click",), within=("click",)),
        S(6, "error_after_purchase", _m("error"), after=("purchase",), within=("purchase",)),
        S(7, "click_ch2_any_time", _m("click", 2), alt=_m("view", 2), after=("purchase",)),
        S(8, "purchase_ch4", _m("purchase", 4), requires=("view",), group="late"),
    )
    return FunnelSpec("demo", anchors, steps, window_ms, observation_ms=observation_ms,
                      hidden_groups=("hint",))
