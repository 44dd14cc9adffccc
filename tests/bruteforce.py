"""Plain-Python evaluation of a FunnelSpec (the semantics, row by row).

Used as an independent check of the Spark compilation on small fixtures.
"""

from __future__ import annotations


def _match(m, ev):
    return (ev["mp_event_name"] == m.event
            and (m.chapter is None or ev["chapter"] == m.chapter)
            and (m.dialog_id is None or ev["dialog_id"] == m.dialog_id))


def user_flags(spec, events, buggy=False):
    """events: list of dicts (mp_event_name, chapter, dialog_id, res_timestamp)."""
    anchors = {}
    for a in spec.anchors:
        ts = [e["res_timestamp"] for e in events if _match(a.match, e)]
        anchors[a.name] = min(ts) if ts else None
    w = spec.window_ms
    flags = {}
    for s in spec.steps:
        hit = 0
        for e in events:
            t = e["res_timestamp"]
            m = s.alt if (buggy and s.alt is not None) else s.match
            if not _match(m, e):
                continue
            ok = all(anchors[x] is not None for x in s.requires)
            ok = ok and all(anchors[x] is not None and t >= anchors[x] for x in s.after)
            ok = ok and all(anchors[x] is not None and t - anchors[x] <= w for x in s.within)
            ok = ok and all(anchors[x] is None or t < anchors[x] for x in s.before)
            ok = ok and all(anchors[x] is None or t <= anchors[x] for x in s.until)
            ok = ok and all(anchors[x] is not None and anchors[y] is not None
                            and anchors[y] - anchors[x] <= w for x, y in s.gap)
            if ok:
                hit = 1
                break
        flags[s.no] = hit
    return anchors, flags


def monotonic(spec, flags):
    """Product form: a spine step needs every earlier spine step; a branch
    step needs the spine before it and the earlier steps of its branch."""
    out = {}
    spine_ok = 1
    branch_ok = 1
    for s in spec.steps:
        if s.branch:
            branch_ok = branch_ok * flags[s.no]
            out[s.no] = spine_ok * branch_ok
        else:
            branch_ok = 1
            spine_ok = spine_ok * flags[s.no]
            out[s.no] = spine_ok
    return out
