"""Funnel specifications: anchors and steps declared as data."""

from cohortflow.plans.steps import (
    Anchor, EventMatch, FunnelSpec, Step,
    main_funnel, funnel_72h, demo_funnel,
)

__all__ = ["Anchor", "EventMatch", "FunnelSpec", "Step",
           "main_funnel", "funnel_72h", "demo_funnel"]
