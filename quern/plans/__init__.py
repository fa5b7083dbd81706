"""Composition and measurement of operators."""

from quern.plans.counts import CountPlan, Dispatch, Workspace, count_at
from quern.plans.pipeline import Pipeline
from quern.plans.profile import Profile, Span, immediate, profile

__all__ = ["CountPlan", "Dispatch", "Pipeline", "Profile", "Span", "Workspace", "count_at", "immediate", "profile"]
