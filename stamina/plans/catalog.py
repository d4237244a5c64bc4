"""All registered queries."""

from stamina.plans import (q_checks, q_io, q_plans, q_runs, q_snapshots, q_streaming,  # noqa: F401
                           q_survival, q_text, q_traces)  # noqa: F401
from stamina.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
