"""All queries over the stored tables, with their SQL twins."""

from govlens.plans import code, context, dependencies, frontend, governance, insight, ledger, policy, rulebook, sources  # noqa: F401
from govlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
