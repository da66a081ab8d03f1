"""Every registered query with the SQL that states the same answer."""

from grainwise.plans.base import CATALOGUE, Query

__all__ = ["CATALOGUE", "Query", "load"]


def load() -> dict[str, Query]:
    """Import every module of plans and return what they registered."""
    from grainwise.plans import (  # noqa: F401
        analyses, cleaning, evidence, profiles, scopes, sources, workflow)
    return CATALOGUE
