"""All registered queries."""

from mailposture.plans import pages, providers, quality, resolve, roundtrips, security  # noqa: F401
from mailposture.plans.registry import RUN, SQL

__all__ = ["RUN", "SQL"]
