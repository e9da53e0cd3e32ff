"""Named analyses over the shop tables, each with the SQL that states its result."""

from claimweave.plans import (  # noqa: F401  (each module registers its analyses)
    changes,
    corpus,
    desk,
    formula,
    joins,
    maintained,
    recursion,
    reports,
    scans,
    streams,
)
from claimweave.plans.registry import ANALYSES

__all__ = ["ANALYSES"]
