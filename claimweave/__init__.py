"""Claim-graph analytics on Spark DataFrames.

A *claim* is a row ``(l, p, r)`` with its own id.  Claims are never changed or
deleted: a later claim ``(x supersedes cid)`` hides an earlier one, so every past
state stays readable.
"""

from claimweave.graph import ClaimGraph
from claimweave.rules import Atom, Rule, Var, atom, ref, rule, var
from claimweave.session import spark_session
from claimweave.workspace import Workspace

__all__ = [
    "Atom",
    "ClaimGraph",
    "Rule",
    "Var",
    "Workspace",
    "atom",
    "ref",
    "rule",
    "spark_session",
    "var",
]
