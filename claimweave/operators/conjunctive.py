"""Conjunctive queries: atoms become DataFrames, shared variables become join keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.graph import BASE_RELATIONS, ClaimGraph
from claimweave.rules import Atom, Ref, Var, constant_id, constant_raw

# Arguments of base relations that are plain numbers, not interned literals.
_PLAIN = {("as-of-triple", 0), ("as-of-claim", 0), ("tx-info", 1), ("value", 1)}

Frames = Callable[[Atom], DataFrame]


def bind_atom(df: DataFrame, columns: Sequence[str], a: Atom, base: bool) -> DataFrame:
    """Filter by the constants and repeated variables of one atom; name columns by variable."""
    if len(columns) != len(a.args):
        raise ValueError(f"{a.rel} has {len(columns)} arguments, {len(a.args)} given")
    conditions = []
    first: dict[str, str] = {}
    for position, (column, arg) in enumerate(zip(columns, a.args)):
        if isinstance(arg, Var):
            if arg.name in first:
                conditions.append(F.col(column) == F.col(first[arg.name]))
            else:
                first[arg.name] = column
        else:
            interned = base and (a.rel, position) not in _PLAIN
            value = constant_id(arg) if interned else constant_raw(arg)
            conditions.append(F.col(column) == F.lit(value))
    for condition in conditions:
        df = df.filter(condition)
    return df.select(*[F.col(column).alias(name) for name, column in first.items()])


def graph_frames(graph: ClaimGraph, derived: dict[str, DataFrame] | None = None) -> Frames:
    """Bound frames of atoms over a graph and a set of derived relations.

    Patterns on live claims are pushed below the anti join by the optimizer, so a bound
    predicate still prunes partitions.
    """
    derived = derived or {}

    def frame(a: Atom) -> DataFrame:
        if a.rel in derived:
            df = derived[a.rel]
            return bind_atom(df, df.columns, a, base=False)
        seq = None
        if a.rel.startswith("as-of"):
            if isinstance(a.args[0], (Var, Ref)) or not isinstance(a.args[0], int):
                raise ValueError(f"{a.rel} needs a bound sequence number")
            seq = a.args[0]
        return bind_atom(graph.relation(a.rel, seq), BASE_RELATIONS[a.rel], a, base=True)

    return frame


def join_body(
    body: Sequence[Atom], frames: Sequence[DataFrame], start: DataFrame | None = None
) -> DataFrame:
    """Natural join of bound atom frames, as a bag.

    Atoms are joined in an order that always shares a variable with what is bound.  A
    body that falls apart into unconnected pieces would be a cross product and is
    refused; an atom without variables only multiplies rows by its number of matches.
    """
    remaining = [(a, f) for a, f in zip(body, frames) if a.variables()]
    ground = [f for a, f in zip(body, frames) if not a.variables()]
    result = start
    if result is None:
        if not remaining:
            raise ValueError("the body binds no variable")
        result = remaining.pop(0)[1]
    while remaining:
        bound = set(result.columns)
        index = next(
            (i for i, (a, _) in enumerate(remaining) if bound & set(a.variables())), None
        )
        if index is None:
            names = ", ".join(a.rel for a, _ in remaining)
            raise ValueError(f"no shared variable with {names}: this is a cross product")
        a, frame = remaining.pop(index)
        shared = [name for name in a.variables() if name in bound]
        result = result.join(frame, shared)
    for frame in ground:
        matches = frame.count()
        if matches == 0:
            result = result.filter(F.lit(False))
        elif matches > 1:
            result = (
                result.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(matches))))
                .drop("_copy")
            )
    return result


def query(
    graph: ClaimGraph,
    *body: Atom,
    derived: dict[str, DataFrame] | None = None,
    select: Sequence[str] | None = None,
) -> DataFrame:
    """All substitutions of the body, one row per match (a bag, nothing deduplicated)."""
    frame = graph_frames(graph, derived)
    result = join_body(body, [frame(a) for a in body])
    return result.select(*select) if select else result


def head_tuples(head: Atom, matches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The head instantiated for each match (not deduplicated)."""
    return matches.select(
        *[
            (F.col(arg.name) if isinstance(arg, Var) else F.lit(constant_raw(arg))).alias(column)
            for column, arg in zip(columns, head.args)
        ]
    )


def derive_once(graph: ClaimGraph, r, derived: dict[str, DataFrame] | None = None) -> DataFrame:
    """A rule without recursion: one join, projected to its head, as a set."""
    columns = [arg.name if isinstance(arg, Var) else f"c{i}" for i, arg in enumerate(r.head.args)]
    frame = graph_frames(graph, derived)
    matches = join_body(r.body, [frame(a) for a in r.body])
    return head_tuples(r.head, matches, columns).distinct()
