"""Rule programs: several rules per head, several derived atoms per body, any recursion."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from claimweave.graph import BASE_RELATIONS, ClaimGraph
from claimweave.operators.closure import closure_of
from claimweave.operators.conjunctive import bind_atom, graph_frames, head_tuples, join_body
from claimweave.rules import Atom, Rule, Var
from claimweave.workspace import Stored, Workspace, unseen, rounds


def columns_of(arity: int) -> list[str]:
    return [f"a{i}" for i in range(arity)]


class RuleProgram:
    """A set of rules.  Derived relations have string columns ``a0, a1, ...`` and are sets."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        self.arity: dict[str, int] = {}
        for r in self.rules:
            if r.head.rel in BASE_RELATIONS:
                raise ValueError(f"{r.head.rel} is a base relation")
            if self.arity.setdefault(r.head.rel, len(r.head.args)) != len(r.head.args):
                raise ValueError(f"{r.head.rel} is used with different numbers of arguments")
        for r in self.rules:
            for a in r.body:
                if a.rel not in BASE_RELATIONS and a.rel not in self.arity:
                    raise ValueError(f"{a.rel} is neither a base relation nor a rule head")

    def is_derived(self, a: Atom) -> bool:
        return a.rel in self.arity

    def schema(self, rel: str) -> StructType:
        return StructType([StructField(c, StringType()) for c in columns_of(self.arity[rel])])

    def head(self, r: Rule, matches: DataFrame) -> DataFrame:
        return head_tuples(r.head, matches, columns_of(len(r.head.args)))

    def readers(self, rel: str) -> list[Rule]:
        return [r for r in self.rules if any(a.rel == rel for a in r.body)]

    def derive(self, graph: ClaimGraph, workspace: Workspace | None = None) -> dict[str, DataFrame]:
        """All derived relations of the program over ``graph``."""
        space = workspace or Workspace(graph.spark)
        stored = evaluate(self, graph_frames(graph), space)
        return {rel: s.df() for rel, s in stored.items()}


def cached_frames(frames: Callable[[Atom], DataFrame], space: Workspace):
    """Write each bound base atom once, so rounds do not repeat its scan and anti join."""
    written: dict[Atom, Stored] = {}

    def frame(a: Atom) -> DataFrame:
        if a not in written:
            written[a] = space.save(frames(a), "atom")
        return written[a].df()

    return frame


def new_tuples(candidates: Sequence[DataFrame], known: Stored, space: Workspace) -> Stored:
    """The distinct candidates not known yet, written as one round."""
    merged = candidates[0]
    for more in candidates[1:]:
        merged = merged.unionByName(more)
    return space.save(unseen(merged, known), "tuples")


def variants(
    program: RuleProgram,
    r: Rule,
    base: Callable[[Atom], DataFrame],
    full: dict[str, Stored],
    delta: dict[str, Stored],
    within: DataFrame | None = None,
) -> list[DataFrame]:
    """The rule once per derived atom with a delta, that atom bound to its delta.

    Derived atoms behind it see the full relation, this round's delta included, those
    before it the relation without that delta: no combination of two new tuples is missed,
    and none is joined twice.
    """
    found = []
    for position, a in enumerate(r.body):
        if not program.is_derived(a) or delta.get(a.rel) is None or delta[a.rel].rows == 0:
            continue
        frames = []
        for other_position, other in enumerate(r.body):
            if not program.is_derived(other):
                frames.append(base(other))
                continue
            if other_position == position:
                df = delta[other.rel].df()
            else:
                df = (_before(full, delta, other.rel) if other_position < position else full[other.rel]).df()
            frames.append(bind_atom(df, df.columns, other, base=False))
        # Start from the delta: it is the small side of the first join.
        order = [position] + [i for i in range(len(r.body)) if i != position]
        body = [r.body[i] for i in order]
        matches = join_body(body, [frames[i] for i in order])
        tuples = program.head(r, matches)
        if within is not None:
            tuples = tuples.join(within, tuples.columns, "left_semi")
        found.append(tuples)
    return found


def _before(full: dict[str, Stored], delta: dict[str, Stored], rel: str) -> Stored:
    """The relation without the rounds of its delta."""
    new = set(delta[rel].paths) if rel in delta else set()
    return Stored(full[rel].spark, full[rel].schema, [p for p in full[rel].paths if p not in new], full[rel].rows)


def transitive(r: Rule) -> bool:
    """Does the rule state that its relation is transitive, and nothing else?"""
    if len(r.body) != 2 or any(a.rel != r.head.rel for a in r.body) or len(r.head.args) != 2:
        return False
    (x, y), (y2, z) = r.body[0].args, r.body[1].args
    return all(isinstance(v, Var) for v in (x, y, z)) and len({x.name, y.name, z.name}) == 3 and y == y2 and tuple(r.head.args) == (x, z)


def run_rounds(
    program: RuleProgram,
    base: Callable[[Atom], DataFrame],
    full: dict[str, Stored],
    delta: dict[str, Stored],
    space: Workspace,
    max_rounds: int | None = None,
    within: dict[str, DataFrame] | None = None,
    heads: set[str] | None = None,
) -> tuple[dict[str, Stored], dict[str, Stored]]:
    """Propagate ``delta`` (already part of ``full``) until no rule yields a new tuple.

    ``heads`` restricts the rules that fire; ``within`` restricts the tuples they may
    add.  Returns the full relations and everything added on the way.
    """
    added = dict(delta)
    rules = [
        r
        for r in program.rules
        if (heads is None or r.head.rel in heads) and (within is None or r.head.rel in within)
    ]
    for _ in rounds(1, max_rounds):
        if all(s.rows == 0 for s in delta.values()):
            return full, added
        candidates: dict[str, list[DataFrame]] = {}
        for r in rules:
            limit = None if within is None else within[r.head.rel]
            found = variants(program, r, base, full, delta, limit)
            if found:
                candidates.setdefault(r.head.rel, []).extend(found)
        delta = {
            rel: new_tuples(frames, full[rel], space) for rel, frames in candidates.items()
        }
        for rel, fresh in delta.items():
            full[rel] = full[rel].plus(fresh)
            added[rel] = added[rel].plus(fresh) if rel in added else fresh
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def strata(program: RuleProgram) -> list[set[str]]:
    """Relations in an order in which each is finished before others read it.

    Relations that depend on each other share a stratum.
    """
    reads = {
        rel: {a.rel for r in program.rules if r.head.rel == rel for a in r.body if program.is_derived(a)}
        for rel in program.arity
    }
    below = {rel: set(needs) for rel, needs in reads.items()}
    for _ in below:
        for rel in below:
            below[rel] |= {x for needed in below[rel] for x in below[needed]}
    together = {
        rel: {rel} | {x for x in below[rel] if rel in below[x]} for rel in program.arity
    }
    ordered = sorted(program.arity, key=lambda rel: len(below[rel] | {rel}))
    found: list[set[str]] = []
    for rel in ordered:
        if together[rel] not in found:
            found.append(together[rel])
    return found


def evaluate(
    program: RuleProgram,
    frames: Callable[[Atom], DataFrame],
    space: Workspace,
    max_rounds: int | None = None,
) -> dict[str, Stored]:
    """All relations, stratum by stratum; only recursive strata need delta rounds."""
    full = {rel: space.empty(program.schema(rel)) for rel in program.arity}
    for heads in strata(program):
        rules = [r for r in program.rules if r.head.rel in heads]
        looping = [r for r in rules if any(a.rel in heads for a in r.body)]
        base = cached_frames(frames, space) if looping else frames
        reused = {a for r in looping for a in r.body}

        def frame(a: Atom, base=base, reused=reused) -> DataFrame:
            if program.is_derived(a):
                df = full[a.rel].df()
                return bind_atom(df, df.columns, a, base=False)
            return base(a) if a in reused else frames(a)

        first: dict[str, list[DataFrame]] = {}
        for r in rules:
            if r not in looping:
                matches = join_body(r.body, [frame(a) for a in r.body])
                first.setdefault(r.head.rel, []).append(program.head(r, matches))
        delta = {rel: new_tuples(found, full[rel], space) for rel, found in first.items()}
        for rel, fresh in delta.items():
            full[rel] = full[rel].plus(fresh)
        if len(looping) == 1 and len(heads) == 1 and max_rounds is None and transitive(looping[0]):
            # pairs joined with pairs find each path once for every node on it; strides do not
            rel = looping[0].head.rel
            paths = closure_of(space, full[rel])
            full[rel] = Stored(paths.spark, program.schema(rel), paths.paths, paths.rows)
        elif looping:
            full, _ = run_rounds(program, frame, full, delta, space, max_rounds, heads=heads)
    return full


def publish(relations: dict[str, DataFrame]) -> None:
    """Make derived relations callable by name in SQL."""
    for rel, df in relations.items():
        df.createOrReplaceTempView(rel.replace("-", "_"))
