"""Derived relations that are kept up to date from changes alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.graph import SUPERSEDES, ClaimGraph
from claimweave.operators.conjunctive import bind_atom, graph_frames, join_body
from claimweave.operators.fixpoint import (
    RuleProgram,
    columns_of,
    evaluate,
    new_tuples,
    run_rounds,
    variants,
)
from claimweave.operators.support import Changes
from claimweave.rules import Atom, Rule
from claimweave.workspace import Stored, Workspace

# Base relations whose changes follow from appended claims.
_FROM_CLAIMS = ("triple", "claim", "current-triple", "current-claim", "value", "tx-claims-rel")


class Views:
    """Materialised relations of a rule program over a graph.

    ``apply`` takes appended claims: first the new live claims are propagated, then the
    claims they hide are removed.  Removal deletes every tuple with a derivation through a
    hidden claim and then restores those that have another support; tuples that only
    support each other in a cycle stay deleted.
    """

    def __init__(
        self,
        program: RuleProgram,
        graph: ClaimGraph,
        workspace: Workspace | None = None,
        relations: dict[str, Stored] | None = None,
        version: int | None = None,
    ):
        self.program = program
        self.graph = graph
        self.space = workspace or Workspace(graph.spark)
        self.stored = relations if relations is not None else {}
        self.version = version

    # -- full ------------------------------------------------------------------

    def materialize(self) -> "Views":
        self.stored = evaluate(self.program, graph_frames(self.graph), self.space)
        self.version = self._latest()
        return self

    def _latest(self) -> int:
        row = self.graph.txs.agg(F.max("seq")).first()
        return int(row[0] or 0)

    def stale(self) -> bool:
        """True when the graph holds transactions the relations have not seen."""
        return self.version is None or self.version < self._latest()

    def invalidate(self) -> None:
        self.version = None

    def relation(self, rel: str) -> DataFrame:
        """A derived relation, recomputed first if it is stale."""
        if self.stale():
            self.materialize()
        return self.stored[rel].df()

    # -- insertion and supersession --------------------------------------------

    def apply(
        self,
        more: DataFrame,
        txs: DataFrame | None = None,
        after: ClaimGraph | None = None,
    ) -> dict[str, DataFrame]:
        """Append ``more`` claims and maintain every relation; returns the added tuples.

        ``after`` is the graph holding the new claims where it is stored already, so that
        plans do not grow with the number of changes.
        """
        if self.version is None:
            self.materialize()
        more = self.space.save(more, "claims").df()
        before = self.graph
        after = after or before.with_claims(more, txs)
        fresh = more.join(after.hidden(), "cid", "left_anti")
        fresh = self.space.save(fresh, "fresh").df()
        hides = more.filter(F.col("p") == SUPERSEDES).select(F.col("r").alias("cid"))
        gone = self.space.save(
            before.current().join(hides.distinct(), "cid", "left_semi"), "gone"
        )

        old_frames = graph_frames(before)
        new_frames = graph_frames(after)
        plus = self._delta_frames(fresh, more, after, Changes(before, after, more, fresh, self.space))
        minus = self._delta_frames(gone.df(), None, after)

        def middle(a: Atom) -> DataFrame:
            """After the insertions, before the removals."""
            if a.rel in ("current-triple", "current-claim"):
                return old_frames(a).unionByName(plus(a))
            return new_frames(a)

        added = self._insert(middle, plus)
        if gone.rows:
            self._remove(middle, new_frames, minus)
        self.graph = after
        self.version = self._latest()
        return {rel: s.df() for rel, s in added.items()}

    def _delta_frames(self, live: DataFrame, raw: DataFrame | None, graph: ClaimGraph, changes: Changes | None = None):
        """Bound frames over changed claims only; None where a relation has no such change."""

        def frame(a: Atom) -> DataFrame | None:
            if a.rel in ("current-triple", "current-claim"):
                source = live
            elif raw is not None and a.rel in _FROM_CLAIMS:
                source = raw
            else:
                # ids and transactions that nothing mentioned before; none ever goes away
                return changes.frame(a) if changes is not None else None
            return graph_frames(_Part(source))(a)

        return frame

    def _base_variants(
        self,
        base: Callable[[Atom], DataFrame],
        delta: Callable[[Atom], DataFrame | None],
        full: dict[str, Stored],
    ) -> dict[str, list[DataFrame]]:
        """Each rule once per base atom, that atom bound to the changed claims."""
        found: dict[str, list[DataFrame]] = {}
        for r in self.program.rules:
            for position, a in enumerate(r.body):
                if self.program.is_derived(a):
                    continue
                changed = delta(a)
                if changed is None:
                    continue
                order = [position] + [i for i in range(len(r.body)) if i != position]
                frames = []
                for i in order:
                    other = r.body[i]
                    if i == position:
                        frames.append(changed)
                    elif self.program.is_derived(other):
                        df = full[other.rel].df()
                        frames.append(bind_atom(df, df.columns, other, base=False))
                    else:
                        frames.append(base(other))
                matches = join_body([r.body[i] for i in order], frames)
                found.setdefault(r.head.rel, []).append(self.program.head(r, matches))
        return found

    def _insert(self, base, plus) -> dict[str, Stored]:
        full = dict(self.stored)
        first = self._base_variants(base, plus, full)
        delta = {rel: new_tuples(frames, full[rel], self.space) for rel, frames in first.items()}
        for rel, fresh in delta.items():
            full[rel] = full[rel].plus(fresh)
        self.stored, added = run_rounds(self.program, base, full, delta, self.space)
        return added

    def _remove(self, old, new, minus) -> None:
        # Everything that may have lost its support, found over the state before removal.
        nothing = {rel: self.space.empty(self.program.schema(rel)) for rel in self.program.arity}
        first = self._base_variants(old, minus, self.stored)
        doomed = dict(nothing)
        delta = {rel: new_tuples(f, nothing[rel], self.space) for rel, f in first.items()}
        while any(s.rows for s in delta.values()):
            for rel, s in delta.items():
                doomed[rel] = doomed[rel].plus(s)
            reached: dict[str, list[DataFrame]] = {}
            for r in self.program.rules:
                found = variants(self.program, r, old, self.stored, delta)
                if found:
                    reached.setdefault(r.head.rel, []).extend(found)
            delta = {rel: new_tuples(f, doomed[rel], self.space) for rel, f in reached.items()}
        self._delete_and_restore(doomed, new)

    def _delete_and_restore(self, doomed: dict[str, Stored], new) -> None:
        full = dict(self.stored)
        doomed = {rel: s for rel, s in doomed.items() if s.rows}
        for rel, s in doomed.items():
            kept = full[rel].df().join(s.df(), columns_of(self.program.arity[rel]), "left_anti")
            full[rel] = self.space.save(kept, "kept")
        restored: dict[str, list[DataFrame]] = {}
        for r in self.program.rules:
            if r.head.rel in doomed:
                restored.setdefault(r.head.rel, []).append(
                    self._rederive(r, doomed[r.head.rel], full, new)
                )
        delta = {rel: new_tuples(f, full[rel], self.space) for rel, f in restored.items()}
        for rel, s in delta.items():
            full[rel] = full[rel].plus(s)
        within = {rel: s.df() for rel, s in doomed.items()}
        self.stored, _ = run_rounds(self.program, new, full, delta, self.space, within=within)

    def _rederive(self, r: Rule, doomed: Stored, full, base) -> DataFrame:
        """The rule restricted to deleted heads: the join starts from them."""
        start = bind_atom(doomed.df(), doomed.df().columns, r.head, base=False)
        frames = []
        for a in r.body:
            if self.program.is_derived(a):
                df = full[a.rel].df()
                frames.append(bind_atom(df, df.columns, a, base=False))
            else:
                frames.append(base(a))
        if not start.columns:
            return self.program.head(r, join_body(r.body, frames))
        return self.program.head(r, join_body(r.body, frames, start=start.distinct()))

    # -- rule changes ----------------------------------------------------------

    def add_rule(self, r: Rule) -> None:
        """Evaluate only the new rule on the stored relations and propagate its tuples."""
        if self.version is None:
            self.materialize()
        self.program = RuleProgram([*self.program.rules, r])
        full = {
            rel: self.stored.get(rel, self.space.empty(self.program.schema(rel)))
            for rel in self.program.arity
        }
        self.stored = self._extend(r, full)

    def _extend(self, r: Rule, full: dict[str, Stored]) -> dict[str, Stored]:
        base = graph_frames(self.graph)
        frames = []
        for a in r.body:
            if self.program.is_derived(a):
                df = full[a.rel].df()
                frames.append(bind_atom(df, df.columns, a, base=False))
            else:
                frames.append(base(a))
        tuples = self.program.head(r, join_body(r.body, frames))
        delta = {r.head.rel: new_tuples([tuples], full[r.head.rel], self.space)}
        full[r.head.rel] = full[r.head.rel].plus(delta[r.head.rel])
        full, _ = run_rounds(self.program, base, full, delta, self.space)
        return full

    def replace_rule(self, old_id: str, r: Rule) -> None:
        """Replace one rule.

        When no other relation reads its head, only that head is derived again, from all
        rules that now share it; otherwise everything is recomputed.
        """
        old = next(x for x in self.program.rules if x.rule_id == old_id)
        kept = [x for x in self.program.rules if x.rule_id != old_id]
        readers = [x for x in self.program.readers(old.head.rel) if x.head.rel != old.head.rel]
        self.program = RuleProgram([*kept, r])
        if readers or self.version is None:
            self.materialize()
            return
        full = {
            rel: self.stored.get(rel, self.space.empty(self.program.schema(rel)))
            for rel in self.program.arity
        }
        if old.head.rel in self.program.arity:
            full[old.head.rel] = self.space.empty(self.program.schema(old.head.rel))
        again = [x for x in self.program.rules if x.head.rel == old.head.rel or x is r]
        for x in again:
            full = self._extend(x, full)
        self.stored = full


class _Part(ClaimGraph):
    """Changed claims seen as a graph whose live claims are all of them."""

    def current(self, l=None, p=None, r=None) -> DataFrame:
        return self.claims_where(l, p, r)
