"""Rules as data: a catalogue next to the claims from which a rule program is built again.

A catalogue is a table with a row per rule: its id, the relation it derives, its text, whether it
is live, what replaced it, and its atoms as nested columns.  Rules are program text, few and
small, so reading them back collects them; whatever they derive stays distributed.

Defined cases: a rule with several rows is live only if all of them say so, since a
replacement appends rows; rows of a rule are alike but for that; an empty catalogue gives an
empty program; a live rule without atoms (kept as text only) cannot be built and raises.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.ids import python_literal
from claimweave.graph import RULES, ClaimGraph
from claimweave.operators.conjunctive import bind_atom, graph_frames, join_body
from claimweave.operators.fixpoint import RuleProgram, evaluate
from claimweave.rules import Atom, Ref, Rule, Var
from claimweave.workspace import Stored, Workspace


def rule_rows(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Catalogue rows of live rules."""
    rows = [(r.rule_id, r.head.rel, r.source(), True, None, _atom_row(r.head), [_atom_row(a) for a in r.body]) for r in rules]
    return spark.createDataFrame(rows, RULES)


def replaced(catalogue: DataFrame, old_id: str, new: DataFrame) -> DataFrame:
    """The catalogue after a replacement; the old rule stays as history."""
    hit = F.col("rule_id") == old_id
    new_id = new.select(F.max("rule_id")).first()[0]
    old = catalogue.withColumn("live", F.col("live") & ~hit).withColumn(
        "replaced_by", F.when(hit, F.lit(new_id)).otherwise(F.col("replaced_by"))
    )
    return old.unionByName(new)


def listed(catalogue: DataFrame) -> DataFrame:
    """One row per rule: rule_id, head_rel, source, live, replaced_by, head, body."""
    return catalogue.groupBy("rule_id").agg(
        F.max("head_rel").alias("head_rel"), F.max("source").alias("source"), F.min("live").alias("live"),
        F.max("replaced_by").alias("replaced_by"), F.first("head", ignorenulls=True).alias("head"), F.first("body", ignorenulls=True).alias("body"),
    )


def rules_of(catalogue: DataFrame) -> list[Rule]:
    """The live rules, by their ids."""
    rules = []
    for row in listed(catalogue).filter("live").orderBy("rule_id").collect():
        if row.head is None or row.body is None:
            raise ValueError(f"{row.rule_id} is kept as text only")
        rules.append(Rule(_atom(row.head), tuple(map(_atom, row.body)), row.rule_id))
    return rules


def program_of(catalogue: DataFrame) -> RuleProgram:
    """The program of the live rules, ready to derive from any graph."""
    return RuleProgram(rules_of(catalogue))


def derived_again(graph: ClaimGraph, workspace: Workspace | None = None) -> dict[str, DataFrame]:
    """All relations that the rules stored with a graph derive from it."""
    return program_of(graph.rules).derive(graph, workspace)


def catalogue_with_tuples(graph: ClaimGraph, workspace: Workspace | None = None) -> DataFrame:
    """rule_id, head_rel, live, replaced_by, tuples: what each live rule derives by itself; NULL for others.

    A tuple that several rules derive counts for each of them.
    """
    space = workspace or Workspace(graph.spark)
    program = program_of(graph.rules)
    base = graph_frames(graph)
    full: dict[str, Stored] = evaluate(program, base, space)
    rows = listed(graph.rules).select("rule_id", "head_rel", "live", "replaced_by")
    counts = []
    for r in program.rules:
        frames = [bind_atom(full[a.rel].df(), full[a.rel].df().columns, a, base=False) if program.is_derived(a) else base(a) for a in r.body]
        tuples = program.head(r, join_body(r.body, frames)).distinct()
        counts.append(tuples.agg(F.count(F.lit(1)).alias("tuples")).select(F.lit(r.rule_id).alias("rule_id"), "tuples"))
    if not counts:
        return rows.withColumn("tuples", F.lit(None).cast("bigint"))
    merged = counts[0]
    for more in counts[1:]:
        merged = merged.unionByName(more)
    return rows.join(space.save(merged, "tuples").df(), "rule_id", "left")


def _atom_row(a: Atom) -> tuple:
    return a.rel, [_term_row(x) for x in a.args]


def _term_row(x: object) -> tuple[str, str]:
    if isinstance(x, Var):
        return "var", x.name
    return ("ref", x.id) if isinstance(x, Ref) else python_literal(x)


def _atom(row) -> Atom:
    return Atom(row["rel"], tuple(_term(x["kind"], x["text"]) for x in row["args"]))


def _term(kind: str, text: str) -> object:
    made = {"var": Var, "ref": Ref, "i": int, "d": float, "s": str, "b": lambda t: t == "true", "n": lambda t: None}
    return made[kind](text)
