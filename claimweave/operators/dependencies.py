"""Dependencies between the definitions of a source corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.graph import ClaimGraph
from claimweave.operators.fixpoint import RuleProgram
from claimweave.operators.lookup import names, newest
from claimweave.rules import Rule, atom, ref, rule


def dependency_program(children: tuple[str, ...] = ("has-child",)) -> RuleProgram:
    """Which calls an expression contains, and what functions depend on and refer to.

    ``children`` lists the predicates that lead from an expression to its parts.
    """
    contains: list[Rule] = [
        rule(atom("contains-call", "?expr", "?fn"), atom("current-triple", "?expr", ref("calls"), "?fn"))
    ]
    for child in children:
        contains.append(
            rule(
                atom("contains-call", "?expr", "?fn"),
                atom("current-triple", "?expr", ref(child), "?part"),
                atom("contains-call", "?part", "?fn"),
            )
        )

    def of_kind(head: str, kind: str) -> Rule:
        return rule(
            atom(head, "?user", "?used"),
            atom("current-triple", "?user", ref("form-kind"), "function"),
            atom("current-triple", "?user", ref("body"), "?body"),
            atom("contains-call", "?body", "?used"),
            atom("current-triple", "?used", ref("form-kind"), kind),
        )

    return RuleProgram(
        [*contains, of_kind("fn-depends-on", "function"), of_kind("fn-references", "variable")]
    )


def symbols(graph: ClaimGraph) -> DataFrame:
    """``entity, name, kind, module, import_line`` of every named definition."""
    kinds = newest(graph.current(p="form-kind")).select(
        F.col("l").alias("entity"), ids.short_literal(F.col("r")).alias("kind")
    )
    modules = graph.ground(newest(graph.current(p="source-module")), "r", "module").select(
        F.col("l").alias("entity"), "module"
    )
    named = names(graph).select(F.col("id").alias("entity"), "name")
    line = F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.col("name"))
    return (
        kinds.join(named, "entity")
        .join(modules, "entity", "left")
        .select("entity", "name", "kind", "module", line.alias("import_line"))
    )


def discover(symbol_rows: DataFrame, kind: str | None = None, module: str | None = None) -> DataFrame:
    """Symbols ordered by module and name, optionally of one kind or module."""
    if kind is not None:
        symbol_rows = symbol_rows.filter(F.col("kind") == kind)
    if module is not None:
        symbol_rows = symbol_rows.filter(F.col("module") == module)
    return symbol_rows.orderBy("module", "name")


def variable_values(graph: ClaimGraph) -> DataFrame:
    """``entity, form, values``: the string literals in the body of each variable.

    A body is one expression of one file, so its literals fit in an array.
    """
    bodies = graph.current(p="body").select(F.col("l").alias("entity"), F.col("r").alias("body"))
    forms = newest(graph.current(p="expr-kind")).select(
        F.col("l").alias("body"), ids.short_literal(F.col("r")).alias("form")
    )
    items = graph.current(p="has-child").select(F.col("l").alias("body"), "r")
    items = items.filter(F.col("r").startswith("v:s"))
    literals = graph.ground(items, "r", "value").groupBy("body").agg(
        F.array_sort(F.collect_list("value")).alias("values")
    )
    return (
        bodies.join(forms, "body")
        .join(literals, "body")
        .select("entity", "form", "values")
    )
