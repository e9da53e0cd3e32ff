"""The help-desk model, source corpora and streams."""

import pytest
from graphs import claims, frame, graph, rows, stored
from pyspark.sql import functions as F

from claimweave import ClaimGraph, Workspace, atom, ref, rule
from claimweave.functions.tables import rule_table
from claimweave.operators import checks
from claimweave.operators.closure import impact
from claimweave.operators.dependencies import dependency_program, symbols, variable_values
from claimweave.operators.fixpoint import RuleProgram
from claimweave.sources.python_source import Corpus, parse_files, syntax_frames, syntax_rows
from claimweave.sources.store import GraphStore
from claimweave.streaming import live

STATUSES = [("open", "active"), ("in_progress", "active"), ("on_hold", "active"), ("closed", "terminal"), ("resolved", "terminal"), ("archived", "terminal")]
TRANSITIONS = [("open", "in_progress"), ("open", "closed"), ("in_progress", "resolved"), ("resolved", "archived")]
PERMISSIONS = [("archive", "admin"), ("manage", "agent"), ("manage", "admin")]
EFFECTS = [("transition", "notification", "not-terminal"), ("transition", "analytics", "always")]
PRIORITY = "name string, response_target bigint, required_role string, notification_mode string, auto_escalate boolean, escalates_to string"


def desk(spark, extra=()):
    return (
        rule_table(spark, ("name", "grp"), [*STATUSES, *extra]),
        rule_table(spark, ("action", "role"), PERMISSIONS),
        rule_table(spark, ("trigger", "kind", "cond"), EFFECTS),
    )


def test_groups_moves_and_access(spark):
    statuses, permissions, _ = desk(spark, [("duplicate", "terminal")])
    sizes = {r["grp"]: r["count"] for r in statuses.groupBy("grp").count().collect()}
    assert sizes == {"active": 3, "terminal": 4}
    states = frame(spark, [("t1", "open")], ["entity", "state"])
    wanted = frame(spark, [("t1", s, i) for i, s in enumerate(("in_progress", "closed", "archived", "resolved"))], ["entity", "target", "ord"])
    allowed = {r["target"] for r in checks.check_moves(states, wanted, rule_table(spark, ("from_name", "to_name"), TRANSITIONS)).filter("allowed").collect()}
    assert allowed == {"in_progress", "closed"}
    users = frame(spark, [("ann", "admin"), ("bo", "agent")], ["user", "role"])
    asked = frame(spark, [("ann", "archive"), ("bo", "archive"), ("bo", "manage")], ["user", "action"])
    assert rows(checks.check_access(users, asked, permissions).filter("allowed"), "user", "action") == [("ann", "archive"), ("bo", "manage")]


def test_base_model_has_no_notification_or_permission_obligations(spark):
    statuses, permissions, effects = desk(spark)
    none = frame(spark, [], PRIORITY)
    assert checks.notification_obligations(statuses, effects, none).count() == 0
    assert checks.permission_obligations(statuses, permissions, none).count() == 0
    assert checks.workflow_obligations(statuses, none).count() == 0


def test_extended_model_obligations(spark):
    statuses, permissions, effects = desk(spark, [("urgent", "escalated")])
    data = [("critical", 1, "senior", "urgent_page", True, "escalated"), ("low", 24, "any", "normal", False, None), ("odd", 5, "admin", "normal", True, "blocked")]
    priorities = frame(spark, data, PRIORITY)
    assert rows(checks.notification_obligations(statuses, effects, priorities), "subject") == [("critical",), ("escalated",)]
    assert rows(checks.permission_obligations(statuses, permissions, priorities), "subject") == [("critical",), ("escalated/de_escalate",), ("escalated/escalate",), ("odd",)]
    assert rows(checks.workflow_obligations(statuses, priorities), "reason", "subject") == [("escalation to empty group", "odd")]
    assert rows(checks.role_requirements(priorities)) == [("critical", "admin"), ("critical", "senior"), ("odd", "admin")]


def test_group_is_the_most_specific_match(spark):
    props = [("a", "counts_as_work", "true"), ("a", "terminal", "false"), ("b", "counts_as_work", "true"), ("b", "terminal", "false"), ("b", "priority", "high"), ("c", "terminal", "false")]
    df = frame(spark, props, ["entity", "prop", "value"])
    assert {r["entity"]: r["grp"] for r in checks.derive_group(df).collect()} == {"a": "active", "b": "escalated", "c": None}
    declared = frame(spark, [("a", "terminal")], ["entity", "grp"])
    assert checks.contradictions(declared, df).count() == 2
    assert checks.contradictions(declared, df, strict=False).count() == 1


SOURCE = '''
import os
from util import helper as h
LIMITS = ["open", "closed"]
def a(x):
    return x
def b(y, n: int = 2, *rest, **extra) -> int:
    return a(y) + len(LIMITS)
async def c(z):
    if z > 1:
        return b(a(z))
class Box(Base):
    @property
    def area(self):
        return c(self.size)
'''


def code(spark, *files):
    df = frame(spark, list(files), ["path", "source"])
    return Corpus(Workspace(spark).save(parse_files(df), "syntax").df())


def test_source_to_dependencies(spark):
    corpus = code(spark, ("src/one.py", SOURCE), ("bad.py", "def ("))
    assert rows(corpus.errors, "path") == [("bad.py",)]
    g = ClaimGraph(stored(corpus.claims()))
    found = dependency_program().derive(g)
    names = {r["entity"]: r["name"] for r in symbols(g).collect()}
    edges = {(names[a], names[b]) for a, b in rows(found["fn-depends-on"])}
    assert edges == {("b", "a"), ("c", "b"), ("c", "a"), ("area", "c")}
    assert {(names[a], names[b]) for a, b in rows(found["fn-references"])} == {("b", "LIMITS")}
    assert [tuple(r) for r in variable_values(g).select("form", "values").collect()] == [("list", ["closed", "open"])]
    have = {(p, r) for p, r in rows(g.claims, "p", "r")}
    assert {("is-async", "v:b:true"), ("return-type", "v:s:int"), ("has-base", "v:s:Base"), ("has-decorator", "v:s:property"), ("has-child", "v:s:helper")} <= have
    shown = {(r["shown"], r["position"]) for r in corpus.parameters().filter("name in ('y', 'n', 'rest', 'extra')").collect()}
    assert shown == {("y", 0), ("n", 1), ("*rest", 2), ("**extra", 3)}


def test_claims_of_a_corpus_need_few_joins(spark):
    # what a node needs of its parent and its nearest real ancestor stands in its row
    corpus = code(spark, ("src/one.py", SOURCE))
    plan = corpus.claims()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4
    around = {r["name"]: (r["parent_type"], r["above_type"], r["above_field"]) for r in corpus.syntax.filter("type = 'arg'").collect()}
    assert around["rest"] == ("arguments", "FunctionDef", "body")
    items = corpus.syntax.filter("lit = 'open'").first()
    assert (items["parent_type"], items["above_type"], items["above_field"]) == ("List", "List", "value")


def test_new_source_resolves_to_what_is_there(spark):
    old = ClaimGraph(stored(code(spark, ("src/one.py", SOURCE)).claims()))
    new = code(spark, ("src/two.py", "def d(x):\n    return a(x)\n"))
    merged = old.with_claims(stored(new.claims(tx_seq=2, existing=symbols(old))))
    found = dependency_program().derive(merged)["fn-depends-on"]
    names = {r["entity"]: r["name"] for r in symbols(merged).collect()}
    assert ("d", "a") in {(names[a], names[b]) for a, b in rows(found)}


def test_fifty_functions_direct_and_transitive(spark):
    # Nine functions call the core directly, eight more only through them.
    edges = [(f"d{i}", "core") for i in range(9)] + [(f"i{i}", f"d{i}") for i in range(8)]
    report = impact(frame(spark, edges, ["src", "dst"])).filter("target = 'core'").first()
    assert (report["direct"], report["transitive"], report["indirect_only"]) == (9, 17, 8)


def test_parser_rows_are_plain_tuples():
    found = syntax_rows("x.py", "x = 1\n")
    assert found[0][5] == "Module" and {r[5] for r in found} == {"Module", "Assign", "Name", "Constant"}


def test_parser_hands_on_small_frames():
    files = [(f"f{i}.py", "x = 1\n" * (i % 7)) for i in range(200)]
    frames = list(syntax_frames(iter(files), most=50))
    longest = max(len(syntax_rows(*f)) for f in files)
    assert max(map(len, frames)) < 50 + longest
    listed = [(r.path, r.nid, r.type) for f in frames for r in f.itertuples()]
    assert listed == [(r[0], r[1], r[5]) for f in files for r in syntax_rows(*f)]


def test_stream_replay_changes_nothing(spark):
    space = Workspace(spark)
    store = GraphStore(spark, space.path("store"))
    store.commit("load", claims(spark, [("a", "edge", "b")]))
    edge = ref("edge")
    program = RuleProgram(
        [
            rule(atom("path", "?x", "?y"), atom("current-triple", "?x", edge, "?y")),
            rule(atom("path", "?x", "?z"), atom("current-triple", "?x", edge, "?y"), atom("path", "?y", "?z")),
        ]
    )
    keeper = live.ViewMaintainer(store, program, base_seq=1)
    batch = claims(spark, [("b", "edge", "c"), ("m", "supersedes", "c:1")], start=10)
    keeper.on_batch(batch, 0)
    once = rows(keeper.views.relation("path"))
    keeper.on_batch(batch, 0)
    assert rows(keeper.views.relation("path")) == once == [("b", "c")]
    assert store.graph().claims.count() == 3
    again = live.ViewMaintainer(store, program, base_seq=1)
    again.on_batch(batch, 0)
    assert rows(again.views.relation("path")) == once
    with pytest.raises(ValueError, match="lies below"):
        live.ViewMaintainer(store, program, base_seq=0)


def test_large_rule_table_is_local_data(spark):
    assert rule_table(spark, ("name", "grp"), [(f"n{i}", "g") for i in range(10_001)]).count() == 10_001


def test_late_claim_does_not_replace_a_newer_one(spark):
    space = Workspace(spark)
    incoming, out = space.path("incoming"), space.path("newest")
    for i, (r, o) in enumerate([("new", 9), ("late", 3)]):
        df = frame(spark, [("c", "x", "p", r, "t:1", 1, o)], "cid string, l string, p string, r string, tx_id string, tx_seq bigint, ord bigint")
        df.coalesce(1).write.mode("append").parquet(incoming)
        live.run_newest(live.claim_stream(spark, incoming), out, space.root + "/progress").awaitTermination()
    assert rows(live.read_newest(spark, out)) == [("x", "p", "new", 9)]


def test_plans_prune_and_never_cross(spark):
    store = GraphStore(spark, Workspace(spark).path("plan"))
    store.commit("load", claims(spark, [("a", "edge", "b"), ("a", "name", ("lit", "x"))]))
    g = store.graph()
    plan = g.claims_where(l="a", p="edge")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan or "(p#" in plan.split("PartitionFilters")[1]
    assert "EqualTo(l,a)" in plan.split("PushedFilters")[1]
    assert "name" not in plan.split("ReadSchema")[1]
    from claimweave.operators.conjunctive import query

    joined = query(g, atom("current-triple", "?x", ref("edge"), "?y"), atom("current-triple", "?x", ref("name"), "?n"))
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_graph_helper(spark):
    assert graph(spark, [("a", "p", "b")]).objects().filter(F.col("kind") == "claim").count() == 1
