"""Literal fixtures with known answers."""

import json

import pytest
from graphs import claims, frame, graph, lit, requests, rows, tx_rows

from claimweave import ClaimGraph, Workspace, atom, ref, rule
from claimweave.operators import closure, formulas, history, lookup, mutate
from claimweave.operators.conjunctive import derive_once, query
from claimweave.operators.fixpoint import RuleProgram
from claimweave.operators.views import Views
from claimweave.sources.export import read_export
from claimweave.sources.store import GraphStore

EDGE = ref("edge")


def path_program():
    return RuleProgram(
        [
            rule(atom("path", "?x", "?y"), atom("current-triple", "?x", EDGE, "?y")),
            rule(atom("path", "?x", "?z"), atom("current-triple", "?x", EDGE, "?y"), atom("path", "?y", "?z")),
        ]
    )


def edges(*pairs):
    return [(a, "edge", b) for a, b in pairs]


def test_chain(spark):
    g = graph(spark, edges("ab", "bc", "cd"))
    found = rows(path_program().derive(g)["path"])
    assert len(found) == 6 and ("a", "d") in found


def test_diamond_has_each_pair_once(spark):
    g = graph(spark, edges("12", "13", "24", "34"))
    found = rows(path_program().derive(g)["path"])
    assert found == [("1", "2"), ("1", "3"), ("1", "4"), ("2", "4"), ("3", "4")]


def test_cycle_and_tree(spark):
    cycle = frame(spark, [("a", "b"), ("b", "c"), ("c", "a")], ["src", "dst"])
    tree = frame(spark, [(k, k // 2) for k in range(1, 20)], ["src", "dst"])
    for squaring in (False, True):
        assert closure.transitive_closure(cycle, squaring=squaring).count() == 9
        assert closure.transitive_closure(tree, squaring=squaring).count() == 69


def test_three_derived_atoms(spark):
    g = graph(spark, edges("ab", "bc") + [("a", "type", lit("source")), ("c", "type", lit("sink"))])
    program = RuleProgram(
        [
            *path_program().rules,
            rule(atom("source", "?x"), atom("current-triple", "?x", ref("type"), "source")),
            rule(atom("sink", "?x"), atom("current-triple", "?x", ref("type"), "sink")),
            rule(atom("flow", "?x", "?y"), atom("source", "?x"), atom("path", "?x", "?y"), atom("sink", "?y")),
        ]
    )
    assert rows(program.derive(g)["flow"]) == [("a", "c")]


def test_derived_relation_exposes_the_literal(spark):
    g = graph(spark, [("sky", "color", lit("blue"))])
    r = rule(atom("color-of", "?x", "?c"), atom("current-triple", "?x", ref("color"), "?v"), atom("value", "?v", "?c"))
    assert rows(derive_once(g, r)) == [("sky", "blue")]


def test_claims_about_claims(spark):
    g = graph(spark, [("a", "p", "b"), ("c:1", "source", "human")])
    found = query(g, atom("claim", "?base", "?l", ref("p"), "?r"), atom("triple", "?base", ref("source"), ref("human")))
    assert rows(found, "base", "l", "r") == [("c:1", "a", "b")]


def test_literal_constant(spark):
    g = graph(spark, [("x", "symbol", lit("tom"))])
    assert query(g, atom("triple", "?x", ref("symbol"), "tom")).count() == 1
    assert query(g, atom("triple", "?x", ref("symbol"), "nobody")).count() == 0


def test_query_is_a_bag_and_a_rule_is_a_set(spark):
    g = graph(spark, edges("ab", "ab"))
    assert query(g, atom("triple", "?x", EDGE, "?y")).count() == 2
    r = rule(atom("e", "?x", "?y"), atom("triple", "?x", EDGE, "?y"))
    assert derive_once(g, r).count() == 1


def test_unbound_head_and_cross_product_are_refused(spark):
    with pytest.raises(ValueError, match="not bound"):
        rule(atom("bad", "?x", "?y"), atom("triple", "?x", EDGE, ref("b")))
    g = graph(spark, edges("ab"))
    with pytest.raises(ValueError, match="cross product"):
        query(g, atom("triple", "?a", EDGE, "?b"), atom("triple", "?c", EDGE, "?d"))
    with pytest.raises(ValueError, match="bound sequence"):
        query(g, atom("as-of-triple", "?n", "?a", EDGE, "?b"))


def test_rule_added_and_replaced(spark):
    g = graph(spark, edges("ab", "bc", "cd"))
    direct = rule(atom("direct", "?x", "?y"), atom("current-triple", "?x", EDGE, "?y"))
    hop2 = rule(
        atom("hop", "?x", "?z"), atom("current-triple", "?x", EDGE, "?y"), atom("current-triple", "?y", EDGE, "?z"),
        rule_id="hop/2",
    )
    hop3 = rule(
        atom("hop", "?x", "?w"), atom("current-triple", "?x", EDGE, "?y"), atom("current-triple", "?y", EDGE, "?z"),
        atom("current-triple", "?z", EDGE, "?w"), rule_id="hop/3",
    )
    views = Views(RuleProgram([direct]), g).materialize()
    views.add_rule(hop2)
    assert views.relation("hop").count() == 2
    views.replace_rule("hop/2", hop3)
    assert rows(views.relation("hop")) == [("a", "d")]
    assert views.relation("direct").count() == 3


def test_replacing_a_rule_keeps_sibling_rules(spark):
    g = graph(spark, edges("ab", "bc"))
    one = rule(atom("near", "?x", "?y"), atom("current-triple", "?x", EDGE, "?y"), rule_id="near/1")
    back = rule(atom("near", "?y", "?x"), atom("current-triple", "?x", EDGE, "?y"), rule_id="near/2")
    self_ = rule(atom("near", "?x", "?x"), atom("current-triple", "?x", EDGE, "?y"), rule_id="near/3")
    views = Views(RuleProgram([one, back]), g).materialize()
    views.replace_rule("near/2", self_)
    assert rows(views.relation("near")) == [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")]


def colour_graph(spark):
    g = graph(spark, [("apple", "color", lit("green"))])
    more = mutate.update(g, requests(spark, [("apple", "color", "v:s:red", 10)]), 2)
    return g.with_claims(more, tx_rows(spark, ("t:2", 2, "agent-A")))


def test_as_of(spark):
    g = colour_graph(spark)
    assert rows(g.as_of(1, p="color"), "r") == [("v:s:green",)]
    assert rows(g.as_of(2, p="color"), "r") == [("v:s:red",)]
    assert rows(g.current(p="color"), "r") == [("v:s:red",)]
    assert rows(g.snapshot(1).current(p="color"), "r") == [("v:s:green",)]


def test_transactions_agents_and_since(spark):
    g = colour_graph(spark)
    assert {r["seq"]: (r["agent"], r["claims"]) for r in history.tx_sizes(g).collect()} == {1: (None, 1), 2: ("agent-A", 2)}
    assert history.claims_since(g, 1).count() == 2
    assert history.claims_by_agent(g, "agent-A").count() == 2
    assert history.latest_seq(g).first()["seq"] == 2


def test_rejected_batch_leaves_no_trace(spark):
    store = GraphStore(spark, Workspace(spark).path("store"))
    store.commit("one", claims(spark, [("a", "p", "b")]))
    more = claims(spark, [("a", "q", "b"), ("a", "q", "c")], seq=2, start=5)
    with pytest.raises(ValueError, match="rejected"):
        store.commit("two", more, validate=more)
    assert store.graph().claims.count() == 1
    # Half-written data of a batch without a log entry is not visible either.
    more.write.partitionBy("p").parquet(f"{store.root}/claims/batch=two")
    assert store.graph().claims.count() == 1
    store.commit("two", more)
    store.commit("two", more)
    assert store.graph().claims.count() == 3
    assert store.graph(upto=1).claims.count() == 1


def test_compaction_keeps_the_graph(spark):
    space = Workspace(spark)
    store, merged = GraphStore(spark, space.path("a")), GraphStore(spark, space.path("b"))
    store.commit("one", claims(spark, [("a", "p", "b")]))
    store.commit("two", claims(spark, [("a", "q", lit("x"))], seq=2, start=5))
    store.compact("all", merged)
    assert rows(merged.graph().claims, "cid", "p", "r") == rows(store.graph().claims, "cid", "p", "r")


def test_update_retract_unlink_history(spark):
    store = GraphStore(spark, Workspace(spark).path("people"))
    first = [("u", "name", lit("Alice")), ("u", "email", lit("old")), ("u", "in", "g1"), ("u", "in", "g2")]
    store.commit("1", claims(spark, first))
    g = store.graph()
    store.commit("2", mutate.update(g, requests(spark, [("u", "email", "v:s:new", 10)]), 2))
    g = store.graph()
    assert rows(lookup.lookup(g, "email"), "value") == [("new",)]
    assert g.claims_where(p="email").count() == 2
    store.commit("3", mutate.unlink(g, requests(spark, [("u", "in", "g1", 11)]), 3))
    g = store.graph()
    assert rows(g.current(p="in"), "r") == [("g2",)]
    store.commit("4", mutate.retract(g, requests(spark, [("u", "email", None, 12)]), 4))
    g = store.graph()
    assert g.current(p="email").count() == 0
    assert rows(lookup.lookup(g, "name"), "value") == [("Alice",)]
    versions = [(r["version"], r["r"], r["valid_from"], r["valid_to"]) for r in history.value_history(g, "email").orderBy("version").collect()]
    assert versions == [(1, "v:s:old", 1, 2), (2, "v:s:new", 2, 4)]


def test_values_are_typed_and_interned(spark):
    g = graph(spark, [("x", "a", lit(1)), ("x", "b", lit(1.0)), ("x", "c", lit("1")), ("x", "d", lit(True)), ("x", "e", lit(False)), ("y", "a", lit(1))])
    assert g.values.count() == 5
    assert lookup.find_by(g, "e", False).count() == 1
    assert rows(lookup.lookup(g, "e"), "value") == [("false",)]


def test_rename_leaves_references(spark):
    g = graph(spark, [("f", "name", lit("old")), ("call", "calls", "f"), ("test", "calls", "f")])
    more = mutate.rename(g, frame(spark, [("f", "new", 10)], "l string, name string, ord bigint"), 2)
    g = g.with_claims(more)
    assert g.current(p="calls", r="f").count() == 2
    assert rows(lookup.names(g)) == [("f", "new")]


def test_affected_includes_the_changed_node(spark):
    depends = frame(spark, [("outer", "inner"), ("other", "leaf")], ["src", "dst"])
    changed = frame(spark, [("inner",)], ["node"])
    assert rows(closure.affected_by(depends, changed), "node") == [("inner",), ("outer",)]


def test_formula_and_branches(spark):
    def binop(n, op, a, b):
        return (n, "binop", op, None, None, None, a, b, None)

    def num(n, x):
        return (n, "literal", None, None, "i", str(x), None, None, None)

    def yes(n, x):
        return (n, "literal", None, None, "b", "true" if x else "false", None, None, None)

    data = [
        num("1", 1), num("2", 2), num("4", 4), num("0", 0), binop("s", "+", "1", "2"), binop("root", "*", "s", "4"),
        binop("bad", "/", "1", "0"), yes("t", True), yes("f", False),
        ("if-t", "if", None, None, None, None, "t", "1", "bad"), ("if-f", "if", None, None, None, None, "f", "bad", "2"),
        ("if-bad", "if", None, None, None, None, "f", "1", "bad"), ("v", "var", None, "x", None, None, None, None, None),
        binop("up", "+", "bad", "v"), binop("unknown", "?", "1", "2"), binop("mixed", "+", "t", "1"),
    ]
    nodes = frame(spark, data, formulas.NODES)
    found = {r["node"]: r for r in formulas.evaluate(nodes).collect()}
    assert len(found) == len(data)
    assert (found["root"]["num"], found["if-t"]["num"], found["if-f"]["num"]) == (12.0, 1.0, 2.0)
    assert found["bad"]["reason"] == found["if-bad"]["reason"] == found["up"]["reason"] == "division by zero"
    assert found["v"]["reason"] == "unbound variable: x"
    assert found["unknown"]["reason"] == "unknown primitive: ?"
    assert found["mixed"]["reason"] == "operands must be literals"
    bound = formulas.evaluate(nodes, frame(spark, [("x", 5.0)], ["param", "value"]))
    assert bound.filter("node = 'v'").first()["num"] == 5.0
    # Division on whole numbers is exact up to double precision.
    roots = frame(spark, [("root",), ("bad",)], ["root"])
    cut = formulas.evaluate(nodes, max_rounds=1)
    assert rows(formulas.run_table(roots, cut), "root", "status") == [("bad", "error"), ("root", "incomplete")]


def test_only_failed_nodes_look_for_their_error(spark):
    data = [("n", "binop", "/", None, None, None, "a", "b", None), ("a", "literal", None, None, "d", "1", None, None, None),
            ("b", "literal", None, None, "d", "0", None, None, None), ("up", "binop", "+", None, None, None, "n", "a", None)]
    done = formulas.evaluate(frame(spark, data, formulas.NODES))
    assert {r["node"]: r["reason"] for r in done.collect()} == {"n": "division by zero", "up": "division by zero", "a": None, "b": None}
    assert "isnull(err" in done._jdf.queryExecution().optimizedPlan().toString()


def test_only_affected_formulas_run_again(spark):
    data = []
    for t in range(100):
        data.append((f"{t}/0", "literal", None, None, "i", "1", None, None, None))
        for d in range(1, 5):
            data.append((f"{t}/{d}", "binop", "+", None, None, None, f"{t}/{d - 1}", f"{t}/0", None))
    nodes = frame(spark, data, formulas.NODES)
    before = Workspace(spark).save(formulas.evaluate(nodes), "before").df()
    data[0] = ("0/0", "literal", None, None, "i", "7", None, None, None)
    changed = frame(spark, [("0/0",)], ["node"])
    after, affected = formulas.reevaluate(frame(spark, data, formulas.NODES), before, changed)
    assert affected.count() == 5
    totals = {r["node"]: r["num"] for r in after.collect()}
    assert len(totals) == 500 and totals["0/4"] == 35.0 and totals["1/4"] == 5.0


@pytest.mark.parametrize("version", [1, 2])
def test_export_document(spark, tmp_path, version):
    data = {
        "objects": ["1", "2", "3", "4"],
        "values": [["2", "symbol"], ["4", 'say "x", ok'], ["5", 1], ["6", 1.5], ["7", True], ["8", "1"], ["9", "supersedes"]],
        "claims": [["c1", "1", "1", "2"], ["c2", "s", "1", "9"], ["c3", "a", "p", "5"], ["c4", "a", "p", "8"], ["c5", "c4", "s", "c3"]],
        "superseded": ["c3"],
    }
    if version == 2:
        data.update({"version": 2, "tx-counter": 2, "claim-txs": [["c1", "t1"], ["c2", "t1"], ["c3", "t1"], ["c4", "t2"], ["c5", "t2"]], "tx-meta": [["t1", 1], ["t2", 2, "bob"]]})
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(data))
    g = read_export(spark, str(path))
    assert rows(g.current(p="p"), "cid", "r") == [("c4", "v:s:1")]
    assert rows(g.values, "vid", "lit")[-1] == ("v:s:symbol", "symbol")
    assert ("v:s:say \"x\", ok", 'say "x", ok') in rows(g.values, "vid", "lit")
    assert {"v:i:1", "v:s:1", "v:d:1.5", "v:b:true"} <= {r[0] for r in rows(g.values, "vid")}
    assert history.latest_seq(g).first()["seq"] == version
    if version == 2:
        assert rows(history.claims_by_agent(g, "bob"), "cid") == [("c4",), ("c5",)]


def test_long_literals_keep_their_text(spark):
    long = "x" * 500
    from claimweave.sources.relational import TableSpec, table_claims, table_values

    df = frame(spark, [(1, long), (2, "short")], "k bigint, text string")
    spec = TableSpec("doc", "k", {"text": "text"})
    g = ClaimGraph(table_claims(df, spec), table_values(df, spec))
    assert {r["value"] for r in lookup.lookup(g, "text").collect()} == {long, "short"}
    assert g.dangling().count() == 0
