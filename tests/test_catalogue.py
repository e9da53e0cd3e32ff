"""Rules kept as data: built again, deriving again, replaced, refused when text only."""

import random

import pytest

from claimweave import ClaimGraph, atom, ref, rule
from claimweave.operators.catalogue import catalogue_with_tuples, derived_again, program_of, replaced, rule_rows, rules_of
from claimweave.operators.fixpoint import RuleProgram
from claimweave.sources.store import GraphStore

CLAIMS = "cid string, l string, p string, r string, tx_id string, tx_seq bigint, ord bigint"


def edges(spark, pairs):
    rows = [(f"c:{i}", a, "edge", b, "t:1", 1, i) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, CLAIMS)


def closure(name="path"):
    return [
        rule(atom(name, "?x", "?y"), atom("current-triple", "?x", ref("edge"), "?y")),
        rule(atom(name, "?x", "?z"), atom("current-triple", "?x", ref("edge"), "?y"), atom(name, "?y", "?z")),
    ]


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


def test_every_kind_of_argument_comes_back(spark):
    rules = [
        rule(atom("kinds", "?x", ref("e:a/1"), 7, -2.5, 1e10, True, None, "it's ?y", ""), atom("triple", "?x", ref("p"), "text"), rule_id="rule:k"),
        *closure(),
    ]
    assert sorted(rules_of(rule_rows(spark, rules)), key=lambda r: r.rule_id) == sorted(rules, key=lambda r: r.rule_id)
    assert rules_of(rule_rows(spark, [])) == [] and program_of(rule_rows(spark, [])).arity == {}


def test_restored_graph_answers_a_recursive_rule(spark, tmp_path):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(20)})
    GraphStore(spark, str(tmp_path / "g")).commit("one", edges(spark, pairs), rules=rule_rows(spark, closure()))
    back = GraphStore(spark, str(tmp_path / "g")).graph()
    want = pairs_of(RuleProgram(closure()).derive(ClaimGraph(edges(spark, pairs)))["path"])
    assert want and pairs_of(derived_again(back)["path"]) == want
    counts = {r.rule_id: r.tuples for r in catalogue_with_tuples(back).collect()}
    steps = {(a, d) for a, b in pairs for c, d in want if b == c}
    assert counts == {closure()[0].rule_id: len(pairs), closure()[1].rule_id: len(steps)}


def test_replacement_in_a_later_batch(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    old = rule(atom("near", "?x", "?y"), atom("current-triple", "?x", ref("edge"), "?y"), rule_id="rule:near/1")
    new = rule(atom("near", "?y", "?x"), *old.body, rule_id="rule:near/2")
    store.commit("one", edges(spark, [("a", "b")]), rules=rule_rows(spark, [old]))
    store.commit("two", edges(spark, []), rules=replaced(rule_rows(spark, [old]), old.rule_id, rule_rows(spark, [new])))
    graph = GraphStore(spark, str(tmp_path / "g")).graph()
    assert [r.rule_id for r in rules_of(graph.rules)] == ["rule:near/2"]
    assert pairs_of(derived_again(graph)["near"]) == {("b", "a")}
    rows = {(r.rule_id, r.live, r.replaced_by, r.tuples) for r in catalogue_with_tuples(graph).collect()}
    assert rows == {("rule:near/1", False, "rule:near/2", None), ("rule:near/2", True, None, 1)}


def test_text_only_rules_are_refused(spark, tmp_path):
    text = spark.createDataFrame([("rule:x", "x", "x(?a) :- ...", True, None)], "rule_id string, head_rel string, source string, live boolean, replaced_by string")
    store = GraphStore(spark, str(tmp_path / "g"))
    store.commit("one", edges(spark, [("a", "b")]), rules=text)
    with pytest.raises(ValueError, match="rule:x"):
        program_of(store.graph().rules)
