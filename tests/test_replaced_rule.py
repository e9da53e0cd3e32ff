"""A replaced rule: readers follow, and only what stands is left on disk."""

from kept import Seen, left

from claimweave.graph import CLAIMS, ClaimGraph
from claimweave.operators.fixpoint import RuleProgram
from claimweave.operators.support import SupportedViews
from claimweave.rules import atom, ref, rule


def links(spark, pairs, p="located-in"):
    rows = [(f"c:{p}/{a}/{b}", a, p, b, "t:1", 1, k) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, CLAIMS)


def test_a_replaced_rule_leaves_only_what_stands(spark, tmp_path):
    inside = links(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")]).unionByName(links(spark, [("a", "x"), ("x", "b")], "part-of"))
    located, part = (atom("current-triple", "?x", ref(p), "?y") for p in ("located-in", "part-of"))
    program = RuleProgram([
        rule(atom("step", "?x", "?y"), located, rule_id="r1"),
        rule(atom("step", "?x", "?y"), part, rule_id="r2"),
        rule(atom("within", "?x", "?y"), atom("step", "?x", "?y"), rule_id="r3"),
        rule(atom("within", "?x", "?z"), atom("step", "?x", "?y"), atom("within", "?y", "?z"), rule_id="r4"),
    ])
    space = Seen(spark, str(tmp_path))
    views = SupportedViews(program, ClaimGraph(inside), space).materialize()
    views.replace_rule("r1", rule(atom("place", "?x", "?y"), located, rule_id="r5"))
    assert {tuple(r) for r in views.relation("within").collect()} == {("a", "x"), ("x", "b"), ("a", "b")}
    assert {tuple(r) for r in views.relation("place").collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")}
    assert not left(spark, space) & {"hit", "asked", "dead", "pool", "born-again"}
    assert SupportedViews(program, ClaimGraph(inside)).space.tidy
