"""Steps that must not gather or move more as tables grow."""

from pyspark.sql import functions as F

from claimweave.functions.skew import attach


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_heavy_keys_are_attached_without_meeting_in_one_task(spark):
    keys = "'t' || CASE WHEN id < 3000 THEN 1 WHEN id < 4000 THEN 2 ELSE id END"
    df = spark.range(5000).selectExpr("id", f"CASE WHEN id % 10 <> 9 THEN {keys} END AS tx_id")
    facts = spark.createDataFrame(
        [("t1", 1), ("t1", 11), ("t4001", 5), ("t4001", 6), ("t9999", 7), (None, 8)], "tx_id string, seq bigint"
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = attach(df, facts, "tx_id", df, heavy=500)
        assert _rows(found.select("id", "tx_id", "seq")) == _rows(df.join(facts, "tx_id", "left").select("id", "tx_id", "seq"))
        sizes = found.filter("tx_id = 't1' OR tx_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 2000 < sum(r["count"] for r in sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _saved(monkeypatch):
    """Labels of all tables that workspaces write from now on."""
    from claimweave.workspace import Workspace

    labels, save = [], Workspace.save

    def noted(self, df, label, where=None):
        labels.append(label)
        return save(self, df, label, where)

    monkeypatch.setattr(Workspace, "save", noted)
    return labels


def _paths(edges):
    """(src, dst) -> length of the shortest path of at least one step."""
    found, new, depth = {e: 1 for e in edges}, set(edges), 1
    while new:
        depth += 1
        new = {(a, c) for a, b in new for b2, c in edges if b == b2} - set(found)
        found.update({p: depth for p in new})
    return found


def test_closures_take_strides_and_keep_shortest_depths(spark, monkeypatch):
    from claimweave.operators.closure import _unseen_shortest, transitive_closure
    from claimweave.workspace import Workspace

    chain = [(i, i + 1) for i in range(1, 30)]
    ring = [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(100, 103), (103, 30), (3, 20), (None, 1)]
    edges = sorted(set(chain + ring), key=repr)
    want = _paths([e for e in edges])
    df = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    labels = _saved(monkeypatch)
    found = transitive_closure(df)
    assert {(r["src"], r["dst"]): r["depth"] for r in found.collect()} == want and found.count() == len(want)
    assert labels.count("paths") <= 4 + max(want.values()) // 4 + 1
    # known pairs beyond the small number: one aggregate gives the same
    space = Workspace(spark)
    known = space.save(spark.createDataFrame([(1, 2, 1), (None, 3, 1)], "src long, dst long, depth int"), "known")
    more = spark.createDataFrame([(1, 2, 3), (1, 4, 5), (1, 4, 4), (None, 3, 4), (None, 4, 4)], "src long, dst long, depth int")
    for few in (0, 10):
        assert _rows(_unseen_shortest(more, known, few)) == sorted([(1, 4, 4), (None, 4, 4)], key=repr)


def test_transitive_rules_are_closures(spark, monkeypatch):
    from claimweave.graph import ClaimGraph, CLAIMS
    from claimweave.operators.fixpoint import RuleProgram, transitive
    from claimweave.rules import atom, ref, rule

    edges = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n20", "n15"), ("n3", "n9")]
    claims = spark.createDataFrame([(f"c{i}", a, "to", b, "t:1", 1, i) for i, (a, b) in enumerate(edges)], CLAIMS)
    twice = rule(atom("path", "?x", "?z"), atom("path", "?x", "?y"), atom("path", "?y", "?z"))
    back = rule(atom("path", "?z", "?x"), atom("path", "?x", "?y"), atom("path", "?y", "?z"))
    first = rule(atom("path", "?x", "?y"), atom("current-triple", "?x", ref("to"), "?y"))
    assert transitive(twice) and not transitive(back) and not transitive(first)
    labels = _saved(monkeypatch)
    found = RuleProgram([first, twice]).derive(ClaimGraph(claims))["path"]
    assert _rows(found) == sorted(_paths(edges), key=repr)
    assert "paths" in labels and labels.count("tuples") == 1
    # a rule that is no closure goes on by rounds, new tuples joined once
    want = set(edges)
    while True:
        more = want | {(c, a) for a, b in want for b2, c in want if b == b2}
        if more == want:
            break
        want = more
    assert _rows(RuleProgram([first, back]).derive(ClaimGraph(claims))["path"]) == sorted(want, key=repr)


def test_what_cannot_return_is_not_looked_for(spark, monkeypatch):
    from claimweave.graph import ClaimGraph, CLAIMS
    from claimweave.operators.fixpoint import RuleProgram
    from claimweave.operators.support import SupportedViews
    from claimweave.rules import atom, ref, rule

    rows = [("c1", "a", "in", "b", "t:1", 1, 1), ("c2", "b", "in", "c", "t:1", 1, 2), ("c3", "d", "by", "a", "t:1", 1, 3)]
    located = rule(atom("step", "?x", "?y"), atom("current-triple", "?x", ref("in"), "?y"))
    placed = rule(atom("step", "?x", "?y"), atom("current-triple", "?x", ref("by"), "?y"))
    within = [
        rule(atom("within", "?x", "?y"), atom("step", "?x", "?y")),
        rule(atom("within", "?x", "?z"), atom("step", "?x", "?y"), atom("within", "?y", "?z")),
    ]
    views = SupportedViews(RuleProgram([located, placed, *within]), ClaimGraph(spark.createDataFrame(rows, CLAIMS))).materialize()
    labels = _saved(monkeypatch)
    views.replace_rule(located.rule_id, rule(atom("place", "?x", "?y"), atom("current-triple", "?x", ref("in"), "?y")))
    assert _rows(views.relation("within")) == [("d", "a")]
    assert _rows(views.relation("place")) == [("a", "b"), ("b", "c")]
    assert "fallen" in labels and "pool" not in labels
