"""Equivalences on random data, and brute force on small fixtures."""

import random

import pytest
from graphs import claims, closure_of, frame, graph, requests, rows, stored, tx_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave import ClaimGraph, Workspace, atom, ref, rule
from claimweave.functions.ordered import cut, neighbour_in_group, number_in_group
from claimweave.functions.skew import attach_sizes
from claimweave.graph import CLAIMS
from claimweave.operators import checks, closure, history, lookup, mutate, naming, pairs
from claimweave.operators.fixpoint import RuleProgram
from claimweave.operators.lineage import SEPARATOR, lineage, touched
from claimweave.operators.views import Views
from claimweave.sources.relational import implicit_transactions
from claimweave.workspace import unseen

EDGE = ref("edge")


def programs():
    step = rule(atom("path", "?x", "?y"), atom("current-triple", "?x", EDGE, "?y"))
    linear = rule(atom("path", "?x", "?z"), atom("current-triple", "?x", EDGE, "?y"), atom("path", "?y", "?z"))
    square = rule(atom("path", "?x", "?z"), atom("path", "?x", "?y"), atom("path", "?y", "?z"))
    return {"linear": RuleProgram([step, linear]), "square": RuleProgram([step, square])}


@pytest.mark.parametrize("kind", ["linear", "square"])
def test_maintained_views_equal_recomputation(spark, kind):
    rng = random.Random(7)
    names = "abcdefg"
    first = [(rng.choice(names), "edge", rng.choice(names)) for _ in range(9)]
    live = {f"c:{i}": (l, r) for i, (l, _, r) in enumerate(first, 1)}
    views = Views(programs()[kind], graph(spark, first)).materialize()
    assert set(rows(views.stored["path"].df())) == closure_of(set(live.values()))
    for seq in (2, 3) if kind == "linear" else (2,):
        start = seq * 100
        new = [(rng.choice(names), "edge", rng.choice(names)) for _ in range(2)]
        dead = rng.sample(sorted(live), 3)
        hide = [(f"m:{c}", "supersedes", c) for c in dead]
        for i, (l, _, r) in enumerate(new, start):
            live[f"c:{i}"] = (l, r)
        for c in dead:
            del live[c]
        views.apply(claims(spark, new + hide, seq, start), tx_rows(spark, (f"t:{seq}", seq, None)))
        found = rows(views.stored["path"].df())
        assert len(found) == len(set(found))
        assert set(found) == closure_of(set(live.values()))
        assert not views.stale()


def test_claims_hidden_on_arrival_are_never_derived(spark):
    views = Views(programs()["linear"], graph(spark, [("a", "edge", "b")])).materialize()
    change = claims(spark, [("b", "edge", "c"), ("x", "supersedes", "c:10")], 2, 10)
    views.apply(change, tx_rows(spark, ("t:2", 2, None)))
    assert rows(views.relation("path")) == [("a", "b")]


def test_lineage_names_what_a_deletion_may_touch(spark):
    edges = [("a", "edge", "b"), ("b", "edge", "c"), ("a", "edge", "c"), ("c", "edge", "d"), ("d", "edge", "c")]
    g = graph(spark, edges)
    program = programs()["linear"]
    relations = program.derive(g)
    found = lineage(program, g, relations)
    both = {r["cid"] for r in found.filter(F.col("tuple_key") == f"a{SEPARATOR}c").collect()}
    assert {"c:1", "c:2", "c:3"} <= both
    hit = touched(found, frame(spark, [("c:2",)], ["cid"]))
    keys = {tuple(r["tuple_key"].split(SEPARATOR)) for r in hit.collect()}
    without = closure_of({(l, r) for l, _, r in edges if (l, r) != ("b", "c")})
    lost = closure_of({(l, r) for l, _, r in edges}) - without
    assert lost <= keys


def test_as_of_the_latest_equals_current(spark):
    rng = random.Random(3)
    g = graph(spark, [(f"e{i % 5}", "p", f"v:i:{i}") for i in range(12)])
    for seq in (2, 3):
        wanted = [(f"e{i}", "p", f"v:i:{rng.randint(0, 9)}", seq * 100 + i) for i in range(4)]
        more = stored(mutate.update(g, requests(spark, wanted), seq))
        g = g.with_claims(more, tx_rows(spark, (f"t:{seq}", seq, None)))
    assert rows(g.as_of(3), "cid") == rows(g.current(), "cid")
    assert history.state_diff(g, 3, 3).count() == 0


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_ranges_give_the_same_order_as_one_window(spark, span):
    rng = random.Random(span)
    data = [("hot", i) for i in rng.sample(range(200), 60)] + [(f"k{i % 7}", 300 + i) for i in range(30)]
    df = frame(spark, data, ["k", "o"])
    w = Window.partitionBy("k").orderBy("o")
    want = rows(df.select("k", "o", F.row_number().over(w).cast("bigint"), F.lead("o").over(w), F.lag("o").over(w)).na.fill(-1))
    got = number_in_group(df, ["k"], "o", "n", span=span)
    got = neighbour_in_group(got, ["k"], "o", {"next": F.col("o")}, span=span)
    got = neighbour_in_group(got, ["k"], "o", {"prev": F.col("o")}, forward=False, span=span)
    assert rows(got.na.fill(-1), "k", "o", "n", "next", "prev") == want


@pytest.mark.parametrize("keys", [["k"], []])
def test_a_hot_group_with_sparse_orders_is_cut_by_rank(spark, keys):
    """A third of all rows in one group, order values a million apart, some far away."""
    hot = [("hot", i * 10**6 + (10**15 if i % 50 == 0 else 0)) for i in range(3_000)]
    data = hot + [(f"k{i % 900}", 7 + i) for i in range(6_000)]
    df = frame(spark, data, ["k", "o"]).repartition(7)
    pieces = cut(df, keys, "o", span=100).groupBy(*keys, "_range").count().collect()
    assert max(r["count"] for r in pieces) <= 150
    assert sum(r["count"] for r in pieces) == len(data)
    if keys:
        assert len([r for r in pieces if r["k"] == "hot"]) <= 2 * 30 + 1
        w = Window.partitionBy("k").orderBy("o")
        want = rows(df.select("k", "o", F.row_number().over(w).cast("bigint"), F.lead("o").over(w)).na.fill(-1))
        got = neighbour_in_group(number_in_group(df, ["k"], "o", "n", span=100), ["k"], "o", {"next": F.col("o")}, span=100)
        assert rows(got.na.fill(-1), "k", "o", "n", "next") == want
    else:
        claims_ = df.select(F.concat("k", F.col("o").cast("string")).alias("cid"), F.lit("l").alias("l"), F.lit("p").alias("p"), F.lit("r").alias("r"), F.col("o").alias("ord"))
        seqs = rows(implicit_transactions(claims_, "ord", 5, span=100), "ord", "tx_seq")
        assert seqs == [(o, 6 + i) for i, o in enumerate(sorted(o for _, o in data))]


@pytest.mark.parametrize("few", [0, 100])
def test_unseen_rows(spark, few):
    known = Workspace(spark).save(frame(spark, [(1, 2), (3, 4)], ["a", "b"]), "known")
    found = unseen(frame(spark, [(1, 2), (5, 6), (5, 6), (3, 5)], ["a", "b"]), known, few)
    assert rows(found) == [(3, 5), (5, 6)]


def test_heavy_keys_get_the_same_sizes(spark):
    df = frame(spark, [("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(20)], ["k", "x"])
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for heavy in (1, 10, 10**6):
        assert rows(attach_sizes(df, sizes, "k", "n", heavy)) == rows(df.join(sizes, "k").select("k", "x", "n"))


def test_closure_and_hops_on_random_graphs(spark):
    rng = random.Random(11)
    edges = {(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(25)}
    df = frame(spark, sorted(edges), ["src", "dst"])
    want = closure_of(edges)
    assert set(rows(closure.transitive_closure(df), "src", "dst")) == want
    assert set(rows(closure.transitive_closure(df, squaring=True))) == want
    two = {(a, d) for a, b in edges for c, d in edges if b == c}
    assert set(rows(pairs.k_hop(df, 2))) == two
    seeds = frame(spark, [(3,), (5,)], ["node"])
    reached = {b for a, b in want if a in (3, 5)} | {3, 5}
    assert {r[0] for r in rows(closure.reach(df, seeds), "node")} == reached
    total = pairs.shared_targets(df).agg(F.sum("partners")).first()[0]
    assert total == sum(1 for a, c in edges for b, d in edges if c == d)


def test_a_hub_with_a_third_of_all_edges(spark):
    edges = [("hub", f"x{i}") for i in range(300)] + [(f"y{i}", "hub") for i in range(300)] + [(f"z{i}", f"z{i + 1}") for i in range(300)]
    df = frame(spark, edges, ["src", "dst"])
    assert pairs.k_hop(df, 2).count() == 300 * 300 + 299
    counts = {r["c"]: r["pairs"] for r in pairs.pair_counts(df).collect()}
    assert counts["hub"] == 90_000


def brute_near(missing, known, k=5):
    out = set()
    for name in set(missing):
        low = name.lower()
        hits = sorted(
            c for c in set(known)
            if c.lower() in low or low in c.lower() or (len(low) >= 4 and low[:4] == c.lower()[:4] and len(c) >= 4)
        )
        out |= {(name, c) for c in hits[:k]}
    return out


def test_near_names_against_brute_force(spark):
    rng = random.Random(5)
    letters = "abAB_"
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    missing = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    found = naming.near_names(
        frame(spark, [(m,) for m in missing], ["name"]), frame(spark, [(n,) for n in known], ["name"])
    )
    assert set(rows(found, "name", "candidate")) == brute_near(missing, known)


def test_moves_applied_in_turn(spark):
    allowed = {("a", "b"), ("b", "c"), ("c", "a")}
    rng = random.Random(2)
    moves = [(f"e{i % 3}", rng.choice("abc"), i) for i in range(15)]
    want, accepted = {f"e{i}": "a" for i in range(3)}, 0
    for entity, target, _ in moves:
        if (want[entity], target) in allowed:
            want[entity], accepted = target, accepted + 1
    states = frame(spark, sorted({(e, "a") for e in want}), ["entity", "state"])
    left = frame(spark, moves, ["entity", "target", "ord"])
    rules = frame(spark, sorted(allowed), ["from_name", "to_name"])
    space, seen = Workspace(spark), 0
    while left.take(1):
        after, outcome, later = checks.apply_moves(states, left, rules)
        seen += outcome.filter("allowed").count()
        states = space.save(after, "states").df()
        left = space.save(later, "later").df()
    assert dict(rows(states)) == want and seen == accepted


def test_newest_is_by_insertion_not_by_transaction_text(spark):
    data = [(f"c:{i}", "x", "p", f"v:i:{i}", f"t:{i}", i, i) for i in range(1, 12)]
    g = ClaimGraph(frame(spark, data, CLAIMS))
    assert rows(lookup.lookup(g, "p"), "value") == [("11",)]


def test_appended_claims_keep_agents_and_transactions(spark):
    from claimweave import ClaimGraph

    columns = "cid string, l string, p string, r string, tx_id string, tx_seq bigint, ord bigint"
    one = spark.createDataFrame([("c:1", "e:a/1", "name", "v:s:x", "t:1", 1, 1)], columns)
    two = spark.createDataFrame([("c:2", "e:a/1", "name", "v:s:y", "t:3", 3, 2)], columns)
    txs = spark.createDataFrame([("t:1", 1, "ann"), ("t:2", 2, "bob")], "tx_id string, seq bigint, agent string")
    after = ClaimGraph(one, txs=txs).with_claims(two).txs
    assert sorted((r.tx_id, r.seq, r.agent) for r in after.collect()) == [("t:1", 1, "ann"), ("t:2", 2, "bob"), ("t:3", 3, None)]


def test_chain_longer_than_any_default_budget_of_rounds():
    from itertools import islice

    from claimweave.workspace import rounds

    assert list(islice(rounds(2, None), 20_000))[-1] == 20_001
    assert list(rounds(1, 3)) == [1, 2, 3]


def test_rule_tables_of_any_size_have_the_same_types(spark):
    from claimweave.functions.tables import rule_table

    rows = [(i % 7, 2.5, None, f"it's {i}") for i in range(12_000)]
    small, large = (rule_table(spark, ["a", "b", "c", "d"], part) for part in (rows[:9], rows))
    assert small.schema == large.schema
    assert large.count() == 12_000
    assert large.filter("d = 'it\\'s 11999' AND c IS NULL").first().a == 11_999 % 7
