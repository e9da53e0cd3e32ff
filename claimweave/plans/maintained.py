"""Lineage and maintained relations over the containment closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.operators.catalogue import catalogue_with_tuples, derived_again, replaced, rule_rows
from claimweave.operators.fixpoint import RuleProgram
from claimweave.operators.lineage import keyed, lineage, touched
from claimweave.operators.mutate import assert_claims, invalidate, supersede
from claimweave.operators.support import SupportedViews
from claimweave.operators.views import Views
from claimweave.plans.recursion import SQL_WITHIN, containment
from claimweave.plans.registry import analysis, once, stored_graph, table
from claimweave.plans.shop import PLACES, claims_of, shop
from claimweave.rules import atom, ref, rule

LOCATED = ref("located-in")
NOW = 10**15


def within() -> RuleProgram:
    return RuleProgram(
        [
            rule(atom("within", "?x", "?y"), atom("current-triple", "?x", LOCATED, "?y")),
            rule(
                atom("within", "?x", "?z"),
                atom("current-triple", "?x", LOCATED, "?y"),
                atom("within", "?y", "?z"),
            ),
        ]
    )


def places(spark, sf):
    return once(spark, sf, "places", lambda: stored_graph(spark, claims_of(spark, sf, *PLACES), "places"))


_EDGES = """
e AS (
  SELECT 'e:customer/' || c_custkey AS src, 'e:nation/' || c_nationkey AS dst,
         'c:customer/' || c_custkey || '/located-in' AS cid FROM customer
  UNION ALL SELECT 'e:supplier/' || s_suppkey, 'e:nation/' || s_nationkey,
         'c:supplier/' || s_suppkey || '/located-in' FROM supplier
  UNION ALL SELECT 'e:nation/' || n_nationkey, 'e:region/' || n_regionkey,
         'c:nation/' || n_nationkey || '/located-in' FROM nation)
"""
_PATHS = "p AS (SELECT src, dst FROM {e} UNION SELECT p.src, x.dst FROM p JOIN {e} x ON p.dst = x.src)"


@analysis(
    "materialized_relations",
    f"WITH RECURSIVE {_EDGES}, {_PATHS.format(e='e')} SELECT src AS a0, dst AS a1 FROM p",
)
def _(spark, sf):
    views = Views(within(), places(spark, sf)).materialize()
    return views.relation("within")


@analysis(
    "lineage_rows",
    f"WITH RECURSIVE {_EDGES}, q AS (SELECT src, dst, [cid] AS cids FROM e UNION ALL "
    "SELECT e.src, q.dst, list_prepend(e.cid, q.cids) FROM q JOIN e ON e.dst = q.src) "
    "SELECT DISTINCT src AS a0, dst AS a1, unnest(cids) AS cid FROM q",
)
def _(spark, sf):
    graph = places(spark, sf)
    program = within()
    relations = program.derive(graph)
    rows = lineage(program, graph, relations)
    tuples = keyed(relations["within"], "within")
    return tuples.join(rows, ["rel", "tuple_key"]).select("a0", "a1", "cid")


@analysis(
    "tuples_touched_by_claims",
    f"WITH RECURSIVE {_EDGES}, q AS (SELECT src, dst, [cid] AS cids FROM e UNION ALL "
    "SELECT e.src, q.dst, list_prepend(e.cid, q.cids) FROM q JOIN e ON e.dst = q.src), "
    "x AS (SELECT DISTINCT src, dst, unnest(cids) AS cid FROM q) "
    "SELECT DISTINCT src AS a0, dst AS a1 FROM x WHERE cid IN (SELECT 'c:nation/' || n_nationkey || '/located-in' FROM nation WHERE n_regionkey = 1)",
)
def _(spark, sf):
    graph = places(spark, sf)
    program = within()
    relations = program.derive(graph)
    rows = lineage(program, graph, relations)
    cids = graph.claims_where(p="located-in", r="e:region/1")
    hit = touched(rows, cids.select("cid"))
    tuples = keyed(relations["within"], "within")
    return tuples.join(hit, ["rel", "tuple_key"], "left_semi").select("a0", "a1")


def _moves(spark, sf):
    """New links: the customers of one segment also sit in the nation after their own."""
    customer = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return assert_claims(
        customer.select(
            ids.entity_id("customer", "c_custkey").alias("l"), F.lit("located-in").alias("p"),
            ids.entity_id("nation", ((F.col("c_nationkey") + 1) % 25)).alias("r"),
            (F.lit(NOW) + F.col("c_custkey")).alias("ord"),
        ),
        2,
    )


_MOVED = (
    "m AS (SELECT src, dst FROM e UNION ALL SELECT 'e:customer/' || c_custkey, "
    "'e:nation/' || ((c_nationkey + 1) % 25) FROM customer WHERE c_mktsegment = 'BUILDING')"
)


def _txs(spark, seq):
    return spark.range(1).select(
        F.lit(f"t:{seq}").alias("tx_id"), F.lit(seq).cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("agent"),
    )


@analysis(
    "insertions_maintained",
    f"WITH RECURSIVE {_EDGES}, {_MOVED}, {_PATHS.format(e='m')} SELECT src AS a0, dst AS a1 FROM p",
)
def _(spark, sf):
    views = Views(within(), places(spark, sf)).materialize()
    views.apply(_moves(spark, sf), _txs(spark, 2))
    return views.relation("within")


_KEPT = "k AS (SELECT src, dst FROM e WHERE cid NOT IN (SELECT 'c:nation/' || n_nationkey || '/located-in' FROM nation WHERE n_regionkey = 1))"


@analysis(
    "supersessions_maintained",
    f"WITH RECURSIVE {_EDGES}, {_KEPT}, {_PATHS.format(e='k')} SELECT src AS a0, dst AS a1 FROM p",
)
def _(spark, sf):
    graph = places(spark, sf)
    views = Views(within(), graph).materialize()
    doomed = table(spark, sf, "nation").filter("n_regionkey = 1").select(
        F.concat(F.lit("c:nation/"), F.col("n_nationkey").cast("string"), F.lit("/located-in")).alias("cid")
    )
    views.apply(invalidate(doomed, 2), _txs(spark, 2))
    return views.relation("within")


@analysis(
    "mixed_changes_maintained",
    f"WITH RECURSIVE {_EDGES}, {_KEPT}, m AS (SELECT src, dst FROM k UNION ALL SELECT 'e:customer/' || c_custkey, "
    "'e:nation/' || ((c_nationkey + 1) % 25) FROM customer WHERE c_mktsegment = 'BUILDING'), "
    f"{_PATHS.format(e='m')} SELECT src AS a0, dst AS a1 FROM p",
)
def _(spark, sf):
    # A customer that loses one way to a region may keep another through its new nation.
    views = Views(within(), places(spark, sf)).materialize()
    doomed = table(spark, sf, "nation").filter("n_regionkey = 1").select(
        F.concat(F.lit("c:nation/"), F.col("n_nationkey").cast("string"), F.lit("/located-in")).alias("cid")
    )
    change = _moves(spark, sf).unionByName(invalidate(doomed, 2))
    views.apply(change, _txs(spark, 2))
    return views.relation("within")


@analysis(
    "stale_relation_recomputed",
    f"WITH RECURSIVE {_EDGES}, {_MOVED}, {_PATHS.format(e='m')} SELECT src AS a0, dst AS a1 FROM p",
)
def _(spark, sf):
    # Claims appended behind the views' back: the next read notices and recomputes.
    views = Views(within(), places(spark, sf)).materialize()
    views.graph = views.graph.with_claims(_moves(spark, sf), _txs(spark, 2))
    return views.relation("within")


# -- relations stored with their derivations -----------------------------------

# One customer in a hundred moves to the next nation.
_MOVING = "c_custkey % 100 = 7"


def customer_moves(spark, sf):
    customer = table(spark, sf, "customer").filter(_MOVING)
    return supersede(
        customer.select(
            F.concat(F.lit("c:customer/"), F.col("c_custkey").cast("string"), F.lit("/located-in")).alias("old_cid"),
            ids.entity_id("customer", "c_custkey").alias("l"), F.lit("located-in").alias("p"),
            ids.entity_id("nation", ((F.col("c_nationkey") + 1) % 25)).alias("r"),
            (F.lit(NOW) + F.col("c_custkey")).alias("ord"),
        ),
        2,
    )


def containment_views(spark, sf) -> SupportedViews:
    return SupportedViews(containment(), shop(spark, sf)).materialize()


def moved_views(spark, sf, views: SupportedViews) -> SupportedViews:
    views.apply(customer_moves(spark, sf), _txs(spark, 2))
    return views


_MOVED_CUSTOMERS = SQL_WITHIN.replace(
    "'e:nation/' || c_nationkey AS dst FROM customer",
    f"'e:nation/' || CASE WHEN {_MOVING} THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS dst FROM customer",
)


@analysis("stored_derivations_maintained", f"{_MOVED_CUSTOMERS} SELECT src AS a0, dst AS a1 FROM p")
def _(spark, sf):
    return moved_views(spark, sf, containment_views(spark, sf)).relation("within")


_MOVED_EDGES = """
e AS (
  SELECT 'e:customer/' || c_custkey AS src,
         'e:nation/' || CASE WHEN {moving} THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS dst,
         CASE WHEN {moving} THEN 'c:2/' || ({now} + c_custkey) ELSE 'c:customer/' || c_custkey || '/located-in' END AS cid FROM customer
  UNION ALL SELECT 'e:supplier/' || s_suppkey, 'e:nation/' || s_nationkey,
         'c:supplier/' || s_suppkey || '/located-in' FROM supplier
  UNION ALL SELECT 'e:nation/' || n_nationkey, 'e:region/' || n_regionkey,
         'c:nation/' || n_nationkey || '/located-in' FROM nation)
""".format(moving=_MOVING, now=NOW)


@analysis(
    "stored_lineage_after_moves",
    f"WITH RECURSIVE {_MOVED_EDGES}, q AS (SELECT src, dst, [cid] AS cids FROM e UNION ALL "
    "SELECT e.src, q.dst, list_prepend(e.cid, q.cids) FROM q JOIN e ON e.dst = q.src) "
    "SELECT DISTINCT src AS a0, dst AS a1, unnest(cids) AS cid FROM q",
)
def _(spark, sf):
    views = moved_views(spark, sf, SupportedViews(within(), places(spark, sf)).materialize())
    tuples = keyed(views.relation("within"), "within")
    return tuples.join(views.lineage(), ["rel", "tuple_key"]).select("a0", "a1", "cid")


@analysis(
    "derivations_of_tuples",
    f"WITH RECURSIVE {_MOVED_EDGES}, {_PATHS.format(e='e')}, "
    "one AS (SELECT src, dst, count(*) AS n FROM e GROUP BY ALL), "
    "two AS (SELECT e.src, p.dst, count(*) AS n FROM e JOIN p ON e.dst = p.src GROUP BY ALL) "
    "SELECT p.src AS a0, p.dst AS a1, coalesce(one.n, 0) + coalesce(two.n, 0) AS derivations "
    "FROM (SELECT DISTINCT src, dst FROM p) p LEFT JOIN one USING (src, dst) LEFT JOIN two USING (src, dst)",
)
def _(spark, sf):
    views = moved_views(spark, sf, SupportedViews(within(), places(spark, sf)).materialize())
    rows = views.living().filter("rel = 'within'")
    return rows.groupBy(F.col("args")[0].alias("a0"), F.col("args")[1].alias("a1")).agg(F.count(F.lit(1)).alias("derivations"))


@analysis(
    "rule_replaced_below_readers",
    f"WITH RECURSIVE {_EDGES}, b AS (SELECT 'e:order/' || o_orderkey AS src, 'e:customer/' || o_custkey AS dst FROM orders), "
    "s AS (SELECT src, dst FROM b), p AS (SELECT src, dst FROM s UNION SELECT s.src, p.dst FROM p JOIN s ON s.dst = p.src) "
    "SELECT src AS a0, dst AS a1 FROM p UNION SELECT src, dst FROM e",
)
def _(spark, sf):
    # Places no longer count as steps, but their own relation keeps them: readers follow.
    views = containment_views(spark, sf)
    located = next(r for r in views.program.rules if r.head.rel == "step" and r.body[0].args[1] == LOCATED)
    views.replace_rule(located.rule_id, rule(atom("place", "?x", "?y"), atom("current-triple", "?x", LOCATED, "?y")))
    return views.relation("within").unionByName(views.relation("place")).distinct()


def first_mentions() -> RuleProgram:
    """Rules over objects and transactions, whose changes are first mentions."""
    return RuleProgram(
        [
            rule(atom("place", "?x"), atom("object", "?x"), atom("current-triple", "?y", LOCATED, "?x")),
            rule(
                atom("stated", "?t", "?x"),
                atom("tx-info", "?t", "?s"), atom("tx-claims-rel", "?t", "?c"), atom("claim", "?c", "?y", LOCATED, "?x"),
            ),
        ]
    )


_MENTIONS = (
    "SELECT 'place' AS rel, NULL AS tx, 'e:nation/' || n_nationkey || '/new' AS x FROM nation "
    "UNION SELECT 'place', NULL, 'e:nation/' || c_nationkey FROM customer UNION SELECT 'place', NULL, 'e:nation/' || s_nationkey FROM supplier "
    "UNION SELECT 'place', NULL, 'e:region/' || n_regionkey FROM nation "
    "UNION SELECT 'stated', 't:1', 'e:nation/' || c_nationkey FROM customer UNION SELECT 'stated', 't:1', 'e:nation/' || s_nationkey FROM supplier "
    "UNION SELECT 'stated', 't:1', 'e:region/' || n_regionkey FROM nation UNION SELECT 'stated', 't:2', 'e:nation/' || n_nationkey || '/new' FROM nation"
)


@analysis("first_mentions_maintained", _MENTIONS)
def _(spark, sf):
    # Places and transactions that no claim named before reach the views by the change alone.
    views = SupportedViews(first_mentions(), places(spark, sf)).materialize()
    nation = table(spark, sf, "nation")
    new = assert_claims(
        nation.select(
            ids.entity_id("nation", "n_nationkey").alias("l"), F.lit("located-in").alias("p"),
            F.concat(ids.entity_id("nation", "n_nationkey"), F.lit("/new")).alias("r"), (F.lit(NOW) + F.col("n_nationkey")).alias("ord"),
        ),
        2,
    )
    views.apply(new, _txs(spark, 2))
    none = F.lit(None).cast("string")
    place = views.relation("place").select(F.lit("place").alias("rel"), none.alias("tx"), F.col("a0").alias("x"))
    return place.unionByName(views.relation("stated").select(F.lit("stated").alias("rel"), F.col("a0").alias("tx"), F.col("a1").alias("x")))


def _same_place():
    return rule(
        atom("two-up", "?x", "?z"),
        atom("current-triple", "?x", LOCATED, "?y"),
        atom("within", "?y", "?z"),
        rule_id="rule:two-up/1",
    )


@analysis(
    "rule_added_to_views",
    "SELECT 'e:customer/' || c_custkey AS a0, 'e:region/' || n_regionkey AS a1 FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'e:supplier/' || s_suppkey, 'e:region/' || n_regionkey "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def _(spark, sf):
    views = Views(within(), places(spark, sf)).materialize()
    views.add_rule(_same_place())
    return views.relation("two-up")


@analysis(
    "rule_replaced_in_views",
    "SELECT DISTINCT 'e:nation/' || n_nationkey AS a0, 'e:region/' || n_regionkey AS a1 FROM nation",
)
def _(spark, sf):
    views = Views(within(), places(spark, sf)).materialize()
    views.add_rule(_same_place())
    views.replace_rule(
        "rule:two-up/1",
        rule(
            atom("two-up", "?y", "?z"),
            atom("current-triple", "?x", LOCATED, "?y"),
            atom("current-triple", "?y", LOCATED, "?z"),
            rule_id="rule:two-up/2",
        ),
    )
    return views.relation("two-up")


def _two_up_again():
    return rule(atom("two-up", "?x", "?z"), *_same_place().body, rule_id="rule:two-up/2")


def _restored(spark, sf):
    """All places with the rules of containment and one replaced rule, stored and read back."""
    old = _same_place()
    catalogue = replaced(rule_rows(spark, [*within().rules, old]), old.rule_id, rule_rows(spark, [_two_up_again()]))
    return stored_graph(spark, claims_of(spark, sf, *PLACES), "rules", rules=catalogue)


_ONE_STEP, _MORE_STEPS = (r.rule_id for r in within().rules)


@analysis(
    "rule_catalogue",
    f"WITH RECURSIVE {_EDGES}, {_PATHS.format(e='e')}, "
    "one AS (SELECT count(*) AS n FROM (SELECT DISTINCT src, dst FROM e)), "
    "two AS (SELECT count(*) AS n FROM (SELECT DISTINCT e.src, p.dst FROM e JOIN p ON e.dst = p.src)) "
    f"SELECT '{_ONE_STEP}' AS rule_id, 'within' AS head_rel, true AS live, CAST(NULL AS VARCHAR) AS replaced_by, n AS tuples FROM one "
    f"UNION ALL SELECT '{_MORE_STEPS}', 'within', true, NULL, n FROM two "
    "UNION ALL SELECT 'rule:two-up/1', 'two-up', false, 'rule:two-up/2', NULL "
    "UNION ALL SELECT 'rule:two-up/2', 'two-up', true, NULL, n FROM two",
)
def _(spark, sf):
    # The catalogue is stored next to the claims, read back with them and derives again.
    return catalogue_with_tuples(_restored(spark, sf))


@analysis(
    "restored_rules_derive",
    f"WITH RECURSIVE {_EDGES}, {_PATHS.format(e='e')} SELECT 'within' AS rel, src AS a0, dst AS a1 FROM p "
    "UNION ALL SELECT DISTINCT 'two-up', e.src, p.dst FROM e JOIN p ON e.dst = p.src",
)
def _(spark, sf):
    found = derived_again(_restored(spark, sf))
    return found["within"].select(F.lit("within").alias("rel"), "a0", "a1").unionByName(
        found["two-up"].select(F.lit("two-up").alias("rel"), "a0", "a1")
    )
