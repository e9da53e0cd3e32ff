"""Conjunctive queries, anti joins, shared targets, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import naming, pairs, reports
from claimweave.operators.closure import transitive_closure
from claimweave.operators.conjunctive import derive_once, query
from claimweave.plans.registry import analysis, table
from claimweave.plans.shop import (
    SQL_ACTIVITY,
    SQL_SPOKE,
    SQL_TREE,
    activity,
    shop,
    spoke_edges,
    tree_edges,
)
from claimweave.rules import atom, ref, rule

LOCATED, NAME = ref("located-in"), ref("name")


@analysis(
    "conjunctive_query",
    "SELECT 'e:customer/' || c_custkey AS c, 'e:nation/' || n_nationkey AS n, 'e:region/' || r_regionkey AS g, "
    "'v:s:' || r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'",
)
def _(spark, sf):
    return query(
        shop(spark, sf),
        atom("current-triple", "?c", ref("segment"), "BUILDING"),
        atom("current-triple", "?c", LOCATED, "?n"),
        atom("current-triple", "?n", LOCATED, "?g"),
        atom("current-triple", "?g", NAME, "?region"),
    )


@analysis(
    "query_keeps_duplicates",
    "SELECT 'v:s:' || c_mktsegment AS s FROM customer",
)
def _(spark, sf):
    # A query is a bag: one row per match, even when the chosen columns repeat.
    body = [
        atom("triple", "?c", ref("segment"), "?s"),
        atom("triple", ref("e:region/1"), NAME, "AMERICA"),
    ]
    return query(shop(spark, sf), *body, select=["s"])


@analysis(
    "claims_about_claims",
    f"WITH {SQL_ACTIVITY} SELECT n.cid AS newer, n.r AS now, o.cid AS older, o.r AS was FROM claims s "
    "JOIN claims n ON s.l = n.cid JOIN claims o ON s.r = o.cid WHERE s.p = 'supersedes'",
)
def _(spark, sf):
    return query(
        activity(spark, sf),
        atom("triple", "?newer", ref("supersedes"), "?older"),
        atom("claim", "?newer", "?u", ref("last-event"), "?now"),
        atom("claim", "?older", "?u", ref("last-event"), "?was"),
        select=["newer", "now", "older", "was"],
    )


@analysis(
    "unused_parts",
    "SELECT p_partkey AS node FROM part WHERE NOT EXISTS "
    "(SELECT 1 FROM part q WHERE q.p_partkey > 0 AND q.p_partkey // 2 = part.p_partkey)",
)
def _(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return reports.uncalled(nodes, tree_edges(spark, sf))


@analysis(
    "customers_without_orders",
    "SELECT c_custkey AS node FROM customer EXCEPT SELECT o_custkey FROM orders",
)
def _(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return reports.difference(
        customers, table(spark, sf, "orders").select(F.col("o_custkey").alias("node"))
    )


@analysis(
    "parts_without_children",
    "SELECT p_partkey AS node FROM part EXCEPT SELECT p_partkey // 2 FROM part WHERE p_partkey > 0",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    parents = table(spark, sf, "part").filter("p_partkey > 0").select(F.expr("p_partkey div 2").alias("node"))
    return reports.difference(parts, parents)


_HOPS = (
    "WITH e AS ({edges}), h2 AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src), "
    "h3 AS (SELECT DISTINCT h2.src, e.dst FROM h2 JOIN e ON h2.dst = e.src) "
)


@analysis("two_hops", _HOPS.format(edges=SQL_SPOKE) + "SELECT src, dst FROM h2")
def _(spark, sf):
    return pairs.k_hop(spoke_edges(spark, sf), 2)


@analysis("three_hops", _HOPS.format(edges=SQL_TREE) + "SELECT src, dst FROM h3")
def _(spark, sf):
    return pairs.k_hop(tree_edges(spark, sf), 3)


def _order_parts(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")
    )


@analysis(
    "shared_targets",
    "WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS c FROM lineitem), "
    "n AS (SELECT c, count(*) AS partners FROM e GROUP BY c) SELECT a, c, partners FROM e JOIN n USING (c)",
)
def _(spark, sf):
    return pairs.shared_targets(_order_parts(spark, sf))


@analysis(
    "shared_target_pair_counts",
    "SELECT c, count(*) AS members, count(*) * count(*) AS pairs FROM "
    "(SELECT DISTINCT l_orderkey, l_partkey AS c FROM lineitem) GROUP BY c",
)
def _(spark, sf):
    return pairs.pair_counts(_order_parts(spark, sf))


@analysis(
    "shared_targets_of_given_pairs",
    "SELECT DISTINCT 'e:supplier/' || l_suppkey AS a, 'e:customer/' || o_custkey AS b, "
    "'e:nation/' || s_nationkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey "
    "WHERE s_nationkey = c_nationkey",
)
def _(spark, sf):
    # Supplier and customer that trade with each other and sit in one nation.
    trade = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    candidates = trade.select(
        F.concat(F.lit("e:supplier/"), F.col("l_suppkey").cast("string")).alias("a"),
        F.concat(F.lit("e:customer/"), F.col("o_custkey").cast("string")).alias("b"),
    )
    located = shop(spark, sf).current(p="located-in").select(
        F.col("l").alias("src"), F.col("r").alias("dst")
    )
    return pairs.shared_by_pairs(located, candidates)


@analysis(
    "partners_of_given_nodes",
    "WITH e AS (SELECT 'e:customer/' || c_custkey AS x, 'e:nation/' || c_nationkey AS c FROM customer "
    "UNION ALL SELECT 'e:supplier/' || s_suppkey, 'e:nation/' || s_nationkey FROM supplier) "
    "SELECT s.x AS a, e.x AS b, e.c FROM e s JOIN e ON s.c = e.c WHERE s.x = 'e:supplier/0'",
)
def _(spark, sf):
    located = shop(spark, sf).current(p="located-in").select(
        F.col("l").alias("src"), F.col("r").alias("dst")
    )
    seeds = located.filter(F.col("src") == "e:supplier/0").select(F.col("src").alias("node"))
    return pairs.partners_of(located, seeds)


@analysis(
    "coupled_through_hub",
    "SELECT 'e:customer/' || c_custkey AS member FROM customer WHERE c_nationkey = 3 "
    "UNION SELECT 'e:supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3",
)
def _(spark, sf):
    located = shop(spark, sf).current(p="located-in").select(
        F.col("l").alias("src"), F.col("r").alias("dst")
    )
    return pairs.coupled_through(located, "e:nation/3")


@analysis(
    "hub_groups",
    f"WITH RECURSIVE e AS ({SQL_SPOKE}), p AS (SELECT src, dst FROM e UNION "
    "SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src), "
    "hubs AS (SELECT dst FROM e GROUP BY dst HAVING count(*) > 1) "
    "SELECT dst AS hub, count(*) AS members, count(*) * count(*) AS pairs FROM p "
    "WHERE dst IN (SELECT dst FROM hubs) GROUP BY dst",
)
def _(spark, sf):
    edges = spoke_edges(spark, sf)
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.hub_groups(transitive_closure(edges), counts.filter("n > 1"))


@analysis(
    "composed_relation",
    "SELECT DISTINCT 'e:nation/' || c_nationkey AS place, 'e:order/' || o_orderkey AS affected "
    "FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(spark, sf):
    graph = shop(spark, sf)
    ordered = derive_once(
        graph,
        rule(
            atom("order-in", "?o", "?n"),
            atom("current-triple", "?o", ref("placed-by"), "?c"),
            atom("current-triple", "?c", LOCATED, "?n"),
        ),
    )
    reverse = rule(atom("blast-radius", "?place", "?affected"), atom("order-in", "?affected", "?place"))
    return derive_once(graph, reverse, {"order-in": ordered})


@analysis(
    "two_properties_by_group",
    "SELECT 'e:order/' || o_orderkey AS item, o_orderstatus AS state, o_orderpriority AS priority FROM orders "
    "WHERE o_orderstatus = 'F'",
)
def _(spark, sf):
    graph = shop(spark, sf)
    found = query(
        graph,
        atom("current-triple", "?item", ref("status"), "F"),
        atom("current-triple", "?item", ref("status"), "?s"),
        atom("current-triple", "?item", ref("priority"), "?q"),
    )
    found = graph.ground(graph.ground(found, "s", "state"), "q", "priority")
    return found.select("item", "state", "priority")


@analysis(
    "near_names",
    "WITH known AS (SELECT DISTINCT p_name AS candidate FROM part UNION SELECT DISTINCT p_brand FROM part "
    "UNION SELECT DISTINCT p_type FROM part), "
    "wanted AS (SELECT DISTINCT substr(p_name, 1, 5) || 'x' AS name FROM part "
    "UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part "
    "UNION SELECT DISTINCT 'my ' || p_type || ' thing' FROM part), "
    "hits AS (SELECT name, candidate FROM wanted, known WHERE contains(lower(candidate), lower(name)) "
    "OR contains(lower(name), lower(candidate)) OR (length(name) >= 4 AND length(candidate) >= 4 "
    "AND left(lower(name), 4) = left(lower(candidate), 4))) "
    "SELECT name, candidate FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY candidate) AS k "
    "FROM hits) WHERE k <= 5",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    known = part.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("name"))
    missing = part.select(
        F.explode(
            F.array(
                F.concat(F.substring("p_name", 1, 5), F.lit("x")),
                F.split("p_name", " ")[1],
                F.concat(F.lit("my "), "p_type", F.lit(" thing")),
            )
        ).alias("name")
    )
    return naming.near_names(missing, known)


@analysis(
    "common_prefix_lengths",
    "SELECT n_nationkey, CASE WHEN NOT starts_with(n_name, left(r_name, 1)) THEN 0 ELSE "
    "(SELECT max(i) FROM range(0, 30) t(i) WHERE i <= least(length(n_name), length(r_name)) "
    "AND left(n_name, i) = left(r_name, i)) END AS shared FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def _(spark, sf):
    both = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return both.select(
        "n_nationkey",
        naming.common_prefix_length(F.col("n_name"), F.col("r_name")).cast("bigint").alias("shared"),
    )
