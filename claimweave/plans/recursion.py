"""Closures, frontiers, rule programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import closure
from claimweave.operators.conjunctive import derive_once
from claimweave.operators.fixpoint import RuleProgram, publish
from claimweave.plans.registry import analysis, table
from claimweave.plans.shop import (
    SQL_DIAMOND,
    SQL_EVENT_GRAPH,
    SQL_SPOKE,
    SQL_TREE,
    diamond_edges,
    event_graph,
    shop,
    spoke_edges,
    tree_edges,
)
from claimweave.rules import atom, ref, rule

LOCATED = ref("located-in")

_CLOSURE = (
    "WITH RECURSIVE e AS ({edges}), p AS (SELECT src, dst FROM e UNION "
    "SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src) "
)

# Containment facts as edges of ids, and all pairs they imply.
SQL_WITHIN = """
WITH RECURSIVE e AS (
  SELECT 'e:customer/' || c_custkey AS src, 'e:nation/' || c_nationkey AS dst FROM customer
  UNION SELECT 'e:supplier/' || s_suppkey, 'e:nation/' || s_nationkey FROM supplier
  UNION SELECT 'e:nation/' || n_nationkey, 'e:region/' || n_regionkey FROM nation
  UNION SELECT 'e:order/' || o_orderkey, 'e:customer/' || o_custkey FROM orders),
p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)
"""


def containment() -> RuleProgram:
    """``within``: located in or placed by, followed through any number of steps."""
    step = [
        rule(atom("step", "?x", "?y"), atom("current-triple", "?x", LOCATED, "?y")),
        rule(atom("step", "?x", "?y"), atom("current-triple", "?x", ref("placed-by"), "?y")),
    ]
    return RuleProgram(
        [
            *step,
            rule(atom("within", "?x", "?y"), atom("step", "?x", "?y")),
            rule(atom("within", "?x", "?z"), atom("step", "?x", "?y"), atom("within", "?y", "?z")),
        ]
    )


ORDERS_PER_REGION_SQL = (
    "SELECT r_name AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
)


@analysis("orders_per_region", ORDERS_PER_REGION_SQL)
def orders_per_region(spark, sf):
    """Load, live scan, recursion, join and aggregation in one."""
    graph = shop(spark, sf)
    within = containment().derive(graph)["within"]
    orders = within.filter(F.col("a0").startswith("e:order/") & F.col("a1").startswith("e:region/"))
    names = graph.current(p="name").select(F.col("l").alias("a1"), "r")
    counted = orders.groupBy("a1").agg(F.count(F.lit(1)).alias("orders"))
    return graph.ground(counted.join(names, "a1"), "r", "region").select("region", "orders")


@analysis("containment_closure", SQL_WITHIN + "SELECT src AS a0, dst AS a1 FROM p")
def _(spark, sf):
    return containment().derive(shop(spark, sf))["within"]


@analysis(
    "closure_with_depth",
    _CLOSURE.replace("SELECT src, dst FROM e UNION", "SELECT src, dst, 1 AS depth FROM e UNION")
    .replace("SELECT p.src, e.dst FROM p", "SELECT p.src, e.dst, p.depth + 1 FROM p")
    .format(edges=SQL_TREE)
    + "SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM p GROUP BY src, dst",
)
def _(spark, sf):
    paths = closure.transitive_closure(tree_edges(spark, sf))
    return paths.withColumn("depth", F.col("depth").cast("bigint"))


@analysis("closure_by_squaring", _CLOSURE.format(edges=SQL_TREE) + "SELECT src, dst FROM p")
def _(spark, sf):
    return closure.transitive_closure(tree_edges(spark, sf), squaring=True)


@analysis("closure_many_paths", _CLOSURE.format(edges=SQL_DIAMOND) + "SELECT src, dst FROM p")
def _(spark, sf):
    return closure.transitive_closure(diamond_edges(spark, sf)).select("src", "dst")


@analysis("closure_cyclic", _CLOSURE.format(edges=SQL_EVENT_GRAPH) + "SELECT src, dst FROM p")
def _(spark, sf):
    return closure.transitive_closure(event_graph(spark, sf)).select("src", "dst")


def _part_of(spark, sf):
    part_of = ref("part-of")
    return [
        rule(atom("odd", "?x", "?y"), atom("current-triple", "?x", part_of, "?y")),
        rule(
            atom("odd", "?x", "?z"),
            atom("current-triple", "?x", part_of, "?y"),
            atom("even", "?y", "?z"),
        ),
        rule(
            atom("even", "?x", "?z"),
            atom("current-triple", "?x", part_of, "?y"),
            atom("odd", "?y", "?z"),
        ),
    ]


@analysis(
    "mutual_recursion",
    f"WITH RECURSIVE e AS ({SQL_TREE}), p AS (SELECT src, dst, 1 AS par FROM e UNION "
    "SELECT p.src, e.dst, 1 - p.par FROM p JOIN e ON p.dst = e.src) "
    "SELECT CASE WHEN par = 1 THEN 'odd' ELSE 'even' END AS rel, 'e:part/' || src AS a0, "
    "'e:part/' || dst AS a1 FROM p",
)
def _(spark, sf):
    found = RuleProgram(_part_of(spark, sf)).derive(shop(spark, sf))
    odd = found["odd"].select(F.lit("odd").alias("rel"), "a0", "a1")
    return odd.unionByName(found["even"].select(F.lit("even").alias("rel"), "a0", "a1"))


@analysis(
    "nonlinear_rule",
    _CLOSURE.format(edges=SQL_TREE) + "SELECT 'e:part/' || src AS a0, 'e:part/' || dst AS a1 FROM p",
)
def _(spark, sf):
    program = RuleProgram(
        [
            rule(atom("path", "?x", "?y"), atom("current-triple", "?x", ref("part-of"), "?y")),
            rule(atom("path", "?x", "?z"), atom("path", "?x", "?y"), atom("path", "?y", "?z")),
        ]
    )
    return program.derive(shop(spark, sf))["path"]


@analysis(
    "three_derived_atoms",
    f"WITH RECURSIVE e AS ({SQL_TREE}), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p "
    "JOIN e ON p.dst = e.src) SELECT DISTINCT 'e:part/' || src AS a0, 'e:part/' || dst AS a1 FROM p "
    "JOIN part s ON s.p_partkey = src JOIN part t ON t.p_partkey = dst "
    "WHERE s.p_brand = 'Brand#1' AND t.p_brand = 'Brand#2'",
)
def _(spark, sf):
    part_of, brand = ref("part-of"), ref("brand")
    program = RuleProgram(
        [
            rule(atom("path", "?x", "?y"), atom("current-triple", "?x", part_of, "?y")),
            rule(atom("path", "?x", "?z"), atom("current-triple", "?x", part_of, "?y"), atom("path", "?y", "?z")),
            rule(atom("source", "?x"), atom("current-triple", "?x", brand, "Brand#1")),
            rule(atom("sink", "?x"), atom("current-triple", "?x", brand, "Brand#2")),
            rule(atom("flow", "?x", "?y"), atom("source", "?x"), atom("path", "?x", "?y"), atom("sink", "?y")),
        ]
    )
    return program.derive(shop(spark, sf))["flow"]


@analysis(
    "rule_evaluated_once",
    "SELECT DISTINCT 'e:nation/' || c_nationkey AS n, c_mktsegment AS segment FROM customer",
)
def _(spark, sf):
    # A derived column may hold the raw literal that the value relation exposes.
    return derive_once(
        shop(spark, sf),
        rule(
            atom("segment-in", "?n", "?segment"),
            atom("current-triple", "?c", LOCATED, "?n"),
            atom("current-triple", "?c", ref("segment"), "?v"),
            atom("value", "?v", "?segment"),
        ),
    )


@analysis(
    "union_of_rules",
    "SELECT 'e:customer/' || c_custkey AS a0, 'e:nation/' || c_nationkey AS a1 FROM customer "
    "UNION SELECT 'e:order/' || o_orderkey, 'e:customer/' || o_custkey FROM orders "
    "UNION SELECT 'e:supplier/' || s_suppkey, 'e:nation/' || s_nationkey FROM supplier "
    "UNION SELECT 'e:nation/' || n_nationkey, 'e:region/' || n_regionkey FROM nation",
)
def _(spark, sf):
    rules = [r for r in containment().rules if r.head.rel == "step"]
    return RuleProgram(rules).derive(shop(spark, sf))["step"]


@analysis(
    "relation_as_sql_view",
    f"SELECT a.dst AS hub, count(*) AS n FROM ({SQL_TREE}) a GROUP BY a.dst",
)
def _(spark, sf):
    edges = rule(atom("depends", "?x", "?y"), atom("current-triple", "?x", ref("part-of"), "?y"))
    publish(RuleProgram([edges]).derive(shop(spark, sf)))
    return spark.sql(
        "SELECT CAST(substring(a1, 8) AS BIGINT) AS hub, count(*) AS n FROM depends GROUP BY a1"
    )


_CHANGED = "SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#7'"


@analysis(
    "affected_by_changes",
    f"WITH RECURSIVE e AS ({SQL_TREE}), a AS ({_CHANGED} UNION SELECT e.src FROM a JOIN e ON e.dst = a.node) "
    "SELECT node FROM a",
)
def _(spark, sf):
    changed = table(spark, sf, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node"))
    return closure.affected_by(tree_edges(spark, sf), changed).select("node")


@analysis(
    "subtrees",
    f"WITH RECURSIVE e AS ({SQL_TREE}), a AS (SELECT node AS root, node, 0 AS depth FROM ({_CHANGED}) "
    "UNION SELECT a.root, e.src, a.depth + 1 FROM a JOIN e ON e.dst = a.node) "
    "SELECT root, node, CAST(depth AS BIGINT) AS depth FROM a",
)
def _(spark, sf):
    roots = table(spark, sf, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node"))
    children = tree_edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = closure.subtree(children, roots)
    return found.withColumn("depth", F.col("depth").cast("bigint"))


@analysis(
    "impact_report",
    f"WITH RECURSIVE e AS ({SQL_SPOKE}), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p "
    "JOIN e ON p.dst = e.src) SELECT p.dst AS target, count(e.src) AS direct, count(*) AS transitive, "
    "count(*) - count(e.src) AS indirect_only FROM p LEFT JOIN e ON p.src = e.src AND p.dst = e.dst GROUP BY p.dst",
)
def _(spark, sf):
    return closure.impact(spoke_edges(spark, sf))


@analysis(
    "callers_per_entity",
    "SELECT t.p_name AS name, 'e:part/' || t.p_partkey AS entity, count(s.p_partkey) AS callers "
    "FROM part t LEFT JOIN part s ON s.p_partkey > 0 AND s.p_partkey // 2 = t.p_partkey GROUP BY t.p_name, t.p_partkey",
)
def _(spark, sf):
    # Many parts share a name: callers belong to the entity, never to the name.
    graph = shop(spark, sf)
    named = graph.ground(graph.current(p="name"), "r", "name").select(F.col("l").alias("entity"), "name")
    parts = named.filter(F.col("entity").startswith("e:part/"))
    callers = graph.current(p="part-of").groupBy(F.col("r").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return parts.join(callers, "entity", "left").select(
        "name", "entity", F.coalesce("n", F.lit(0)).alias("callers")
    )


@analysis(
    "page_links",
    "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) "
    "SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY target",
)
def _(spark, sf):
    links = table(spark, sf, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")
    )
    per_page = links.groupBy("target", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("target").agg(
        F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages")
    )


