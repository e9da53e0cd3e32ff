"""Counts, degrees, rankings, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.operators import lookup, reports
from claimweave.plans.registry import analysis, once, stored_graph, table
from claimweave.plans.shop import (
    SQL_ACTIVITY,
    SQL_EVENT_GRAPH,
    SQL_SHOP,
    SQL_SPOKE,
    SQL_TREE,
    activity,
    event_graph,
    shop,
    spoke_edges,
    tree_edges,
)
from claimweave.sources.relational import TableSpec, table_claims


@analysis(
    "workspace_status",
    f"WITH {SQL_ACTIVITY} SELECT (SELECT count(*) FROM (SELECT cid FROM claims UNION SELECT l FROM claims "
    "UNION SELECT p FROM claims UNION SELECT r FROM claims UNION SELECT tx_id FROM txs)) AS objects, "
    "(SELECT count(*) FROM claims) AS claims, CAST(0 AS BIGINT) AS rules, (SELECT count(*) FROM txs) AS txs, "
    "(SELECT max(seq) FROM txs) AS latest_seq",
)
def _(spark, sf):
    return reports.status(activity(spark, sf))


@analysis(
    "degrees",
    f"WITH e AS ({SQL_SPOKE}) SELECT node, CAST(sum(o) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS called_by "
    "FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node",
)
def _(spark, sf):
    return reports.degrees(spoke_edges(spark, sf))


@analysis(
    "named_edges",
    "SELECT coalesce(a.p_name, '?') AS src, b.p_name AS dst, count(*) AS n FROM part a JOIN part b "
    "ON a.p_partkey > 0 AND a.p_partkey // 2 = b.p_partkey GROUP BY 1, 2",
)
def _(spark, sf):
    graph = shop(spark, sf)
    edges = graph.current(p="part-of").select(F.col("l").alias("src"), F.col("r").alias("dst"))
    named = lookup.with_names(graph, edges, "src", "dst")
    return named.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@analysis(
    "hub_ranking",
    "SELECT l_partkey AS node, count(*) AS refs, rank() OVER (ORDER BY count(*) DESC) AS place "
    "FROM lineitem GROUP BY l_partkey QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10",
)
def _(spark, sf):
    # All hubs tied with the tenth are kept: the tenth count is a one-row frame.
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(
        F.count(F.lit(1)).alias("refs")
    )
    top = counts.orderBy(F.col("refs").desc()).limit(10)
    floor = top.agg(F.min("refs").alias("least"))
    kept = counts.join(F.broadcast(floor), F.col("refs") >= F.col("least")).drop("least")
    above = kept.groupBy("refs").agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct count among the kept hubs.
    w = Window.orderBy(F.col("refs").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = above.select("refs", (F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).alias("place"))
    return kept.join(places, "refs").select("node", "refs", "place")


@analysis(
    "top_hubs",
    'SELECT l_partkey AS node, count(*) AS "references" FROM lineitem GROUP BY l_partkey '
    'ORDER BY "references" DESC, node LIMIT 20',
)
def _(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")
    )
    return reports.top_targets(edges, 20)


@analysis(
    "distinct_groups",
    "SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations FROM customer",
)
def _(spark, sf):
    return table(spark, sf, "customer").agg(
        F.countDistinct("c_mktsegment").alias("segments"),
        F.countDistinct("c_nationkey").alias("nations"),
    )


@analysis(
    "members_per_group",
    "SELECT 'v:s:' || c_mktsegment AS grp, count(DISTINCT c_custkey) AS members FROM customer GROUP BY c_mktsegment",
)
def _(spark, sf):
    members = shop(spark, sf).current(p="segment")
    return reports.group_sizes(members, "r", "l").withColumnRenamed("r", "grp")


@analysis(
    "adjacency",
    f"WITH e AS ({SQL_EVENT_GRAPH}), n AS (SELECT src, count(*) AS targets FROM e GROUP BY src) "
    "SELECT e.src, e.dst, n.targets FROM e JOIN n ON e.src = n.src",
)
def _(spark, sf):
    return reports.adjacency(event_graph(spark, sf))


@analysis(
    "actions_to_roles",
    "SELECT event_type AS action, string_agg(role, ',' ORDER BY role) AS roles FROM "
    "(SELECT DISTINCT event_type, 'role-' || (user_id % 3) AS role FROM events) GROUP BY event_type",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("src"),
        F.concat(F.lit("role-"), (F.col("user_id") % 3).cast("string")).alias("dst"),
    )
    return reports.small_adjacency(events).select(F.col("src").alias("action"), F.col("targets").alias("roles"))


@analysis(
    "work_summary",
    "WITH i AS (SELECT o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_custkey % 10 <> 0 "
    "THEN 'agent-' || (o_custkey % 7) END AS a FROM orders) "
    "SELECT 'total' AS section, 'total' AS item, count(*) AS n FROM i "
    "UNION ALL SELECT 'status', s, count(*) FROM i GROUP BY s "
    "UNION ALL SELECT 'active', 'active', count(*) FROM i WHERE s IN ('O', 'P') "
    "UNION ALL SELECT 'priority', p, count(*) FROM i WHERE s IN ('O', 'P') GROUP BY p "
    "UNION ALL SELECT 'assignee', a, count(*) FROM i WHERE s IN ('O', 'P') AND a IS NOT NULL GROUP BY a "
    "UNION ALL SELECT 'unassigned', 'unassigned', count(*) FROM i WHERE s IN ('O', 'P') AND a IS NULL",
)
def _(spark, sf):
    items = table(spark, sf, "orders").withColumn(
        "assignee",
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("agent-"), (F.col("o_custkey") % 7).cast("string"))),
    )
    return reports.work_summary(items, "o_orderstatus", "o_orderpriority", "assignee", ["O", "P"])


def conversation_graph(spark, sf):
    """Turns as ordered children of their conversation; every fifth turn has no position."""

    def build():
        turns = table(spark, sf, "conversations").select(
            "conv_id", "turn", "role",
            F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"),
            (F.col("conv_id") * 100_000 + F.col("turn")).alias("o"),
            F.when(F.col("turn") % 5 != 4, F.col("turn")).alias("place"),
        )
        spec = TableSpec("turn", "key", {"place": "position", "role": "role"}, order="o")
        links = turns.select(
            F.concat(F.lit("c:conversation/"), "key").alias("cid"),
            ids.entity_id("conversation", "conv_id").alias("l"), F.lit("has-turn").alias("p"),
            ids.entity_id("turn", "key").alias("r"), F.lit("t:1").alias("tx_id"),
            F.lit(1).cast("bigint").alias("tx_seq"), F.col("o").alias("ord"),
        )
        return stored_graph(spark, table_claims(turns, spec).unionByName(links, allowMissingColumns=True), "conversations")

    return once(spark, sf, "conversations", build)


@analysis(
    "ordered_children",
    "SELECT 'e:conversation/' || conv_id AS parent, CASE WHEN turn % 5 <> 4 THEN turn ELSE 999 END AS position, "
    "'e:turn/' || conv_id || '-' || turn AS child FROM conversations",
)
def _(spark, sf):
    return lookup.ordered_children(conversation_graph(spark, sf), "has-turn")


@analysis(
    "all_edges_bag",
    f"SELECT src, dst FROM ({SQL_TREE}) UNION ALL SELECT src, dst FROM ({SQL_SPOKE})",
)
def _(spark, sf):
    return tree_edges(spark, sf).unionByName(spoke_edges(spark, sf))


@analysis(
    "literal_intersection",
    "SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(p_name || ' ' || lower(p_type), "
    "'[a-z]+')) AS w FROM part) INTERSECT SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), "
    "'[a-z]+')) AS w FROM documents)",
)
def _(spark, sf):
    def words(column):
        return F.explode(F.regexp_extract_all(column, F.lit("[a-z]+"), F.lit(0))).alias("word")

    known = table(spark, sf, "part").select(words(F.concat("p_name", F.lit(" "), F.lower("p_type"))))
    used = table(spark, sf, "documents").select(words(F.lower("text")))
    return known.intersect(used)


@analysis(
    "typed_equality",
    "SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM ("
    "SELECT 'i' AS kind, 'v:i:' || p_size AS id FROM part UNION ALL SELECT 's', 'v:s:' || p_size FROM part "
    "UNION ALL SELECT 'b', 'v:b:' || (p_size > 25) FROM part) GROUP BY kind",
)
def _(spark, sf):
    # 7, '7' and true stay three different values.
    size = F.col("p_size").cast("string")
    truth = (F.col("p_size") > 25).cast("string")
    rows = table(spark, sf, "part").select(
        F.explode(
            F.array(
                F.struct(F.lit("i").alias("kind"), ids.value_id("i", size).alias("id")),
                F.struct(F.lit("s").alias("kind"), ids.value_id("s", size).alias("id")),
                F.struct(F.lit("b").alias("kind"), ids.value_id("b", truth).alias("id")),
            )
        ).alias("v")
    )
    return rows.groupBy("v.kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("v.id").alias("ids")
    )


@analysis(
    "text_functions",
    "SELECT p_partkey, contains(p_name, 'ring') AS has_ring, starts_with(p_name, 'red') AS is_red, "
    "'tag-' || p_type AS tag, upper(p_name) AS loud, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) "
    "|| ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part",
)
def _(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", name.contains("ring").alias("has_ring"), name.startswith("red").alias("is_red"),
        F.concat(F.lit("tag-"), "p_type").alias("tag"), F.upper(name).alias("loud"),
        F.initcap(name).alias("title"),
    )


@analysis(
    "language_detection",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^\\s*(def|class|import|from)\\s') THEN 'python' "
    "ELSE 'text' END AS language FROM documents",
)
def _(spark, sf):
    code = F.col("text").rlike(r"(?m)^\s*(def|class|import|from)\s")
    return table(spark, sf, "documents").select(
        "doc_id", F.when(code, "python").otherwise("text").alias("language")
    )


@analysis(
    "literal_text",
    "SELECT 'e:part/' || p_partkey AS l, CAST(p_size AS VARCHAR) AS text, CAST(p_size AS BIGINT) + 1 AS plus_one FROM part",
)
def _(spark, sf):
    sizes = shop(spark, sf).current(p="size")
    text = ids.short_literal(F.col("r"))
    return sizes.select("l", text.alias("text"), (text.cast("bigint") + 1).alias("plus_one"))


@analysis(
    "claim_maps",
    f"WITH c AS ({SQL_SHOP}) SELECT l, count(*) AS n, max(CASE WHEN p = 'name' THEN r END) AS name "
    "FROM c GROUP BY l",
)
def _(spark, sf):
    # Claims of one row, gathered as a map: as many entries as the row has columns.
    claims = shop(spark, sf).claims
    maps = claims.groupBy("l").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "r"))).alias("m")
    )
    return maps.select("l", F.size("m").cast("bigint").alias("n"), F.col("m")["name"].alias("name"))
