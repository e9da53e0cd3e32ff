"""History, transactions and set-at-a-time changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.operators import history, lookup, mutate
from claimweave.operators.conjunctive import query
from claimweave.plans.registry import analysis, table
from claimweave.plans.shop import SQL_ACTIVITY, SQL_SHOP, activity, shop
from claimweave.rules import atom, ref

NOW = 10**15


@analysis(
    "value_history",
    f"WITH {SQL_ACTIVITY} SELECT l, p, r, row_number() OVER (PARTITION BY l, p ORDER BY ord) AS version, "
    "tx_seq AS valid_from, hid.seq AS valid_to FROM claims LEFT JOIN hid ON claims.cid = hid.cid "
    "WHERE p = 'last-event'",
)
def _(spark, sf):
    return history.value_history(activity(spark, sf), "last-event")


@analysis(
    "claims_as_of",
    f"WITH {SQL_ACTIVITY} SELECT cid, l, r FROM claims WHERE p = 'last-event' AND tx_seq <= 10 "
    "AND cid NOT IN (SELECT cid FROM hid WHERE seq <= 10)",
)
def _(spark, sf):
    return activity(spark, sf).as_of(10, p="last-event").select("cid", "l", "r")


@analysis(
    "as_of_atoms",
    f"WITH {SQL_ACTIVITY}, a AS (SELECT l, r FROM claims WHERE p = 'last-event' AND tx_seq <= 5 "
    "AND cid NOT IN (SELECT cid FROM hid WHERE seq <= 5)), b AS (SELECT l, r FROM claims WHERE p = 'last-event' "
    "AND tx_seq <= 15 AND cid NOT IN (SELECT cid FROM hid WHERE seq <= 15)) "
    "SELECT a.l AS u, a.r AS was, b.r AS became FROM a JOIN b ON a.l = b.l",
)
def _(spark, sf):
    event = ref("last-event")
    return query(
        activity(spark, sf),
        atom("as-of-triple", 5, "?u", event, "?was"),
        atom("as-of-triple", 15, "?u", event, "?became"),
    )


@analysis(
    "as_of_claim_atom",
    f"WITH {SQL_ACTIVITY} SELECT cid AS c, l AS u FROM claims WHERE p = 'last-event' AND tx_seq <= 20 "
    "AND r = 'v:s:click' AND cid NOT IN (SELECT cid FROM hid WHERE seq <= 20)",
)
def _(spark, sf):
    return query(
        activity(spark, sf), atom("as-of-claim", 20, "?c", "?u", ref("last-event"), "click")
    )


@analysis(
    "transaction_atoms",
    f"WITH {SQL_ACTIVITY} SELECT 't:' || tx_seq AS t, CAST(tx_seq AS BIGINT) AS n, cid AS c, r AS v FROM claims "
    "WHERE p = 'last-event'",
)
def _(spark, sf):
    return query(
        activity(spark, sf),
        atom("tx-info", "?t", "?n"),
        atom("tx-claims-rel", "?t", "?c"),
        atom("claim", "?c", "?u", ref("last-event"), "?v"),
        select=["t", "n", "c", "v"],
    )


@analysis(
    "claims_since",
    f"WITH {SQL_ACTIVITY} SELECT cid, tx_seq FROM claims WHERE tx_seq > 20",
)
def _(spark, sf):
    return history.claims_since(activity(spark, sf), 20).select("cid", "tx_seq")


@analysis(
    "claim_transactions",
    f"WITH {SQL_ACTIVITY} SELECT cid, tx_id, seq, agent FROM claims JOIN txs ON tx_seq = seq",
)
def _(spark, sf):
    return history.claim_transactions(activity(spark, sf))


@analysis("latest_sequence", f"WITH {SQL_ACTIVITY} SELECT max(seq) AS seq FROM txs")
def _(spark, sf):
    return history.latest_seq(activity(spark, sf))


@analysis(
    "claims_by_agent",
    f"WITH {SQL_ACTIVITY} SELECT cid FROM claims JOIN txs ON tx_seq = seq WHERE agent = 'agent-2'",
)
def _(spark, sf):
    return history.claims_by_agent(activity(spark, sf), "agent-2").select("cid")


@analysis(
    "claims_per_transaction",
    f"WITH {SQL_ACTIVITY} SELECT tx_id, seq, agent, count(*) AS claims FROM claims JOIN txs ON tx_seq = seq "
    "GROUP BY tx_id, seq, agent",
)
def _(spark, sf):
    return history.tx_sizes(activity(spark, sf))


@analysis(
    "transaction_log",
    f"WITH {SQL_ACTIVITY} SELECT tx_id, seq, agent, count(*) AS claims FROM claims JOIN txs ON tx_seq = seq "
    "WHERE seq > 3 GROUP BY tx_id, seq, agent ORDER BY seq LIMIT 7",
)
def _(spark, sf):
    return history.tx_log(activity(spark, sf), since=3, limit=7)


@analysis(
    "recent_transactions",
    f"WITH {SQL_ACTIVITY} SELECT tx_id, seq, agent, count(*) AS claims FROM claims JOIN txs ON tx_seq = seq "
    "GROUP BY tx_id, seq, agent ORDER BY seq DESC LIMIT 5",
)
def _(spark, sf):
    return history.recent_transactions(activity(spark, sf))


_STATES = (
    "a AS (SELECT DISTINCT l, p, r FROM claims WHERE tx_seq <= 8 AND cid NOT IN (SELECT cid FROM hid WHERE seq <= 8)), "
    "b AS (SELECT DISTINCT l, p, r FROM claims WHERE tx_seq <= 16 AND cid NOT IN (SELECT cid FROM hid WHERE seq <= 16))"
)


@analysis(
    "state_difference",
    f"WITH {SQL_ACTIVITY}, {_STATES} SELECT l, p, r, 'removed' AS change FROM (FROM a EXCEPT FROM b) "
    "UNION ALL SELECT l, p, r, 'added' FROM (FROM b EXCEPT FROM a)",
)
def _(spark, sf):
    return history.state_diff(activity(spark, sf), 8, 16)


@analysis(
    "changed_values",
    f"WITH {SQL_ACTIVITY}, {_STATES} SELECT a.l, a.p, a.r AS old_r, b.r AS new_r FROM a JOIN b ON a.l = b.l "
    "AND a.p = b.p AND a.r <> b.r WHERE a.p = 'last-event'",
)
def _(spark, sf):
    return history.changed_values(activity(spark, sf), 8, 16)


@analysis(
    "snapshot_read",
    f"WITH {SQL_ACTIVITY} SELECT l, arg_max(r, ord) AS r FROM claims WHERE p = 'last-event' AND tx_seq <= 12 GROUP BY l",
)
def _(spark, sf):
    # Fixed at transaction 12: the claims committed later are not seen.
    return lookup.newest(activity(spark, sf).snapshot(12).current(p="last-event")).select("l", "r")


# -- changes ---------------------------------------------------------------------


_POOR_NAMES = "SELECT 'c:supplier/' || s_suppkey || '/name' AS cid FROM supplier WHERE s_acctbal < 3000 AND s_name IS NOT NULL"


def _after(graph, more):
    return graph.with_claims(more)


@analysis(
    "supersede_claims",
    f"WITH c AS ({SQL_SHOP}) SELECT cid, l, p, r FROM c WHERE NOT (p = 'segment' AND r = 'v:s:BUILDING') "
    "UNION ALL SELECT 'c:2/' || (1000000000000000 + c_custkey), 'e:customer/' || c_custkey, 'segment', 'v:s:HOUSING' "
    "FROM customer WHERE c_mktsegment = 'BUILDING' "
    "UNION ALL SELECT 'c:2/hide/c:customer/' || c_custkey || '/segment', 'c:2/' || (1000000000000000 + c_custkey), 'supersedes', "
    "'c:customer/' || c_custkey || '/segment' FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def _(spark, sf):
    graph = shop(spark, sf)
    old = graph.claims_where(p="segment", r="v:s:BUILDING")
    requests = old.select(
        F.col("cid").alias("old_cid"), "l", "p", F.lit("v:s:HOUSING").alias("r"),
        (F.lit(NOW) + F.substring("l", 12, 20).cast("bigint")).alias("ord"),
    )
    return _after(graph, mutate.supersede(requests, 2)).current().select("cid", "l", "p", "r")


@analysis(
    "invalidate_claims",
    f"WITH c AS ({SQL_SHOP}), d AS ({_POOR_NAMES}) SELECT l, p, r FROM c WHERE cid NOT IN (SELECT cid FROM d) "
    "UNION ALL SELECT 'e:marker/' || cid, 'supersedes', cid FROM d",
)
def _(spark, sf):
    graph = shop(spark, sf)
    doomed = table(spark, sf, "supplier").filter("s_acctbal < 3000").select(
        F.concat(F.lit("c:supplier/"), F.col("s_suppkey").cast("string"), F.lit("/name")).alias("cid")
    )
    after = _after(graph, mutate.invalidate(doomed, 2))
    return after.current().select("l", "p", "r")


@analysis(
    "supersession_is_one_way",
    f"WITH c AS ({SQL_SHOP}), d AS ({_POOR_NAMES}) SELECT l, p, r FROM c WHERE cid NOT IN (SELECT cid FROM d) "
    "UNION ALL SELECT 'e:marker/c:2/hide/' || cid, 'supersedes', 'c:2/hide/' || cid FROM d",
)
def _(spark, sf):
    # Hiding the hiding claims revives nothing.
    graph = shop(spark, sf)
    poor = table(spark, sf, "supplier").filter("s_acctbal < 3000")
    poor = poor.select(ids.entity_id("supplier", "s_suppkey").alias("l"))
    doomed = graph.claims_where(p="name").join(poor, "l", "left_semi")
    once_hidden = mutate.invalidate(doomed.select("cid"), 2)
    twice = mutate.invalidate(once_hidden.select("cid"), 3)
    after = _after(_after(graph, once_hidden), twice)
    return after.current().select("l", "p", "r")


def _segment_updates(spark, sf):
    """Every customer's segment set twice in one batch."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("e:customer/"), F.col("c_custkey").cast("string")).alias("l"),
        F.lit("segment").alias("p"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "c_custkey",
    ).select(
        "l", "p", F.concat(F.lit("v:s:round-"), F.col("i").cast("string")).alias("r"),
        (F.lit(NOW) + F.col("c_custkey") * 2 + F.col("i")).alias("ord"),
    )


@analysis(
    "update_properties",
    "SELECT 'e:customer/' || c_custkey AS l, 'v:s:round-1' AS r, 'live' AS state FROM customer "
    "UNION ALL SELECT 'e:customer/' || c_custkey, 'v:s:round-0', 'hidden' FROM customer "
    "UNION ALL SELECT 'e:customer/' || c_custkey, 'v:s:' || c_mktsegment, 'hidden' FROM customer",
)
def _(spark, sf):
    graph = shop(spark, sf)
    after = _after(graph, mutate.update(graph, _segment_updates(spark, sf), 2))
    flagged = after.flagged().filter(F.col("p") == "segment")
    return flagged.select("l", "r", F.when(F.col("superseded"), "hidden").otherwise("live").alias("state"))


@analysis(
    "assert_is_multi_valued",
    "SELECT 'e:customer/' || c_custkey AS l, CAST(3 AS BIGINT) AS n FROM customer",
)
def _(spark, sf):
    graph = shop(spark, sf)
    after = _after(graph, mutate.assert_claims(_segment_updates(spark, sf), 2))
    return after.current(p="segment").groupBy("l").agg(F.count(F.lit(1)).alias("n"))


@analysis(
    "retract_properties",
    f"WITH c AS ({SQL_SHOP}), d AS (SELECT 'c:customer/' || c_custkey || '/segment' AS cid FROM customer WHERE c_nationkey = 3) "
    "SELECT l, p, r FROM c WHERE cid NOT IN (SELECT cid FROM d) "
    "UNION ALL SELECT 'e:marker/' || cid, 'supersedes', cid FROM d WHERE cid IN (SELECT cid FROM c)",
)
def _(spark, sf):
    graph = shop(spark, sf)
    requests = graph.current(p="located-in", r="e:nation/3").select("l", F.lit("segment").alias("p"))
    return _after(graph, mutate.retract(graph, requests, 2)).current().select("l", "p", "r")


@analysis(
    "unlink_memberships",
    f"WITH c AS ({SQL_SHOP}), d AS (SELECT 'c:customer/' || c_custkey || '/located-in' AS cid FROM customer WHERE c_acctbal < 5000) "
    "SELECT l, p, r FROM c WHERE cid NOT IN (SELECT cid FROM d) "
    "UNION ALL SELECT 'e:marker/' || cid, 'supersedes', cid FROM d WHERE cid IN (SELECT cid FROM c)",
)
def _(spark, sf):
    graph = shop(spark, sf)
    links = graph.current(p="located-in")
    poor = table(spark, sf, "customer").filter("c_acctbal < 5000")
    poor = poor.select(ids.entity_id("customer", "c_custkey").alias("l"))
    requests = links.join(poor, "l", "left_semi").select("l", "p", "r")
    after = _after(graph, mutate.unlink(graph, requests, 2))
    return after.current().select("l", "p", "r")


@analysis(
    "rename_keeps_references",
    "SELECT 'e:order/' || o_orderkey AS o, 'renamed ' || o_custkey AS customer FROM orders",
)
def _(spark, sf):
    graph = shop(spark, sf)
    requests = table(spark, sf, "customer").select(
        ids.entity_id("customer", "c_custkey").alias("l"),
        F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")).alias("name"),
        (F.lit(NOW) + F.col("c_custkey")).alias("ord"),
    )
    after = _after(graph, mutate.rename(graph, requests, 2))
    placed = after.current(p="placed-by").select(F.col("l").alias("o"), F.col("r").alias("customer"))
    return lookup.with_names(after, placed, "customer")


@analysis(
    "change_operands",
    "SELECT 'live' AS what, 'e:order/' || o_orderkey AS l, CASE WHEN o_orderstatus = 'O' THEN 'v:s:X' "
    "ELSE 'v:s:' || o_orderstatus END AS r FROM orders "
    "UNION ALL SELECT 'unmatched', 'e:order/' || o_orderkey, 'v:s:X' FROM orders WHERE o_orderstatus <> 'O'",
)
def _(spark, sf):
    graph = shop(spark, sf)
    requests = table(spark, sf, "orders").select(
        ids.entity_id("order", "o_orderkey").alias("l"), F.lit("status").alias("p"),
        F.lit("v:s:O").alias("old_r"), F.lit("v:s:X").alias("new_r"),
        (F.lit(NOW) + F.col("o_orderkey")).alias("ord"),
    )
    more, unmatched = mutate.change_operand(graph, requests, 2)
    live = _after(graph, more).current(p="status").select(F.lit("live").alias("what"), "l", "r")
    return live.unionByName(
        unmatched.select(F.lit("unmatched").alias("what"), "l", F.col("new_r").alias("r"))
    )


_SUBTREE = (
    "RECURSIVE roots AS (SELECT p_partkey AS k FROM part WHERE p_brand = 'Brand#7'), "
    "sub AS (SELECT k FROM roots UNION SELECT p_partkey FROM part JOIN sub ON p_partkey > 0 AND p_partkey // 2 = k)"
)


# All claims with the child links beside the links to the parent.
_LINKED = (
    f"shop AS ({SQL_SHOP}), c AS (SELECT cid, l, p, r FROM shop "
    "UNION ALL SELECT cid || '/child', r, 'has-part', l FROM shop WHERE p = 'part-of')"
)


def _brand_seven(spark, sf):
    parts = table(spark, sf, "part").filter("p_brand = 'Brand#7'")
    return parts.select(F.col("p_partkey").alias("id"))


def _with_parts(graph):
    """Child links of the part hierarchy, written from the parent to the child."""
    links = graph.claims_where(p="part-of").select(
        F.concat("cid", F.lit("/child")).alias("cid"), F.col("r").alias("l"),
        F.lit("has-part").alias("p"), F.col("l").alias("r"), "tx_id", "tx_seq", "ord",
    )
    return graph.with_claims(links)


@analysis(
    "remove_subtrees",
    f"WITH {_SUBTREE}, {_LINKED}, gone AS (SELECT 'e:part/' || k AS l FROM sub) "
    "SELECT l, p, r FROM c WHERE l NOT IN (SELECT l FROM gone) "
    "UNION ALL SELECT 'e:marker/' || cid, 'supersedes', cid FROM c WHERE l IN (SELECT l FROM gone)",
)
def _(spark, sf):
    graph = _with_parts(shop(spark, sf))
    roots = _brand_seven(spark, sf).select(ids.entity_id("part", "id").alias("node"))
    after = _after(graph, mutate.remove_subtrees(graph, roots, ["has-part"], 2))
    return after.current().select("l", "p", "r")


@analysis(
    "replace_subtrees",
    f"WITH {_SUBTREE}, {_LINKED}, top AS (SELECT 'e:part/' || k AS l, k FROM roots), "
    "below AS (SELECT 'e:part/' || k AS l FROM sub WHERE k NOT IN (SELECT k FROM roots)), "
    "cut AS (SELECT cid FROM c WHERE l IN (SELECT l FROM below) OR (p = 'has-part' AND l IN (SELECT l FROM top))), "
    "old AS (SELECT cid, k FROM c JOIN top ON c.l = top.l WHERE p = 'name') "
    "SELECT l, p, r FROM c WHERE cid NOT IN (SELECT cid FROM cut) AND cid NOT IN (SELECT cid FROM old) "
    "UNION ALL SELECT 'e:marker/' || cid, 'supersedes', cid FROM cut "
    "UNION ALL SELECT 'c:2/' || (1000000000000000 + k), 'supersedes', cid FROM old "
    "UNION ALL SELECT 'e:part/' || k, 'name', 'v:s:new ' || k FROM roots "
    "UNION ALL SELECT 'e:part/' || k, 'has-part', 'e:part/new-' || k FROM roots "
    "UNION ALL SELECT 'e:part/new-' || k, 'brand', 'v:s:NEW' FROM roots",
)
def _(spark, sf):
    graph = _with_parts(shop(spark, sf))
    keys = _brand_seven(spark, sf)
    k = F.col("id").cast("string")
    roots = keys.select(ids.entity_id("part", "id").alias("node"))
    names = keys.select(
        ids.entity_id("part", "id").alias("l"), F.concat(F.lit("new "), k).alias("name"),
        (F.lit(NOW) + F.col("id")).alias("ord"),
    )
    new = F.concat(F.lit("e:part/new-"), k)
    fresh = keys.select(
        F.explode(
            F.array(
                F.struct(ids.entity_id("part", "id").alias("l"), F.lit("has-part").alias("p"), new.alias("r"), F.lit(0).alias("i")),
                F.struct(new.alias("l"), F.lit("brand").alias("p"), F.lit("v:s:NEW").alias("r"), F.lit(1).alias("i")),
            )
        ).alias("c"), "id",
    ).select("c.l", "c.p", "c.r", (F.lit(NOW) + 100 + F.col("id") * 2 + F.col("c.i")).alias("ord"))
    more = mutate.replace_subtrees(
        graph, roots, mutate.assert_claims(fresh, 2), ["has-part"], 2, new_names=names
    )
    after = _after(graph, more)
    return after.current().select("l", "p", "r")
