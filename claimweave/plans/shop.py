"""The shop tables as claim graphs and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.ordered import neighbour_in_group
from claimweave.graph import ClaimGraph
from claimweave.plans.registry import once, stored_graph, table
from claimweave.sources.relational import TableSpec, table_claims, table_values

STEP = 1_000_000_000_000

SPECS = {
    "customer": TableSpec(
        "customer", "c_custkey", {"c_name": "name", "c_mktsegment": "segment"},
        {"c_nationkey": ("located-in", "nation")},
    ),
    "supplier": TableSpec(
        "supplier", "s_suppkey", {"s_name": "name"}, {"s_nationkey": ("located-in", "nation")},
        base=STEP,
    ),
    "nation": TableSpec(
        "nation", "n_nationkey", {"n_name": "name"}, {"n_regionkey": ("located-in", "region")},
        base=2 * STEP,
    ),
    "region": TableSpec("region", "r_regionkey", {"r_name": "name"}, base=3 * STEP),
    "orders": TableSpec(
        "order", "o_orderkey", {"o_orderstatus": "status", "o_orderpriority": "priority"},
        {"o_custkey": ("placed-by", "customer")}, base=4 * STEP,
    ),
    "part": TableSpec(
        "part", "p_partkey", {"p_name": "name", "p_brand": "brand", "p_size": "size"},
        {"p_parent": ("part-of", "part")}, base=5 * STEP,
    ),
}
PLACES = ("customer", "supplier", "nation", "region")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    if name == "part":
        half = F.floor(F.col("p_partkey") / 2).cast("bigint")
        df = df.withColumn("p_parent", F.when(F.col("p_partkey") > 0, half))
    return df


def claims_of(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    parts = [table_claims(source(spark, sf_dir, n), SPECS[n]) for n in names]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def values_of(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    parts = [table_values(source(spark, sf_dir, n), SPECS[n]) for n in names]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.distinct()


def shop(spark: SparkSession, sf_dir: str) -> ClaimGraph:
    """All shop tables as one stored graph."""

    def build():
        return stored_graph(
            spark,
            claims_of(spark, sf_dir, *SPECS),
            "shop",
            values=values_of(spark, sf_dir, *SPECS),
        )

    return once(spark, sf_dir, "shop", build)


def sql_claims(*names: str) -> str:
    """A SELECT giving the same claims: ``cid, l, p, r, ord``."""
    extra = {"p_parent": "CASE WHEN p_partkey > 0 THEN p_partkey // 2 END"}
    kinds = {"p_size": "i"}
    selects = []
    for name in names:
        spec = SPECS[name]
        width = len(spec.props) + len(spec.links)
        slots = [(c, p, None) for c, p in spec.props.items()]
        slots += [(c, p, kind) for c, (p, kind) in spec.links.items()]
        for position, (column, predicate, kind) in enumerate(slots):
            cell = extra.get(column, column)
            prefix = f"e:{kind}/" if kind else f"v:{kinds.get(column, 's')}:"
            selects.append(
                f"SELECT 'c:{spec.kind}/' || {spec.key} || '/{predicate}' AS cid, "
                f"'e:{spec.kind}/' || {spec.key} AS l, '{predicate}' AS p, "
                f"'{prefix}' || ({cell}) AS r, "
                f"CAST({spec.base} + {spec.key} * {width} + {position} AS BIGINT) AS ord "
                f"FROM {name} WHERE ({cell}) IS NOT NULL"
            )
    return " UNION ALL ".join(selects)


SQL_SHOP = sql_claims(*SPECS)
SQL_PLACES = sql_claims(*PLACES)


# -- activity: a property with a long history ------------------------------------


def event_days(events: DataFrame) -> DataFrame:
    """``(day, tx_seq)``: one transaction per day with events (one row per day)."""
    days = events.select(F.to_date("ts").alias("day")).distinct()
    return days.withColumn("tx_seq", F.row_number().over(Window.orderBy("day")).cast("bigint"))


def activity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, last-event, type)`` per event, each superseding the user's one before."""
    events = table(spark, sf_dir, "events")
    dated = events.withColumn("day", F.to_date("ts")).join(event_days(events), "day")
    chained = neighbour_in_group(
        dated.select("event_id", "user_id", "event_type", "tx_seq"),
        ["user_id"], "event_id", {"previous": F.col("event_id")}, forward=False,
    )
    cid = F.concat(F.lit("c:event/"), F.col("event_id").cast("string"))
    state = F.struct(
        cid.alias("cid"),
        F.concat(F.lit("e:user/"), F.col("user_id").cast("string")).alias("l"),
        F.lit("last-event").alias("p"),
        F.concat(F.lit("v:s:"), "event_type").alias("r"),
    )
    hide = F.struct(
        F.concat(cid, F.lit("/supersedes")).alias("cid"), cid.alias("l"),
        F.lit("supersedes").alias("p"),
        F.concat(F.lit("c:event/"), F.col("previous").cast("string")).alias("r"),
    )
    return chained.select(
        F.explode(F.array(state, hide)).alias("c"), "tx_seq", F.col("event_id").alias("ord")
    ).filter(F.col("c.r").isNotNull()).select(
        "c.*", F.concat(F.lit("t:"), F.col("tx_seq").cast("string")).alias("tx_id"), "tx_seq",
        "ord",
    )


def activity(spark: SparkSession, sf_dir: str) -> ClaimGraph:
    """The activity claims with one transaction, and an agent on most, per day."""

    def build():
        days = event_days(table(spark, sf_dir, "events"))
        agent = F.when(
            F.col("tx_seq") % 5 != 0,
            F.concat(F.lit("agent-"), (F.col("tx_seq") % 5).cast("string")),
        )
        txs = days.select(
            F.concat(F.lit("t:"), F.col("tx_seq").cast("string")).alias("tx_id"),
            F.col("tx_seq").alias("seq"), agent.alias("agent"),
        )
        return stored_graph(spark, activity_claims(spark, sf_dir), "activity", txs=txs)

    return once(spark, sf_dir, "activity", build)


# CTEs: ev(event_id, user_id, event_type, tx_seq, prev), claims(cid, l, p, r, tx_seq, ord),
# hid(cid, seq) and txs(tx_id, seq, agent).
SQL_ACTIVITY = """
ev AS (
  SELECT event_id, user_id, event_type,
         dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS tx_seq,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev
  FROM events),
claims AS (
  SELECT 'c:event/' || event_id AS cid, 'e:user/' || user_id AS l, 'last-event' AS p,
         'v:s:' || event_type AS r, tx_seq, event_id AS ord FROM ev
  UNION ALL
  SELECT 'c:event/' || event_id || '/supersedes', 'c:event/' || event_id, 'supersedes',
         'c:event/' || prev, tx_seq, event_id FROM ev WHERE prev IS NOT NULL),
hid AS (SELECT r AS cid, min(tx_seq) AS seq FROM claims WHERE p = 'supersedes' GROUP BY r),
txs AS (
  SELECT DISTINCT 't:' || tx_seq AS tx_id, tx_seq AS seq,
         CASE WHEN tx_seq % 5 <> 0 THEN 'agent-' || (tx_seq % 5) END AS agent FROM ev)
"""


# -- edge tables -----------------------------------------------------------------


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep hierarchy: part k depends on part k // 2."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k > 0).select(
        k.alias("src"), F.floor(k / 2).cast("bigint").alias("dst")
    )


def spoke_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub and spoke: k depends on k - 1, and every fifth part on part 0."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k > 0).select(
        k.alias("src"), F.when(k % 5 == 0, F.lit(0)).otherwise(k - 1).cast("bigint").alias("dst")
    )


def diamond_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several paths between the same nodes: k to k // 2 and to k // 3."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k > 0).select(
        k.alias("src"),
        F.explode(
            F.array(F.floor(k / 2).cast("bigint"), F.floor(k / 3).cast("bigint"))
        ).alias("dst"),
    ).distinct()


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic graph: consecutive event types, one copy per residue class of the user."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.concat("event_type", F.lit("/"), (F.col("user_id") % 7).cast("string")).alias("node"),
    )
    nexts = neighbour_in_group(events, ["user_id"], "event_id", {"next": F.col("node")})
    return nexts.filter(F.col("next").isNotNull()).select(
        F.col("node").alias("src"), F.col("next").alias("dst")
    ).distinct()


SQL_TREE = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0"
SQL_SPOKE = (
    "SELECT p_partkey AS src, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey - 1 END AS dst "
    "FROM part WHERE p_partkey > 0"
)
SQL_DIAMOND = (
    "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 "
    "UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0"
)
SQL_EVENT_GRAPH = (
    "SELECT DISTINCT node AS src, next AS dst FROM (SELECT event_type || '/' || (user_id % 7) AS node, "
    "lead(event_type || '/' || (user_id % 7)) OVER (PARTITION BY user_id ORDER BY event_id) AS next "
    "FROM events) WHERE next IS NOT NULL"
)
