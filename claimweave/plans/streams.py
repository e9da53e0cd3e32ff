"""The same results computed from streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.graph import CLAIMS
from claimweave.operators import checks
from claimweave.operators.support import SupportedViews
from claimweave.plans.desk import SQL_STATUSES, statuses
from claimweave.plans.maintained import _EDGES, _PATHS, within
from claimweave.plans.registry import analysis, table
from claimweave.plans.shop import claims_of
from claimweave.sources.store import GraphStore
from claimweave.streaming import live
from claimweave.workspace import Workspace


def event_claims(spark, sf):
    """The events table read as a stream of claims."""
    schema = table(spark, sf, "events").schema
    events = live.claim_stream(spark, sf, schema, pattern="events.parquet")
    return events.select(
        F.concat(F.lit("c:event/"), F.col("event_id").cast("string")).alias("cid"),
        F.concat(F.lit("e:user/"), F.col("user_id").cast("string")).alias("l"),
        F.lit("last-event").alias("p"), F.concat(F.lit("v:s:"), "event_type").alias("r"),
        F.lit(None).cast("string").alias("tx_id"), F.lit(None).cast("bigint").alias("tx_seq"),
        F.col("event_id").alias("ord"),
    )


@analysis(
    "streamed_claims",
    "SELECT 'c:event/' || event_id AS cid, 'e:user/' || user_id AS l, 'v:s:' || event_type AS r FROM events",
)
def _(spark, sf):
    space = Workspace(spark)
    folder = space.path("claims")
    live.run_to_table(event_claims(spark, sf), folder, space.path("progress")).awaitTermination()
    return spark.read.schema(CLAIMS).parquet(folder).select("cid", "l", "r")


@analysis(
    "streamed_newest_values",
    "SELECT 'e:user/' || user_id AS l, 'v:s:' || arg_max(event_type, event_id) AS r, max(event_id) AS ord FROM events GROUP BY user_id",
)
def _(spark, sf):
    space = Workspace(spark)
    folder = space.path("newest")
    live.run_newest(event_claims(spark, sf), folder, space.path("progress")).awaitTermination()
    return live.read_newest(spark, folder).select("l", "r", "ord")


@analysis(
    "streamed_tagging",
    f"WITH {SQL_STATUSES} SELECT event_id, event_type AS to_state, coalesce(grp = 'terminal', false) AS is_terminal, "
    "coalesce(grp = 'escalated', false) AS is_escalated, coalesce(grp = 'blocked', false) AS is_blocked FROM events LEFT JOIN st ON event_type = name",
)
def _(spark, sf):
    space = Workspace(spark)
    folder = space.path("tagged")
    schema = table(spark, sf, "events").schema
    events = live.claim_stream(spark, sf, schema, pattern="events.parquet").select(
        "event_id", F.col("event_type").alias("to_state")
    )
    known = space.save(statuses(spark, sf), "statuses").df()
    tagged = checks.tag_transitions(events, known)
    live.run_to_table(tagged, folder, space.path("progress")).awaitTermination()
    return spark.read.schema(tagged.schema).parquet(folder)


@analysis(
    "streamed_view_maintenance",
    f"WITH RECURSIVE {_EDGES}, {_PATHS.format(e='e')} SELECT src AS a0, dst AS a1 FROM p",
)
def _(spark, sf):
    # Regions and suppliers are stored; nations, then customers, arrive as a stream.
    space = Workspace(spark)
    store = GraphStore(spark, space.path("store"))
    store.commit("load", claims_of(spark, sf, "region", "supplier"))
    folder = space.path("incoming")
    claims_of(spark, sf, "nation").coalesce(1).write.mode("append").parquet(folder)
    claims_of(spark, sf, "customer").coalesce(1).write.mode("append").parquet(folder)
    keeper = live.ViewMaintainer(store, within(), base_seq=1, kind=SupportedViews)
    stream = live.claim_stream(spark, folder, files_per_batch=1)
    keeper.start(stream, space.path("progress")).awaitTermination()
    return keeper.views.relation("within")
