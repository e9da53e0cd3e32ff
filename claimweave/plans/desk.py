"""Classification, moves, obligations and projections over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.functions.ordered import neighbour_in_group
from claimweave.functions.tables import rule_table
from claimweave.operators import checks, lookup, moves, reports
from claimweave.plans.registry import analysis, table
from claimweave.plans.shop import activity
from claimweave.workspace import Workspace

GROUP_OF = (("view", "active"), ("signup", "blocked"), ("purchase", "terminal"), ("error", "escalated"))
TRANSITIONS = (
    ("view", "click"), ("click", "view"), ("view", "purchase"), ("click", "purchase"),
    ("signup", "view"), ("error", "view"), ("purchase", "view"), ("view", "error"),
    ("click", "error"),
)
EFFECTS = (
    ("transition", "notification", "not-terminal"), ("transition", "analytics", "always"),
    ("transition", "analytics", "tag-blocked"), ("priority", "notification", "on-escalated"),
)
PERMISSIONS = (
    ("archive", "admin"), ("manage", "agent"), ("manage", "admin"), ("set_urgent", "senior"),
    ("escalate", "senior"), ("priority_high_change", "admin"),
)


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def statuses(spark, sf) -> DataFrame:
    """The event types in use with their group; clicks have none."""
    groups = rule_table(spark, ("name", "grp"), GROUP_OF)
    used = table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    return used.join(groups, "name", "left")


SQL_STATUSES = (
    f"st AS (SELECT u.name, g.grp FROM (SELECT DISTINCT event_type AS name FROM events) u "
    f"LEFT JOIN (VALUES {values(GROUP_OF)}) g(name, grp) ON u.name = g.name)"
)


def priorities(spark, sf) -> DataFrame:
    """The order priorities in use with settings that follow from their digit."""
    digit = F.substring("o_orderpriority", 1, 1).cast("bigint")
    used = table(spark, sf, "orders").select(
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("name"), digit.alias("digit")
    ).distinct()
    d = F.col("digit")
    return used.select(
        "name",
        F.when(d != 4, d * 24).alias("response_target"),
        F.when(d == 1, "senior").when(d == 2, "admin").when(d == 3, "any").when(d == 5, "agent").alias("required_role"),
        F.when(d == 1, "urgent_page").when(d != 4, "normal").alias("notification_mode"),
        (d <= 3).alias("auto_escalate"),
        F.when(d == 1, "escalated").when(d == 3, "vip").alias("escalates_to"),
    )


SQL_PRIORITIES = """
pr AS (
  SELECT name, CASE WHEN d <> 4 THEN d * 24 END AS response_target,
    CASE d WHEN 1 THEN 'senior' WHEN 2 THEN 'admin' WHEN 3 THEN 'any' WHEN 5 THEN 'agent' END AS required_role,
    CASE WHEN d = 1 THEN 'urgent_page' WHEN d <> 4 THEN 'normal' END AS notification_mode,
    d <= 3 AS auto_escalate, CASE d WHEN 1 THEN 'escalated' WHEN 3 THEN 'vip' END AS escalates_to
  FROM (SELECT DISTINCT lower(substr(o_orderpriority, 3)) AS name, CAST(o_orderpriority[1] AS BIGINT) AS d FROM orders))
"""


def effects(spark) -> DataFrame:
    return rule_table(spark, ("trigger", "kind", "cond"), EFFECTS)


def permissions(spark) -> DataFrame:
    return rule_table(spark, ("action", "role"), PERMISSIONS)


def transitions(spark) -> DataFrame:
    return rule_table(spark, ("from_name", "to_name"), TRANSITIONS)


def order_props(spark, sf) -> DataFrame:
    """Properties of every order as rows; medium priority says nothing about being terminal."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    low = (status == "P") & (priority == "5-LOW")
    pairs = F.array(
        F.struct(
            F.lit("counts_as_work").alias("prop"),
            F.when(status.isin("O", "P") & ~low, "true").otherwise("false").alias("value"),
        ),
        F.struct(
            F.lit("terminal").alias("prop"),
            F.when(priority != "3-MEDIUM", F.when(status == "F", "true").otherwise("false")).alias("value"),
        ),
        F.struct(
            F.lit("priority").alias("prop"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "high").otherwise("normal").alias("value"),
        ),
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entity"), F.explode(pairs).alias("p")
    ).select("entity", "p.prop", "p.value").filter(F.col("value").isNotNull())


_ORDER_GROUP = """
g AS (
  SELECT o_orderkey AS entity, CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL
    WHEN o_orderstatus = 'F' THEN 'terminal'
    WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'blocked'
    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'escalated' ELSE 'active' END AS grp FROM orders)
"""


@analysis("derived_groups", f"WITH {_ORDER_GROUP} SELECT entity, grp FROM g")
def _(spark, sf):
    return checks.derive_group(order_props(spark, sf))


@analysis("unmatched_entities", f"WITH {_ORDER_GROUP} SELECT entity FROM g WHERE grp IS NULL")
def _(spark, sf):
    return checks.unmatched(order_props(spark, sf))


_CONTRADICTIONS = """
WITH d AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'escalated' ELSE 'terminal' END AS grp FROM orders),
p AS (
  SELECT o_orderkey AS entity, grp, 'counts_as_work' AS prop, CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P'
    AND o_orderpriority = '5-LOW') THEN 'false' ELSE 'true' END AS value FROM d
  UNION ALL SELECT o_orderkey, grp, 'terminal', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END FROM d
    WHERE o_orderpriority <> '3-MEDIUM'
  UNION ALL SELECT o_orderkey, grp, 'priority', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'normal' END FROM d)
SELECT p.entity, p.grp, p.prop, p.value, x.expected FROM p JOIN (VALUES ('active', 'counts_as_work', 'true'),
  ('active', 'terminal', 'false'), ('terminal', 'counts_as_work', 'false'), ('terminal', 'terminal', 'true'),
  ('escalated', 'counts_as_work', 'true'), ('escalated', 'terminal', 'false'), ('escalated', 'priority', 'high')
) x(grp, prop, expected) ON p.grp = x.grp AND p.prop = x.prop WHERE p.value <> x.expected
"""


@analysis("contradicting_properties", _CONTRADICTIONS)
def _(spark, sf):
    declared = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entity"),
        F.when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "P", "escalated")
        .otherwise("terminal")
        .alias("grp"),
    )
    return checks.contradictions(declared, order_props(spark, sf))


def user_states(spark, sf) -> DataFrame:
    live = lookup.newest(activity(spark, sf).current(p="last-event"))
    return live.select(F.col("l").alias("entity"), ids.short_literal(F.col("r")).alias("state"))


def move_requests(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        ids.entity_id("user", "user_id").alias("entity"), F.col("event_type").alias("target"),
        F.col("event_id").alias("ord"),
    )


_STATE = (
    "s AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id), "
    f"t AS (SELECT * FROM (VALUES {values(TRANSITIONS)}) v(a, b))"
)


@analysis(
    "allowed_moves",
    f"WITH {_STATE} SELECT 'e:user/' || e.user_id AS entity, event_id AS ord, state, event_type AS target, "
    "(state, event_type) IN (SELECT (a, b) FROM t) AS allowed FROM events e JOIN s ON e.user_id = s.user_id",
)
def _(spark, sf):
    return checks.check_moves(user_states(spark, sf), move_requests(spark, sf), transitions(spark))


@analysis(
    "applied_moves",
    f"WITH {_STATE}, f AS (SELECT user_id, min(event_id) AS ord, arg_min(event_type, event_id) AS target "
    "FROM events GROUP BY user_id) SELECT 'e:user/' || s.user_id AS entity, CASE WHEN (state, target) IN "
    "(SELECT (a, b) FROM t) THEN target ELSE state END AS state, (state, target) IN (SELECT (a, b) FROM t) "
    "AS accepted, (SELECT count(*) FROM events e WHERE e.user_id = s.user_id) - 1 AS waiting FROM s JOIN f ON s.user_id = f.user_id",
)
def _(spark, sf):
    after, outcome, later = checks.apply_moves(
        user_states(spark, sf), move_requests(spark, sf), transitions(spark)
    )
    waiting = later.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return (
        after.join(outcome.select("entity", F.col("allowed").alias("accepted")), "entity")
        .join(waiting, "entity", "left")
        .select("entity", "state", "accepted", F.coalesce("n", F.lit(0)).alias("waiting"))
    )


# Each user's events in their order; a step per event, all users at once.
_TO_THE_END = (
    f"RECURSIVE {_STATE}, q AS (SELECT user_id, event_id, event_type AS target, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    "w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS met, "
    "CAST(NULL AS VARCHAR) AS target, false AS allowed, state FROM s "
    "UNION ALL SELECT q.user_id, q.k, q.event_id, w.state, q.target, t.a IS NOT NULL, "
    "CASE WHEN t.a IS NOT NULL THEN q.target ELSE w.state END "
    "FROM w JOIN q ON q.user_id = w.user_id AND q.k = w.k + 1 LEFT JOIN t ON t.a = w.state AND t.b = q.target)"
)


def _moved(spark, sf):
    return moves.move_to_the_end(user_states(spark, sf), move_requests(spark, sf), transitions(spark), Workspace(spark))


@analysis(
    "moves_to_the_end",
    f"WITH {_TO_THE_END} SELECT 'e:user/' || user_id AS entity, ord, met AS state, target, allowed FROM w WHERE k > 0",
)
def _(spark, sf):
    return _moved(spark, sf)[1]


@analysis(
    "states_after_all_moves",
    f"WITH {_TO_THE_END} SELECT 'e:user/' || user_id AS entity, arg_max(state, k) AS state FROM w GROUP BY user_id",
)
def _(spark, sf):
    return _moved(spark, sf)[0]


_ROLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'senior' WHEN 'HOUSEHOLD' THEN 'agent' END"


def customer_roles(spark, sf) -> DataFrame:
    segment = F.col("c_mktsegment")
    role = F.when(segment == "BUILDING", "admin").when(segment == "MACHINERY", "senior").when(
        segment == "HOUSEHOLD", "agent"
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), role.alias("role"))


@analysis(
    "access_checks",
    f"WITH r AS (SELECT c_custkey, {_ROLE} AS role FROM customer), q AS (SELECT o_orderkey, o_custkey AS u, "
    "CASE o_orderstatus WHEN 'F' THEN 'archive' WHEN 'O' THEN 'manage' ELSE 'escalate' END AS action FROM orders) "
    f"SELECT o_orderkey, u AS \"user\", action, role, coalesce((action, role) IN (VALUES {values(PERMISSIONS)}), false) AS allowed "
    "FROM q JOIN r ON u = c_custkey",
)
def _(spark, sf):
    status = F.col("o_orderstatus")
    requests = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user"),
        F.when(status == "F", "archive").when(status == "O", "manage").otherwise("escalate").alias("action"),
    )
    allowed = checks.check_access(
        customer_roles(spark, sf), requests.select("user", "action").distinct(), permissions(spark)
    )
    return requests.join(allowed, ["user", "action"]).select("o_orderkey", "user", "action", "role", "allowed")


@analysis(
    "priority_access_checks",
    f"WITH {SQL_PRIORITIES}, r AS (SELECT c_custkey, {_ROLE} AS role FROM customer), q AS (SELECT DISTINCT o_custkey AS u, "
    "lower(substr(o_orderpriority, 3)) AS priority FROM orders), o(role, k) AS (VALUES ('agent', 1), ('senior', 2), ('admin', 3)) "
    "SELECT u AS \"user\", q.priority, r.role, required_role IS NULL OR required_role = 'any' OR coalesce(h.k >= m.k, false) AS allowed "
    "FROM q JOIN r ON u = c_custkey LEFT JOIN pr ON q.priority = pr.name LEFT JOIN o h ON h.role = r.role "
    "LEFT JOIN o m ON m.role = required_role",
)
def _(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("priority")
    ).distinct()
    return checks.check_priority_access(customer_roles(spark, sf), requests, priorities(spark, sf))


_MENTIONS = f"ef AS (SELECT * FROM (VALUES {values(EFFECTS)}) v(trigger, kind, cond))"
_COVERED = (
    "cov AS (SELECT DISTINCT g.grp, ef.kind FROM (SELECT DISTINCT grp FROM st WHERE grp IS NOT NULL) g JOIN ef "
    "ON ef.cond IN (g.grp, 'tag-' || g.grp, 'on-' || g.grp, 'not-' || g.grp))"
)


@analysis("effect_coverage", f"WITH {SQL_STATUSES}, {_MENTIONS}, {_COVERED} SELECT grp, kind FROM cov")
def _(spark, sf):
    return checks.covered_groups(effects(spark), checks.used_groups(statuses(spark, sf)))


@analysis(
    "workflow_obligations",
    f"WITH {SQL_STATUSES}, {SQL_PRIORITIES} SELECT 'workflow' AS module, 'status without group' AS reason, name AS subject FROM st WHERE grp IS NULL "
    "UNION ALL SELECT 'workflow', 'escalation without target', name FROM pr WHERE auto_escalate AND escalates_to IS NULL "
    "UNION ALL SELECT 'workflow', 'escalation to empty group', name FROM pr WHERE auto_escalate AND escalates_to NOT IN (SELECT grp FROM st WHERE grp IS NOT NULL)",
)
def workflow(spark, sf):
    return checks.workflow_obligations(statuses(spark, sf), priorities(spark, sf))


_NOTIFICATION_SQL = (
    "SELECT 'notifications' AS module, 'terminal group not suppressed' AS reason, grp AS subject FROM (SELECT DISTINCT grp FROM st "
    "WHERE grp = 'terminal') WHERE grp NOT IN (SELECT grp FROM cov WHERE kind = 'notification') "
    "UNION ALL SELECT 'notifications', 'group not handled', grp FROM (SELECT DISTINCT grp FROM st WHERE grp IN ('blocked', 'escalated')) "
    "WHERE grp NOT IN (SELECT grp FROM cov WHERE kind = 'notification') "
    "UNION ALL SELECT 'notifications', 'priority mode without effect', name FROM pr WHERE notification_mode <> 'normal' "
    "AND NOT EXISTS (SELECT 1 FROM ef WHERE kind = 'notification' AND contains(cond, 'priority'))"
)
_ANALYTICS_SQL = (
    "SELECT 'analytics' AS module, 'group not tagged' AS reason, grp AS subject FROM (SELECT DISTINCT grp FROM st WHERE grp IN ('blocked', 'escalated')) "
    "WHERE grp NOT IN (SELECT grp FROM cov WHERE kind = 'analytics') "
    "UNION ALL SELECT 'analytics', 'priority not tracked', name FROM pr WHERE NOT EXISTS "
    "(SELECT 1 FROM ef WHERE kind = 'analytics' AND contains(cond, 'priority'))"
)
_ALL = f"WITH {SQL_STATUSES}, {SQL_PRIORITIES}, {_MENTIONS}, {_COVERED} "


@analysis("notification_obligations", _ALL + _NOTIFICATION_SQL)
def notifications(spark, sf):
    return checks.notification_obligations(statuses(spark, sf), effects(spark), priorities(spark, sf))


@analysis("analytics_obligations", _ALL + _ANALYTICS_SQL)
def analytics(spark, sf):
    return checks.analytics_obligations(statuses(spark, sf), effects(spark), priorities(spark, sf))


_ACTIONS = "(('terminal', 'archive'), ('blocked', 'suspend'), ('blocked', 'resume'), ('escalated', 'escalate'), ('escalated', 'de_escalate'))"
_PERMISSION_SQL = (
    f"SELECT 'permissions' AS module, 'group action missing' AS reason, grp || '/' || action AS subject FROM (VALUES {_ACTIONS[1:-1]}) n(grp, action) "
    "WHERE grp IN (SELECT grp FROM st) AND action NOT IN (SELECT action FROM pm) "
    "UNION ALL SELECT 'permissions', 'priority without gate', name FROM pr WHERE required_role <> 'any' AND NOT EXISTS "
    "(SELECT 1 FROM pm WHERE action = 'set_' || name OR action = 'set_priority_' || name OR (contains(action, 'priority') AND contains(action, name)))"
)
_PERMISSIONS = f"pm AS (SELECT * FROM (VALUES {values(PERMISSIONS)}) v(action, role))"


@analysis("permission_obligations", _ALL + f", {_PERMISSIONS} " + _PERMISSION_SQL)
def permission(spark, sf):
    return checks.permission_obligations(statuses(spark, sf), permissions(spark), priorities(spark, sf))


@analysis(
    "obligation_summary",
    _ALL + f", {_PERMISSIONS}, ob AS ({_NOTIFICATION_SQL} UNION ALL {_ANALYTICS_SQL} UNION ALL {_PERMISSION_SQL}) "
    "SELECT count(*) AS obligations, CAST(count(*) FILTER (module = 'permissions') AS BIGINT) AS critical, "
    "CASE WHEN count(*) = 0 THEN 'pass' ELSE 'failed' END AS status FROM ob",
)
def _(spark, sf):
    found = notifications(spark, sf).unionByName(analytics(spark, sf)).unionByName(permission(spark, sf))
    return checks.obligation_summary(found, F.col("module") == "permissions")


@analysis(
    "projected_status_sets",
    f"WITH {SQL_STATUSES} SELECT upper(grp) || '_STATUSES' AS set_name, name AS status FROM st WHERE grp IS NOT NULL "
    "UNION ALL SELECT 'ALL_STATUSES', name FROM st",
)
def _(spark, sf):
    return checks.status_sets(statuses(spark, sf))


@analysis(
    "projected_priorities",
    f"WITH {SQL_PRIORITIES} SELECT name, response_target, CASE WHEN auto_escalate THEN true END AS auto_escalate, "
    "CASE WHEN auto_escalate THEN escalates_to END AS escalates_to, nullif(required_role, 'any') AS required_role, "
    "nullif(notification_mode, 'normal') AS notification_mode FROM pr",
)
def _(spark, sf):
    return checks.priority_table(priorities(spark, sf))


@analysis(
    "projected_role_requirements",
    f"WITH {SQL_PRIORITIES}, o(role, k) AS (VALUES ('agent', 1), ('senior', 2), ('admin', 3)) SELECT name AS priority, o.role "
    "FROM pr JOIN o m ON m.role = required_role JOIN o ON o.k >= m.k",
)
def _(spark, sf):
    return checks.role_requirements(priorities(spark, sf))


@analysis(
    "projected_transitions",
    "SELECT a AS src, string_agg(b, ',' ORDER BY b) AS targets FROM (SELECT DISTINCT prev AS a, event_type AS b FROM "
    "(SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL) GROUP BY a",
)
def _(spark, sf):
    return reports.small_adjacency(
        transition_events(spark, sf).select(
            F.col("from_state").alias("src"), F.col("to_state").alias("dst")
        )
    )


def transition_events(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    chained = neighbour_in_group(
        events, ["user_id"], "event_id", {"from_state": F.col("event_type")}, forward=False
    )
    return chained.filter(F.col("from_state").isNotNull()).select(
        "event_id", F.col("user_id").alias("item"), "from_state", F.col("event_type").alias("to_state")
    )


_MOVES = (
    "mv AS (SELECT * FROM (SELECT event_id, user_id AS item, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) "
    "AS from_state, event_type AS to_state FROM events) WHERE from_state IS NOT NULL)"
)


@analysis(
    "tagged_transitions",
    f"WITH {SQL_STATUSES}, {_MOVES} SELECT event_id, item, from_state, to_state, coalesce(grp = 'terminal', false) AS is_terminal, "
    "coalesce(grp = 'escalated', false) AS is_escalated, coalesce(grp = 'blocked', false) AS is_blocked FROM mv LEFT JOIN st ON to_state = name",
)
def _(spark, sf):
    return checks.tag_transitions(transition_events(spark, sf), statuses(spark, sf))


def order_priorities(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.lower(F.substring("o_orderpriority", 3, 20)).alias("priority"), "o_orderdate"
    )


@analysis(
    "tagged_priorities",
    f"WITH {SQL_PRIORITIES} SELECT o_orderkey, lower(substr(o_orderpriority, 3)) AS priority, response_target, "
    "lower(substr(o_orderpriority, 3)) = 'critical' AS is_critical FROM orders JOIN pr ON name = lower(substr(o_orderpriority, 3))",
)
def _(spark, sf):
    events = order_priorities(spark, sf).select("o_orderkey", "priority")
    return checks.tag_priorities(events, priorities(spark, sf))


@analysis(
    "target_compliance",
    f"WITH {SQL_PRIORITIES}, s AS (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey) "
    "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(first_ship AS DATE)) AS BIGINT) AS elapsed, response_target, "
    "coalesce(date_diff('day', CAST(o_orderdate AS DATE), CAST(first_ship AS DATE)) <= response_target, true) AS compliant "
    "FROM orders JOIN s ON o_orderkey = l_orderkey JOIN pr ON name = lower(substr(o_orderpriority, 3))",
)
def _(spark, sf):
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship")
    )
    items = order_priorities(spark, sf).join(first, "o_orderkey").select(
        "o_orderkey", "priority",
        F.date_diff(F.to_date("first_ship"), F.to_date("o_orderdate")).cast("bigint").alias("elapsed"),
    )
    return checks.check_targets(items, priorities(spark, sf), "elapsed").drop("priority")


@analysis(
    "settings_with_default",
    f"WITH {SQL_PRIORITIES}, i AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE lower(substr(o_orderpriority, 3)) END AS priority FROM orders) "
    "SELECT o_orderkey, priority, CASE WHEN pr.name IS NULL THEN (SELECT response_target FROM pr WHERE name = 'low') ELSE response_target END AS response_target, "
    "coalesce(notification_mode, 'normal') AS notification_mode FROM i LEFT JOIN pr ON priority = pr.name",
)
def _(spark, sf):
    items = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "none")
        .otherwise(F.lower(F.substring("o_orderpriority", 3, 20)))
        .alias("priority"),
    )
    return checks.settings_or_default(items, priorities(spark, sf), default="low")


_SUBSCRIBERS = (
    "sb AS (SELECT DISTINCT user_id AS item, 'a' || user_id || '@example.org' AS email FROM events "
    "UNION ALL SELECT DISTINCT user_id, 'b' || user_id || '@example.org' FROM events WHERE event_type = 'signup')"
)


@analysis(
    "routed_notifications",
    f"WITH {SQL_STATUSES}, {_MOVES}, {_SUBSCRIBERS} SELECT event_id, mv.item, email, CASE WHEN grp IN ('escalated', 'blocked') "
    "THEN upper(grp[1]) || substr(grp, 2) || ' notification to ' ELSE 'Notification to ' END || email || ': ' || from_state || ' -> ' || to_state AS message "
    "FROM mv LEFT JOIN st ON to_state = name JOIN sb ON mv.item = sb.item WHERE coalesce(grp <> 'terminal', true)",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    subscribers = events.select(
        F.col("user_id").alias("item"), F.concat(F.lit("a"), user, F.lit("@example.org")).alias("email")
    ).unionByName(
        events.filter("event_type = 'signup'").select(
            F.col("user_id").alias("item"), F.concat(F.lit("b"), user, F.lit("@example.org")).alias("email")
        )
    ).distinct()
    return checks.route_notifications(
        transition_events(spark, sf), statuses(spark, sf), subscribers, keep=["event_id"]
    )


@analysis(
    "work_count",
    f"WITH {SQL_STATUSES} SELECT count(*) AS active_count FROM events JOIN st ON event_type = name WHERE grp IN ('active', 'escalated')",
)
def _(spark, sf):
    items = table(spark, sf, "events").select(F.col("event_type").alias("state"))
    return checks.work_count(items, statuses(spark, sf))


@analysis(
    "plain_listings",
    f"WITH {SQL_PRIORITIES} SELECT name, required_role, escalates_to FROM pr WHERE required_role IS NOT NULL AND escalates_to IS NOT NULL",
)
def _(spark, sf):
    return checks.complete_rows(priorities(spark, sf), "name", "required_role", "escalates_to")


@analysis(
    "rejected_rows",
    f"WITH {SQL_STATUSES}, n AS (SELECT c_name AS name, c_mktsegment = 'BUILDING' AS auto_escalate, CASE WHEN c_acctbal < 0 THEN NULL "
    "WHEN c_acctbal < 5000 THEN 'escalated' ELSE 'vip' END AS escalates_to, CASE WHEN c_nationkey = 3 THEN 'captain' ELSE 'senior' END AS required_role FROM customer) "
    "SELECT name, 'escalation without target' AS reason FROM n WHERE auto_escalate AND escalates_to IS NULL "
    "UNION ALL SELECT name, 'target group is empty' FROM n WHERE auto_escalate AND escalates_to NOT IN (SELECT grp FROM st WHERE grp IS NOT NULL) "
    "UNION ALL SELECT name, 'unknown role' FROM n WHERE required_role NOT IN ('any', 'agent', 'senior', 'admin')",
)
def _(spark, sf):
    balance = F.col("c_acctbal")
    rows = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("auto_escalate"),
        F.when(balance < 0, None).when(balance < 5000, "escalated").otherwise("vip").alias("escalates_to"),
        F.when(F.col("c_nationkey") == 3, "captain").otherwise("senior").alias("required_role"),
    )
    return checks.validate_priorities(rows, statuses(spark, sf))
