"""Classification and constraint checks driven by small rule tables.

Entities, states and events are tables of any size; the rules are Python values or small
frames.  A violation is a row, never an exception.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.tables import rule_table

Groups = Mapping[str, Mapping[str, str]]

# The group model of the help-desk domain (property values as text).
GROUPS: dict[str, dict[str, str]] = {
    "active": {"counts_as_work": "true", "terminal": "false"},
    "terminal": {"counts_as_work": "false", "terminal": "true"},
    "blocked": {"counts_as_work": "false", "terminal": "false"},
    "escalated": {"counts_as_work": "true", "terminal": "false", "priority": "high"},
}
# Actions each group needs a permission for.
GROUP_ACTIONS: dict[str, tuple[str, ...]] = {
    "active": (),
    "terminal": ("archive",),
    "blocked": ("suspend", "resume"),
    "escalated": ("escalate", "de_escalate"),
}
# Roles from least to most powerful.
ROLES = ("agent", "senior", "admin")
STANDARD = ("active", "terminal")


# -- classification ------------------------------------------------------------


def derive_group(
    props: DataFrame, groups: Groups = GROUPS, entity: str = "entity"
) -> DataFrame:
    """The most specific group whose properties all hold: ``(entity, grp)``.

    ``props`` has ``entity, prop, value``.  The rules become conditions of a single
    aggregate, so there is one shuffle and no join.  Entities matching no group get NULL.
    """
    ranked = sorted(groups.items(), key=lambda item: (-len(item[1]), item[0]))
    wanted = sorted({pair for _, rules in ranked for pair in rules.items()})

    def holds(prop: str, value: str) -> Column:
        return F.coalesce(F.max((F.col("prop") == prop) & (F.col("value") == value)), F.lit(False))

    name = {pair: f"_h{i}" for i, pair in enumerate(wanted)}
    flags = props.groupBy(entity).agg(*[holds(*pair).alias(name[pair]) for pair in wanted])
    chosen = F.lit(None).cast("string")
    for group, rules in reversed(ranked):
        matches = F.lit(True)
        for pair in rules.items():
            matches = matches & F.col(name[pair])
        chosen = F.when(matches, group).otherwise(chosen)
    return flags.select(entity, chosen.alias("grp"))


def unmatched(props: DataFrame, groups: Groups = GROUPS, entity: str = "entity") -> DataFrame:
    """Entities whose properties match no group."""
    return derive_group(props, groups, entity).filter(F.col("grp").isNull()).select(entity)


def contradictions(
    declared: DataFrame, props: DataFrame, groups: Groups = GROUPS, strict: bool = True
) -> DataFrame:
    """Properties that contradict the declared group of their entity.

    ``strict`` also checks required values of ``false``; without it they are skipped.
    """
    spark = props.sparkSession
    rows = [
        (g, k, v) for g, rules in groups.items() for k, v in rules.items() if strict or v != "false"
    ]
    expected = rule_table(spark, ("grp", "prop", "expected"), rows)
    return (
        props.join(declared.select("entity", "grp"), "entity")
        .join(expected, ["grp", "prop"])
        .filter(F.col("value") != F.col("expected"))
        .select("entity", "grp", "prop", "value", "expected")
    )


# -- moves and access ----------------------------------------------------------


def check_moves(states: DataFrame, requests: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each requested move with ``allowed``; an entity without a state allows nothing.

    ``states(entity, state)``, ``requests(entity, target, ord)``,
    ``transitions(from_name, to_name)``.
    """
    pairs = transitions.select(
        F.col("from_name").alias("state"), F.col("to_name").alias("target")
    ).distinct().withColumn("_ok", F.lit(True))
    return (
        requests.join(states, "entity", "left")
        .join(pairs, ["state", "target"], "left")
        .select("entity", "ord", "state", "target", F.coalesce("_ok", F.lit(False)).alias("allowed"))
    )


def apply_moves(
    states: DataFrame, requests: DataFrame, transitions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of many moves: new states, outcomes, and the requests still to come.

    The earliest request of each entity is tried; its later requests are returned
    unchanged as the next batch, since they depend on the outcome.
    """
    first = requests.groupBy("entity").agg(
        F.min("ord").alias("ord"), F.min_by("target", "ord").alias("target")
    )
    outcome = check_moves(states, first, transitions)
    moved = outcome.filter("allowed").select("entity", F.col("target").alias("_new"))
    after = states.join(moved, "entity", "left").select(
        "entity", F.coalesce("_new", "state").alias("state")
    )
    later = requests.join(first.select("entity", "ord"), ["entity", "ord"], "left_anti")
    return after, outcome, later


def check_access(users: DataFrame, requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """``requests(user, action)`` with ``allowed``; ``users(user, role)``,
    ``permissions(action, role)``."""
    granted = permissions.select("action", "role").distinct().withColumn("_ok", F.lit(True))
    return (
        requests.join(users.select("user", "role"), "user", "left")
        .join(granted, ["action", "role"], "left")
        .select("user", "action", "role", F.coalesce("_ok", F.lit(False)).alias("allowed"))
    )


def roles_from(minimum: Column, hierarchy: Sequence[str] = ROLES) -> Column:
    """The minimum role and every role above it; an unknown minimum admits all roles."""
    order = F.array(*[F.lit(r) for r in hierarchy])
    start = F.greatest(F.array_position(order, minimum), F.lit(1)).cast("int")
    return F.slice(order, start, F.lit(len(hierarchy)))


def check_priority_access(users: DataFrame, requests: DataFrame, priorities: DataFrame) -> DataFrame:
    """``requests(user, priority)`` with ``allowed``; an unrestricted priority passes."""
    needed = priorities.select(F.col("name").alias("priority"), "required_role")
    free = F.col("required_role").isNull() | (F.col("required_role") == "any")
    allowed = free | F.coalesce(
        F.array_contains(roles_from(F.col("required_role")), F.col("role")), F.lit(False)
    )
    return (
        requests.join(users.select("user", "role"), "user", "left")
        .join(needed, "priority", "left")
        .select("user", "priority", "role", allowed.alias("allowed"))
    )


# -- effects and obligations ---------------------------------------------------


def covered_groups(effects: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, kind)`` pairs some effect condition mentions as g, tag-g, on-g or not-g."""
    g = F.col("grp")
    mentions = groups.select(
        "grp",
        F.explode(
            F.array(
                g,
                F.concat(F.lit("tag-"), g),
                F.concat(F.lit("on-"), g),
                F.concat(F.lit("not-"), g),
            )
        ).alias("cond"),
    )
    return mentions.join(effects.select("kind", "cond"), "cond").select("grp", "kind").distinct()


def _obligations(df: DataFrame, module: str, reason: str, subject: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select(
        F.lit(module).alias("module"), F.lit(reason).alias("reason"), subject.alias("subject")
    )


def used_groups(statuses: DataFrame) -> DataFrame:
    return statuses.filter(F.col("grp").isNotNull()).select("grp").distinct()


def _special_groups(statuses: DataFrame, groups: Groups) -> DataFrame:
    """Used groups of the model other than the active and terminal ones."""
    special = [g for g in groups if g not in STANDARD]
    return used_groups(statuses).filter(F.col("grp").isin(*special))


def _when_none(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """``df`` if ``evidence`` has no row, else nothing; evidence is cut to one row."""
    one = evidence.select(F.lit(True).alias("_seen")).limit(1)
    return (
        df.withColumn("_always", F.lit(True))
        .join(F.broadcast(one), F.col("_always") == F.col("_seen"), "left_anti")
        .drop("_always")
    )


def workflow_obligations(statuses: DataFrame, priorities: DataFrame) -> DataFrame:
    """Statuses without a group; escalation without a target or with an empty target."""
    no_group = statuses.filter(F.col("grp").isNull())
    escalating = priorities.filter(F.col("auto_escalate"))
    targets = used_groups(statuses).withColumnRenamed("grp", "escalates_to")
    aimless = escalating.filter(F.col("escalates_to").isNull())
    empty = escalating.filter(F.col("escalates_to").isNotNull()).join(
        targets, "escalates_to", "left_anti"
    )
    return (
        _obligations(no_group, "workflow", "status without group", "name")
        .unionByName(_obligations(aimless, "workflow", "escalation without target", "name"))
        .unionByName(_obligations(empty, "workflow", "escalation to empty group", "name"))
    )


def notification_obligations(
    statuses: DataFrame, effects: DataFrame, priorities: DataFrame, groups: Groups = GROUPS
) -> DataFrame:
    """Terminal suppression, handling of special groups, special priority modes."""
    mine = effects.filter(F.col("kind") == "notification")
    used = used_groups(statuses)
    covered = covered_groups(mine, used).select("grp")
    terminal = used.filter(F.col("grp") == "terminal").join(covered, "grp", "left_anti")
    special = _special_groups(statuses, groups).join(covered, "grp", "left_anti")
    modes = priorities.filter(
        F.col("notification_mode").isNotNull() & (F.col("notification_mode") != "normal")
    )
    modes = _when_none(modes, mine.filter(F.col("cond").contains("priority")))
    return (
        _obligations(terminal, "notifications", "terminal group not suppressed", "grp")
        .unionByName(_obligations(special, "notifications", "group not handled", "grp"))
        .unionByName(_obligations(modes, "notifications", "priority mode without effect", "name"))
    )


def analytics_obligations(
    statuses: DataFrame, effects: DataFrame, priorities: DataFrame, groups: Groups = GROUPS
) -> DataFrame:
    """Special groups without a tag; priorities without tracking."""
    mine = effects.filter(F.col("kind") == "analytics")
    special = _special_groups(statuses, groups)
    untagged = special.join(covered_groups(mine, special).select("grp"), "grp", "left_anti")
    untracked = _when_none(priorities, mine.filter(F.col("cond").contains("priority")))
    return _obligations(untagged, "analytics", "group not tagged", "grp").unionByName(
        _obligations(untracked, "analytics", "priority not tracked", "name")
    )


def permission_obligations(
    statuses: DataFrame,
    permissions: DataFrame,
    priorities: DataFrame,
    group_actions: Mapping[str, Sequence[str]] = GROUP_ACTIONS,
) -> DataFrame:
    """Group actions without a permission; restricted priorities without a gate."""
    spark = statuses.sparkSession
    actions = permissions.select("action").distinct()
    rows = [(g, a) for g, acts in group_actions.items() if g != "active" for a in acts]
    needed = rule_table(spark, ("grp", "action"), rows)
    missing = needed.join(used_groups(statuses), "grp", "left_semi").join(
        actions, "action", "left_anti"
    )
    restricted = priorities.filter(
        F.col("required_role").isNotNull() & (F.col("required_role") != "any")
    ).select("name")
    by_name = restricted.select(
        "name",
        F.explode(
            F.array(
                F.concat(F.lit("set_"), F.col("name")),
                F.concat(F.lit("set_priority_"), F.col("name")),
            )
        ).alias("action"),
    ).join(actions, "action", "left_semi")
    # An action that contains "priority" and the name: every piece of it is a candidate.
    text = F.col("action")
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.length(text) - i + 1), lambda n: F.substring(text, i, n)
            ),
        )
    )
    mentioned = (
        actions.filter(text.contains("priority"))
        .select(F.explode(pieces).alias("name"))
        .distinct()
    )
    ungated = restricted.join(by_name.select("name"), "name", "left_anti").join(
        mentioned, "name", "left_anti"
    )
    return _obligations(
        missing, "permissions", "group action missing", F.concat_ws("/", "grp", "action")
    ).unionByName(_obligations(ungated, "permissions", "priority without gate", "name"))


def obligation_summary(obligations: DataFrame, critical: Column) -> DataFrame:
    """One row: number of obligations, how many are critical, pass or failed."""
    return obligations.agg(
        F.count(F.lit(1)).alias("obligations"),
        F.coalesce(F.sum(F.when(critical, 1).otherwise(0)), F.lit(0)).alias("critical"),
    ).withColumn("status", F.when(F.col("obligations") == 0, "pass").otherwise("failed"))


# -- projected tables ----------------------------------------------------------


def status_sets(statuses: DataFrame) -> DataFrame:
    """``(set_name, status)``: one set per used group, named GROUP_STATUSES, and all of them."""
    named = statuses.filter(F.col("grp").isNotNull()).select(
        F.concat(F.upper("grp"), F.lit("_STATUSES")).alias("set_name"), F.col("name").alias("status")
    )
    every = statuses.select(F.lit("ALL_STATUSES").alias("set_name"), F.col("name").alias("status"))
    return named.unionByName(every)


def priority_table(priorities: DataFrame) -> DataFrame:
    """The projected priority configuration, settings equal to the default left out."""
    role, mode = F.col("required_role"), F.col("notification_mode")
    return priorities.select(
        "name",
        "response_target",
        F.when(F.col("auto_escalate"), True).alias("auto_escalate"),
        F.when(F.col("auto_escalate"), F.col("escalates_to")).alias("escalates_to"),
        F.when(role != "any", role).alias("required_role"),
        F.when(mode != "normal", mode).alias("notification_mode"),
    )


def role_requirements(priorities: DataFrame, hierarchy: Sequence[str] = ROLES) -> DataFrame:
    """``(priority, role)``: roles that may set each restricted priority."""
    restricted = priorities.filter(
        F.col("required_role").isNotNull() & (F.col("required_role") != "any")
    )
    return restricted.select(
        F.col("name").alias("priority"),
        F.explode(roles_from(F.col("required_role"), hierarchy)).alias("role"),
    )


def work_count(items: DataFrame, statuses: DataFrame, groups: Groups = GROUPS) -> DataFrame:
    """One row: items whose status lies in a group that counts as work."""
    work = [g for g, rules in groups.items() if rules.get("counts_as_work") == "true"]
    counted = statuses.filter(F.col("grp").isin(*work)).select(F.col("name").alias("state"))
    return items.join(counted.distinct(), "state", "left_semi").agg(
        F.count(F.lit(1)).alias("active_count")
    )


# -- event rules ---------------------------------------------------------------


def tag_transitions(
    events: DataFrame, statuses: DataFrame, tagged: Sequence[str] = ("escalated", "blocked")
) -> DataFrame:
    """Events with ``is_terminal`` and ``is_<group>`` of their new state (column ``to_state``).

    Works on batch and streaming events alike.
    """
    groups = statuses.select(F.col("name").alias("to_state"), "grp")
    flags = {g: F.coalesce(F.col("grp") == g, F.lit(False)) for g in ("terminal", *tagged)}
    return (
        events.join(groups, "to_state", "left")
        .withColumns({f"is_{g}": flag for g, flag in flags.items()})
        .drop("grp")
    )


def tag_priorities(events: DataFrame, priorities: DataFrame) -> DataFrame:
    """Events with the response target of their priority and ``is_critical``."""
    targets = priorities.select(F.col("name").alias("priority"), "response_target")
    return events.join(targets, "priority", "left").withColumn(
        "is_critical", F.coalesce(F.col("priority") == "critical", F.lit(False))
    )


def check_targets(items: DataFrame, priorities: DataFrame, elapsed: str) -> DataFrame:
    """Items with ``compliant``: elapsed time within the target, a missing target passes."""
    targets = priorities.select(F.col("name").alias("priority"), "response_target")
    met = F.coalesce(F.col(elapsed) <= F.col("response_target"), F.lit(True))
    return items.join(targets, "priority", "left").withColumn("compliant", met)


def settings_or_default(
    items: DataFrame, priorities: DataFrame, default: str = "normal"
) -> DataFrame:
    """Response target and notification mode, falling back to the default priority's row."""
    own = priorities.select(
        F.col("name").alias("priority"), "response_target", "notification_mode", F.lit(True).alias("_known")
    )
    base = priorities.filter(F.col("name") == default).select("response_target").first()
    fallback = F.lit(base[0] if base else None)
    return items.join(own, "priority", "left").select(
        *[F.col(c) for c in items.columns],
        F.when(F.col("_known"), F.col("response_target"))
        .otherwise(fallback)
        .alias("response_target"),
        F.coalesce("notification_mode", F.lit("normal")).alias("notification_mode"),
    )


def route_notifications(
    events: DataFrame,
    statuses: DataFrame,
    subscribers: DataFrame,
    special: Sequence[str] = ("escalated", "blocked"),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One message per transition event and subscriber; terminal states are suppressed.

    ``events(item, from_state, to_state)``, ``subscribers(item, email)``; columns of the
    event named in ``keep`` are passed on.
    """
    groups = statuses.select(F.col("name").alias("to_state"), "grp")
    kept = events.join(groups, "to_state", "left").filter(
        F.coalesce(F.col("grp") != "terminal", F.lit(True))
    )
    change = F.concat(F.col("from_state"), F.lit(" -> "), F.col("to_state"))
    text = F.when(
        F.col("grp").isin(*special),
        F.concat(F.initcap("grp"), F.lit(" notification to "), F.col("email"), F.lit(": "), change),
    ).otherwise(F.concat(F.lit("Notification to "), F.col("email"), F.lit(": "), change))
    return kept.join(subscribers, "item").select(*keep, "item", "email", text.alias("message"))


# -- validation before commit --------------------------------------------------


def validate_priorities(
    rows: DataFrame, statuses: DataFrame, roles: Sequence[str] = ROLES
) -> DataFrame:
    """Reject rows: escalation without target, empty target group, unknown role."""
    targets = used_groups(statuses).withColumnRenamed("grp", "escalates_to")
    escalating = rows.filter(F.col("auto_escalate"))
    aimless = escalating.filter(F.col("escalates_to").isNull())
    empty = escalating.filter(F.col("escalates_to").isNotNull()).join(
        targets, "escalates_to", "left_anti"
    )
    known = ("any", *roles)
    stranger = rows.filter(F.col("required_role").isNotNull() & ~F.col("required_role").isin(*known))

    def reject(df: DataFrame, reason: str) -> DataFrame:
        return df.select("name", F.lit(reason).alias("reason"))

    return (
        reject(aimless, "escalation without target")
        .unionByName(reject(empty, "target group is empty"))
        .unionByName(reject(stranger, "unknown role"))
    )


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """A plain listing; rows with a missing part are dropped."""
    return df.select(*columns).dropna()


# -- module checks -------------------------------------------------------------

# Name hints of lifecycle variables, in the order they are tried.
LIFECYCLE_HINTS = (
    ("active", "active"),
    ("terminal", "terminal"),
    ("status", "status"),
    ("state", "status"),
    ("transition", "transitions"),
    ("valid_transition", "transitions"),
    ("workflow", "transitions"),
)
SHORT_VALUE = 40


def lifecycle_class(name: Column, values: Column, form: Column) -> Column:
    """Lifecycle role of a variable from its name, its string values and its body form.

    ``values`` is the list of the literals in the variable's body: as long as one source
    file at most.
    """
    hinted = F.lit(None).cast("string")
    for hint, role in reversed(LIFECYCLE_HINTS):
        hinted = F.when(F.lower(name).contains(hint), role).otherwise(hinted)
    short = (F.size(values) > 0) & F.forall(values, lambda v: F.length(v) < SHORT_VALUE)
    by_size = F.when(F.size(values) >= 2, "status")
    return F.when((form == "dict") & (F.size(values) > 0), "transitions").when(
        short, F.coalesce(hinted, by_size)
    )


def unmet_needs(intents: DataFrame) -> DataFrame:
    """Declared needs that no module provides; ``intents(module, kind, name)`` with kind
    ``depends-on`` or ``provides``."""
    provided = intents.filter(F.col("kind") == "provides").select("name").distinct()
    needs = intents.filter(F.col("kind") == "depends-on").select("module", "name").distinct()
    return needs.join(provided, "name", "left_anti").select("module", "name")


def evidence_obligations(facts: DataFrame, rules: Sequence[tuple[str, str, Sequence[str], Sequence[str]]]):
    """Modules whose text touches a topic without the evidence the topic requires.

    ``facts(module, fact)`` holds lower-cased names, imports and literals of a module.
    Each rule is ``(domain, severity, keywords, required)``: a fact containing a keyword
    demands a fact containing one of the required words.  All rules are tested in one
    aggregate per module.
    """
    fact = F.col("fact")

    def any_of(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | fact.contains(word)
        return F.max(found)

    tests = []
    for i, (_, _, keywords, required) in enumerate(rules):
        tests.append(any_of(keywords).alias(f"_k{i}"))
        tests.append(any_of(required).alias(f"_r{i}"))
    flags = facts.groupBy("module").agg(*tests)
    failed = F.array(
        *[
            F.when(
                F.col(f"_k{i}") & ~F.col(f"_r{i}"),
                F.struct(F.lit(domain).alias("domain"), F.lit(severity).alias("severity")),
            )
            for i, (domain, severity, _, _) in enumerate(rules)
        ]
    )
    return flags.select(
        "module", F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("o")
    ).select("module", "o.domain", "o.severity")


def hardcoded(literals: DataFrame, known: DataFrame) -> DataFrame:
    """Literals of each module that are known status values: ``(module, literal)``."""
    return (
        literals.select("module", "literal")
        .distinct()
        .join(known.select(F.col("name").alias("literal")).distinct(), "literal", "left_semi")
        .select("module", "literal")
    )
