"""Moves of entities between states, each depending on the ones before it, to the end.

A request for a target is a function of the state it meets: the target where the model
allows the move, the state itself elsewhere.  Such functions compose, and a composition is
again a small array, one end state for each start state.  So the requests are range-sorted
once, runs of ``RUN`` requests of an entity become one function each, runs of runs become one
function, and so on until no entity has more than ``RUN`` of them; then the states are handed
down again.  The rounds grow with the logarithm of the longest entity, no task holds more
than ``RUN`` requests of an entity at a time, and an entity with most of all requests is
spread over many tasks.

Defined cases: requests of equal ``ord`` are tried in the order of their targets, a null
``ord`` first; repeated requests are tried once each; an entity without a state, or in one the
model does not know, stays as it is and every request of it is refused, as is a null target;
requests of a null entity are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators import checks
from claimweave.workspace import Workspace

RUN_BITS = 8
RUN = 1 << RUN_BITS
# A function is an array with one end state for each state of the model, and the model is an
# array in the plan; with more states than this the requests are tried round by round.
STATES = 64


def move_to_the_end(
    states: DataFrame, requests: DataFrame, transitions: DataFrame, work: Workspace, most_states: int = STATES
) -> tuple[DataFrame, DataFrame]:
    """Final ``(entity, state)`` and an outcome per request: entity, ord, state, target, allowed.

    ``states(entity, state)`` with one row per entity, ``requests(entity, target, ord)``,
    ``transitions(from_name, to_name)``.  The state of an outcome is the one its request met.
    """
    pairs = transitions.select("from_name", "to_name").filter("from_name IS NOT NULL AND to_name IS NOT NULL").distinct()
    names = pairs.select(F.explode(F.array("from_name", "to_name")).alias("name")).distinct()
    known = [r.name for r in names.orderBy("name").limit(most_states + 1).collect()]
    if len(known) > most_states:
        return _round_by_round(states, requests, transitions, work)
    allowed = {(r.from_name, r.to_name) for r in pairs.collect()}  # at most STATES squared
    model = _Model(known, allowed)
    # a request's place in the sort: its task in the upper bits, its row in the lower ones
    coded = requests.select("entity", "ord", "target", model.code(F.col("target")).alias("t"))
    placed = coded.orderBy("entity", "ord", "target").withColumn("at", F.monotonically_increasing_id())
    rows = work.save(placed, "requests").df()
    levels = [work.save(model.folded(_runs(rows, "at", F.struct("at", "t"), "entity"), lambda x: x["t"]), "runs")]
    while levels[-1].rows and _longest(levels[-1].df()) > RUN:
        above = _runs(levels[-1].df(), "run", F.struct("run", "ends"), "entity")
        levels.append(work.save(model.chained(above), "runs"))
    first = states.select("entity", F.col("state").alias("_name"), model.code(F.col("state")).alias("start"))
    top = (
        levels[-1].df().groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("run", "ends"))).alias("items"))
        .join(first, "entity", "left")
    )
    starts = work.save(model.started(top), "starts").df()
    for level in reversed(levels[:-1]):
        up = _runs(level.df(), "run", F.struct("run", "ends"), "entity")
        starts = work.save(model.started(_with_start(up, starts)), "starts").df()
    tried = _runs(rows, "at", F.struct("at", "t", "ord", "target"), "entity")
    outcomes = work.save(model.outcomes(_with_start(tried, starts)), "outcomes").df()
    # what the model does not know keeps its own name
    met = outcomes.join(states.select("entity", F.col("state").alias("_name")), "entity", "left")
    outcomes = met.select("entity", "ord", F.coalesce(model.name(F.col("s")), "_name").alias("state"), "target", "allowed")
    ends = work.save(model.ended(top), "ends").df()
    after = states.join(ends, "entity", "left").select("entity", F.coalesce(model.name(F.col("s")), "state").alias("state"))
    return after, outcomes


def _runs(rows: DataFrame, number: str, item: Column, entity: str) -> DataFrame:
    """(entity, run, items): up to ``RUN`` consecutive rows of an entity in their order."""
    run = F.shiftright(number, RUN_BITS).alias("run")
    return rows.groupBy(entity, run).agg(F.sort_array(F.collect_list(item)).alias("items"))


def _with_start(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """``runs`` with the state that each one meets."""
    mine = starts.select(F.col("entity").alias("_entity"), F.col("run").alias("_run"), "start")
    return runs.join(mine, F.col("entity").eqNullSafe(F.col("_entity")) & (F.col("run") == F.col("_run"))).drop("_entity", "_run")


def _longest(runs: DataFrame) -> int:
    sizes = runs.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).head()[0]


class _Model:
    """The states of a model as numbers, and its moves as expressions over them."""

    def __init__(self, names: list[str], allowed: set[tuple[str, str]]):
        self.names = names
        self.n = len(names)
        # never empty, so that the array has a type
        self.allowed = F.array(*[F.lit((a, b) in allowed) for a in names for b in names], F.lit(False))

    def code(self, name: Column) -> Column:
        if not self.names:
            return F.lit(None).cast("int")
        pairs = [F.lit(x) for i, n in enumerate(self.names) for x in (n, i)]
        return F.when(name.isNotNull(), F.try_element_at(F.create_map(*pairs), name)).cast("int")

    def name(self, code: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.names), F.lit(None).cast("string")), code)

    def may(self, state: Column, target: Column) -> Column:
        return F.coalesce(F.get(self.allowed, state * self.n + target), F.lit(False))

    def step(self, state: Column, target: Column) -> Column:
        return F.when(self.may(state, target), target).otherwise(state)

    def _all(self) -> Column:
        return F.array(*map(F.lit, range(self.n))).cast("array<int>")

    def folded(self, runs: DataFrame, target) -> DataFrame:
        """The function of each run of requests."""
        ends = F.transform(self._all(), lambda s: F.aggregate("items", s, lambda at, x: self.step(at, target(x))))
        return runs.select("entity", "run", ends.alias("ends"))

    def chained(self, runs: DataFrame) -> DataFrame:
        """The function of each run of functions."""
        ends = F.transform(self._all(), lambda s: F.aggregate("items", s, lambda at, x: F.get(x["ends"], at)))
        return runs.select("entity", "run", ends.alias("ends"))

    def _met(self, step) -> Column:
        """The states met by the items, first to last, and the one left by the last."""
        grow = lambda met, x: F.concat(met, F.array(step(F.element_at(met, -1), x)))
        return F.aggregate("items", F.array(F.col("start")), grow)

    def started(self, runs: DataFrame) -> DataFrame:
        """The state that each item, a run one level below, meets."""
        met = runs.withColumn("met", self._met(lambda at, x: F.get(x["ends"], at)))
        each = F.transform("items", lambda x, i: F.struct(x["run"].alias("run"), F.get(F.col("met"), i).alias("start")))
        return met.select("entity", F.explode(each).alias("x")).select("entity", "x.run", "x.start")

    def ended(self, runs: DataFrame) -> DataFrame:
        """The state that each entity is in at last."""
        end = F.aggregate("items", F.col("start"), lambda at, x: F.get(x["ends"], at))
        return runs.select("entity", end.alias("s"))

    def outcomes(self, runs: DataFrame) -> DataFrame:
        met = runs.withColumn("met", self._met(lambda at, x: self.step(at, x["t"])))
        each = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.get(F.col("met"), i).alias("s")))
        rows = met.select("entity", F.explode(each).alias("e")).select("entity", "e.x.*", "e.s")
        return rows.select("entity", "ord", "s", "target", self.may(F.col("s"), F.col("t")).alias("allowed"))


def _round_by_round(states: DataFrame, requests: DataFrame, transitions: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """One written round for each request of the longest entity."""
    numbered = requests.select("entity", "target", "ord").orderBy("entity", "ord", "target")
    left = work.save(numbered.withColumn("_at", F.monotonically_increasing_id()), "requests")
    outcomes = None
    while left.rows:
        queue = left.df().select("entity", "target", F.col("_at").alias("ord"))
        after, outcome, later = checks.apply_moves(states, queue.filter("entity IS NOT NULL"), transitions)
        if outcomes is None:
            nobody = queue.filter("entity IS NULL").select("entity", "ord", F.lit(None).cast("string").alias("state"), "target", F.lit(False).alias("allowed"))
            outcome = outcome.unionByName(nobody)
            given = left.df().select(F.col("_at").alias("_ord"), F.col("ord").alias("_given"))
        done = work.save(outcome, "outcomes")
        outcomes = done if outcomes is None else outcomes.plus(done)
        states = work.save(after, "states").df()
        left = work.save(later.withColumnRenamed("ord", "_at"), "requests")
    if outcomes is None:
        return states, requests.select("entity", "ord", F.lit(None).cast("string").alias("state"), "target", F.lit(False).alias("allowed"))
    tried = outcomes.df().join(given, F.col("ord") == F.col("_ord"))
    return states, tried.select("entity", F.col("_given").alias("ord"), "state", "target", "allowed")
