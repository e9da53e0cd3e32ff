"""Moves to the end against trying them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import moves
from claimweave.workspace import Workspace

STATES = "entity string, state string"
REQUESTS = "entity string, target string, ord bigint"
MODEL = {("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")}


def in_turn(states, requests, allowed):
    """Plainly: one request after the other."""
    now, out = dict(states), []
    key = lambda q: (q[2] is not None, q[2] or 0, q[1] is not None, q[1] or "")
    for entity, target, at in sorted(requests, key=key):
        state = now.get(entity) if entity is not None else None
        ok = (state, target) in allowed
        out.append((entity, at, state, target, ok))
        if ok:
            now[entity] = target
    return now, out


def run(spark, states, requests, allowed, **options):
    after, outcomes = moves.move_to_the_end(
        spark.createDataFrame(states, STATES), spark.createDataFrame(requests, REQUESTS),
        spark.createDataFrame(sorted(allowed), "from_name string, to_name string"), Workspace(spark), **options,
    )
    return {r.entity: r.state for r in after.collect()}, sorted(map(tuple, outcomes.collect()), key=repr)


@pytest.mark.parametrize("most_states", [64, 2])
def test_against_one_by_one(spark, monkeypatch, most_states):
    monkeypatch.setattr(moves, "RUN_BITS", 2)
    monkeypatch.setattr(moves, "RUN", 4)
    rng = random.Random(11)
    names = ["a", "b", "c", "d", "unheard", None]
    states = [(f"e{i}", rng.choice(names)) for i in range(8)]
    lengths = [70, 17, 5, 1, 4, 3, 2, 0] if most_states == 64 else [9, 4, 3, 1, 2, 2, 1, 0]
    requests = [(f"e{i}", rng.choice(names), rng.randrange(40)) for i, n in enumerate(lengths) for _ in range(n)]
    requests += [("nowhere", "b", 1), (None, "b", 2), (None, "c", 2), ("e0", "a", None), ("e1", "b", 3), ("e1", "b", 3)]
    want, outcomes = in_turn(states, requests, MODEL)
    got, tried = run(spark, states, requests, MODEL, most_states=most_states)
    assert got == want
    assert tried == sorted(outcomes, key=repr)


def test_nothing_to_do(spark):
    assert run(spark, [("e", "a")], [], MODEL) == ({"e": "a"}, [])
    assert run(spark, [], [("e", "a", 1)], MODEL) == ({}, [("e", 1, None, "a", False)])
    assert run(spark, [("e", "a")], [("e", "b", 1)], set()) == ({"e": "a"}, [("e", 1, "a", "b", False)])


def test_one_entity_with_a_hundred_thousand_moves(spark):
    n = 100_000
    letter = F.element_at(F.array(*map(F.lit, "abc")), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int"))
    requests = spark.range(n, numPartitions=8).select(F.lit("hot").alias("entity"), letter.alias("target"), F.col("id").alias("ord"))
    allowed = spark.createDataFrame(sorted(MODEL), "from_name string, to_name string")
    work = Workspace(spark)
    after, outcomes = moves.move_to_the_end(spark.createDataFrame([("hot", "a")], STATES), requests, allowed, work)
    want, _ = in_turn([("hot", "a")], [tuple(r) for r in requests.collect()], MODEL)
    assert [tuple(r) for r in after.collect()] == [("hot", want["hot"])]
    assert outcomes.count() == n
    assert outcomes.filter("allowed").count() > n / 4
