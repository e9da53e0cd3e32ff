"""Texts of long literals stay with their claims, and a digest without its text is refused."""

import hashlib

import pytest
from graphs import claims, graph, lit, requests, rows, tx_rows
from pyspark.sql import functions as F

from claimweave import ClaimGraph
from claimweave.functions import ids
from claimweave.operators import mutate
from claimweave.sources.store import GraphStore
from claimweave.workspace import Workspace

LONG = ["x" * 65, "é" * 300, "a\tb" * 5_000]


def texts(g, p="name"):
    found = g.ground(g.claims_where(p=p).select("l", "r"), "r", "text")
    return {(r.l, r.text) for r in found.collect()}


def named(spark, names, start):
    df = requests(spark, [(f"n{i}", "name", t, start + i) for i, t in enumerate(names)], "l string, p string, t string, ord bigint")
    value = ids.value_id("s", F.col("t"))
    return df.select("l", "p", value.alias("r"), "ord", ids.long_text(value, F.col("t")).alias("lit"))


def test_with_claims_and_every_change_keep_the_text(spark):
    start = graph(spark, [("n0", "name", lit("short"))])
    g = start.with_claims(mutate.assert_claims(named(spark, LONG, 10), 2), tx_rows(spark, ("t:2", 2, None)))
    assert texts(g) == {("n0", "short"), *((f"n{i}", t) for i, t in enumerate(LONG))}
    again = requests(spark, [("n1", "y" * 99, 50)], "l string, name string, ord bigint")
    more = mutate.rename(g, again, 3)
    assert ("n1", "y" * 99) in texts(g.with_claims(more))
    assert "lit" not in g.claims.columns
    replaced = named(spark, ["z" * 70], 90).withColumn("old_cid", F.lit("c:1"))
    assert ("n0", "z" * 70) in texts(g.with_claims(mutate.supersede(replaced, 4)))
    assert ("n0", "q" * 70) in texts(g.with_claims(mutate.update(g, named(spark, ["q" * 70], 95), 5)))


def test_commit_keeps_texts_and_refuses_a_digest_without_one(spark):
    store = GraphStore(spark, Workspace(spark).path("store"))
    store.commit("one", mutate.assert_claims(named(spark, LONG, 10), 1))
    assert {t for _, t in texts(store.graph())} == set(LONG)
    bare = claims(spark, [("n9", "name", lit("w" * 80))], seq=2, start=70)
    with pytest.raises(ValueError, match="no text for v:s#" + hashlib.sha256(b"w" * 80).hexdigest()):
        store.commit("two", bare)
    assert store.graph().claims.count() == len(LONG)
    # the text is known already, or given as a value
    store.commit("two", claims(spark, [("n9", "name", lit(LONG[0]))], seq=2, start=70))
    given = spark.createDataFrame([("w" * 80,)], "t string").select(ids.value_id("s", F.col("t")).alias("vid"), F.lit("s").alias("lit_type"), F.col("t").alias("lit"))
    store.commit("three", bare, values=given)
    assert {("n9", LONG[0]), ("n9", "w" * 80)} <= texts(store.graph())


def test_a_graph_of_claims_takes_its_texts(spark):
    g = ClaimGraph(mutate.assert_claims(named(spark, LONG, 10), 1))
    assert {t for _, t in texts(g)} == set(LONG)
    assert len(rows(g.values, "lit")) == len(LONG)
