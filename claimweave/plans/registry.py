"""The list of named analyses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimweave.graph import ClaimGraph
from claimweave.sources.store import GraphStore
from claimweave.workspace import Workspace

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Analysis:
    run: Run
    sql: str | None


ANALYSES: dict[str, Analysis] = {}


def analysis(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in ANALYSES:
            raise ValueError(f"{name} is registered twice")
        ANALYSES[name] = Analysis(run, sql)
        return run

    return add


_stored: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], object]):
    """Build a stored input once per application and folder: load once, query many times."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored_graph(spark: SparkSession, claims: DataFrame, label: str, **parts) -> ClaimGraph:
    """Write a graph in the store layout and read it back."""
    store = GraphStore(spark, Workspace(spark).path(label))
    store.commit("load", claims, **parts)
    return store.graph()
