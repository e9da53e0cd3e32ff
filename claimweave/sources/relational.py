"""Relational tables as claims: one claim per non-null cell, one link per foreign key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.functions.ordered import SPAN, cut
from claimweave.functions.tables import rule_table


@dataclass(frozen=True)
class TableSpec:
    """How one table becomes claims.

    ``props`` maps a column to the predicate of a literal claim, ``links`` maps a column
    to ``(predicate, kind of the target)``.  ``order`` is an integer expression unique
    per row (the key itself by default); ``base`` keeps the ``ord`` ranges of several
    tables apart.
    """

    kind: str
    key: str
    props: dict[str, str] = field(default_factory=dict)
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    order: str | None = None
    base: int = 0


def _cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per non-null cell, in a single pass and without a shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    width = len(spec.props) + len(spec.links)
    cells: list[Column] = []
    for position, (column, predicate) in enumerate(spec.props.items()):
        text = F.col(column).cast("string")
        kind = ids.literal_type(types[column])
        cells.append(
            F.struct(
                F.lit(predicate).alias("p"),
                ids.value_id(kind, text).alias("r"),
                F.lit(kind).alias("lit_type"),
                text.alias("lit"),
                F.lit(position).alias("slot"),
            )
        )
    for position, (column, (predicate, kind)) in enumerate(spec.links.items(), len(spec.props)):
        cells.append(
            F.struct(
                F.lit(predicate).alias("p"),
                ids.entity_id(kind, column).alias("r"),
                F.lit(None).cast("string").alias("lit_type"),
                F.lit(None).cast("string").alias("lit"),
                F.lit(position).alias("slot"),
            )
        )
    key = F.col(spec.key).cast("string")
    order = F.expr(spec.order) if spec.order else F.col(spec.key).cast("bigint")
    return (
        df.select(
            ids.entity_id(spec.kind, key).alias("l"),
            key.alias("_key"),
            order.alias("_order"),
            F.explode(F.array(*cells)).alias("c"),
        )
        .filter(F.col("c.r").isNotNull())
        .select(
            F.concat(F.lit(f"c:{spec.kind}/"), "_key", F.lit("/"), F.col("c.p")).alias("cid"),
            "l",
            "c.p",
            "c.r",
            (F.lit(spec.base) + F.col("_order") * width + F.col("c.slot"))
            .cast("bigint")
            .alias("ord"),
            "c.lit_type",
            "c.lit",
        )
    )


def table_claims(
    df: DataFrame, spec: TableSpec, tx_seq: int | Column = 1
) -> DataFrame:
    """Claims of one table; ``tx_seq`` is a number for a bulk load."""
    seq = (F.lit(tx_seq) if isinstance(tx_seq, int) else tx_seq).cast("bigint")
    return _cells(df, spec).select(
        "cid", "l", "p", "r",
        F.concat(F.lit("t:"), seq.cast("string")).alias("tx_id"),
        seq.alias("tx_seq"),
        "ord",
        ids.long_text(F.col("r"), F.col("lit")).alias("lit"),
    )


def table_values(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The interned literals of one table, long ones included."""
    return (
        _cells(df, spec)
        .filter(F.col("lit").isNotNull())
        .select(F.col("r").alias("vid"), "lit_type", "lit")
        .distinct()
    )


def intern_column(df: DataFrame, column: str) -> DataFrame:
    """Value rows of one column of literals."""
    kind = ids.literal_type(df.schema[column].dataType)
    text = F.col(column).cast("string")
    return (
        df.filter(F.col(column).isNotNull())
        .select(
            ids.value_id(kind, text).alias("vid"), F.lit(kind).alias("lit_type"), text.alias("lit")
        )
        .distinct()
    )


def named_entities(
    df: DataFrame, kind: str, key: str, name: str, tx_seq: int = 1, base: int = 0
) -> DataFrame:
    """A ``symbol`` claim for each row: objects that can be found by name."""
    return table_claims(df, TableSpec(kind, key, {name: "symbol"}, base=base), tx_seq)


def predicate_vocabulary(spark: SparkSession, names: Sequence[str], tx_seq: int = 1) -> DataFrame:
    """A ``symbol`` claim for each predicate name."""
    rows = [(name, i) for i, name in enumerate(dict.fromkeys(names))]
    return rule_table(spark, ("name", "i"), rows).select(
        F.concat(F.lit("c:predicate/"), "name").alias("cid"),
        F.col("name").alias("l"),
        F.lit("symbol").alias("p"),
        ids.value_id("s", F.col("name")).alias("r"),
        F.lit(f"t:{tx_seq}").alias("tx_id"),
        F.lit(tx_seq).cast("bigint").alias("tx_seq"),
        (-1 - F.col("i")).cast("bigint").alias("ord"),
    )


def implicit_transactions(claims: DataFrame, order: str, base_seq: int = 0, span: int = SPAN) -> DataFrame:
    """Give each claim its own transaction, numbered by ``order`` after ``base_seq``.

    ``order`` is an integer column unique over the frame.  Ranks come from quantile ranges of it
    (see :mod:`claimweave.functions.ordered`), never from one global sort in one task.
    """
    ranges = cut(claims, [], order, span)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so some thousand at most.
    offsets = (
        ranges.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy("_range").orderBy(order)
    seq = (F.lit(base_seq) + F.col("_offset") + F.col("_local")).cast("bigint")
    return (
        ranges.withColumn("_local", F.row_number().over(local))
        .join(offsets, "_range")
        .select(
            "cid", "l", "p", "r",
            F.concat(F.lit("t:"), seq.cast("string")).alias("tx_id"),
            seq.alias("tx_seq"),
            "ord",
        )
    )
