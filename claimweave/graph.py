"""The claim graph: kernel tables, pattern scans and the base relations of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.functions import ids
from claimweave.functions.skew import spread
from claimweave.rules import constant_id
from claimweave.workspace import empty_frame

CLAIMS = "cid string, l string, p string, r string, tx_id string, tx_seq bigint, ord bigint"
VALUES = "vid string, lit_type string, lit string"
TXS = "tx_id string, seq bigint, agent string"
# An atom as data: kinds of arguments are var, ref and the literal types.
ATOM = "struct<rel: string, args: array<struct<kind: string, text: string>>>"
RULES = f"rule_id string, head_rel string, source string, live boolean, replaced_by string, head {ATOM}, body array<{ATOM}>"

SUPERSEDES = "supersedes"

# Columns of every base relation, in argument order.
BASE_RELATIONS = {
    "triple": ("l", "p", "r"),
    "claim": ("cid", "l", "p", "r"),
    "current-triple": ("l", "p", "r"),
    "current-claim": ("cid", "l", "p", "r"),
    "value": ("vid", "lit"),
    "object": ("id",),
    "as-of-triple": ("seq", "l", "p", "r"),
    "as-of-claim": ("seq", "cid", "l", "p", "r"),
    "tx-info": ("tx_id", "seq"),
    "tx-claims-rel": ("tx_id", "cid"),
}


class ClaimGraph:
    """Claims, values, transactions and rules as four DataFrames.

    ``ord`` grows with insertion and is unique within ``(l, p)``; it decides which claim
    is newest.  Claims may carry the texts of long literals in one more column, ``lit``; they go
    to the values.  Nothing here runs a job: every method returns a lazy DataFrame.
    """

    def __init__(
        self,
        claims: DataFrame,
        values: DataFrame | None = None,
        txs: DataFrame | None = None,
        rules: DataFrame | None = None,
    ):
        spark = claims.sparkSession
        values = values if values is not None else values_in(claims)
        claims = claims.drop("lit")
        self.spark: SparkSession = spark
        self.claims = claims
        self.values = values
        self.txs = (
            txs
            if txs is not None
            else claims.select("tx_id", F.col("tx_seq").alias("seq"))
            .distinct()
            .withColumn("agent", F.lit(None).cast("string"))
        )
        self.rules = (
            rules if rules is not None else empty_frame(spark, StructType.fromDDL(RULES))
        )

    def with_claims(self, more: DataFrame, txs: DataFrame | None = None) -> "ClaimGraph":
        """The graph after appending ``more`` claims.

        Transactions known so far keep their agents; of ``more``, unknown ones are added.
        Lazy: for a chain of changes commit each one to a store and read the graph back,
        so that plans do not grow with the number of changes.
        """
        merged = self.claims.unionByName(more.drop("lit"))
        if txs is None:
            fresh = more.groupBy("tx_id").agg(F.min("tx_seq").alias("seq")).join(self.txs, "tx_id", "left_anti")
            txs = fresh.select("tx_id", "seq", F.lit(None).cast("string").alias("agent"))
        merged_txs = self.txs.unionByName(txs)
        new_values = self.values.unionByName(values_in(more)).distinct()
        return ClaimGraph(merged, new_values, merged_txs, self.rules)

    # -- pattern scans ---------------------------------------------------------

    def claims_where(
        self, l: str | None = None, p: str | None = None, r: object = None
    ) -> DataFrame:
        """Claims matching any subset of bound slots; only bound slots become filters."""
        return self.claims.filter(pattern(l, p, r))

    def claims_about(self, object_id: str) -> DataFrame:
        return self.claims.filter(F.col("l") == object_id).select("cid", "p", "r")

    def claims_targeting(self, object_id: str) -> DataFrame:
        return self.claims.filter(F.col("r") == object_id).select("cid", "p", "l")

    def hidden(self) -> DataFrame:
        """Ids of superseded claims.  One way: hiding the hiding claim revives nothing."""
        return self.claims.filter(F.col("p") == SUPERSEDES).select(F.col("r").alias("cid"))

    def current(
        self, l: str | None = None, p: str | None = None, r: object = None
    ) -> DataFrame:
        """Live claims.  The pattern is applied before the anti join."""
        return self.claims_where(l, p, r).join(self.hidden(), "cid", "left_anti")

    def flagged(self) -> DataFrame:
        """All claims with a ``superseded`` flag."""
        hidden = self.hidden().distinct().withColumn("superseded", F.lit(True))
        return self.claims.join(hidden, "cid", "left").withColumn(
            "superseded", F.coalesce("superseded", F.lit(False))
        )

    def get_claims(self, cids: DataFrame) -> DataFrame:
        """Claims with the given ids (column ``cid``)."""
        return self.claims.join(cids.select("cid").distinct(), "cid", "left_semi")

    def objects(self) -> DataFrame:
        """Every object with its kind: ``claim``, ``value`` or ``entity``."""
        tagged = self.claims.select(
            F.explode(
                F.array(
                    F.struct(F.col("cid").alias("id"), F.lit(2).alias("rank")),
                    F.struct(F.col("l").alias("id"), F.lit(0).alias("rank")),
                    F.struct(F.col("p").alias("id"), F.lit(0).alias("rank")),
                    F.struct(F.col("r").alias("id"), F.lit(0).alias("rank")),
                    F.struct(F.col("tx_id").alias("id"), F.lit(0).alias("rank")),
                )
            ).alias("o")
        ).select("o.*")
        values = self.values.select(F.col("vid").alias("id"), F.lit(1).alias("rank"))
        kind = F.when(F.col("rank") == 2, "claim").when(
            (F.col("rank") == 1) | ids.is_value(F.col("id")), "value"
        )
        return (
            tagged.unionByName(values)
            .groupBy("id")
            .agg(F.max("rank").alias("rank"))
            .select("id", kind.otherwise("entity").alias("kind"))
        )

    def check_objects(self, wanted: DataFrame) -> DataFrame:
        """For ids in column ``id``: does the object exist, is it a superseded claim."""
        known = self.objects().select("id", F.lit(True).alias("known"))
        hidden = self.hidden().distinct().select(F.col("cid").alias("id"), F.lit(True).alias("h"))
        return (
            wanted.select("id")
            .distinct()
            .join(known, "id", "left")
            .join(hidden, "id", "left")
            .select(
                "id",
                F.coalesce("known", F.lit(False)).alias("object_exists"),
                F.coalesce("h", F.lit(False)).alias("superseded"),
            )
        )

    def dangling(self) -> DataFrame:
        """Claim slots naming a claim or value that does not exist."""
        slots = self.claims.select(
            "cid",
            F.explode(
                F.array(
                    F.struct(F.lit("l").alias("slot"), F.col("l").alias("id")),
                    F.struct(F.lit("r").alias("slot"), F.col("r").alias("id")),
                )
            ).alias("s"),
        ).select("cid", "s.slot", "s.id")
        claim_slots = slots.filter(F.col("id").startswith("c:")).join(
            self.claims.select(F.col("cid").alias("id")), "id", "left_anti"
        )
        value_slots = slots.filter(ids.is_value(F.col("id"))).join(
            self.values.select(F.col("vid").alias("id")), "id", "left_anti"
        )
        return claim_slots.unionByName(value_slots).select("cid", "slot", "id")

    # -- values ----------------------------------------------------------------

    def ground(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the literal of ``column``; ids without a literal give NULL.

        Short literals are read from the id itself.  Only digested ids need the value
        table, and only rows holding such ids meet it in the join.
        """
        long_values = self.values.filter(ids.is_long_value(F.col("vid"))).select(
            F.col("vid").alias("_vid"), F.col("lit").alias("_vlit")
        )
        key = F.when(ids.is_long_value(F.col(column)), F.col(column)).otherwise(spread(df.columns))
        return (
            df.withColumn("_key", key)
            .join(long_values, F.col("_key") == F.col("_vid"), "left")
            .withColumn(out, F.coalesce(ids.short_literal(F.col(column)), F.col("_vlit")))
            .drop("_key", "_vid", "_vlit")
        )

    # -- time ------------------------------------------------------------------

    def as_of(
        self, seq: int, l: str | None = None, p: str | None = None, r: object = None
    ) -> DataFrame:
        """Claims visible at ``seq``: made by then and not hidden by then."""
        made = self.claims_where(l, p, r).filter(F.col("tx_seq") <= seq)
        hidden = self.claims.filter((F.col("p") == SUPERSEDES) & (F.col("tx_seq") <= seq)).select(
            F.col("r").alias("cid")
        )
        return made.join(hidden, "cid", "left_anti")

    def snapshot(self, seq: int) -> "ClaimGraph":
        """A read that later writes cannot change."""
        return ClaimGraph(
            self.claims.filter(F.col("tx_seq") <= seq),
            self.values,
            self.txs.filter(F.col("seq") <= seq),
            self.rules,
        )

    # -- base relations --------------------------------------------------------

    def relation(self, name: str, seq: int | None = None) -> DataFrame:
        """A base relation by name; the two as-of relations need a bound ``seq``."""
        columns = BASE_RELATIONS[name]
        if name in ("triple", "claim"):
            return self.claims.select(*columns)
        if name in ("current-triple", "current-claim"):
            return self.current().select(*columns)
        if name == "value":
            return self.values.select("vid", "lit").distinct()
        if name == "object":
            return self.objects().select("id")
        if name in ("as-of-triple", "as-of-claim"):
            if seq is None:
                raise ValueError(f"{name} needs a bound sequence number")
            return self.as_of(seq).withColumn("seq", F.lit(seq).cast("bigint")).select(*columns)
        if name == "tx-info":
            return self.txs.select("tx_id", "seq")
        return self.claims.select("tx_id", "cid")


def pattern(l: str | None, p: str | None, r: object) -> Column:
    condition = F.lit(True)
    if p is not None:
        condition = F.col("p") == p
    if l is not None:
        condition = condition & (F.col("l") == l)
    if r is not None:
        condition = condition & (F.col("r") == (r if isinstance(r, str) else constant_id(r)))
    return condition


def values_in(claims: DataFrame) -> DataFrame:
    """The value rows readable from short value ids in any slot, and the long ones carried as ``lit``."""
    slot = F.explode(F.array("l", "r")).alias("vid")
    short = (
        claims.select(slot)
        .filter(F.col("vid").rlike(r"^v:[a-z]:"))
        .distinct()
        .select(
            "vid",
            ids.short_literal_type(F.col("vid")).alias("lit_type"),
            ids.short_literal(F.col("vid")).alias("lit"),
        )
    )
    if "lit" not in claims.columns:
        return short
    long = claims.filter(ids.is_long_value(F.col("r")) & F.col("lit").isNotNull())
    return short.unionByName(long.select(F.col("r").alias("vid"), F.substring("r", 3, 1).alias("lit_type"), "lit").distinct())
