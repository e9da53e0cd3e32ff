"""Structured Streaming over claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimweave.graph import CLAIMS
from claimweave.operators.fixpoint import RuleProgram
from claimweave.operators.views import Views
from claimweave.sources.store import GraphStore


def claim_stream(
    spark: SparkSession,
    folder: str,
    schema: str | StructType = CLAIMS,
    files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """A stream of claim rows (or of any rows to turn into claims) from Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


class ViewMaintainer:
    """Keeps the views of a rule program current from a stream of claims.

    One micro-batch is one transaction: it is committed to the store under the batch id
    and then applied as a change.  A batch that the store holds is a replay and is not
    committed again; should the views lack it, since applying it failed, they are made anew.
    ``base_seq`` must not lie below what was loaded otherwise, since sequence numbers would be
    given twice.  ``kind`` is the class of the views.
    """

    def __init__(self, store: GraphStore, program: RuleProgram, base_seq: int, kind: type = Views):
        self.store = store
        self.base_seq = base_seq
        loaded = store.latest_seq(but="stream-")
        if loaded > base_seq:
            raise ValueError(f"base_seq {base_seq} lies below sequence number {loaded} of the store")
        self.views = kind(program, store.graph()).materialize()

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        seq = self.base_seq + batch_id + 1
        name = f"stream-{batch_id}"
        if self.store.folder_of(name) is not None:
            if self.views.version is None or self.views.version < seq:
                self.views.graph = self.store.graph()
                self.views.materialize()
            return
        stamped = batch.withColumn("tx_seq", F.lit(seq).cast("bigint")).withColumn(
            "tx_id", F.lit(f"t:{seq}")
        )
        self.store.commit(name, stamped)
        after = self.store.graph()
        # The change is read back from the store, not computed a second time.
        more = after.claims.filter(F.col("tx_seq") == seq)
        self.views.apply(more, after=after)

    def start(self, claims: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        trigger = trigger or {"availableNow": True}
        return (
            claims.writeStream.foreachBatch(self.on_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


def newest_stream(claims: DataFrame) -> DataFrame:
    """Newest value per ``(l, p)``; a late claim with a smaller ``ord`` changes nothing.

    A built-in aggregate: batches are pre-combined before the state is touched, and the
    state holds one row per property.
    """
    return claims.groupBy("l", "p").agg(
        F.max_by("r", "ord").alias("r"), F.max("ord").alias("ord")
    )


def run_newest(claims: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each change of a newest value to ``folder``; read it with :func:`read_newest`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        newest_stream(claims)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_newest(spark: SparkSession, folder: str) -> DataFrame:
    changes = spark.read.schema("l string, p string, r string, ord bigint").parquet(folder)
    return newest_stream(changes)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stateless stream (such as tagged events) to Parquet."""
    return (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
