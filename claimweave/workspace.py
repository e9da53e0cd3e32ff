"""Shared storage for the intermediate results of iterative jobs."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only for a local master with nothing set; on a
    cluster the written rounds must outlive any one executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="claimweave-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of whatever file system the path is in; none if it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def rounds(first: int, most: int | None) -> Iterable[int]:
    """Numbers of the rounds of a loop that ends by itself; ``most`` only where it is asked for."""
    return itertools.count(first) if most is None else range(first, first + most)


FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside gives its shuffle files back at its end."""
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


# Writer options of tables that are large beside what they come from.
DENSE = {"compression": "zstd"}


class Workspace:
    """Parquet tables written once per round of an iterative job.

    Writing a round cuts the lineage, survives lost executors, and leaves file sizes
    from which the optimizer picks broadcast or shuffle joins for the next round.  Like
    checkpoint files, the tables stay until the shared folder is cleaned, or until a job that
    is done with one calls ``drop``.  A ``tidy`` one keeps no shuffle files of written rounds, a ``dense`` one
    writes all its tables as ``DENSE``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tidy: bool = False, dense: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.dense = dense
        self.root = f"{(folder or shared_folder(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, label: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:05d}-{label}"

    def save(self, df: DataFrame, label: str, where: str | None = None, **options: str) -> "Stored":
        """Write ``df`` once and count its rows (those meeting ``where``) on the way; ``options`` of the writer."""
        path = self.path(label)
        seen = Observation()
        counted = F.count(F.lit(1)) if where is None else F.count_if(F.expr(where))
        with shuffles_freed(self.spark) if self.tidy else nullcontext():
            df.observe(seen, counted.alias("rows")).write.options(**(DENSE if self.dense else {}) | options).parquet(path)
        return Stored(self.spark, df.schema, [path], int(seen.get["rows"]))

    def drop(self, *stored: "Stored") -> None:
        """Delete tables that no frame still to be evaluated reads."""
        for path in (p for s in stored for p in s.paths):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def empty(self, schema: StructType) -> "Stored":
        return Stored(self.spark, schema, [], 0)


class Stored:
    """A relation kept as a list of written rounds; adding a round rewrites nothing."""

    def __init__(self, spark: SparkSession, schema: StructType, paths: Sequence[str], rows: int):
        self.spark = spark
        self.schema = schema
        self.paths = list(paths)
        self.rows = rows

    def plus(self, other: "Stored") -> "Stored":
        if other.rows == 0:
            return self
        return Stored(self.spark, self.schema, self.paths + other.paths, self.rows + other.rows)

    def df(self) -> DataFrame:
        if not self.paths:
            return empty_frame(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def empty_frame(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, with a size the optimizer knows."""
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


# Up to this many known rows an anti join is cheaper: the known side is then small enough
# for the optimizer to broadcast it, if its size on disk allows.
FEW_ROWS = 1_000_000


def unseen(candidates: DataFrame, known: Stored, few: int = FEW_ROWS) -> DataFrame:
    """The distinct candidates that ``known`` does not hold yet.

    With many known rows, one aggregate over both sides removes duplicates and known rows
    in a single shuffle without a sort; a distinct followed by an anti join would shuffle
    twice.
    """
    keys = candidates.columns
    if known.rows == 0:
        return candidates.distinct()
    seen = known.df().select(*keys)
    if known.rows <= few:
        return candidates.distinct().join(seen, keys, "left_anti")
    tagged = candidates.withColumn("_new", F.lit(True)).unionByName(
        seen.withColumn("_new", F.lit(False))
    )
    return tagged.groupBy(*keys).agg(F.min("_new").alias("_new")).filter("_new").drop("_new")
