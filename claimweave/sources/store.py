"""A claim graph as Parquet, changed only by atomic batches.

Layout under one root folder::

    claims/folder=<f>/p=<predicate>/...   claims, sorted by l inside a predicate
    values|txs|rules/folder=<f>/...       interned literals, transactions, rule catalogue
    log/after=<v>/...                     one row per entry since checkpoint v, written last
    checkpoint/upto=<v>/folders, batches  the log folded up to version v

Every attempt to write a batch has a folder of its own, and the batch counts from the moment
its log entry names that folder.  An entry is one row in one file, which appears by a single
rename; so a second attempt that fails leaves the first one whole, and one that succeeds takes
its place.  Entries are numbered: a reader sees the graph of one version, and later versions
never change the files of an earlier one.

After ``TAIL`` entries the log is folded.  Folders of like size are merged once there are
``MERGE`` of them, so their number grows with the logarithm of the claims, and the state is
written as a checkpoint.  Reading needs one checkpoint and at most ``TAIL`` entries, whatever
the number of batches.  There may be any number of readers, and one writer at a time.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.functions.ids import is_long_value
from claimweave.graph import CLAIMS, RULES, TXS, VALUES, ClaimGraph, values_in
from claimweave.workspace import child_names, empty_frame, shuffles_freed

TAIL = 32
MERGE = 16
# Replaced batches a merged folder may hide before it is rewritten.
MOST_HIDDEN = 200
_ENTRY = "version bigint, kind string, batch string, folder string, n_claims bigint, max_seq bigint, rules boolean, replaces string, covers array<string>"
_FOLDERS = "folder string, n_claims bigint, n_batches bigint, rules boolean, hidden array<string>"
_BATCHES = "batch string, version bigint, folder string, max_seq bigint"


@dataclass(frozen=True)
class Folder:
    name: str
    n_claims: int
    n_batches: int
    rules: bool
    hidden: tuple[str, ...] = ()


@dataclass
class Manifest:
    """The folders of one version, and what happened to batches since the checkpoint."""

    version: int = 0
    checkpoint: int = 0
    folders: dict[str, Folder] = field(default_factory=dict)
    recent: dict[str, tuple[int, str, int]] = field(default_factory=dict)
    moved: dict[str, str] = field(default_factory=dict)
    n_tail: int = 0

    def take(self, e) -> None:
        self.version, self.n_tail = e["version"], self.n_tail + 1
        n_batches = 1
        if e["kind"] == "merge":
            n_batches = sum(self.folders[f].n_batches - len(self.folders[f].hidden) for f in e["covers"])
            for f in e["covers"]:
                del self.folders[f]
                self.moved[f] = e["folder"]
            for batch, (version, folder, seq) in self.recent.items():
                if folder in e["covers"]:
                    self.recent[batch] = (version, e["folder"], seq)
        else:
            old = self.folders.get(e["replaces"])
            if old is not None and old.n_batches == 1:
                del self.folders[old.name]
            elif old is not None:
                self.folders[old.name] = replace(old, hidden=(*old.hidden, e["batch"]))
            self.recent[e["batch"]] = (e["version"], e["folder"], e["max_seq"])
        self.folders[e["folder"]] = Folder(e["folder"], e["n_claims"], n_batches, e["rules"])

    def now_in(self, folder: str) -> str:
        """Where the rows of a folder of the checkpoint are by now."""
        while folder in self.moved:
            folder = self.moved[folder]
        return folder


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- writing ---------------------------------------------------------------

    def commit(
        self,
        batch: str,
        claims: DataFrame,
        values: DataFrame | None = None,
        txs: DataFrame | None = None,
        rules: DataFrame | None = None,
        validate: DataFrame | None = None,
    ) -> int:
        """Write one batch; all of it becomes visible at once or not at all.

        A batch id that is visible already is replaced as a whole.  ``validate`` is a frame of
        violations: a single row of it aborts the batch.  Returns the highest sequence number
        of the batch.
        """
        if validate is not None:
            broken = validate.limit(1).collect()
            if broken:
                raise ValueError(f"batch {batch} rejected: {broken[0].asDict()}")
        now = self.manifest()
        folder = f"{now.version + 1:012d}-{uuid.uuid4().hex}"
        stamp = F.lit(batch).alias("batch")
        n_claims, n_long = self._write_claims(claims.withColumn("batch", stamp), folder)
        written = self._read([folder], "claims", CLAIMS)
        new_values = values
        if values is None:
            carried = [values_in(claims.filter(is_long_value(F.col("r"))))] if n_long and "lit" in claims.columns else []
            new_values = functools.reduce(DataFrame.unionByName, carried, values_in(written)).distinct()
        self._write(new_values.select("vid", "lit_type", "lit", stamp), "values", folder)
        if n_long:
            self._refuse_without_text(written, folder, now, batch)
        if txs is None:
            txs = (
                written.select("tx_id", F.col("tx_seq").alias("seq"))
                .distinct()
                .withColumn("agent", F.lit(None).cast("string"))
            )
        seen = Observation()
        self._write(txs.select("tx_id", "seq", "agent", stamp).observe(seen, F.max("seq").alias("seq")), "txs", folder)
        if rules is not None:
            # rules that are text only have no atoms
            fields = [F.col(f.name) if f.name in rules.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RULES)]
            self._write(rules.select(*fields, stamp), "rules", folder)
        max_seq = int(seen.get["seq"] or 0)
        self._enter(now, kind="add", batch=batch, folder=folder, n_claims=n_claims, max_seq=max_seq, rules=rules is not None, replaces=self.folder_of(batch, now), covers=[])
        if now.n_tail >= TAIL:
            self._fold(now)
        return max_seq

    def _refuse_without_text(self, written: DataFrame, folder: str, now: Manifest, batch: str) -> None:
        """A long literal is known by its digest only; its text must be somewhere in the store."""
        long = F.col("vid").rlike(r"^v:[a-z]#")
        asked = written.select(F.explode(F.array("l", "r")).alias("vid")).filter(long).distinct()
        known = self._read([*now.folders, folder], "values", VALUES).filter(long & F.col("lit").isNotNull())
        lost = asked.join(known, "vid", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"batch {batch} rejected: no text for {lost[0]['vid']}; give claims a column lit, or values")

    def _write_claims(self, claims: DataFrame, folder: str) -> tuple[int, int]:
        # Ranges over (p, l): a predicate with a large part of all claims is spread over
        # many files, and each file covers a narrow range of l.
        seen = Observation()
        sorted_claims = (
            claims.select("cid", "l", "r", "tx_id", "tx_seq", "ord", "batch", "p")
            .repartitionByRange("p", "l")
            .sortWithinPartitions("p", "l")
            # last, since a batch without claims leaves no stage below the exchange to count in
            .observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(is_long_value(F.col("r")) | is_long_value(F.col("l"))).alias("long"))
        )
        with shuffles_freed(self.spark):
            sorted_claims.write.partitionBy("p").parquet(f"{self.root}/claims/folder={folder}")
        return int(seen.get["n"]), int(seen.get["long"])

    def _write(self, df: DataFrame, table: str, folder: str) -> None:
        with shuffles_freed(self.spark):
            df.write.parquet(f"{self.root}/{table}/folder={folder}")

    def _enter(self, now: Manifest, **entry) -> None:
        """The moment a change becomes visible: one row, one file, one rename."""
        entry = {"version": now.version + 1, **entry}
        schema = StructType.fromDDL(_ENTRY)
        values = [F.lit(entry[f.name]) if f.name != "covers" else F.array(*map(F.lit, entry["covers"])) for f in schema]
        row = self.spark.range(0, 1, 1, 1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, schema)])
        row.write.mode("append").parquet(f"{self.root}/log/after={now.checkpoint}")
        now.take(entry)

    # -- upkeep ----------------------------------------------------------------

    def _fold(self, now: Manifest) -> None:
        """Merge folders of like size and write the state as a checkpoint."""
        while True:
            tiers: dict[int, list[Folder]] = {}
            for f in now.folders.values():
                tiers.setdefault(int(math.log(max(f.n_claims, 1), MERGE) + 1e-9), []).append(f)
            group = next((g for g in tiers.values() if len(g) >= MERGE), None)
            group = group or next(([f] for f in now.folders.values() if len(f.hidden) > MOST_HIDDEN), None)
            if group is None:
                break
            self._merge(now, group)
        self._checkpoint(now)

    def _merge(self, now: Manifest, group: list[Folder]) -> None:
        folder = f"{now.version + 1:012d}-{uuid.uuid4().hex}"
        n_claims, _ = self._write_claims(self._rows(group, "claims", CLAIMS), folder)
        for table, schema in (("values", VALUES), ("txs", TXS)):
            self._write(self._rows(group, table, schema).distinct(), table, folder)
        rules = [f for f in group if f.rules]
        if rules:
            self._write(self._rows(rules, "rules", RULES), "rules", folder)
        self._enter(now, kind="merge", batch=None, folder=folder, n_claims=n_claims, max_seq=0, rules=bool(rules), replaces=None, covers=[f.name for f in group])

    def _checkpoint(self, now: Manifest) -> None:
        path = f"{self.root}/checkpoint/upto={now.version}"
        self._batches(now).write.parquet(f"{path}/batches")
        rows = [(f.name, f.n_claims, f.n_batches, f.rules, list(f.hidden)) for f in now.folders.values()]
        # written last: a checkpoint counts once its folders are there
        self.spark.createDataFrame(rows, _FOLDERS).coalesce(1).write.parquet(f"{path}/folders")

    def compact(self, batch: str, into: "GraphStore") -> None:
        """Merge all committed batches into one batch of another root."""
        graph = self.graph()
        into.commit(batch, graph.claims, graph.values.distinct(), graph.txs, graph.rules)

    # -- the manifest ------------------------------------------------------------

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest state, or that of an earlier version."""
        now = Manifest()
        made = sorted((int(n.split("=")[1]) for n in child_names(self.spark, f"{self.root}/checkpoint")), reverse=True)
        for v in made:
            path = f"{self.root}/checkpoint/upto={v}/folders"
            if (version is None or v <= version) and "_SUCCESS" in child_names(self.spark, path):
                rows = self.spark.read.schema(_FOLDERS).parquet(path).collect()  # grows with the logarithm of the claims
                folders = {r[0]: Folder(r[0], r[1], r[2], r[3], tuple(r[4])) for r in rows}
                now = Manifest(version=v, checkpoint=v, folders=folders)
                break
        log = f"{self.root}/log/after={now.checkpoint}"
        if any(n.endswith(".parquet") for n in child_names(self.spark, log)):
            entries = self.spark.read.schema(_ENTRY).parquet(log)
            if version is not None:
                entries = entries.filter(F.col("version") <= version)
            for e in sorted(entries.collect(), key=lambda e: e["version"]):
                now.take(e)
        return now

    def _known(self, now: Manifest) -> DataFrame:
        """The batches of the checkpoint, as they were then."""
        if now.checkpoint == 0:
            return empty_frame(self.spark, StructType.fromDDL(_BATCHES))
        return self.spark.read.schema(_BATCHES).parquet(f"{self.root}/checkpoint/upto={now.checkpoint}/batches")

    def _batches(self, now: Manifest) -> DataFrame:
        """(batch, version, folder, max_seq) of every visible batch."""
        recent = self.spark.createDataFrame([(b, *x) for b, x in now.recent.items()], _BATCHES)
        old = self._known(now).join(F.broadcast(recent.select("batch")), "batch", "left_anti")
        if now.moved:
            moves = self.spark.createDataFrame([(f, now.now_in(f)) for f in now.moved], "folder string, _now string")
            old = old.join(F.broadcast(moves), "folder", "left").withColumn("folder", F.coalesce("_now", "folder")).drop("_now")
        return old.select(*recent.columns).unionByName(recent)

    def folder_of(self, batch: str, now: Manifest | None = None) -> str | None:
        """The folder of a visible batch; None for another one."""
        now = now or self.manifest()
        if batch in now.recent:
            return now.recent[batch][1]
        rows = self._known(now).filter(F.col("batch") == batch).select("folder").collect() if now.checkpoint else []
        return now.now_in(rows[0][0]) if rows else None

    def latest_seq(self, but: str) -> int:
        """Highest sequence number of the batches whose ids do not start with ``but``."""
        rows = self._batches(self.manifest()).filter(~F.col("batch").startswith(but))
        return int(rows.agg(F.coalesce(F.max("max_seq"), F.lit(0)).alias("n")).first()["n"])

    # -- reading ---------------------------------------------------------------

    def _read(self, folders: Iterable[str], table: str, schema: str) -> DataFrame:
        # only the folders of one version are listed, however many others there are
        paths = [f"{self.root}/{table}/folder={f}" for f in folders]
        if not paths:
            return empty_frame(self.spark, StructType.fromDDL(f"{schema}, batch string"))
        reader = self.spark.read.schema(f"{schema}, batch string, folder string").option("basePath", f"{self.root}/{table}")
        return reader.parquet(*paths)

    def _rows(self, folders: Iterable[Folder], table: str, schema: str) -> DataFrame:
        """Rows with their batch, without those of batches that were written again since."""
        folders = list(folders)
        rows = self._read([f.name for f in folders], table, schema)
        for f in folders:
            if f.hidden:
                rows = rows.filter((F.col("folder") != f.name) | ~F.col("batch").isin(*f.hidden))
        return rows.drop("folder")

    def graph(self, upto: int | None = None, version: int | None = None) -> ClaimGraph:
        """The committed graph; ``upto`` fixes the last visible sequence number.

        ``version`` reads an earlier state of the store, whatever was written since.
        """
        folders = list(self.manifest(version).folders.values())
        claims = self._rows(folders, "claims", CLAIMS).drop("batch")
        txs = self._rows(folders, "txs", TXS).drop("batch")
        if upto is not None:
            claims = claims.filter(F.col("tx_seq") <= upto)
            txs = txs.filter(F.col("seq") <= upto)
        rules = self._rows([f for f in folders if f.rules], "rules", RULES).drop("batch")
        return ClaimGraph(claims, self._rows(folders, "values", VALUES).drop("batch"), txs, rules)


def write_projection(tables: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """Write each projected table into its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(format).save(f"{folder}/{name}")
