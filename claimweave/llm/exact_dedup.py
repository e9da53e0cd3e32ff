"""Exact duplicates by skew-safe combining [native].

Texts are equal when nothing but blanks (``[\\x20\\x09-\\x0D]``) tells them apart.  Copies are
combined in three steps, and each step groups by the digest *and* the whole normalised
text, so content is compared in full wherever rows meet:

1. locally: the partial aggregation of a task keeps one row per text it has read;
2. by salted digest: digests with a large share of all rows (``hot``) are dealt to ``SALTS``
   tasks by the partition they were read in, all others go to one task each;
3. globally: the winners of the salts of a hot digest are combined; there are at most
   ``SALTS`` of them for each of at most ``HOT_SHARE`` digests.

The first pass reads digests only and counts them, so a text crosses the network once per
task that holds it.  Rows find their group by digest; should two different texts have one
digest, the rows of that digest are told apart by the texts again.

Of equal texts the row with the most characters stays, then the one with the smallest
doc_id; a null doc_id comes after all others.  Defined cases: a null text is empty; texts
of blanks only are equal to it; repeated rows (equal doc_id, too) are one group in which
exactly one row stays; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, pick
from claimweave.workspace import Stored

SALTS = 32
# A digest is hot from this share of all rows on, and from HOT_ROWS rows on; so there are
# never more hot digests than HOT_SHARE, which bounds what is broadcast (40 bytes each).
HOT_SHARE = 1 << 16
HOT_ROWS = 64
BLANKS = r"[\x20\x09-\x0D]"
_WIDE = "decimal(38,0)"
_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(sha: Column) -> Column:
    """What rows are dealt and joined by: all of the SHA-256 digest of the text."""
    return sha


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number whose maximum is the row that stays: most characters, then smallest doc_id."""
    place = F.coalesce((_number(_LAST + 1) - doc_id.cast(_WIDE)).cast(_WIDE), _number(0))
    return ((n_chars.cast("decimal(12,0)") * F.lit(str(1 << 65)).cast("decimal(20,0)")).cast(_WIDE) + place).cast(_WIDE)


def _doc_id(rank: Column) -> Column:
    place = (rank % _number(1 << 65)).cast(_WIDE)
    return F.when(place > 0, (_number(_LAST + 1) - place).cast("bigint"))


def _texts(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("body"))
    return rows.withColumn("sha", F.unhex(F.sha2("body", 256))).withColumn("digest", digest(F.col("sha")))


def hot_digests(rows: DataFrame, n_rows: int) -> DataFrame:
    """Digests of more rows than one task should combine, HOT_SHARE at most."""
    least = max(HOT_ROWS, n_rows // HOT_SHARE + 1)
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("digest")


def combined(texts: DataFrame, hot: Stored, work: Workspace) -> Stored:
    """(digest, body, size, best): one row per text; body only where hot, null elsewhere."""
    marked = texts.join(F.broadcast(hot.df().withColumn("hot", F.lit(True))), "digest", "left")
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(-1))
    rows = marked.select("digest", "body", salt.alias("salt"), _rank(F.col("n"), F.col("doc_id")).alias("best"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.count(F.lit(1)).alias("size"), F.max("best").alias("best"))
    salted = work.save(salted.withColumn("body", F.when(F.col("salt") >= 0, F.col("body"))), "salted").df()
    cold = salted.filter("salt < 0").drop("salt")
    # hot digests only, at most SALTS rows for each of their texts
    whole = salted.filter("salt >= 0").groupBy("digest", "body").agg(F.sum("size").alias("size"), F.max("best").alias("best"))
    return work.save(cold.select("digest", "size", "best", F.lit(False).alias("hot")).unionByName(whole.select("digest", "size", "best", F.lit(True).alias("hot"))), "groups")


def _told_apart(docs: DataFrame, clash: DataFrame, work: Workspace) -> DataFrame:
    """The rows of digests that stand for several texts, with their groups, found by the texts."""
    rows = _texts(docs).withColumn("row", -1 - F.monotonically_increasing_id()).join(clash.select("digest"), "digest", "left_semi")
    rows = work.save(rows, "clashing").df()
    groups = rows.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("size"), F.max(_rank(F.col("n"), F.col("doc_id"))).alias("best"))
    groups = groups.select(F.col("digest").alias("_d"), F.col("body").alias("_b"), "size", "best")
    found = rows.join(groups, (F.col("digest") == F.col("_d")) & (F.col("body") == F.col("_b")))
    return found.select("row", "doc_id", "n", "sha", "size", "best")


def duplicate_groups(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    work = work or Workspace(docs.sparkSession)
    stored = work.save(_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "sha"), "digests")
    rows = stored.df().withColumn("digest", digest(F.col("sha")))
    hot = work.save(hot_digests(rows, stored.rows), "hot")
    groups = combined(_texts(docs), hot, work).df()
    clash = work.save(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("digest"), "clash")
    if clash.rows:
        groups = groups.join(clash.df(), "digest", "left_anti")
    # a hot digest meets its group by broadcast (the bound of ``hot``), any other by a shuffle
    flags = F.broadcast(groups.filter("hot").select("digest", "size", "best"))
    rest = rows.join(F.broadcast(hot.df()), "digest", "left_anti")
    columns = ["row", "doc_id", "n", "sha", "size", "best"]
    found = rows.join(flags, "digest").select(*columns)
    found = found.unionByName(rest.join(groups.filter("NOT hot").select("digest", "size", "best"), "digest").select(*columns))
    if clash.rows:
        found = found.unionByName(_told_apart(docs, clash.df(), work))
    found = work.save(found.withColumn("first", _rank(F.col("n"), F.col("doc_id")) == F.col("best")), "members").df()
    # rows that repeat the one that stays are told apart by their number
    alone, several = found.filter("size = 1"), found.filter("size > 1")
    winners = several.filter("first").groupBy("sha", "best").agg(F.min("row").alias("_row")).select("_row")
    several = several.join(winners, F.col("row") == F.col("_row"), "left").withColumn("kept", F.col("_row").isNotNull())
    both = alone.withColumn("kept", F.lit(True)).select(*columns, "kept").unionByName(several.select(*columns, "kept"))
    return both.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _doc_id(F.col("best")).alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    kept = duplicate_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    keys = [F.col("doc_id").alias("_id"), F.col("text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), *keys)
    rows = rows.select("_all", "_id", F.length(F.coalesce("text", F.lit(""))).alias("_n"), F.sha2(normalised(F.col("text")), 256).alias("_sha"))
    rows = rows.alias("a").join(kept.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._sha") == F.col("b._sha")), "left_semi")
    # rows that share doc_id and text: the longest of them, one only
    return rows.groupBy("_id", "_sha").agg(F.max_by("_all", "_n").alias("_all")).select("_all.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""
