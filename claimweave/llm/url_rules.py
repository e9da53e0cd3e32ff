"""URL filters by association rules [native].

Labelled addresses become token sets (host labels, name ending, first path parts); Spark's
FP-growth mines combinations that imply a verdict; rules are pruned by support and
confidence, and a rule whose part implies the same verdict at least as surely is dropped.
A rule is indexed under its rarest token only, so one equi join on tokens finds every rule
an address can fit; the rest of the combination is checked on the joined row.

Given host and path rules decide first and are the labels the method learns from.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no
rule and is allowed; the surest fitting combination decides, then the one with more
support, and ``block`` on a tie; with no labelled address, or none mined, the verdict is
``allow``; repeated rows are judged alike, each returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, pick, table

# Given rules: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
PATH_PARTS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for said, h, p in reversed(longest):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: each host label, the last label, the first parts of the path."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, PATH_PARTS)
    ending = F.filter(F.array(F.concat(F.lit("end:"), F.try_element_at(labels, F.lit(-1)))), lambda x: x.isNotNull())
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            ending,
            F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
        )
    )


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``key, rest, verdict, confidence, support`` mined from (tokens, verdict).

    Tokens below the support alone are cut before mining, so the trees hold few items; the
    number of rules is bounded by the support, not by the number of addresses.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    work = Workspace(spark)
    empty = "key string, rest array<string>, verdict string, confidence double, support double"
    base = work.save(labelled.select("tokens", "verdict"), "labelled")
    if base.rows == 0:
        return spark.createDataFrame([], empty)
    data = base.df()
    least = max(1, int(-(-base.rows * min_support // 1)))
    counts = data.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= least)
    frequent = work.save(counts, "frequent").df()  # at most tokens a url / support rows
    # equal token sets are mined once per row: FP-growth needs every transaction
    marked = data.withColumn("_row", F.monotonically_increasing_id())
    kept = (
        marked.select("_row", "verdict", F.explode("tokens").alias("token"))
        .join(frequent.select("token"), "token")
        .groupBy("_row", "verdict")
        .agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # tokens of one address
    )
    items = kept.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    items = work.save(items, "transactions")
    if items.rows == 0:
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items.df())
    found = model.associationRules.filter(
        F.startswith(F.element_at("consequent", 1), F.lit("="))
        & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("=")))
    ).select(
        F.sort_array("antecedent").alias("items"),
        F.substr(F.element_at("consequent", 1), F.lit(2)).alias("verdict"),
        "confidence",
        "support",
    )
    found = work.save(found, "rules").df().withColumn("_id", F.monotonically_increasing_id())
    # a combination adds nothing if one item less implies the same at least as surely
    shorter = found.select(
        "_id", "verdict", "confidence", F.explode("items").alias("_out"), F.col("items")
    ).select(
        "_id", "verdict", "confidence", F.array_except("items", F.array("_out")).alias("items")
    )
    general = found.select(F.col("items"), "verdict", F.col("confidence").alias("_c"))
    redundant = shorter.join(general, ["items", "verdict"]).filter(F.col("_c") >= F.col("confidence")).select("_id").distinct()
    pruned = found.join(redundant, "_id", "left_anti")
    rarest = (
        pruned.select("_id", "items", "verdict", "confidence", "support", F.explode("items").alias("token"))
        .join(frequent, "token")
        .groupBy("_id")
        .agg(F.min_by("token", F.struct("count", "token")).alias("key"))
    )
    rules = pruned.join(rarest, "_id").select("key", F.col("items").alias("rest"), "verdict", "confidence", "support")
    return work.save(rules, "pruned").df()


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    rows = pick(pages, "page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("given"))
    work = Workspace(pages.sparkSession)
    rows = work.save(rows.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))), "urls").df()
    mined = mined_rules(rows.filter("given IS NOT NULL").select("tokens", F.col("given").alias("verdict")), **mining)
    open_sets = rows.filter("given IS NULL").select("tokens").distinct()
    fits = (
        open_sets.withColumn("key", F.explode("tokens"))
        .join(mined, "key")
        .filter(F.size(F.array_except("rest", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max_by("verdict", F.struct("confidence", "support", "verdict")).alias("learned"))
    )
    return rows.join(fits, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", "learned", F.lit("allow")).alias("verdict")
    )


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"))
