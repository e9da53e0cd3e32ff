"""Secret scans with a random forest that removes false positives.

Candidates are the runs of at least 16 key-like characters with a digit, every one of a word.
Each has features of its length, its character transitions, how much of it known words cover,
where it stands (file name in the source) and the words before it.  A random forest is
trained from labelled findings and keeps what it takes for secrets.

Without a table of findings, ``rule_findings`` labels some: a quoted value assigned to a
name is a secret, plain numbers and words joined by hyphens are not; the rest stays open.
The forest is fitted on all labelled rows: equal ones are one row that weighs their number.

Defined cases: a null or empty text has no candidates; with no labelled finding of either
class every candidate is returned with a null score; repeated words of a text, and repeated
runs of a word, are each reported, by the place of the word; repeated rows are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, pick

RUN = r"[A-Za-z0-9+/=_-]{16,}"
NAMES = "(?i)(token|secret|passw|passwd|pwd|api|key|auth|credential|private)"
PATH = r"(?i)([./\\]|config|env|test|doc)"
# Common word parts for coverage; a parameter of ``features``.
DICTIONARY = ("the", "and", "ing", "ion", "ent", "for", "est", "ation", "que", "der", "sch", "con", "mente", "user", "test", "http", "www", "com", "data", "name", "file", "page", "html", "item", "id")
FEATURES = ("length", "transitions", "digits", "uppers", "hexlike", "covered", "quoted", "assigned", "named", "path")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, place (word number), word, lead, run, before, before2 of every candidate.

    ``lead``: what stands before the run in its word, from the run before it on.
    """
    words = F.split("text", r"\s+")
    rows = pick(docs, "doc_id", "text", "source").filter(F.col("text").rlike(RUN)).withColumn("_w", words)
    found = F.filter(
        F.transform("_w", lambda w, i: F.struct(i.alias("place"), w.alias("word"))),
        lambda x: (F.length(x["word"]) >= 16) & x["word"].rlike("[0-9]") & x["word"].rlike(RUN),
    )
    one = rows.withColumn("x", F.explode(found))
    at = F.col("x.place")
    words = one.select(
        "doc_id",
        "source",
        at.alias("place"),
        F.col("x.word").alias("word"),
        F.regexp_extract_all("x.word", F.lit(RUN), F.lit(0)).alias("_runs"),
        F.split("x.word", RUN, -1).alias("_gaps"),
        F.coalesce(F.when(at > 0, F.get("_w", at - 1)), F.lit("")).alias("before"),
        F.coalesce(F.when(at > 1, F.get("_w", at - 2)), F.lit("")).alias("before2"),
    )
    runs = words.select("*", F.posexplode("_runs").alias("_i", "run")).filter(F.col("run").rlike("[0-9]"))
    last = F.coalesce(F.when(F.col("_i") > 0, F.get("_runs", F.col("_i") - 1)), F.lit(""))
    return runs.withColumn("lead", F.concat(last, F.get("_gaps", F.col("_i")))).select(
        "doc_id", "source", "place", "word", "lead", "run", "before", "before2"
    )


def _share(run: Column, characters: str) -> Column:
    return (F.length(run) - F.length(F.regexp_replace(run, characters, ""))) / F.length(run)


def features(found: DataFrame, dictionary=DICTIONARY) -> DataFrame:
    run = F.col("run")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(run, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "9")
    known = "(?i)(" + "|".join(sorted(dictionary, key=len, reverse=True)) + ")"
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "length": F.length(run).cast("double"),
        "transitions": (F.length(kinds) - 1) / F.length(run),
        "digits": _share(run, "[0-9]"),
        "uppers": _share(run, "[A-Z]"),
        "hexlike": flag(run.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": _share(run, known),
        "quoted": flag(F.col("word").rlike("[\"']")),
        "assigned": flag(F.col("before").rlike("[=:]$") | F.col("word").rlike("^[A-Za-z_]+[=:]") | F.col("lead").rlike("[=:][\"']*$")),
        "named": flag(F.concat_ws(" ", "before2", "before", "word").rlike(NAMES)),
        "path": flag(F.coalesce(F.col("source"), F.lit("")).rlike(PATH)),
    })


def rule_findings(rows: DataFrame) -> DataFrame:
    """Candidates with a sure label: 1 for a quoted assigned value, 0 for numbers and words."""
    sure = F.when((F.col("assigned") == 1) & (F.col("quoted") == 1), 1.0).when(
        F.col("run").rlike("^[0-9-]+$") | (F.col("covered") > 0.6), 0.0
    )
    return rows.withColumn("label", sure).filter("label IS NOT NULL")


def scanned(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, place, run, score of the candidates that the forest keeps.

    ``findings``: the features and a ``label`` (0 or 1); made by rule where not given.
    """
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    work = Workspace(docs.sparkSession)
    rows = work.save(features(candidates(docs)), "candidates").df()
    labelled = (rule_findings(rows) if findings is None else findings).select(*FEATURES, F.col("label").cast("double").alias("label"))
    labelled = work.save(labelled.groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("_n")), "findings")
    if labelled.rows == 0 or labelled.df().select("label").distinct().count() < 2:
        return rows.select("doc_id", "place", "run", F.lit(None).cast("double").alias("score"))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="_n", numTrees=24, maxDepth=6, seed=7)
    # written and read again: a fitted model holds its training frames, the read one does not
    path = work.path("forest")
    forest.fit(vector.transform(labelled.df())).write().save(path)
    model = RandomForestClassificationModel.load(path)
    scored = model.transform(vector.transform(rows)).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return scored.filter(F.col("score") >= threshold).select("doc_id", "place", "run", "score")


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))
