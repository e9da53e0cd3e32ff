"""Personal data by bootstrapped contextual extraction [native].

Base spans come from four fixed expressions and their checks.  They seed the method: every
token with a digit or an ``@`` (and every phone-like run) is an instance, the words left
and right of it are lexical patterns.  In each round a pattern's confidence for a kind is
the share of its distinct instances known to be of that kind; patterns with enough
instances and confidence are taken, an instance not known yet is scored by the patterns
that find it (one minus the product of their doubts), and instances above the bar join the
seeds of the next round, until a round adds none (or ``most`` rounds, where the caller of
``discovered`` gives a number).  Instances of any length from one character on and context words are compared by
128-bit hashes, and context words are whole.  Every occurrence of a discovered instance
becomes a span.

The expressions are written without nested repetition and start only where a run starts, so
texts of any length are scanned in one pass; results are those of the plain expressions.

Defined cases: a null text is an empty one, with no spans; spans of different kinds may
overlap; a kind's base spans do not; a discovered span that overlaps a base span of its
kind is left out; equal rows get equal results, each returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, pick, whole_rows
from claimweave.workspace import rounds

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# Each starts where a run of its first class starts, or right after the last match.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Whole runs of digits with single blanks or hyphens between, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MENTION = r"\+[0-9][\x20().0-9-]+[0-9]|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.9
MIN_SCORE = 0.95


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass: every second from the right doubled, sum divisible by ten."""
    digits = F.split(F.reverse(_digits(match)), "")
    total = F.aggregate(
        F.transform(
            F.filter(digits, lambda d: d != ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's argument is not computed again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walked(pieces: Column) -> Column:
    """Length of the pieces, and the matches among them with start and end; the array grows by copying."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(pieces, state, step)


def _positions(pieces: Column) -> Column:
    """Matches with start and end.  Many pieces are walked in blocks of the root of their number,
    so the copying stays far below the square of it."""
    wide = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(pieces), wide), lambda i: _walked(F.slice(pieces, i, wide)))

    def shifted(blocks: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

        def moved(starts: Column) -> Column:
            def of_block(b: Column, j: Column) -> Column:
                by = F.element_at(starts["out"], j + 1)
                return F.transform(b["out"], lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m")))

            return F.flatten(F.transform(blocks, of_block))

        return bound(starts, moved)

    return F.when(F.size(pieces) <= 64, _walked(pieces)["out"]).otherwise(bound(blocks, shifted))


def placed(text: Column, pattern: str) -> Column:
    """Matches with their start and end in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m")), _positions)


def base_spans(text: Column) -> Column:
    """``array<struct<k, s, e>>`` of all kinds, by kind and start; kinds by number."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    cheap = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = text.rlike("[0-9]")
    parts = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        may = cheap.get(kind, digit) & text.rlike(pattern)
        spans = F.when(may, placed(text, pattern)).otherwise(none)
        parts.append(_kept(spans, k, kind))
    return F.concat(*parts)


def _kept(spans: Column, number: int, kind: str) -> Column:
    return F.transform(
        F.filter(spans, lambda x: _valid(kind, x["m"])),
        lambda x: F.struct(F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e")),
    )


def _count(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == number)).cast("bigint")


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order given."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def _met(spans: Column, start: Column, end: Column) -> Column:
    """Does one of the spans (in order, apart from each other) overlap start to end?  By halving."""
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    before = F.aggregate(steps, F.lit(0), lambda at, b: F.when((at + b <= F.size(spans)) & (F.get(spans, at + b - 1)["s"] < end), at + b).otherwise(at))
    return F.coalesce(F.get(spans, before - 1)["e"] > start, F.lit(False)) & (before > 0)


def mentions(scanned: DataFrame) -> DataFrame:
    """Every identifier-like mention: its row, place, normal form, known kind and contexts.

    All of it is put into one struct per mention before the rows are exploded, so no row carries
    its text or the other mentions.
    """
    text = F.col("text")
    by_kind = F.struct(*[F.filter("base", lambda b, k=k: b["k"] == k).alias(f"k{k}") for k in range(len(KINDS))])
    parts = F.struct(placed(text, MENTION).alias("found"), F.split(text, MENTION, -1).alias("gaps"), by_kind.alias("base"))

    def of_text(t: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            # punctuation around an identifier is no part of it
            core = F.regexp_extract(x["m"], r"^[^A-Za-z0-9@+]*+(.*?)[^A-Za-z0-9]*$", 1)
            start = x["s"] + F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9@+]*+", 0))
            end = start + F.length(core)
            kind = F.coalesce(*[F.when(_met(t["base"][f"k{k}"], start, end), F.lit(k)) for k in range(len(KINDS))])
            return F.struct(
                start.alias("s"),
                end.alias("e"),
                core.alias("core"),
                kind.alias("kind"),
                F.lower(F.reverse(F.regexp_extract(F.reverse(F.element_at(t["gaps"], i + 1)), r"^\s*+(\S++)", 1))).alias("left"),
                F.lower(F.regexp_extract(F.element_at(t["gaps"], i + 2), r"^\s*+(\S++)", 1)).alias("right"),
            )

        return F.transform(t["found"], one)

    rows = scanned.filter(text.rlike("[0-9@]")).select("_row", F.explode(bound(parts, of_text)).alias("x"))
    rows = rows.select("_row", "x.*").filter(F.length("core") > 0)
    return rows.select("_row", "s", "e", F.md5("core").alias("instance"), "kind", "left", "right")


def discovered(found: DataFrame, work: Workspace, most: int | None = None) -> DataFrame:
    """Instances (with kind) that seed instances' patterns find, until a round adds none."""
    edges = (
        found.select(
            "instance",
            "kind",
            F.explode(F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"), F.concat(F.lit("b:"), "left", F.lit(" "), "right"))).alias("pattern"),
        )
        .filter(F.length("pattern") > 3)
        .withColumn("pattern", F.md5("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.min("kind").alias("kind"))
    )
    edges = work.save(edges, "edges").df()
    known = work.save(edges.filter("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("score")), "seeds")
    fresh = None
    for step in rounds(0, most):
        scored = edges.select("pattern", "instance").join(known.df(), "instance", "left")
        totals = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"p{k}") for k in range(len(KINDS))])
        best = F.array_max(F.array(*[F.struct(F.coalesce(f"p{k}", F.lit(0.0)).alias("p"), F.lit(-k).alias("k")) for k in range(len(KINDS))]))
        patterns = (
            totals.withColumn("best", best)
            .select("pattern", (-F.col("best.k")).alias("kind"), F.col("best.p").alias("hits"), (F.col("best.p") / F.col("n")).alias("confidence"))
            .filter((F.col("hits") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") < 1.0))
        )
        new = (
            edges.select("pattern", "instance")
            .join(patterns, "pattern")
            .join(known.df().select("instance"), "instance", "left_anti")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
            .filter(F.col("score") >= MIN_SCORE)
            .groupBy("instance")
            .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        )
        added = work.save(new, f"round{step}")
        if added.rows == 0:
            break
        known = known.plus(added)
        fresh = added if fresh is None else fresh.plus(added)
    return fresh.df().select("instance", "kind") if fresh is not None else found.sparkSession.createDataFrame([], "instance string, kind int")


def scanned_rows(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (_row, doc_id, base spans) and the added spans by ``_row``.

    ``_row`` stands for (doc_id, text): a hash of the text keeps repeated ids apart.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    rows = rows.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("h")))
    scanned = rows.withColumn("base", base_spans(F.col("text")))
    found = work.save(mentions(scanned), "mentions").df()
    new = discovered(found, work)
    extra = (
        found.filter("kind IS NULL")
        .drop("kind")
        .join(new, "instance")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e"))).alias("extra"))  # spans of one text
    )
    return scanned, work.save(extra, "extra").df()


def _with_extra(scanned: DataFrame, extra: DataFrame) -> DataFrame:
    wide = extra.select(F.col("_row.doc_id").alias("_id"), F.col("_row.h").alias("_h"), "extra")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row.h") == F.col("_h"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return scanned.join(wide, same, "left").withColumn("extra", F.coalesce("extra", none)).drop("_id", "_h")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans, number added."""
    work = Workspace(docs.sparkSession)
    scanned, extra = scanned_rows(docs, work)
    rows = _with_extra(scanned.select("doc_id", "_row", "base"), extra)
    everything = F.array_sort(F.concat("base", "extra"))
    return rows.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(everything).alias("spans"),
        F.size("extra").cast("bigint").alias("n_added"),
    )


def replaced(text: Column, spans: Column, names: Column) -> Column:
    """The text with every run of overlapping spans (s, -e, k, in order) replaced by its first one's name.

    Spans are taken in blocks of the root of their number, each with its own part of the text, so
    that neither finding a place nor adding to the result grows with all of the text.
    """
    wide = F.ceil(F.sqrt(F.size(spans))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(spans), wide), lambda i: F.slice(spans, i, wide))

    def all_blocks(blocks: Column) -> Column:
        last = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: -x["e"])))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(last, none, lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

        def from_starts(starts: Column) -> Column:
            def of_block(b: Column, j: Column) -> Column:
                first = F.element_at(starts["out"], j + 1)
                end = F.array_max(F.transform(b, lambda x: -x["e"]))
                part = F.substr(text, first + 1, F.greatest(end - first, F.lit(0)))

                def of_part(part: Column) -> Column:
                    def step(acc: Column, x: Column) -> Column:
                        before = F.substr(part, acc["at"] - first + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
                        return F.struct(
                            F.greatest(acc["at"], -x["e"]).alias("at"),
                            F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(before, F.element_at(names, x["k"] + 1)))).alias("out"),
                        )

                    state = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))
                    return F.aggregate(b, state, step, lambda acc: F.array_join(acc["out"], ""))

                return bound(part, of_part)

            return F.concat(F.array_join(F.transform(blocks, of_block), ""), F.substr(text, starts["at"] + 1))

        return bound(starts, from_starts)

    return bound(blocks, all_blocks)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars follows the text."""
    work = Workspace(docs.sparkSession)
    scanned, extra = scanned_rows(docs, work)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    text = F.coalesce("text", F.lit(""))
    whole = replaced(text, F.col("spans"), names)
    keyed = whole_rows(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    keyed = keyed.withColumn("_row", F.struct("doc_id", F.xxhash64(text).alias("h"))).withColumn("base", base_spans(text))
    rows = _with_extra(keyed, extra).withColumn("spans", ordered)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(whole)
    rows = rows.select("_all", clean.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return rows.select(*[changed.get(c, F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
