"""Sharding by a Hilbert curve over several metadata dimensions [native].

Each dimension is quantised to ``bits`` bits, the cell's index on the Hilbert curve orders
the rows, and the order is cut into runs whose row counts differ by at most one (law
``rows``).  Neighbours on the curve are near in every dimension, so files written per run
carry narrow minima and maxima in all of them and a filter on any one prunes files.

Defined cases: a null dimension falls into cell 0; a dimension with one value gives cell 0;
ties on the curve are ordered by doc_id, then by size and checksum, so repeated rows take
neighbouring slots; a null text has size 1 and checksum 0; an empty table gives no rows.
Equal texts are not kept together: the law balances rows, not groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, globally_numbered, pick

BITS = 6
SHARDS = 8
TEXT_BYTES = 4


def size_scale(value: Column) -> Column:
    """A whole-number logarithm: 8 steps for each doubling."""
    v = F.greatest(value.cast("bigint"), F.lit(0))
    digits = F.length(F.bin(v)).cast("bigint")
    steps = F.when(digits > 4, F.call_function("shiftright", v, (digits - 4).cast("int")).bitwiseAND(7)).otherwise(
        F.call_function("shiftleft", v, (F.lit(4) - digits).cast("int")).bitwiseAND(7)
    )
    return digits * 8 + steps


def common_prefix(low: Column, high: Column) -> Column:
    """Length in bytes of what two hex strings share, in whole bytes."""
    n = F.least(F.length(low), F.length(high))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(n / 2), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when(
            (acc == i - 1) & (n >= 2 * i) & (F.substr(low, i * 2 - 1, F.lit(2)) == F.substr(high, i * 2 - 1, F.lit(2))),
            i.cast("int"),
        ).otherwise(acc),
    )
    return same


def text_scale(value: Column, skip: Column) -> Column:
    """The first bytes after the part that all values share, as a number in string order."""
    hexed = F.hex(F.encode(value, "UTF-8"))
    tail = F.rpad(F.substr(hexed, skip * 2 + 1, F.lit(2 * TEXT_BYTES)), 2 * TEXT_BYTES, "0")
    return F.conv(tail, 16, 10).cast("bigint")


def cells(df: DataFrame, numeric: Sequence[str], text: Sequence[str], bits: int) -> DataFrame:
    """Add ``_cells``: each dimension scaled between its minimum and maximum over all rows."""
    if not [*numeric, *text]:
        raise ValueError("name at least one dimension")
    hexes = {c: F.hex(F.encode(F.col(c), "UTF-8")) for c in text}
    ends = df.agg(
        *[f(size_scale(F.col(c))).alias(f"_{k}_{c}") for c in numeric for k, f in (("lo", F.min), ("hi", F.max))],
        *[f(hexes[c]).alias(f"_{k}_{c}") for c in text for k, f in (("lo", F.min), ("hi", F.max))],
    )
    for c in text:
        ends = ends.withColumn(f"_skip_{c}", F.coalesce(common_prefix(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")), F.lit(0)))
    out = df.crossJoin(F.broadcast(ends))  # one row
    top = 1 << bits

    def scaled(value: Column, low: Column, high: Column) -> Column:
        cell = F.floor((value - low) * top / (high - low + 1)).cast("bigint")
        return F.coalesce(cell, F.lit(0).cast("bigint"))

    found = [scaled(size_scale(F.col(c)), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in numeric]
    for c in text:
        skip = F.col(f"_skip_{c}")
        low, high = (
            F.conv(F.rpad(F.substr(F.col(f"_{k}_{c}"), skip * 2 + 1, F.lit(2 * TEXT_BYTES)), 2 * TEXT_BYTES, "0"), 16, 10).cast("bigint")
            for k in ("lo", "hi")
        )
        found.append(scaled(text_scale(F.col(c), skip), low, high))
    return out.select(*df.columns, F.array(*found).alias("_cells"))


def hilbert_index(cell: Column, dims: int, bits: int) -> Column:
    """Index of a cell on the curve (Skilling's transform as folds over the bits)."""
    axes = F.array(*[F.lit(i) for i in range(dims)])

    def undo(x: Column, q: Column) -> Column:
        p = q - 1

        def at(state: Column, i: Column) -> Column:
            first, here = F.element_at(state, 1), F.element_at(state, i + 1)
            swap = first.bitwiseXOR(here).bitwiseAND(p)
            hit = here.bitwiseAND(q) != 0
            return F.transform(
                state,
                lambda v, j: F.when(hit, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(
                    F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)
                ),
            )

        return F.aggregate(axes, x, at)

    planes = F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)])
    x = F.aggregate(planes, cell, undo) if bits > 1 else cell
    empty = F.array().cast("array<bigint>")
    gray = F.aggregate(
        x, empty, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")).bitwiseXOR(v)))
    )

    def fix(axes_now: Column) -> Column:
        if bits == 1:
            return axes_now
        last = F.element_at(axes_now, dims)
        t = F.aggregate(
            planes,
            F.lit(0).cast("bigint"),
            lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc),
        )
        return F.transform(axes_now, lambda v: v.bitwiseXOR(t))

    order = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def interleave(state: Column) -> Column:
        return F.aggregate(
            order,
            F.lit(0).cast("bigint"),
            lambda acc, b: F.aggregate(
                state, acc, lambda a, v: a * 2 + F.call_function("shiftright", v, b).bitwiseAND(1)
            ),
        )

    # one-element arrays bind a computed array to a name, so it is evaluated once
    fixed = F.element_at(F.transform(F.array(gray), fix), 1)
    return F.element_at(F.transform(F.array(fixed), interleave), 1)


def hilbert_shards(
    docs: DataFrame,
    numeric: Sequence[str] = ("n_chars",),
    text: Sequence[str] = ("source", "lang"),
    n_shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for every row of ``docs``.

    The text is read once for its size and checksum and moves nowhere; what is sorted and
    written is one narrow row per document.
    """
    if n_shards < 1 or not 1 <= bits * len([*numeric, *text]) <= 62:
        raise ValueError("shards must be positive and the curve index must fit 62 bits")
    body = F.coalesce(F.col("text"), F.lit(""))
    dims = list(dict.fromkeys([*numeric, *text]))
    narrow = pick(docs, *dict.fromkeys(["doc_id", "text", *dims])).select(
        "doc_id",
        *[F.col(c).alias(f"_d{i}") for i, c in enumerate(dims)],
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    names = {c: f"_d{i}" for i, c in enumerate(dims)}
    placed = cells(narrow, [names[c] for c in numeric], [names[c] for c in text], bits)
    curve = placed.select("doc_id", "size", "text_crc32", hilbert_index(F.col("_cells"), len(dims), bits).alias("curve"))
    work = Workspace(docs.sparkSession)
    curve = work.save(curve, "curve").df()  # texts are read once, before the sort samples its rows
    ranked, rows = globally_numbered(curve, ["curve", "doc_id", "size", "text_crc32"], work, "hilbert")
    shard = F.expr(f"_rank * {n_shards} div {max(rows, 1)}")
    first = F.expr(f"(_shard * {rows} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write ``docs`` as one folder per shard, rows in curve order, for file pruning."""
    placed = hilbert_shards(docs, **options).select(F.col("doc_id").alias("_id"), "shard", "slot").dropDuplicates(["_id"])
    n = options.get("n_shards", SHARDS)
    joined = docs.drop("shard", "slot").join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))


def _sql(bits: int = BITS, n_shards: int = SHARDS) -> str:
    """The same placing as a chain of plain selects."""
    size_of = (
        "length(bin(v)) * 8 + CASE WHEN length(bin(v)) > 4 THEN (v >> (length(bin(v)) - 4)) & 7 "
        "ELSE (v << (4 - length(bin(v)))) & 7 END"
    )

    def number(h: str, skip: str) -> str:
        return f"CAST('0x' || rpad(substr({h}, {skip} * 2 + 1, {2 * TEXT_BYTES}), {2 * TEXT_BYTES}, '0') AS BIGINT)"

    def skip(c: str) -> str:
        return (
            f"coalesce((SELECT max(i) FROM range(0, least(length(lo_{c}), length(hi_{c})) // 2 + 1) r(i) "
            f"WHERE substr(lo_{c}, 1, 2 * i) = substr(hi_{c}, 1, 2 * i)), 0)"
        )

    top = 1 << bits
    steps = [
        f"""d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS body,
            ({size_of.replace('v', 'n_chars')}) AS s, hex(encode(source)) AS a, hex(encode(lang)) AS b FROM documents)""",
        "e AS (SELECT min(s) AS lo_s, max(s) AS hi_s, min(a) AS lo_a, max(a) AS hi_a, min(b) AS lo_b, max(b) AS hi_b FROM d)",
        f"k AS (SELECT *, {skip('a')} AS sk_a, {skip('b')} AS sk_b FROM e)",
        f"""x0 AS (SELECT d.doc_id, d.size, d.body,
            coalesce((s - lo_s) * {top} // (hi_s - lo_s + 1), 0)::BIGINT AS p0,
            coalesce(({number('a', 'sk_a')} - {number('lo_a', 'sk_a')}) * {top} // ({number('hi_a', 'sk_a')} - {number('lo_a', 'sk_a')} + 1), 0)::BIGINT AS p1,
            coalesce(({number('b', 'sk_b')} - {number('lo_b', 'sk_b')}) * {top} // ({number('hi_b', 'sk_b')} - {number('lo_b', 'sk_b')} + 1), 0)::BIGINT AS p2
            FROM d, k)""",
    ]
    at = 0

    def step(**changed: str) -> None:
        nonlocal at
        steps.append(f"x{at + 1} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in changed.items())}) FROM x{at})")
        at += 1

    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(3):
            if i == 0:
                step(p0=f"CASE WHEN p0 & {q} <> 0 THEN xor(p0, {p}) ELSE p0 END")
            else:
                swap = f"(xor(p0, p{i}) & {p})"
                step(
                    p0=f"CASE WHEN p{i} & {q} <> 0 THEN xor(p0, {p}) ELSE xor(p0, {swap}) END",
                    **{f"p{i}": f"CASE WHEN p{i} & {q} <> 0 THEN p{i} ELSE xor(p{i}, {swap}) END"},
                )
    step(p1="xor(p1, p0)")
    step(p2="xor(p2, p1)")
    t = "0::BIGINT"
    for bit in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN p2 & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    step(p0=f"xor(p0, {t})", p1=f"xor(p1, {t})", p2=f"xor(p2, {t})")
    index = " + ".join(
        f"((p{i} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(bits - 1, -1, -1) for i in range(3)
    )
    # CRC-32 byte by byte over the table of its generator
    steps = [
        "gen AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, "
        "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM gen WHERE k < 8)",
        "tab AS (SELECT list(c ORDER BY i) AS tab FROM gen WHERE k = 8)",
        *steps,
    ]
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(body)), "
        "lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), "
        "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )
    return f"""WITH RECURSIVE {', '.join(steps)},
        h AS (SELECT doc_id, size, body, ({index})::BIGINT AS curve FROM x{at}),
        r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id) - 1 AS r, count(*) OVER () AS n FROM h),
        cut AS (SELECT doc_id, curve, size, r, n, body, hex(encode(body)) AS h, (r * {n_shards} // n) AS sh FROM r)
        SELECT doc_id, size, {crc} AS text_crc32, 'rows' AS law, sh::INTEGER AS shard,
            (r - (sh * n + {n_shards - 1}) // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve FROM cut, tab"""


SQL = _sql()
