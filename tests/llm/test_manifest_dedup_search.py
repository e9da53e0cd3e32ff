"""Merkle manifest, exact dedup and lexical search against plain versions, on the awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import differences, duck

from claimweave.llm import exact_dedup, lexical, merkle
from claimweave.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, body string, tree long, best int, _rank long"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_lexical_search"])
def test_query_against_its_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert differences(QUERIES[name](spark, FOLDER), SQL[name], duck(FOLDER)) == []


def rows_of(n, seed=3):
    """Nulls in every column, empty and long texts, blanks, repeated rows and equal ids; languages of all sizes."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        text = draw.choice([None, "", " ", "\t\n", "Ab c", "a b C", "abc", f"ünï {k % 7} Zoë-x9 the THE the", "y " * draw.choice([1, 30_000])])
        lang = draw.choice(["en"] * 12 + ["fr", None, "", "zz" if k < 5 else "en", "é"])
        out.append((None if k % 29 == 7 else k, text, lang, draw.choice(["s", None]), None if k % 11 == 0 else len(text or ""), 1, "b", 2, 3, 4))
    return [*out, *([out[0], out[0], out[7]] if n > 7 else [])]


# -- manifest --------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_by_hand(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_by_hand(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 2])) for i in range(0, len(low), 2)])
    return levels


def manifest_by_hand(rows):
    trees = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = leaf_by_hand(d, source, lang, n, text)
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        trees[lang].append(((d is not None, d or 0, leaf), d, leaf, leaf_by_hand(d, source, lang, n + 1, text) if hit else leaf))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {lang: levels_by_hand([r[2] for r in sorted(trees[lang])]) for lang in order}
    top = levels_by_hand([made[lang][-1][0] for lang in order])
    out = []
    for t, lang in enumerate(order):
        for i, (_, d, leaf, changed) in enumerate(sorted(trees[lang])):
            siblings, node = [], changed
            for levels, at in ((made[lang], i), (top, t)):
                for low in levels[:-1]:
                    other = low[at ^ 1] if at ^ 1 < len(low) else ""
                    siblings.append(other)
                    node = sha(other + node if at & 1 else node + other)
                    at >>= 1
            out.append((d, leaf, made[lang][-1][0], top[-1][0], sha("".join(siblings)), node, node == top[-1][0]))
    return out


def key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("every, n", [(1, 40), (2, 90), (3, 33), (10, 90), (2, 1)])
def test_manifest(spark, every, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = merkle.tampering_found(df, every=every).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, manifest_by_hand([r[:5] for r in rows])))


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert merkle.tampering_found(none).collect() == []
    made = merkle.Manifest(none.selectExpr("lang", "doc_id", "sha2(text, 256) AS leaf"), "lang", ["doc_id"])
    assert made.root is None


def test_manifest_keeps_only_every_few_levels(spark, tmp_path):
    leaves = spark.range(1000).selectExpr("0L AS tree", "1000L AS n", "id AS idx", "unhex(sha2(cast(id AS string), 256)) AS node")
    forest = merkle.Forest(leaves, merkle.Workspace(spark, str(tmp_path)), 3)
    stored = [sum(len(r.nodes) for r in s.df().collect()) for s in forest.levels]
    assert stored == [1000, 125, 16, 2]
    assert max(len(r.nodes) for s in forest.levels for r in s.df().collect()) == 8
    assert {len(r.steps) for r in forest.proofs().collect()} == {10}


# -- exact dedup -----------------------------------------------------------------


def groups_by_hand(rows):
    groups = defaultdict(list)
    for d, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), d is None, d or 0))
    out = []
    for body, members in groups.items():
        members.sort()
        for k, (_, unknown, d) in enumerate(members):
            keep = None if members[0][1] else members[0][2]
            out.append((None if unknown else d, keep, len(members), k == 0, sha(body)))
    return out


@pytest.mark.parametrize("hot_rows, weak", [(64, False), (3, False), (3, True), (64, True)])
def test_exact_dedup(spark, monkeypatch, hot_rows, weak):
    """Also with hot groups, and with a digest that many different texts share."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    if weak:
        monkeypatch.setattr(exact_dedup, "digest", lambda c: c.substr(1, 1).cast("string").substr(1, 0).cast("binary"))
    rows = rows_of(300, 5)
    rows += [(2_000 + k, f"copy {k % 4}", "en", "s", 6, 1, "b", 2, 3, 4) for k in range(200)]
    rows += [(-(1 << 63), "low", "en", "s", 3, 1, "b", 2, 3, 4), ((1 << 63) - 1, "lo w", "en", "s", 3, 1, "b", 2, 3, 4), ((1 << 63) - 1, "low", "en", "s", 3, 1, "b", 2, 3, 4)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    got = exact_dedup.duplicate_groups(df).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, groups_by_hand(rows)))


def test_deduplicated_keeps_every_column(spark):
    rows = rows_of(200, 9)
    df = spark.createDataFrame(rows, COLUMNS)
    out = exact_dedup.deduplicated(df)
    assert out.schema == df.schema
    kept = [tuple(r) for r in out.collect()]
    assert not Counter(map(key, kept)) - Counter(map(key, rows))
    assert sorted(key(r[:1]) for r in kept) == sorted(key(g[:1]) for g in groups_by_hand(rows) if g[3])
    assert exact_dedup.deduplicated(df.limit(0)).collect() == []
    assert exact_dedup.duplicate_groups(df.limit(0)).collect() == []


def test_hot_digests_are_few(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 1)
    rows = spark.range(1000).selectExpr("id % 3 AS digest").unionByName(spark.range(900).selectExpr("id + 10 AS digest"))
    assert sorted(r.digest for r in exact_dedup.hot_digests(rows, 1900).collect()) == []
    assert len(exact_dedup.hot_digests(rows.filter("digest < 3"), 1000).collect()) == 3


# -- lexical search --------------------------------------------------------------


def terms_by_hand(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def ranked_by_hand(docs, items, k=20):
    counts = [(d, Counter(terms_by_hand(t))) for d, t in docs]
    total = sum(sum(c.values()) for _, c in counts)
    texts = sum(bool(c) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * texts // total if total else 0
            score = 0
            for t in terms_by_hand(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("bounds", [{}, {"block_bytes": 64, "block_items": 2}, {"k": 3}])
def test_lexical_search(spark, monkeypatch, bounds):
    monkeypatch.setattr(lexical, "CELLS", 40)
    draw = random.Random(4)
    known = ["alpha", "Beta", "gamma", "Zoë", "ZOË", "x9", "日本", "be", "ta", " ", "éa", "the"]
    join = lambda n: "".join(draw.choice(known) + draw.choice([" ", "-", "  ", "\x00", "\n", "'"]) for _ in range(n))
    docs = [(k, join(draw.randint(0, 30))) for k in range(120)] + [(None, join(20)), (None, None), (500, None), (501, ""), (502, " ,. "), (503, "beta" * 9_000 + " beta")]
    docs += [docs[3], docs[3], (504, docs[3][1])]
    items = [(k, join(draw.randint(1, 12))) for k in range(9)] + [(20, None), (21, ""), (22, "..."), (23, "neverseen"), (3, "be ta be"), (24, "zOË"), (25, "x9 " * 300)]
    df = spark.createDataFrame([(*d, "t", 7) for d in docs], "doc_id long, text string, term string, score int").repartition(6)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, _rank string")
    got = lexical.ranked(df, bench, **bounds).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, ranked_by_hand(docs, items, bounds.get("k", 20))))


def test_lexical_search_over_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), bench).collect() == []
    assert lexical.ranked(docs.filter("text IS NULL"), bench).collect() == []
    assert lexical.ranked(docs, bench.limit(0)).collect() == []


def test_item_blocks_stay_within_their_bounds(spark):
    lengths = [0, 1, 1, 5, 9, 9, 30, 31, 200, 3000]
    items = spark.createDataFrame([("x" * n,) for n in lengths], "text string")
    blocks = list(lexical.item_blocks(items, len(lengths), 64, 4))
    assert [a for a, _ in blocks] == [0, *[b for _, b in blocks[:-1]]] and blocks[-1][1] == len(lengths)
    assert all(b - a <= 4 and (b - a == 1 or sum(lengths[a:b]) <= 64) for a, b in blocks)
