"""The text operators against brute force, on small tables with the awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import bpe, decontaminate, jaccard_join, licenses, phrases, pii, quality, secrets, sharding, url_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id long, _row long"
PROSE = "the quick brown fox jumps over the lazy dog while seven bright stars look down on quiet fields of green".split()


def prose(k, n=60):
    return " ".join(PROSE[(k * 7 + i * (k % 5 + 1)) % len(PROSE)] + ("" if i % 9 else str(k)) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, very long, repeated and near-equal rows; columns with working names."""
    texts = [prose(k) for k in range(12)]
    texts += [None, "", " \n\t", "one two", "ONE TWO", texts[0], texts[1] + " tail", "x" * 30_000, prose(3, 4_000)]
    texts += [texts[2].replace("fox", "cat", 1), "a@b.c 4111111111111111, 10.0.0.1, +1 (234) 555-6666"]
    rows = [(k, t, None if k == 4 else "en", "src0", None if t is None else len(t), 1, 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, None, None, None, None, None, None, None)], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sets_of(rows, width):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def test_shards(docs, none):
    rows = sharding.hilbert_shards(docs).collect()
    assert len(rows) == docs.count()
    sizes = [sum(r.shard == k for r in rows) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    texts = dict(pairs_of(docs))
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    assert sharding.hilbert_shards(none).count() == 0


def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(512).select(F.array((F.col("id") / 64).cast("long"), (F.col("id") / 8 % 8).cast("long"), (F.col("id") % 8)).alias("c"))
    rows = cells.select("c", sharding.hilbert_index(F.col("c"), 3, 3).alias("i")).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(x.c, y.c)) == 1 for x, y in zip(rows, rows[1:]))


def components_by_hand(rows, like):
    sets = sets_of(rows, like.width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and like.links(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), (d if not sets[i] else least.get(find(i)))) for i, (d, _) in enumerate(rows)), sets


@pytest.mark.parametrize("like", [jaccard_join.Similar(), jaccard_join.Similar(3, 9, 10)])
def test_jaccard_join(docs, none, like):
    want, _ = components_by_hand(pairs_of(docs), like)
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in jaccard_join.components(docs, like).collect())
    assert got == want
    assert jaccard_join.components(none, like).count() == 0


@pytest.mark.parametrize("whole", [0, 34, 512])
def test_jaccard_join_over_several_leaves(spark, monkeypatch, whole):
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    monkeypatch.setattr(jaccard_join, "WHOLE", whole)
    base = prose(1, 40).split()
    texts = [" ".join(w if i != k else f"edit{k}" for i, w in enumerate(base)) for k in range(24)] + [" ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for like in (jaccard_join.Similar(1, 9, 10), jaccard_join.Similar(5, 8, 10), jaccard_join.Similar(2, 8, 10)):
        want, _ = components_by_hand(list(enumerate(texts)), like)
        assert sorted(map(tuple, jaccard_join.components(df, like).collect())) == want


def test_fingerprints(docs, none):
    rows = phrases.fingerprints(docs).collect()
    order = sorted(pairs_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(order)
    texts = [t or "" for _, t in order]
    by_id = {}
    for k, (d, _) in enumerate(order):
        by_id.setdefault(d, []).append(phrases.edited(texts[k], texts[(k + 1) % len(texts)]))
    for r in rows:
        assert r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in by_id[r.doc_id]}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = {r.fingerprint for r in rows if r.doc_id in (0, 17)}
    assert len(one) == 1
    assert phrases.fingerprints(none).count() == 0


def test_phrases_inside_do_not_depend_on_the_offset():
    draw = random.Random(3)
    body = " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(1_500))
    a, b = phrases.sketches([body, "some other words in front, " + body])
    assert phrases.likeness(a, b) > 0.8
    assert phrases.likeness(*phrases.sketches([prose(1, 400), body[::-1]])) < 0.2


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "https://a.example.net/de/2", "http://x.example.com/de/3?q", "http://b.org/fr/4", "HTTP://B.ORG/de/5", "http://b.org/de/6", None, "", "no scheme", "http://net", "http://c.com/xx#/de/"]
    df = spark.createDataFrame([(k, u, 1, "x") for k, u in enumerate(urls * 30)], "page_id long, url string, tokens int, key string")
    rows = {r.page_id: r for r in url_rules.judged_urls(df).collect()}
    assert len(rows) == len(urls) * 30
    assert [rows[k].rule for k in range(11)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert [rows[k].verdict for k in range(6)] == ["allow", "block", "block", "allow", "block", "block"]
    assert (rows[4].host, rows[4].path, rows[10].path, rows[6].host) == ("b.org", "/de/5", "/xx", "")
    assert all(rows[k].verdict == "allow" for k in (6, 7, 8))
    assert url_rules.judged_urls(df.filter("page_id < 0")).count() == 0


def test_bpe(docs, none):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    files = bpe.vocabulary_file()
    texts = dict(pairs_of(docs))
    for r in bpe.digests(docs, *files).collect():
        ids = other.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    coded = bpe.encode(docs, *files)
    assert all(r.text == (texts[r.doc_id] or "") for r in bpe.decode(coded, *files).collect())
    tool = bpe.ByteBpe(*files)
    text = "naïve 😀 <|endoftext|>\x00  x"
    ids = tool.encode(text)
    ends, first, last = tool.offsets(text, ids)
    assert ends[-1] == len(text.encode()) and (first[0], last[-1]) == (0, len(text))
    assert tool.decode(ids[:5]).decode(errors="replace")
    assert bpe.digests(none, *files).count() == 0


def test_quality(spark, none):
    good = [(k, prose(k, 80), "en", 1) for k in range(60)]
    bad = [(100 + k, " ".join(f"@#{i}{k}$$$%%" for i in range(60)), "en", 0) for k in range(6)]
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in good + bad] + [(200, None, "en"), (201, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, q, 0) for a, _, _, q in good + bad], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.keep for r in quality.judged(df, labels).collect()}
    assert not any(found[k] for k in (*range(100, 106), 200, 201))
    assert sum(found[k] for k in range(60)) >= 57
    assert sorted(r.doc_id for r in quality.kept(df, labels).collect()) == sorted(k for k, v in found.items() if v)
    unlabelled = quality.judged(df, labels.filter("doc_id < 0"))
    assert unlabelled.filter("keep").count() == 66
    assert quality.judged(none, labels).count() == 0


def test_quality_knows_every_word_of_trusted_text(spark):
    """Clean text of many rare words stays, other words of the same case and length go; any partitions."""
    draw = random.Random(8)
    own = ["".join(draw.choices("abcdefgh", k=7)) for _ in range(1_500)]
    other = ["".join(draw.choices("abcdefgh", k=7)) for _ in range(1_500)]
    # rare words of their own languages, one text each language and partition at most
    rows = [(k, " ".join(draw.sample(own, 60)), f"l{k % 3}", 1) for k in range(600)]
    rows += [(1000 + k, " ".join(draw.sample(other, 60)), f"l{k % 3}", 0) for k in range(30)]
    labels = spark.createDataFrame([(a, q, 0) for a, _, _, q in rows], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    seen = []
    for n in (2, 60):
        found = {r.doc_id: (r.keep, round(r.perplexity, 6)) for r in quality.judged(df.repartition(n), labels).collect()}
        assert not any(found[1000 + k][0] for k in range(30))
        assert sum(found[k][0] for k in range(600)) >= 590
        seen.append(found)
    assert seen[0] == seen[1]


def kneser_ney_by_hand(trained, text):
    """Logarithm of the text's probability, from dictionaries, less the spelling of unknown words."""
    def padded(t):
        ws = t.split()
        return ["<", "<", *[(w, i > 0 and ws[i - 1] == w) for i, w in enumerate(ws)]]

    c3 = {}
    for t in trained:
        p = padded(t)
        for g in zip(p, p[1:], p[2:]):
            c3[g] = c3.get(g, 0) + 1
    orders = [c3]
    for _ in range(2):
        low = {}
        for g in orders[-1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        orders.append(low)

    def level(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        ds = [min(k, max(0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and n[1] else 0.5 * k for k in (1, 2, 3)]
        d = {g: min(ds[min(c, 3) - 1], c) for g, c in counts.items()}
        total, left = {}, {}
        for g, c in counts.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            left[g[:-1]] = left.get(g[:-1], 0) + d[g]
        return lambda g, p: p if g[:-1] not in total else (counts.get(g, 0) - d.get(g, 0)) / total[g[:-1]] + max(left[g[:-1]] / total[g[:-1]], 1e-12) * p

    three, two, one = map(level, orders)
    out, p = 0.0, padded(text)
    for g in zip(p, p[1:], p[2:]):
        out += math.log(three(g, two(g[1:], one(g[2:], 1 / (len(orders[2]) + 1)))))
        out -= 0 if g[2:] in orders[2] else quality.SPELL * min(len(g[2][0]), 41)
    return out


@pytest.mark.parametrize("hot, mapped", [(1 << 19, 1 << 26), (0, 0), (20, 1 << 26)])
def test_quality_sums_are_those_of_the_model(spark, tmp_path, monkeypatch, hot, mapped):
    monkeypatch.setattr(quality, "HOT", hot)
    monkeypatch.setattr(quality, "MAPPED", mapped)
    draw = random.Random(1)
    texts = [" ".join(draw.choices(PROSE, k=draw.randint(1, 40))) for _ in range(40)]
    asked = [*texts[:5], "zebra the quick", "the the the", "quick, brown? unheardof", "", texts[0]]
    work = quality.Workspace(spark, str(tmp_path))
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model, unknown = quality.model_of(work.save(quality.trained_trigrams(df, df.select(F.col("doc_id").alias("_id")), work), "t").df(), work)
    flat = unknown.collect()[0].unknown
    rows = spark.createDataFrame([(hash(t), t) for t in asked], "row long, text string").select("row", F.xxhash64(F.lit("en")).alias("lang"), "text")
    got = {r.row: r.logp + r.n_words * flat for r in quality.scores_of(rows, model).collect()}
    bare = lambda t: t.replace(",", "").replace("?", "")
    assert got == pytest.approx({hash(t): kneser_ney_by_hand(texts, bare(t)) for t in asked}, abs=1e-6)


@pytest.mark.parametrize("parts", [1, 8])
def test_quality_by_parts_keeps_no_counts(spark, monkeypatch, parts):
    """The sums are the same in any number of parts; what a part wrote is gone after it."""
    from claimweave.workspace import Workspace, child_names

    made = []
    monkeypatch.setattr(quality, "Workspace", lambda *a, **k: made.append(Workspace(*a, **k)) or made[-1])
    monkeypatch.setattr(quality, "PARTS", parts, raising=False)
    monkeypatch.setattr(quality, "PART_BYTES", 100, raising=False)
    draw = random.Random(4)
    texts = [" ".join(draw.choices(PROSE, k=draw.randint(1, 40))) for _ in range(40)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*texts, texts[0], "", None, "zebra crossing"])], "doc_id long, text string, lang string")
    train = [k for k in range(40) if spark.range(1).select(F.pmod(F.xxhash64(F.lit(k).cast("bigint")), F.lit(quality.FOLDS)).alias("f")).first().f]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    judged = quality.judged(df, labels)
    left = {n.split("-", 1)[1] for n in child_names(spark, made[0].root)}
    assert not left & {"trigrams", "bigrams", "pairs", "contexts2", "contexts3", "model", "words"}
    rows = spark.read.parquet(f"{made[0].root}/*-scores").collect()
    unknown = spark.read.parquet(f"{made[0].root}/*-languages").first().unknown
    expected = {k: kneser_ney_by_hand([texts[i] for i in train], t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.logp for r in rows if r.doc_id < 40} == pytest.approx(expected, abs=1e-6)
    assert unknown < 0 and judged.count() == 44


def test_joins_keep_no_keys_and_vectors(spark, docs, monkeypatch):
    """Components are the same by parts of the keys; points, forests and leaves are gone after them."""
    from claimweave.workspace import Workspace, child_names

    made, found = [], []
    monkeypatch.setattr(jaccard_join, "Workspace", lambda *a, **k: made.append(Workspace(*a, **k)) or made[-1])
    for points in (100_000, 0):
        monkeypatch.setattr(jaccard_join, "PART_POINTS", points, raising=False)
        found.append(sorted(map(str, jaccard_join.components(docs).collect())))
        left = {n.split("-", 1)[1] for n in child_names(spark, made[-1].root)}
        assert not left & {"counts", "points", "forest", "leaves", "boxes"}
    assert found[0] == found[1]


def test_secrets(spark, none):
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(30)]
    rows = [(k, f'some text token = "{x}" and more', "src") for k, x in enumerate(keys)]
    rows += [(100 + k, f"order {10**15 + k * 7919} was shipped", "src") for k in range(30)] + [(200, None, None), (201, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id, r.run) for r in secrets.scanned(df).collect()} == set(enumerate(keys))
    assert secrets.scanned(none).count() == 0


def test_secrets_beside_a_frequent_vector(spark):
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(30)]
    rows = [(k, f'some text token = "{x}" and more', "src") for k, x in enumerate(keys)]
    numbers = spark.createDataFrame([(n, "order " + "7" * n, "src") for n in range(16, 300)], "doc_id long, text string, source string")
    one = secrets.features(secrets.candidates(numbers)).orderBy(F.xxhash64(*secrets.FEATURES)).first().doc_id
    many = spark.range(1_000, 22_000).select(F.col("id").alias("doc_id"), F.lit("order " + "7" * one).alias("text"), F.lit("src").alias("source"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(many)
    assert {(r.doc_id, r.run) for r in secrets.scanned(df).collect()} == set(enumerate(keys))


def test_every_run_of_a_word_is_a_candidate(spark):
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]
    rows = [(k, f'{{"access_token_value":"{keys[k]}","refresh_token_value":"{keys[k + 30]}"}}', "src") for k in range(30)]
    rows += [(100 + k, f"order {10**15 + k * 7919} was shipped", "src") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(k % 30, x) for k, x in enumerate(keys)}
    assert {(r.doc_id, r.run) for r in secrets.candidates(df.filter("doc_id < 100")).collect()} == want
    assert {(r.doc_id, r.run) for r in secrets.scanned(df).collect()} == want


def test_licenses(spark, none):
    mit = "Copyright (c) 2020 A. Person\n\n" + licenses.KNOWN[1][1].replace(" License", " LICENCE").replace(",", " ,")
    rows = [(1, mit), (2, "x\n# Licensed under the Apache Licence, v2.0\ny"), (3, "MIT"), (4, None), (5, ""), (1, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.license) for r in licenses.licensed(df, licenses.known_digests(spark)).collect())
    assert got == [(1, "text", "MIT"), (1, "text", "MIT"), (2, "line", "Apache-2.0")]
    assert licenses.licensed(none, licenses.known_digests(spark)).count() == 0


def test_whole_license_texts(spark):
    files = sorted(licenses.TEXTS.glob("*.txt"))
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0"} <= {f.stem for f in files}
    texts = [(f.stem, f.read_text(errors="replace")) for f in files]
    rows = [(k, "Copyright (c) 2021, Some One. All rights reserved.\n\n" + t.replace("\n", " \r\n  ").upper() + "\n") for k, (_, t) in enumerate(texts)]
    apache = dict(texts)["Apache-2.0"]
    rows += [(100, apache[: apache.index("APPENDIX")]), (101, "BSD 3-Clause License\n\n" + dict(texts)["BSD-3-Clause"]), (102, apache[:-200])]
    got = licenses.licensed(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark)).filter("unit = 'text'")
    want = {(k, n) for k, (n, _) in enumerate(texts)} | {(100, "Apache-2.0"), (101, "BSD-3-Clause")}
    assert {(r.doc_id, r.license) for r in got.collect()} == want


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, docs, none):
    odd = ["a@b.c%x@d.e.f a@@b.c x@y 1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "é😀 4111 1111-1111 1111 41111111111111111111 4111-1111-1111-1111-", "1" * 40_000, "a" * 40_000 + "@b.c", "+49-30-1234567890123456 +1 (234) 555-6666", "4111111111111111  4111111111111111 4111111111111111.4111111111111111"]
    df = docs.select("doc_id", "text", "_row").unionByName(spark.createDataFrame([(900 + k, t, 0) for k, t in enumerate(odd)], "doc_id long, text string, _row long"))
    texts = dict(pairs_of(df))
    rows = pii.personal_data(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base_by_hand(texts[r.doc_id]).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert clean[22] == "[EMAIL] [CARD], [IP], [PHONE]" and clean[0] == texts[0] and clean[12] is None
    assert pii.personal_data(none).count() == 0


def test_personal_data_is_discovered_by_context(spark):
    rows = [(k, f"so write mailto user{k}@mail.example now") for k in range(30)] + [(99, "so write mailto user7-at-mail now"), (98, "we counted user8-at-mail today")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_added for r in found.filter("n_added > 0").collect()} == {99: 1}


def test_personal_data_is_discovered_over_many_hops(spark):
    """Each hop's pattern is sure only once the hop before is known; long and short instances and context words."""
    found = ["id1-at-mail", "z" * 99 + "2", "id3-at-mail", "id4-at-mail", "q5", "id6-at-mail", "id7-at-mail"]
    rows, want = [], set()
    for k in range(len(found)):
        left, right = f"{'w' * 80}hop{chr(97 + k)}", f"stop{chr(97 + k)}"
        inside = [f"user{k}x{i}@mail.example" for i in range(17 if k else 20)] + found[max(0, k - 1) : k + 1]
        for x in inside:
            rows.append((len(rows), f"so {left} {x} {right} then"))
            want |= {rows[-1][0]} if x in found else set()
    # the same end of a longer word is another context
    rows += [(len(rows) + i, f"so v{'w' * 80}hopa {1000 + i} elsewhere then") for i in range(40)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.filter("n_added > 0").collect()} == want


def test_contaminated(spark, docs, none):
    items = [(1, prose(5, 30)), (2, "never seen words of some other test item that nobody wrote down in any text at all"), (3, None), (4, ""), (1, prose(5, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hidden = spark.createDataFrame([(500, "before " + items[1][1].upper().replace(" ", ", ") + " after"), (501, "words of some other test")], "doc_id long, text string")
    hits = decontaminate.contaminated(docs.select("doc_id", "text").unionByName(hidden), bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} >= {(5, 1), (500, 2)}
    assert not {r.doc_id for r in hits} & {0, 12, 13, 14, 501}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.filter("item_id < 0")).count() == 0


def test_contaminated_finds_all_that_is_similar(spark, monkeypatch):
    """Head, tail, cut, lengthened and spread edits against brute force over all runs of words; items in several blocks."""
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 3)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=4))
    items = [[word() for _ in range(n)] for n in (50, 50, 52, 40, 31, 4, 12)]
    items.append(items[0][:20] + [word() for _ in range(25)])  # shares shingles with another one
    texts = [items[0][:-1], items[0][:42], items[1][:43], items[3][4:]]
    for k in (3, 5, 7, 8, 10):
        for it in items[:5]:
            fresh = [word() for _ in range(k)]
            around = [word() for _ in range(9)]
            texts += [around + fresh + it[k:] + around, around + it[:-k] + fresh + around, around + it[:20] + fresh[: k // 2] + it[20:] + around]
    texts += [[word(), *items[5], word()], items[5], items[6][1:], items[7] + items[0]]
    sets = [Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) for x in items]
    df = Counter(g for s in sets for g in s)
    weight = lambda g: 1 + math.log(len(items) / max(1, df[g]))
    want = {}
    for d, x in enumerate(texts):
        grams = [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
        for m, s in enumerate(sets):
            if len(items[m]) < 5:
                if any(x[i : i + 4] == items[m] for i in range(len(x))):
                    want[d, m] = 1.0
                continue
            for i in range(len(grams)):
                run, both, own = Counter(), 0.0, 0.0
                for g in grams[i:] if grams[i] in s else ():
                    run[g] += 1
                    own += weight(g)
                    both += weight(g) if run[g] <= s[g] else 0
                    like = both / (own + sum(c * weight(h) for h, c in s.items()) - both) if g in s else 0
                    if like >= 0.8 - 1e-9:
                        want[d, m] = max(want.get((d, m), 0), like)
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    assert (0, 0) in want and len(want) > 40
    assert got == pytest.approx(want)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert not [t for _, t in pairs_of(docs) if base_by_hand(t)]


def test_personal_data_grows_with_the_matches(spark):
    """20,000 addresses in one text, overlapping kinds among them: blocks give what one walk gives."""
    import time

    draw = random.Random(2)
    odd = ["+1 (234) 555-6666", "4111 1111 1111 1111", "é a@b.c%x", "+4111111111111111 10.0.0.1", "999.1.1.1"]
    for n in (70, 500):
        text = " ".join(draw.choice(odd) if draw.random() < 0.3 else f"ü 10.{i % 250}.{draw.randint(0, 300)}.7" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert pii.personal_data(df).first().base_sha256 == hashlib.sha256(base_by_hand(text).encode()).hexdigest()
        spans = sorted((int(s), -int(e), list(BASE).index(k)) for k, s, e in (x.split(":") for x in pii.personal_data(df).first().spans.split(",")))
        out, at = "", 0
        for s, e, k in spans:
            if s >= at:
                out += text[at:s] + f"[{list(BASE)[k].upper()}]"
            at = max(at, -e)
        assert pii.masked(df).first().text == out + text[at:]
    long = " ".join(f"10.{i % 250}.{i // 250 % 250}.7 and" for i in range(20_000))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    start = time.perf_counter()
    assert pii.personal_data(df).first().n_ip == 20_000
    assert pii.masked(df).first().text == "[IP] and " * 19_999 + "[IP] and"
    assert time.perf_counter() - start < 90


AWKWARD = "_id long, _row string, base string, spans string, extra string, _h long, _doc string, _text string, clean string, doc_id long, text string, lang string, source string, n_chars long"


def test_no_stage_touches_other_columns(spark):
    """Columns named like working ones come back as they were, in every stage that returns documents."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = {n.split()[0]: n.split()[1] for n in AWKWARD.split(", ") if n.split()[0] not in docs.columns}
    docs = docs.select(*[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) if t == "string" else (F.col("doc_id") + k).alias(n) for k, (n, t) in enumerate(extra.items())], "*")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema == docs.schema or name == "personal data" and out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            for c in out.columns:
                assert name == "personal data" and c in ("text", "n_chars") or r[c] == before[r.doc_id][c], (name, c)


def test_components_of_chains_hubs_and_repeated_links(spark):
    from claimweave.llm.jaccard_join import connected
    from claimweave.workspace import Workspace

    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(200, 260)]
    hub = [(500, 500 + i) for i in range(1, 80)] + [(900 + i, 500 + i) for i in range(5)]
    loose = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    links = chain + hub + loose + chain[:7] + [(b, a) for a, b in hub[:9]] + [(7, 7)]
    smallest = {n: n for pair in links for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(smallest[a], smallest[b])
            changed |= smallest[a] != low or smallest[b] != low
            smallest[a] = smallest[b] = low
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = [tuple(r) for r in connected(spark.createDataFrame(links, "a bigint, b bigint"), Workspace(spark)).collect()]
    assert sorted(got) == sorted((n, smallest[n]) for n in linked)
    assert connected(spark.createDataFrame([], "a bigint, b bigint"), Workspace(spark)).count() == 0


def test_jaccard_join_of_long_texts(spark):
    """Long texts of one vocabulary: some share half their passages, some are near copies."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (3000, 3000, 2600, 700)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for changes in (4, 30, 200):
            copy = list(b)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(b[: len(b) // 2] + base[0][: len(b) // 2]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for like in (jaccard_join.Similar(), jaccard_join.Similar(3, 9, 10)):
        want, _ = components_by_hand(rows, like)
        assert len({c for *_, c in want}) < len(want)
        assert sorted(map(tuple, jaccard_join.components(df, like).collect())) == want


def test_finer_vectors_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 1), (1, 900, 1), (64, 70, 30), (500, 4000, 450), (3000, 2900, 2800), (2000, 2000, 0)):
        every = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64) * np.uint64(2))
        every = rng.permutation(every)
        s, t = np.sort(every[:n]), np.sort(every[n - both : n - both + m])
        bound = jaccard_join._least_common(jaccard_join.fine_vector(s), n, jaccard_join.fine_vector(t), m)
        assert bound >= len(np.intersect1d(s, t)) == both
        assert bound <= min(n, m)
    same = np.sort(np.concatenate([np.arange(400, dtype=np.uint64), np.uint64(1) << np.arange(40, 63, dtype=np.uint64)]))
    assert jaccard_join._least_common(jaccard_join.fine_vector(same), len(same), jaccard_join.fine_vector(same), len(same)) == len(same)


@pytest.mark.parametrize("most", [1, 2, 1 << 18])
def test_bit_table_keeps_all_wanted_rows(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "MOST_WORDS", most)
    rows = spark.range(5000).withColumn("extra", F.lit("x"))
    wanted = rows.filter("id % 97 = 3").select("id")
    found = jaccard_join.among(rows, "id", wanted, wanted.count())
    assert found.columns == rows.columns
    ids = [r.id for r in found.collect()]
    assert len(ids) == len(set(ids)) and set(ids) >= {r.id for r in wanted.collect()}
    assert most < 9 or len(ids) < 1000
    assert jaccard_join.among(rows, "id", wanted.limit(0), 0).count() == 0
