"""Keys of one point go no further, leaves met before are passed over, rows that stay do not move."""

import random

import numpy as np

from claimweave.llm import jaccard_join


def test_keys_of_one_point_go_no_further(spark):
    draw = random.Random(5)
    points = [(k, [draw.choice([draw.randint(-(1 << 63), (1 << 63) - 1), *range(-3, 3), (1 << 62) + 5]) for _ in range(draw.randint(0, 4))]) for k in range(300)]
    points = [(k, sorted(set(keys))) for k, keys in points]
    owners = {}
    for k, keys in points:
        for key in keys:
            owners.setdefault(key, []).append(k)
    want = sorted((key, k) for key, ks in owners.items() if len(ks) > 1 for k in ks)
    reps = spark.createDataFrame(points, "node bigint, keys array<bigint>")
    for n in (300, 2_000_000):
        assert sorted(map(tuple, jaccard_join.shared_keys(reps.repartition(5), n).collect())) == want


def test_linked_texts_meet_once_a_task():
    """A leaf of the same points under another key brings nothing new; one of other points does."""
    import pyarrow as pa

    vec = jaccard_join._packed(np.bincount([k % 64 for k in range(70)], minlength=64))
    nodes = [1, 2, 1, 2, 1, 3, 1, 2, 4]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0, 5, 5, 6, 6, 7, 7, 9], pa.int64()), pa.array(nodes, pa.int64()), pa.array([70] * 9, pa.int64()), pa.array([vec] * 9, pa.binary())],
        names=["key", "node", "n", "vec"],
    )
    rows = [tuple(r.values()) for b in jaccard_join._forest(jaccard_join.Similar())(iter([batch])) for r in b.to_pylist()]
    # key 0 may go on in another task, keys 5 and 7 are of the same points
    assert [r for r in rows if r[1] is not None] == [(1, 2, None), (1, 2, None), (1, 3, None)]


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (3, text), (3, text), (8, "some other words here and there"), (8, "some other words here and there"), (None, "a text of nobody at all"), (9, None), (9, None), (2, "alone")]
    docs = spark.createDataFrame([(a, b, f"x{i}") for i, (a, b) in enumerate(rows)], "doc_id int, text string, _word string")
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.near_duplicates_removed(docs).collect()), key=str)
    assert got == sorted([(3, text), (8, rows[3][1]), (None, rows[5][1]), (9, None), (2, "alone")], key=str)
