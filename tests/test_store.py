"""The store's log: failed attempts, versions, replacement, folding."""

import time

import pytest
from graphs import claims, frame, graph, rows

from claimweave.sources import store as stores
from claimweave.sources.store import GraphStore
from claimweave.workspace import Workspace, child_names


@pytest.fixture
def store(spark):
    return GraphStore(spark, Workspace(spark).path("store"))


def cids(graph_):
    return [r[0] for r in rows(graph_.claims, "cid")]


def test_a_failed_second_attempt_leaves_the_first_whole(spark, store, monkeypatch):
    store.commit("one", claims(spark, [("a", "p", "b"), ("a", "p", ("lit", "x"))]))
    reader = store.graph()
    other = claims(spark, [("z", "p", "y")], seq=7, start=50)
    real = GraphStore._write
    for broken in ("values", "txs"):

        def fail(self, df, table, folder, broken=broken):
            if table == broken:
                raise RuntimeError("executor lost")
            real(self, df, table, folder)

        monkeypatch.setattr(GraphStore, "_write", fail)
        with pytest.raises(RuntimeError):
            store.commit("one", other)
        monkeypatch.setattr(GraphStore, "_write", real)
        assert cids(store.graph()) == ["c:1", "c:2"] and store.graph().values.count() == 1
    # claims that cannot be computed
    with pytest.raises(Exception):
        store.commit("one", other.selectExpr("*", "1 AS x").withColumn("l", other.l + "").selectExpr("cid", "raise_error('no') AS l", "p", "r", "tx_id", "tx_seq", "ord"))
    assert cids(store.graph()) == ["c:1", "c:2"]
    # a reader of the first attempt still reads it while the second one takes its place
    store.commit("one", other)
    assert cids(store.graph()) == ["c:50"] and cids(reader) == ["c:1", "c:2"]
    assert rows(store.graph().txs, "seq") == [(7,)]


def test_versions_stay_as_they_were(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "TAIL", 3)
    monkeypatch.setattr(stores, "MERGE", 2)
    seen = {}
    for k in range(1, 9):
        batch = "again" if k in (2, 6) else f"b{k}"
        store.commit(batch, claims(spark, [("a", f"p{k % 2}", f"x{k}")], seq=k, start=k))
        seen[store.manifest().version] = cids(store.graph())
    assert list(seen.values())[-1] == [f"c:{k}" for k in (1, 3, 4, 5, 6, 7, 8)]
    for version, want in seen.items():
        assert cids(store.graph(version=version)) == want
    assert store.graph(version=0).claims.count() == 0


def test_replacing_a_batch_inside_a_merged_folder(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "TAIL", 4)
    monkeypatch.setattr(stores, "MERGE", 4)
    for k in range(4):
        store.commit(f"b{k}", claims(spark, [("a", "p", ("lit", f"x{k}"))], seq=k + 1, start=k))
    now = store.manifest()
    assert len(now.folders) == 1 and now.checkpoint == now.version
    store.commit("b1", claims(spark, [("a", "p", ("lit", "other"))], seq=9, start=90))
    assert cids(store.graph()) == ["c:0", "c:2", "c:3", "c:90"]
    assert rows(store.graph().values, "lit") == [("other",), ("x0",), ("x2",), ("x3",)]
    assert rows(store.graph().txs, "seq") == [(1,), (3,), (4,), (9,)]
    assert store.folder_of("b1") != store.folder_of("b0") == store.folder_of("b3")
    assert store.folder_of("b7") is None and store.latest_seq("b1") == 4
    monkeypatch.setattr(stores, "MOST_HIDDEN", 0)
    for k in range(5, 9):
        store.commit(f"b{k}", claims(spark, [("a", "p", "y")], seq=k + 1, start=k))
    assert not any(f.hidden for f in store.manifest().folders.values())
    assert cids(store.graph()) == sorted(f"c:{k}" for k in (0, 2, 3, 90, 5, 6, 7, 8))


def test_an_unfinished_checkpoint_does_not_count(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "TAIL", 2)
    store.commit("a", claims(spark, [("a", "p", "b")]))
    monkeypatch.setattr(GraphStore, "_checkpoint", lambda self, now: self._batches(now).write.parquet(f"{self.root}/checkpoint/upto={now.version}/batches"))
    store.commit("b", claims(spark, [("a", "p", "c")], seq=2, start=2))
    monkeypatch.undo()
    assert cids(store.graph()) == ["c:1", "c:2"] and store.manifest().checkpoint == 0
    store.commit("c", claims(spark, [("a", "p", "d")], seq=3, start=3))
    assert cids(store.graph()) == ["c:1", "c:2", "c:3"]


def test_many_batches_keep_few_folders_and_a_short_tail(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "TAIL", 5)
    monkeypatch.setattr(stores, "MERGE", 4)
    seconds = []
    for k in range(30):
        start = time.perf_counter()
        store.commit(f"stream-{k}", claims(spark, [("a", "p", f"x{k}")], seq=k + 1, start=k))
        now = store.manifest()
        seconds.append(time.perf_counter() - start)
        assert now.n_tail < 5 + 4 and len(now.folders) <= 4 * 5
    assert store.graph().claims.count() == 30 and store.graph().txs.count() == 30
    assert len(child_names(spark, f"{store.root}/log")) <= 30 // 5 + 1
    assert sorted(seconds[20:])[5] < 4 * sorted(seconds[:10])[5]


def test_rules_are_read_from_the_folders_that_have_some(spark, store):
    store.commit("a", claims(spark, [("a", "p", "b")]))
    assert store.graph().rules.count() == 0
    rules = frame(spark, [("r", "h", "text", True, None)], "rule_id string, head_rel string, source string, live boolean, replaced_by string")
    store.commit("b", graph(spark, [("a", "p", "c")], 2, 9).claims, rules=rules)
    assert rows(store.graph().rules, "rule_id") == [("r",)]
