import json
import os
import socket
import threading
import time

import pytest

from lexigrove.operators import facets
from lexigrove.plans.engine import SearchEngine
from lexigrove.sources import store
from lexigrove.sources.files import Files
from lexigrove.sources.lock import Lock, LockTimeout
from lexigrove.sources.store import Store
from lexigrove.streaming.ingest import ingest

SCHEMA = "name string, size int"


@pytest.fixture
def engine(spark, tmp_path):
    e = SearchEngine(spark).open(str(tmp_path / "index"), SCHEMA)
    yield e
    e.close()


def names(df):
    return [r["name"] for r in df.collect()]


def test_lifecycle(engine):
    assert engine.count() == 0 and engine.fragmentation_rate() == 0 and names(engine.search("red")) == []
    assert engine.insert_bulk([{"name": "red ring", "size": 1}, {"name": "blue ring"}, {"name": "green bolt", "size": 3}]) == [0, 1, 2]
    assert engine.insert({"name": "red bolt"}) == 3
    assert set(names(engine.search("red", limit=1))) <= {"red ring", "red bolt"}
    engine.delete(0)
    engine.delete([0, 0])
    assert engine.count() == 3 and engine.fragmentation_rate() == 25
    assert "red ring" not in names(engine.search("red ring"))
    assert names(engine.get(2)) == ["green bolt"] and names(engine.get(0)) == names(engine.get(77)) == []
    new = engine.update(1, {"name": "violet ring"})
    assert new == 4 and engine.count() == 3
    assert names(engine.search("violet", limit=1)) == ["violet ring"] and "blue ring" not in names(engine.search("blue"))
    before = engine.search("ring bolt").count()
    engine.compact()
    assert engine.count() == 3 and engine.fragmentation_rate() == 0 and engine.search("ring bolt").count() == before
    assert sorted(r.doc_id for r in engine.store.index().documents.collect()) == [2, 3, 4]  # ids stay
    assert engine.insert({"name": "last"}) == 5
    engine.reset()
    assert engine.count() == 0 and engine.insert({"name": "again"}) == 0


def test_reopen_and_deleted_statistics(spark, engine):
    engine.insert_bulk([{"name": "red"}, {"name": "reds"}])
    engine.delete(1)
    again = SearchEngine(spark).open(engine.store.path)
    stats = again.store.index().stats.first()
    assert (again.count(), stats.n, stats.trigram_sum) == (1, 2, 7)
    again.compact()
    stats = again.store.index().stats.first()
    assert (stats.n, stats.trigram_sum) == (1, 3)


def test_order_and_ids(spark, engine):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("concat('n', id) AS name", "int(1000 - id) AS size")
    ids = engine.insert_bulk(df, ["size"])
    rows = engine.store.index().documents.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(1000)) == [r.doc_id for r in ids.collect()]
    assert [r.size for r in rows] == sorted(r.size for r in rows)


def test_what_a_crash_leaves_is_swept(spark, engine):
    engine.insert({"name": "red"})
    left = os.path.join(engine.store.path, "segment-dead")
    os.makedirs(left)
    again = SearchEngine(spark).open(engine.store.path)
    assert os.path.exists(left) and names(again.search("red")) == ["red"]  # readers delete nothing
    again.delete(7)
    assert not os.path.exists(left) and names(again.search("red")) == ["red"]


def test_readers_keep_their_version(spark, engine):
    engine.insert({"name": "red"})
    index, reader = engine.store.index(), SearchEngine(spark).open(engine.store.path)
    engine.insert({"name": "red two"})
    engine.delete(0)
    engine.compact()
    assert [r.name for r in index.documents.collect()] == ["red"] and index.postings.count() == 3
    assert names(reader.search("red")) == ["red two"]  # the newest
    engine.reset()
    assert index.documents.count() == 1 and names(reader.search("red")) == []


def test_old_versions_go(engine, monkeypatch):
    monkeypatch.setattr(store, "KEEP_SECONDS", 0)
    for i in range(6):
        engine.insert({"name": f"red {i}"})
        engine.compact()
    kept = [n for n in os.listdir(engine.store.path) if n.startswith("segment-")]
    assert len(kept) <= store.KEEP + 1 and len(engine.store._versions()) <= store.KEEP + 1
    assert engine.search("red").count() == 6


def test_segments_of_a_size_merge(engine, monkeypatch):
    monkeypatch.setattr(store, "FAN", 3)
    for i in range(10):
        assert engine.insert({"name": f"red {i}"}) == i
    assert sorted(s["n"] for s in engine.store.state["segments"]) == [1, 9]
    engine.delete(4)
    assert engine.search("red").count() == 9 and engine.store.index().corpus()[0] == 10
    assert sorted(r.doc_id for r in engine.store.index().forward.collect()) == list(range(10))


def test_opening_during_a_write(spark, engine):
    engine.insert({"name": "red"})
    with engine.store.lock:
        reader = SearchEngine(spark).open(engine.store.path, lock_timeout=0.1)
        assert names(reader.search("red")) == ["red"] and reader.count() == 1
        with pytest.raises(LockTimeout):
            reader.delete(0)


def test_other_file_systems(spark, tmp_path, monkeypatch):
    """What a file system without directories of its own on this machine takes: its lock is a file."""
    monkeypatch.setattr(Files, "local", None)
    engine = SearchEngine(spark).open(f"file://{tmp_path}/index", SCHEMA, lock_timeout=0.2)
    assert engine.insert_bulk([{"name": "red"}, {"name": "blue"}]) == [0, 1]
    engine.update(1, {"name": "red two"})
    engine.compact()
    assert sorted(names(engine.search("red"))) == ["red", "red two"]
    other = SearchEngine(spark).open(f"file://{tmp_path}/index", lock_timeout=0.2)
    with engine.store.lock:
        with pytest.raises(LockTimeout):
            other.delete(0)
        engine.store.files.write(".lock", "999999999\nsome-other-host\n")  # not ours to judge
        with pytest.raises(LockTimeout):
            other.delete(0)
        engine.store.files.write(".lock", f"999999999\n{socket.gethostname()}\n")  # a dead owner's
        other.delete(0)
    assert other.count() == 1


def test_closed_and_bad_indexes(spark, tmp_path, engine):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        SearchEngine(spark).open(engine.store.path, "other string")
    files, state = engine.store.files, engine.store.state
    files.write("manifest-000000000009.json", json.dumps(state | {"format_version": 9}))
    with pytest.raises(ValueError):
        SearchEngine(spark).open(engine.store.path)
    files.delete("manifest-000000000009.json")
    engine.close()
    engine.close()
    with pytest.raises(RuntimeError):
        engine.search("x")


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with Lock(path), pytest.raises(LockTimeout):
        Lock(path, 0.1).acquire()
    assert not os.path.exists(path)
    with pytest.raises(KeyError), Lock(path):
        raise KeyError
    assert not os.path.exists(path)
    first = Lock(path)
    first.acquire()
    threading.Timer(0.3, first.release).start()
    began = time.monotonic()
    with Lock(path, 5):
        assert time.monotonic() - began > 0.2
    os.mkdir(path)
    open(os.path.join(path, "pid"), "w").write("999999999")
    with Lock(path, 0.5):  # a dead owner's
        pass
    os.mkdir(path)
    open(os.path.join(path, "pid"), "w").write("999999999\nelsewhere\n")
    with pytest.raises(LockTimeout):  # another host's, which may be alive
        Lock(path, 0.2).acquire()
    open(os.path.join(path, "pid"), "w").write(f"{os.getpid()}\n{socket.gethostname()}\n1")
    with Lock(path, 0.5):  # a process of this number began at another time
        pass


def test_stream(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("red", 1), ("blue", 2)], SCHEMA).write.parquet(source)
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest(stream, engine, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert engine.count() == 2
    spark.createDataFrame([("green", 1)], SCHEMA).write.mode("append").parquet(source)
    ingest(spark.readStream.schema(SCHEMA).parquet(source), engine, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert engine.count() == 3


def test_product_page(spark, tmp_path):
    fields = "name string, category string, brand string, gender string, promo int, price double, stock int, active boolean"
    rows = [("red shoe", "shoes", "Acme", "f", -10, 10.5, 3, True), ("red boot", "boots", "Acme", None, None, 20.25, 1, True), ("red sock", "socks", "Bolt", "m", -15, 3.0, 0, True), ("red hat", "hats", "Bolt", "m", -20, 99.0, 5, False), ("red bag", "shoes", "Cord", "f", -50, None, 2, True)]
    engine = SearchEngine(spark).open(str(tmp_path / "shop"), fields)
    engine.insert_bulk(spark.createDataFrame(rows, fields), ["name"])
    page = facets.response(lambda f, n: engine.search("red", n, filters=f), facets.product_filters(category=["shoes"], price_min=5.0))
    assert page["total"] == 1 and page["results"][0]["name"] == "red shoe"
    assert page["facets"]["category"] == {"boots": 1, "shoes": 1} and page["facets"]["brand"] == {"Acme": 1}
    assert page["facets"]["promo"] == {"on_sale": 1, "full_price": 0} and page["facets"]["price"] == {"min": 0.0, "max": 10.5}


def test_what_is_empty_in_a_form_does_not_filter():
    given = facets.product_filters(category=[], brand=None, gender="", promo=False, price_max=0.0)
    assert {k for k, v in given.items() if v} == {"price"}
