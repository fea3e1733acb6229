"""Writes, batches, snapshots, dumps and backups."""

import threading

import pytest
from pyspark.sql import functions as F

from keyloom import AlreadyExists, Batch, Catalog, IndexDef, NotFound, Point, Points, SyncBatch, TableDef, desc
from keyloom.functions.keyfilter import KeyFilter
from keyloom.operators.merge import SEQ
from keyloom.sources import backup
from keyloom.sources.kv import KeyValues, user_key
from keyloom.sources.profiles import profile
from pyspark.sql.types import LongType, StringType, StructType

SCHEMA = StructType().add("id", LongType()).add("name", StringType()).add("n", LongType())
DEF = TableDef("tokens", 1, SCHEMA, ["id"], (IndexDef("by_name", 1, ["name"], [desc("n")]),))


@pytest.fixture
def table(spark, tmp_path):
    return Catalog(spark, f"{tmp_path}/store", buckets=4).table(DEF)


def rows(t, batch=None):
    return [tuple(r) for r in t.scan(batch=batch).collect()]


def test_insert(table):
    table.insert([(1, "a", 5), {"id": 2, "name": "b", "n": 6}])
    assert rows(table) == [(1, "a", 5), (2, "b", 6)]
    for bad in ([(3, "c", 1), (1, "x", 0)], [(4, "d", 1), (4, "e", 1)]):
        with pytest.raises(AlreadyExists):
            table.insert(bad)
    assert len(rows(table)) == 2
    table.insert([])
    assert len(rows(table)) == 2


def test_update_and_delete(table):
    table.insert([(k, "a", k) for k in range(10)])
    table.update([(1, "b", 7), (2, "b", 8), (1, "c", 9)])
    assert rows(table)[1:3] == [(1, "c", 9), (2, "b", 8)]
    with pytest.raises(NotFound):
        table.update([(1, "z", 0), (99, "z", 0)])
    table.delete([{"id": 1}, {"id": 77}])
    assert [r[0] for r in rows(table)] == [0, *range(2, 10)]
    assert [r.id for r in table.scan_index("by_name", Point(name="a")).collect()] == [9, 8, 7, 6, 5, 4, 3, 0]


def add(old, new):
    return {"n": old.n + new.n}


def test_upsert(table):
    table.insert([(1, "a", 5)])
    table.upsert([(1, "b", 7), (1, "c", 7), (2, "d", 15)], add)
    assert rows(table) == [(1, "c", 19), (2, "d", 15)]
    table.upsert([(2, "x", 1), (3, "y", 1), (3, "z", 2)], {"n": "sum", "name": "min"})
    assert rows(table)[1:] == [(2, "d", 16), (3, "y", 3)]
    table.upsert([(3, "r", 0), (3, "s", 1)])
    assert rows(table)[2] == (3, "s", 1)
    with pytest.raises(ValueError):
        table.upsert([(1, "a", 1)], lambda old, new: {"id": new.id})
    for wrong in ({"n": "summ"}, {"m": "sum"}, {"id": "sum"}, "summ"):
        with pytest.raises(ValueError, match="no rules"):
            table.upsert([(1, "a", 1)], wrong)


def test_upsert_keeps_the_order_of_a_frame(spark, table):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("id"), F.col("id").cast("string").alias("name"), F.col("id").alias("n")).withColumn(SEQ, F.col("n"))
    table.upsert(df)
    assert rows(table) == [(1, "999", 999)]


def test_unsafe(table):
    table.insert([(1, "a", 1)])
    table.unsafe_insert([(1, "b", 2), (2, "c", 3)])
    assert rows(table) == [(1, "b", 2), (2, "c", 3)]
    table.unsafe_update([(2, "d", 4)], [(2, "c", 3)])
    assert rows(table)[1] == (2, "d", 4)
    with pytest.raises(ValueError):
        table.unsafe_update([(2, "d", 4)], [])
    table.unsafe_update(iter([(2, "from an iterator", 5)]), iter([(2, "d", 4)]))
    assert rows(table)[1] == (2, "from an iterator", 5)


def test_reads(table):
    table.insert([(k, "a", k) for k in (1, 2, 3)])
    assert table.get_point({"id": 2}).n == 2
    assert table.exist({"id": 2}) and not table.exist({"id": 9})
    assert [r.id for r in table.get(Points({"id": 3}, {"id": 9}, {"id": 1})).collect()] == [3, None, 1]
    assert table.get(Point(id=3)).count() == 1
    for f in (lambda: table.get(Point(id=9)), lambda: table.get_point({"id": 9})):
        with pytest.raises(NotFound):
            f()
    seen = []
    table.scan_for_each(lambda r: seen.append(r.id) or len(seen) < 2)
    assert seen == [1, 2]
    assert [r.id for r in table.iterate("by_name", Point(name="a"))] == [3, 2, 1]


def test_only_touched_buckets_are_rewritten(table):
    table.insert([(k, "a", k) for k in range(100)])
    before = table.catalog.state["tables"]["tokens"]["parts"]
    table.update([(5, "b", 5)])
    after = table.catalog.state["tables"]["tokens"]["parts"]
    assert after[0]["path"] == before[0]["path"] and len(after[0]["live"]) == 3 and len(after[1]["live"]) == 1
    assert table.df().count() == 100
    table.catalog.compact()
    assert len(table.catalog.state["tables"]["tokens"]["parts"]) == 1 and table.df().count() == 100
    assert len(table.catalog.vacuum()) == 2 and table.df().count() == 100


def test_batches(table):
    cat, calls = table.catalog, []
    b = Batch(cat)
    b.on_commit(lambda _: calls.append("commit"))
    b.on_committed(lambda _: calls.append("committed"))
    b.on_close(lambda _: calls.append("close"))
    table.insert([(1, "a", 1)], b)
    table.update([(1, "b", 2)], b)
    table.insert([(2, "c", 3)], b)
    table.delete([{"id": 2}], b)
    assert rows(table) == [] and rows(table, b) == [(1, "b", 2)]
    with pytest.raises(AlreadyExists):
        table.insert([(1, "x", 1)], b)
    b.commit()
    b.close()
    assert rows(table) == [(1, "b", 2)] and calls == ["commit", "committed", "close"] and b.empty
    version = cat.version
    Batch(cat).commit()
    assert cat.version == version
    failing = Batch(cat)
    failing.on_commit(lambda _: 1 / 0)
    failing.on_error(lambda _, e: calls.append(type(e).__name__))
    table.delete([{"id": 1}], failing)
    with pytest.raises(ZeroDivisionError):
        failing.commit()
    assert rows(table) == [(1, "b", 2)] and calls[-1] == "ZeroDivisionError"
    outer, inner = Batch(cat), Batch(cat, readable=False)
    inner.on_committed(lambda _: calls.append("inner"))
    table.insert([(7, "q", 7)], inner)
    with pytest.raises(ValueError):
        table.df(inner)
    outer.apply(inner)
    assert outer.count() == 1 and calls[-1] != "inner"
    outer.commit()
    assert table.exist({"id": 7}) and calls[-1] == "inner"
    sync, n = SyncBatch(Batch(cat)), []
    threads = [threading.Thread(target=lambda: sync.with_sync(lambda x: n.append(x.id))) for _ in range(5)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(n) == 5 and len(set(n)) == 1


def test_catalog(spark, tmp_path, table):
    table.insert([(1, "a", 1)])
    again = Catalog(spark, f"{tmp_path}/store")
    assert again.tables() == ["tokens"] and rows(again.table(DEF)) == [(1, "a", 1)]
    for bad in (TableDef("other", 1, SCHEMA, ["id"]), TableDef("tokens", 2, SCHEMA, ["id"]), TableDef("tokens", 1, SCHEMA, ["name"])):
        with pytest.raises(ValueError):
            again.table(bad)
    closed = []
    again.on_close(lambda: closed.append(1))
    with again:
        pass
    assert closed == [1]
    with pytest.raises(RuntimeError):
        again.table(DEF)
    table.catalog.publish({**table.catalog.state, "format_version": 99})
    with pytest.raises(ValueError):
        Catalog(spark, f"{tmp_path}/store")


def test_projection(table):
    table.insert([(1, "a", 1), (2, "a", 2)])
    with pytest.raises(NotFound):
        table.projection("by_name")
    table.reindex()
    assert [tuple(r) for r in table.projection("by_name").collect()] == [("a", 2, 2), ("a", 1, 1)]
    table.add_index(IndexDef("n", 2, ["n"]))
    assert [r.id for r in table.scan_index("n", Point(n=2)).collect()] == [2]


def test_dump_and_restore(spark, tmp_path, table):
    other = table.catalog.table(TableDef("tokens_1", 2, SCHEMA, ["id"]))
    table.insert([(1, "a", 1)])
    other.insert([(2, "b", 2)])
    table.catalog.dump(f"{tmp_path}/dump")
    to = Catalog(spark, f"{tmp_path}/to")
    to.restore(f"{tmp_path}/dump", ["tokens"])
    assert to.tables() == ["tokens"] and rows(to.table(DEF)) == [(1, "a", 1)]
    with pytest.raises(ValueError):
        to.restore(f"{tmp_path}/dump", ["none"])


def test_key_values(spark, tmp_path):
    kv = KeyValues(Catalog(spark, f"{tmp_path}/kv"))
    for k in (b"a", b"b", b"b\xff", b"c"):
        kv.set(k, k.upper())
    assert kv.get(b"b") == b"B"
    assert [bytes(r.key) for r in kv.range(b"b", b"c").collect()] == [b"b", b"b\xff"]
    kv.delete_range(b"b", b"c")
    assert [bytes(r.key) for r in kv.range(reverse=True).collect()] == [b"c", b"a"]
    kv.delete(b"a")
    with pytest.raises(NotFound):
        kv.get(b"a")
    assert user_key(b"a", b"b") != user_key(b"ab", b"")


def test_key_filter(spark, tmp_path):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    f = KeyFilter.build(keys.where("id < 1000") if "id" in keys.columns else keys.limit(1000), ["key"], 300, 0.01, 5)
    f = KeyFilter.build(keys, ["key"], 500, 0.01, 5)
    assert f.may_contain(keys).where("NOT may_contain").count() == 0
    other = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert f.probe(other).where("may_contain").count() < 80
    assert f.stats.asked == 2000 and f.stats.absent > 1900
    f.save(f"{tmp_path}/filter")
    f.add(other.limit(1))
    assert f.pending_buckets() == 1
    f.save(f"{tmp_path}/filter")
    g = KeyFilter.load(spark, f"{tmp_path}/filter", 5)
    assert g.may_contain(keys.unionByName(other.limit(1))).where("NOT may_contain").count() == 0
    with pytest.raises(ValueError):
        KeyFilter.load(spark, f"{tmp_path}/filter", 6)


def test_backups(spark, tmp_path, table):
    b = backup.Backups(table.catalog.files, f"{tmp_path}/backups")
    with pytest.raises(LookupError):
        b.restore_set()
    table.insert([(k, "a", k) for k in range(20)])
    first = b.backup(table.catalog, "complete", "2026-01-01")
    table.update([(1, "b", 1)])
    second = b.backup(table.catalog, "incremental", "2026-01-02")
    assert 1 < len(second.files) < len(second.state) and second.seq == 1
    table.delete([{"id": 2}])
    b.backup(table.catalog, "incremental", "2026-01-03")
    assert [x.seq for x in b.restore_set()] == [0, 1, 2] and [x.seq for x in b.restore_set("2026-01-02T10:00:00")] == [0, 1]
    b.restore(f"{tmp_path}/r1", "2026-01-02")
    old = Catalog(spark, f"{tmp_path}/r1").table(DEF)
    assert old.df().count() == 20 and old.get_point({"id": 1}).name == "b"
    with pytest.raises(FileExistsError):
        b.restore(f"{tmp_path}/r1")
    elsewhere = Catalog(spark, f"{tmp_path}/other")
    with pytest.raises(backup.ChainBroken):
        b.backup(elsewhere, "incremental", "2026-01-04")
    b.files.write(f"{b.folder}/20260105000000-incremental-00003/x", b"")
    assert b.incomplete() == ["20260105000000-incremental-00003"] and b.remove_incomplete()
    nonce = b._lock()
    with pytest.raises(backup.Locked):
        b.backup(table.catalog, "complete", "2026-01-06")
    b._unlock(nonce)
    b.backup(table.catalog, "complete", "2026-01-07")
    with pytest.raises(backup.ChainBroken):
        b.delete([first.name])
    assert b.delete(older_than="2026-01-05") and [x.kind for x in b.list()] == ["complete"]
    b.files.delete(f"{b.folder}/{b.list()[0].name}/_CURRENT")
    with pytest.raises(backup.Corrupt):
        b.restore(f"{tmp_path}/r2")
    with pytest.raises(backup.Corrupt):
        backup._safe("a/../b")
    assert backup.parse_name("20260102030405-complete-00007")[1:] == ("complete", 7)


def test_retries():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        backup.retried(fails, 3, 1, 3, waits.append)
    assert len(calls) == 4 and waits == [1, 2, 3]


def test_streams(spark, tmp_path, table):
    from keyloom.streaming import delete_stream, upsert_stream

    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    upsert_stream(stream, table, f"{tmp_path}/p1", {"n": "sum"}).awaitTermination()
    assert rows(table) == [(1, "a", 1), (2, "b", 2)]
    spark.createDataFrame([(2, "c", 5)], SCHEMA).write.mode("append").parquet(src)
    upsert_stream(stream, table, f"{tmp_path}/p1", {"n": "sum"}).awaitTermination()
    assert rows(table) == [(1, "a", 1), (2, "c", 7)]
    delete_stream(stream, table, f"{tmp_path}/p2").awaitTermination()
    assert rows(table) == []


def test_profiles():
    assert int(profile("high", 10**14)["spark.sql.shuffle.partitions"]) > 500_000
    assert "spark.sql.shuffle.partitions" not in profile("low")
