import threading

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom import IndexDef, Table, TableDef, cond
from keyloom.functions.keys import KeyBuilder, decode_key, encode_key, sort_key
from keyloom.functions.sequence import NumberSequence, sequence_number
from keyloom.inspection import Inspect
from keyloom.inspection.cli import main
from keyloom.inspection.server import Client, serve


def test_cond(spark):
    df = spark.createDataFrame([(5, 1.0, "a"), (6, float("nan"), None), (None, None, "b")], "i int, d double, s string")
    n = lambda c: df.filter(c).count()
    assert [n(f("i", 5)) for f in (cond.eq, cond.gt, cond.gte, cond.lt, cond.lte)] == [1, 1, 2, 0, 1]
    assert [n(f("d", 0.5)) for f in (cond.eq, cond.gt, cond.gte, cond.lt, cond.lte)] == [0, 1, 1, 0, 0]
    assert n(cond.eq("s", None)) == 1
    assert n(cond.and_()) == 3 and n(cond.or_()) == 0
    assert n(cond.and_(cond.gt("i", 4), cond.eq("s", "a"))) == 1 and n(cond.or_(cond.eq("i", 6), cond.eq("s", "b"))) == 2
    assert n(cond.not_(cond.gt("i", 5))) == 2
    assert n(cond.func(lambda r: r["i"] == 6, "i")) == 1


def test_key_bytes():
    k = lambda: KeyBuilder()
    assert [k().int16(v).bytes().hex() for v in (10, 0, -10)] == ["0102000a", "01010000", "0100fff5"]
    assert k().string("abc").bytes() == b"\x01abc" and k().byte(0xF1).bytes() == b"\x01\xf1" and k().binary(b"\xf1\x1f").bytes() == b"\x01\xf1\x1f"
    assert [k().big_int(v, 32).bytes().hex() for v in (1, 0, -1)] == ["010200000001", "010100000000", "0100fffffffe"]
    assert k().uint16(1).uint32(2).uint64(3).bytes().hex() == "0100010200000002030000000000000003"
    with pytest.raises(OverflowError):
        k().big_int(2**40, 32)
    parts = (1, 2, b"ix", b"order", b"pk")
    assert decode_key(encode_key(*parts)) == parts
    with pytest.raises(ValueError):
        decode_key(b"short")


@given(st.integers(-(2**63) + 1, 2**63 - 1), st.integers(-(2**63) + 1, 2**63 - 1))
def test_key_order(a, b):
    assert (KeyBuilder().int64(a).bytes() < KeyBuilder().int64(b).bytes()) == (a < b)


def test_sort_key(spark):
    v = [-(2**63), -5, -1, 0, 1, 77, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in reversed(v)], "x bigint")
    assert [r.x for r in df.orderBy(sort_key("x")).collect()] == v


def test_sequence(spark):
    s = NumberSequence(lambda: 1000.9)
    drawn = [s.next() for _ in range(5)]
    assert sorted(set(drawn)) == drawn and {s.timestamp(x) for x in drawn} == {1000} and [s.number(x) for x in drawn] == [1, 2, 3, 4, 5]
    assert spark.createDataFrame([(drawn[2],)], "x bigint").select(sequence_number("x")).first()[0] == 3


@pytest.fixture
def inspect(spark):
    df = spark.createDataFrame([(1, 1, "0xc", "0xa", 10, 501), (2, 1, "0xc", "0xa", 5, 1)], "ID bigint, AccountID bigint, ContractAddress string, AccountAddress string, TokenID bigint, Balance bigint")
    return Inspect([Table(TableDef("balance", 1, df.schema, ["ID"], (IndexDef("acct", 1, ["AccountAddress"], ["-Balance"]),)), df)])


def test_inspect(inspect):
    of = lambda **k: [r["ID"] for r in inspect.query("balance", **k)]
    assert inspect.tables() == ["balance"] and inspect.indexes("balance") == ["primary", "acct"]
    assert inspect.entry_fields("balance")["ID"] == "bigint"
    assert of() == [1, 2] and of(filter={"ID": 1}) == [1] and of(filter={"ID": 1.0}) == [1]
    assert of(filter={"none": 1}) == [] and of(filter={"ID": "1"}) == []
    assert of(index="acct", selector={"AccountAddress": "0xa"}) == [1, 2] and of(index="acct", selector={"AccountAddress": "0xb"}) == []
    assert of(selector={"ID": 2}) == [1, 2]
    assert of(limit=1) == [1] and of(limit=1, after={"ID": 1}) == [2]
    for bad in ({"ID": "5"}, {"IDd": 5}):
        with pytest.raises(ValueError):
            of(index="acct", selector=bad)
    for f in (inspect.indexes, inspect.entry_fields, inspect.query):
        with pytest.raises(KeyError):
            f("none")


def test_http(inspect, capsys):
    server = serve(inspect)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        c = Client(url)
        assert c.tables() == ["balance"] and c.indexes("balance") == ["primary", "acct"] and c.entry_fields("balance")["TokenID"] == "bigint"
        assert [r["ID"] for r in c.query("balance", "acct", {"AccountAddress": "0xa"}, limit=1)] == [1]
        with pytest.raises(RuntimeError, match="table not found"):
            c.indexes("none")
        import urllib.error
        import urllib.request

        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"{url}/tables", b"", {"Content-Type": "text/plain"}))
        assert e.value.code == 406
        assert main(["--url", url, "query", "--table", "balance", "--filter", '{"ID": 2}']) == 0
        assert '"ID": 2' in capsys.readouterr().out
    finally:
        server.shutdown()


def test_serializers(spark):
    from keyloom.functions.serializers import deserialized, serialized

    df = spark.createDataFrame([(1, "a", [1, 2], None), (2, None, [], 0.5)], "id bigint, s string, n array<bigint>, d double")
    packed = serialized(df, ["id"])
    assert packed.columns == ["id", "value"]
    assert sorted(deserialized(packed, df.schema).collect()) == sorted(df.collect())
