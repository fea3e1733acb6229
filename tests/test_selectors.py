"""Index order, selectors, cursors and reversal on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from keyloom import IndexDef, Point, Points, Range, Ranges, Table, TableDef, asc, desc
from keyloom.plans.selector import segment_predicates

COLS = "ID bigint, AccountID bigint, ContractAddress string, AccountAddress string, TokenID bigint, Balance bigint"
A, A1, A2, A3, C, C1, C2, C3 = (f"0xtest{x}" for x in ("Account", "Account1", "Account2", "Account3", "Contract", "Contract1", "Contract2", "Contract3"))
MAX = 2**63 - 1
INDEXES = (
    IndexDef("acct", 1, ["AccountAddress"]),
    IndexDef("acct_bal", 2, ["AccountAddress"], [desc("Balance")]),
    IndexDef("contract", 3, ["ContractAddress"]),
    IndexDef("acct_contract", 4, ["AccountAddress", "ContractAddress"]),
    IndexDef("partial", 5, ["AccountAddress", "ContractAddress"], where=f"ContractAddress = '{C}'"),
    IndexDef("all_token", 6, [], ["-TokenID"]),
)


def make(spark, rows, cols=COLS, pk=("ID",), indexes=INDEXES):
    df = spark.createDataFrame(rows, cols)
    return Table(TableDef("t", 1, df.schema, list(pk), indexes), df)


@pytest.fixture(scope="module")
def ten(spark):
    pairs = [(C, A), (C, A), (C, A1), (C, A1), (C, A2), (C, A2), (C1, A), (C, A3), (C, A3), (C2, A)]
    return make(spark, [(k, k, c, a, 100 * k, 100 * k) for k, (c, a) in enumerate(pairs, 1)])


@pytest.fixture(scope="module")
def four(spark):
    return make(spark, [(1, 1, C, A, 0, 5), (2, 1, C2, A, 0, 15), (3, 1, C3, A, 0, 7), (4, 2, C, A2, 0, 4)])


def ids(df):
    return [r.ID for r in df.collect()]


def rec(a, i=None):
    return {"AccountAddress": a} | ({} if i is None else {"ID": i})


@pytest.mark.parametrize(
    ("index", "selector", "want"),
    [
        (None, Point(), list(range(1, 11))),
        (None, Point(ID=8), [8, 9, 10]),
        (None, Point(ID=11), []),
        (None, Points({"ID": 1}, {"ID": 7}), [1, 7]),
        (None, Points({"ID": 7}, {"ID": 1}), [7, 1]),
        (None, Points({"ID": 11}, {"ID": 15}), []),
        (None, Range({"ID": 2}, {"ID": 7}), [2, 3, 4, 5, 6, 7]),
        (None, Range({"ID": 11}, {"ID": MAX}), []),
        (None, Ranges(({"ID": 0}, {"ID": 1}), ({"ID": 7}, {"ID": 7}), ({"ID": 10}, {"ID": MAX})), [1, 7, 10]),
        (None, Ranges(({"ID": 3}, {"ID": 5}), ({"ID": 4}, {"ID": 6})), [3, 4, 5, 4, 5, 6]),
        ("acct", Point(rec(A)), [1, 2, 7, 10]),
        ("acct", Point(rec(A, 7)), [7, 10]),
        ("acct", Point(rec("none")), []),
        ("acct", Points(rec(A), rec(A2)), [1, 2, 7, 10, 5, 6]),
        ("acct", Points(rec(A2), rec(A), rec(A2)), [5, 6, 1, 2, 7, 10, 5, 6]),
        ("acct", Points(rec("none"), rec(A1)), [3, 4]),
        ("acct", Range(rec(A, 0), rec(A, MAX)), [1, 2, 7, 10]),
        ("acct", Range(rec(A, 2), rec(A, 7)), [2, 7]),
        ("acct", Range(rec(A, 0), rec(A1, MAX)), [1, 2, 7, 10, 3, 4]),
        ("acct", Range(rec(A), {}), [1, 2, 7, 10, 3, 4, 5, 6, 8, 9]),
        ("acct", Ranges((rec(A, 0), rec(A, 2)), (rec(A3, 9), rec(A3, 9))), [1, 2, 9]),
        ("acct_contract", Point(AccountAddress=A, ContractAddress=C), [1, 2]),
        ("partial", Point(AccountAddress=A, ContractAddress=C), [1, 2]),
        ("partial", Point(AccountAddress=A, ContractAddress=C1), []),
        ("all_token", Point(), list(range(10, 0, -1))),
        ("all_token", Point(TokenID=300, ID=0), [3, 2, 1]),
    ],
)
def test_selectors(ten, index, selector, want):
    assert ids(ten.scan_index(index, selector)) == want
    assert ids(ten.scan_index(index, selector, reverse=True)) == want[::-1]


@pytest.mark.parametrize(
    ("selector", "after", "reverse", "want"),
    [
        (None, None, False, [1, 2, 3, 4]),
        (Point(rec(A)), None, False, [1, 2, 3]),
        (Point(rec(A)), 2, False, [3]),
        (Points(rec(A), rec(A2)), None, False, [1, 2, 3, 4]),
        (Points(rec(A), rec("x"), rec(A2)), None, False, [1, 2, 3, 4]),
        (Points(rec(A), rec(A2), rec(A3)), None, True, [4, 3, 2, 1]),
        (Points(rec(A), rec(A3), rec(A2)), None, True, [4, 3, 2, 1]),
        (Points(rec(A), rec(A2)), 2, False, [3, 4]),
        (Points(rec(A), rec(A2)), 3, False, [4]),
        (Points(rec(A), rec(A2)), 4, False, []),
        (Range(rec(A, 0), rec(A, MAX)), 2, False, [3]),
        (Range(rec(A, 0), rec(A, MAX)), 3, False, []),
        (Ranges((rec(A, 0), rec(A, MAX)), (rec(A2, 0), rec(A2, MAX))), 2, False, [3, 4]),
        (Ranges((rec(A, 0), rec(A, MAX)), (rec(A2, 0), rec(A2, MAX))), 4, False, []),
        (Point(rec(A)), 2, True, [1]),
        (Point(rec(A)), 1, True, []),
    ],
)
def test_cursors(four, selector, after, reverse, want):
    q = four.query() if selector is None else four.query().with_("acct", selector)
    if after:
        q = q.after({"AccountAddress": A2 if after == 4 else A, "ID": after})
    assert ids((q.reverse() if reverse else q).to_df()) == want


def test_ordered_index(four):
    q = four.query().with_("acct_bal", Point(rec(A)))
    assert ids(q.to_df()) == [2, 3, 1]
    assert ids(q.reverse().to_df()) == [1, 3, 2]
    assert ids(q.after({"AccountAddress": A, "Balance": 7, "ID": 3}).to_df()) == [1]
    assert ids(q.after({"AccountAddress": A, "Balance": 6, "ID": 99}).to_df()) == [1]  # a cursor whose row is gone
    assert ids(q.after({"AccountAddress": A, "Balance": 5, "ID": 1}).to_df()) == []
    assert ids(q.offset(1).limit(1).to_df()) == [3]
    assert ids(four.scan_index("acct_bal", Point(AccountAddress=A, Balance=7))) == [3, 1]


def test_filter_order_limit(four):
    q = four.query()
    assert ids(q.filter(F.col("Balance") > 4).order("-Balance").to_df()) == [2, 3, 1]
    assert ids(q.filter("Balance > 4").filter("Balance < 7").to_df()) == [1, 4]  # the last filter counts
    assert ids(q.order("AccountID", desc("Balance")).reverse().to_df()) == [2, 3, 1, 4]  # an own order isn't reversed
    assert ids(q.limit(0).to_df()) == [1, 2, 3, 4]
    assert ids(q.offset(3).to_df()) == [4]
    assert ids(q.filter("Balance > 4").offset(1).limit(1).to_df()) == [2]
    assert ids(q.order("-Balance").after({"ID": 3}).to_df()) == [1, 4]
    assert ids(q.order("-Balance").after({"ID": 77}).to_df()) == [2, 3, 1, 4]  # not there: nothing is dropped
    with pytest.raises(ValueError):
        q.limit(-1)


def test_intersect(spark):
    t = make(spark, [(1, 1, C, A, 0, 5), (2, 1, C2, A, 1, 15), (3, 1, C3, A, 0, 7), (4, 2, C, A2, 0, 4), (5, 1, C2, A, 3, 7)])
    q = t.query()
    both = q.with_("acct", Point(rec(A))).intersects(q.with_("contract", Point(ContractAddress=C2)))
    assert ids(both.to_df()) == [2, 5]
    assert ids(both.reverse().to_df()) == [5, 2]
    assert ids(both.order("-Balance").limit(1).to_df()) == [2]
    assert ids(both.order("-Balance").after({"ID": 2}).to_df()) == [5]
    assert ids(both.after({"ID": 2}).limit(1).to_df()) == [5]
    assert ids(both.offset(1).to_df()) == [5]
    assert ids(both.filter("TokenID = 3").to_df()) == [5]
    for bad in (q.filter("true"), q.order("ID"), q.limit(1), q.offset(1), q.after({"ID": 1})):
        with pytest.raises(ValueError):
            q.intersects(bad).to_df()


def test_shorter_strings_come_first(spark):
    t = make(spark, [(1, "aa"), (2, "b"), (3, "ab"), (4, "a")], "ID bigint, s string", indexes=(IndexDef("s", 1, ["s"]), IndexDef("bytes", 2, ["s"], byte_order=True)))
    assert ids(t.scan_index("s", Range({}, {}))) == [4, 2, 1, 3]
    assert ids(t.scan_index("s", Range({"s": "b"}, {"s": "aa"}))) == [2, 1]
    assert ids(t.scan_index("bytes", Range({}, {}))) == [4, 1, 3, 2]


def test_multi_key_index(spark):
    addresses = (IndexDef("addr", 1, ["addr"], [desc("block"), asc("tx")], multi_key="array(src, dst)"), IndexDef("some", 2, ["addr"], multi_key="array(src, dst)", where="src = '0xfff3'"))
    t = make(spark, [(1, 1, "0xabc1", "0xdef1"), (1, 2, "0xabc2", "0xdef2"), (1, 3, "0xfff3", "0xabc1"), (2, 1, "0xsame", "0xsame")], "block bigint, tx bigint, src string, dst string", ("block", "tx"), addresses)
    of = lambda df: [(r.block, r.tx) for r in df.collect()]
    assert of(t.scan_index("addr", Point(addr="0xabc1"))) == [(1, 1), (1, 3)]
    assert of(t.scan_index("addr", Point(addr="0xsame"))) == [(2, 1)]
    assert of(t.scan_index("addr", Points({"addr": "0xabc2"}, {"addr": "0xdef2"}))) == [(1, 2), (1, 2)]
    assert of(t.scan_index("some", Point(addr="0xabc2"))) == []
    q = t.query()
    assert of(q.with_("addr", Point(addr="0xabc1")).intersects(q.with_("addr", Point(addr="0xfff3"))).to_df()) == [(1, 3)]


def test_many_points_are_joined(spark):
    t = make(spark, [(k, 0, C, f"a{k % 50}", 0, k) for k in range(500)])
    wanted = [f"a{k % 50}" for k in range(99, 0, -1)]
    got = ids(t.scan_index("acct_bal", Points(*(rec(a) for a in wanted))))
    assert got == [k for a in wanted for k in range(499, -1, -1) if f"a{k % 50}" == a]
    assert ids(t.scan_index(None, Points(*({"ID": k} for k in range(300, 200, -1))))) == list(range(300, 200, -1))


def test_predicates_reach_the_scan(spark, four, tmp_path):
    four.df().write.parquet(f"{tmp_path}/t")
    t = Table(four.definition, spark.read.parquet(f"{tmp_path}/t"))
    plan = t.scan_index("acct_bal", Point(AccountAddress=A, Balance=7))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(AccountAddress" in pushed and "LessThanOr" in pushed
    narrow = t.covering("acct_bal", Point(rec(A)))._jdf.queryExecution().executedPlan().toString()
    assert "ContractAddress" not in narrow[narrow.index("ReadSchema") :]


def test_definitions_are_checked(four):
    d = four.definition
    for bad in (lambda: IndexDef("x", 0, ["ID"]), lambda: IndexDef("primary", 1, ["ID"]), lambda: IndexDef("x", 9, ["a", "b"], multi_key="array(a)"), lambda: TableDef("t", 0, d.schema, ["ID"]), lambda: TableDef("t", 1, d.schema, []), lambda: TableDef("t", 1, d.schema, ["none"]), lambda: d.with_indexes(IndexDef("new", 1, ["ID"])), lambda: d.with_indexes(IndexDef("new", 9, ["none"])), lambda: segment_predicates(d, d.index("acct"), Point(ID=1))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        d.index("none")
