"""Offsets without a limit: the same rows in the same order as after a sort, and no task with all of them."""

import pytest
from pyspark.sql import functions as F

from keyloom import IndexDef, Point, Points, Table, TableDef, desc
from keyloom.plans import skip

COLS = "id bigint, a string, b double, tags array<string>"
TAG = IndexDef("tag", 1, ["tag"], [desc("b")], multi_key="tags")


def make(spark, rows, pk=("id",)):
    df = spark.createDataFrame(rows, COLS).repartition(5)
    return Table(TableDef("t", 1, df.schema, list(pk), (TAG,)), df)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, NaN, both zeros and many equal values."""
    values = [None, float("nan"), float("inf"), -0.0, 0.0, 1.5, -2.0]
    return make(spark, [(k * 37 % 101, None if k % 9 == 0 else "x" * (k % 4), values[k % 7], ["p", "q"] if k % 2 else ["q"]) for k in range(101)])


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks of four rows, so that there are many."""
    monkeypatch.setattr(skip, "BLOCK_BITS", 2)


@pytest.fixture
def plain(spark):
    """Without adaptive plans."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "query",
    [
        lambda t: t.query(),
        lambda t: t.query().reverse(),
        lambda t: t.query().order("b", desc("a")),
        lambda t: t.query().order(desc("b"), "a"),
        lambda t: t.query().order(F.length("a")).filter("id % 3 > 0"),
        lambda t: t.query().with_("tag", Points({"tag": "q"}, {"tag": "p"}, {"tag": "q"})),
        lambda t: t.query().with_("tag", Point(tag="p")).reverse().after({"tag": "p", "b": 1.5, "id": 40}),
        lambda t: t.query().after({"id": 20}).intersects(t.query().with_("tag", Point(tag="p"))),
    ],
)
def test_rest_of_every_order(odd, query):
    q = query(odd)
    every = ids(q.to_df())
    n = len(every) // 2
    assert n > 2 and ids(q.offset(n).to_df()) == every[n:]


def test_ends(odd):
    for n in (0, 1, 100, 101, 1000):
        assert ids(odd.query().offset(n).to_df()) == list(range(n, 101))


def test_equal_keys_count_each(spark, plain):
    t = make(spark, [(k // 10, "s", 0.0, ["p"]) for k in range(60)])
    for n in (9, 10, 31):
        assert ids(t.query().offset(n).to_df()) == [k // 10 for k in range(n, 60)]
    twice = make(spark, [(k, "s", 0.0, ["p", "q"]) for k in range(20)]).query().with_("tag", Points({"tag": "p"}, {"tag": "q"})).order("a")
    for n in (2, 13):
        assert ids(twice.offset(n).to_df()) == [k // 2 for k in range(n, 40)]


def test_order_by_a_column_of_the_frame(odd):
    q = odd.query().order(odd.df()["b"])
    assert ids(q.offset(30).to_df()) == ids(q.to_df())[30:]


def test_no_task_takes_all_rows(spark, plain):
    df = spark.range(2000).select("id", F.lit("s").alias("a"), F.lit(0.0).alias("b"), F.array(F.lit("p")).alias("tags"))
    rest = Table(TableDef("t", 1, df.schema, ["id"]), df).query().offset(100).to_df()
    counts = [r["count"] for r in rest.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == 1900 and max(counts) < 1000
