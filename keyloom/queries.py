"""The engine's operators as queries over the tables of a folder, and the SQL that each must agree with.

Where the order of rows is what a query shows, it has rn: the row's number within its index key, or within a page whose
length a limit bounds, so that numbering never gathers a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import cond, keyfilter
from .inspection import Inspect
from .operators import merge
from .operators.table import Table
from .plans import IndexDef, Point, Points, Range, Ranges, TableDef, asc, desc
from .plans.selector import SEGMENT, select
from .sources import backup, kv
from .sources.catalog import Catalog
from .sources.scratch import scratch

QueryFn = Callable[[SparkSession, str], DataFrame]

KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
INDEXES = {
    "orders": (
        IndexDef("cust", 1, ["o_custkey"]),
        IndexDef("cust_recent", 2, ["o_custkey"], [desc("o_orderdate")]),
        IndexDef("urgent", 3, ["o_orderstatus"], [asc("o_orderdate")], where="o_orderpriority = '1-URGENT'"),
        IndexDef("status", 4, ["o_orderstatus"]),
        IndexDef("priority", 5, ["o_orderpriority"]),
    ),
    "customer": (IndexDef("segment_balance", 1, ["c_mktsegment"], [desc("c_acctbal")]), IndexDef("nation", 2, ["c_nationkey"])),
    "part": (IndexDef("type", 1, ["p_type"]), IndexDef("brand_or_type", 2, ["label"], multi_key="array(p_brand, p_type)"), IndexDef("brand_size", 3, ["p_brand", "p_size"])),
    "events": (IndexDef("by_value", 1, [], [desc("value")]), IndexDef("user", 2, ["user_id"], [asc("ts")])),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A read-only table over a Parquet file of the folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ids = sorted(KEYS)
    return Table(TableDef(name, ids.index(name) + 1, df.schema, KEYS[name], INDEXES.get(name, ())), df)


def numbered(df: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long"))


QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: QueryFn) -> QueryFn:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# scans and gets


@query("SELECT * FROM orders")
def scan_primary(spark, d):
    return table(spark, d, "orders").scan()


@query("SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders ORDER BY o_orderkey DESC LIMIT 500")
def scan_reverse(spark, d):
    return numbered(table(spark, d, "orders").query().reverse().limit(500).to_df(), F.desc("o_orderkey"))


@query("SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def get_point(spark, d):
    t = table(spark, d, "orders")
    return t.get(Point(o_orderkey=t.df().agg(F.min("o_orderkey")).first()[0]))


@query("SELECT p.pos, o.* FROM (VALUES (0, 5), (1, 99999999), (2, 3), (3, 5)) p(pos, k) LEFT JOIN orders o ON o.o_orderkey = p.k")
def get_points_positional(spark, d):
    t = table(spark, d, "orders")
    found = t.get(Points(*({"o_orderkey": k} for k in (5, 99999999, 3, 5))))
    return found.coalesce(1).select(F.monotonically_increasing_id().cast("int").alias("pos"), "*")


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
def get_range(spark, d):
    return table(spark, d, "orders").get(Range({"o_orderkey": 100}, {"o_orderkey": 250}))


@query("SELECT s AS seg, o.* FROM (VALUES (0, 40, 60), (1, 10, 45)) v(s, a, b) JOIN orders o ON o_orderkey BETWEEN a AND b")
def get_ranges(spark, d):
    t = table(spark, d, "orders")
    found, _ = select(t.definition, None, Ranges(({"o_orderkey": 40}, {"o_orderkey": 60}), ({"o_orderkey": 10}, {"o_orderkey": 45})), t.df())
    return found.withColumnRenamed(SEGMENT, "seg")


@query('SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 7) AS "exists" FROM customer')
def exist_flags(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") * 7).alias("o_orderkey"))
    return table(spark, d, "orders").exist_flags(keys).drop("o_orderkey")


@query("SELECT * FROM orders WHERE o_orderkey >= 1000")
def primary_point_from_here(spark, d):
    return table(spark, d, "orders").scan_index(None, Point(o_orderkey=1000))


# selectors on secondary indexes


@query("SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_custkey = 7")
def idx_point(spark, d):
    return numbered(table(spark, d, "orders").scan_index("cust", Point(o_custkey=7)), F.col("o_orderkey"), by=("o_custkey",))


@query("SELECT * FROM orders WHERE o_custkey = 7 AND o_orderkey >= 500")
def idx_point_resume(spark, d):
    return table(spark, d, "orders").scan_index("cust", Point(o_custkey=7, o_orderkey=500))


@query("SELECT seg, o.*, row_number() OVER (PARTITION BY seg ORDER BY o_orderkey) AS rn FROM (VALUES (0, 7), (1, 3), (2, 7)) v(seg, k) JOIN orders o ON o_custkey = k")
def idx_points_dup(spark, d):
    t = table(spark, d, "orders")
    found, _ = select(t.definition, t.definition.index("cust"), Points(*({"o_custkey": k} for k in (7, 3, 7))), t.df())
    return numbered(found.withColumnRenamed(SEGMENT, "seg"), F.col("o_orderkey"), by=("seg",))


@query("SELECT o.* FROM (VALUES (0, 7), (1, 3), (2, 7)) v(seg, k) JOIN orders o ON o_custkey = k ORDER BY seg DESC, o_orderkey DESC LIMIT 12")
def idx_points_reverse(spark, d):
    return table(spark, d, "orders").query().with_("cust", Points(*({"o_custkey": k} for k in (7, 3, 7)))).reverse().limit(12).to_df()


@query("SELECT o.* FROM orders o JOIN (SELECT unnest(range(0, 200)) AS k) ON o_custkey = 3 * k + 1")
def idx_points_many(spark, d):
    return table(spark, d, "orders").scan_index("cust", Points(*({"o_custkey": 3 * k + 1} for k in range(200))))


@query("SELECT * FROM orders WHERE (o_custkey > 5 OR (o_custkey = 5 AND o_orderkey >= 100)) AND (o_custkey < 8 OR (o_custkey = 8 AND o_orderkey <= 9000))")
def idx_range(spark, d):
    return table(spark, d, "orders").scan_index("cust", Range({"o_custkey": 5, "o_orderkey": 100}, {"o_custkey": 8, "o_orderkey": 9000}))


@query("SELECT o.* FROM (VALUES (5, 9), (8, 12)) v(a, b) JOIN orders o ON o_custkey BETWEEN a AND b")
def idx_ranges_overlap(spark, d):
    return table(spark, d, "orders").scan_index("cust", Ranges(({"o_custkey": 5}, {"o_custkey": 9}), ({"o_custkey": 8}, {"o_custkey": 12})))


@query("SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY rn LIMIT 20")
def idx_ordered_desc(spark, d):
    found = table(spark, d, "customer").query().with_("segment_balance", Point(c_mktsegment="BUILDING")).limit(20).to_df()
    return numbered(found, F.desc("c_acctbal"), F.col("c_custkey"))


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey >= 10))")
def idx_ordered_resume(spark, d):
    return table(spark, d, "customer").scan_index("segment_balance", Point(c_mktsegment="BUILDING", c_acctbal=5000.0, c_custkey=10))


@query("SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_custkey BETWEEN 20 AND 40")
def idx_range_ordered(spark, d):
    found = table(spark, d, "orders").scan_index("cust_recent", Range({"o_custkey": 20}, {"o_custkey": 40}))
    return numbered(found, F.desc("o_orderdate"), F.col("o_orderkey"), by=("o_custkey",))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def idx_partial(spark, d):
    return table(spark, d, "orders").scan_index("urgent", Point(o_orderstatus="F"))


@query("SELECT p.* FROM part p, (SELECT p_partkey AS k, unnest(list_distinct([p_brand, p_type])) AS label FROM part) WHERE k = p_partkey AND label IN ('Brand#2', 'Brand#12')")
def idx_multi_key(spark, d):
    return table(spark, d, "part").scan_index("brand_or_type", Points({"label": "Brand#2"}, {"label": "Brand#12"}))


@query("SELECT * FROM part WHERE p_brand = 'Brand#12' AND p_size BETWEEN 5 AND 20")
def idx_composite(spark, d):
    return table(spark, d, "part").scan_index("brand_size", Range({"p_brand": "Brand#12", "p_size": 5}, {"p_brand": "Brand#12", "p_size": 20}))


@query("SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS rn FROM events ORDER BY rn LIMIT 100")
def idx_empty_key_order(spark, d):
    found = table(spark, d, "events").query().with_("by_value", Point()).limit(100).to_df()
    return numbered(found, F.desc("value"), F.col("event_id"))


@query("SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part WHERE strlen(p_type) > 5 OR (strlen(p_type) = 5 AND p_type >= 'M    ')")
def idx_shortlex_range(spark, d):
    found = table(spark, d, "part").scan_index("type", Range({"p_type": "M    "}, {}))
    return numbered(found, F.col("p_partkey"), by=("p_type",))


@query("SELECT *, row_number() OVER (ORDER BY strlen(p_type), p_type, p_partkey) AS rn FROM part ORDER BY rn LIMIT 200")
def idx_shortlex_order(spark, d):
    found = table(spark, d, "part").query().with_("type", Range({}, {})).limit(200).to_df()
    return numbered(found, F.octet_length("p_type"), F.col("p_type"), F.col("p_partkey"))


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def idx_covering(spark, d):
    return table(spark, d, "customer").covering("segment_balance", Point(c_mktsegment="MACHINERY"))


# predicates


def _filtered(c: Callable[[], Column | Callable]):
    return lambda spark, d: table(spark, d, "orders").query().filter(c()).to_df()


for _name, _c, _sql in (
    ("eq", lambda: cond.eq("o_orderstatus", "F"), "o_orderstatus = 'F'"),
    ("gt", lambda: cond.gt("o_totalprice", 200000.0), "o_totalprice > 200000"),
    ("gte", lambda: cond.gte("o_custkey", 90), "o_custkey >= 90"),
    ("lt", lambda: cond.lt("o_custkey", 15), "o_custkey < 15"),
    ("lte", lambda: cond.lte("o_totalprice", 9000.0), "o_totalprice <= 9000"),
    ("and", lambda: cond.and_(cond.eq("o_orderstatus", "F"), cond.lt("o_custkey", 50)), "o_orderstatus = 'F' AND o_custkey < 50"),
    ("or", lambda: cond.or_(cond.eq("o_custkey", 3), cond.gt("o_totalprice", 400000.0)), "o_custkey = 3 OR o_totalprice > 400000"),
    ("not", lambda: cond.not_(cond.eq("o_orderstatus", "F")), "o_orderstatus <> 'F'"),
    ("func", lambda: cond.func(lambda r: r["o_custkey"] % 10 == 3, "o_custkey"), "o_custkey % 10 = 3"),
    ("empty_and", lambda: cond.and_(), "true"),
    ("empty_or", lambda: cond.or_(), "false"),
):
    QUERIES[f"filter_{_name}"] = _filtered(_c)
    ORACLE_SQL[f"filter_{_name}"] = f"SELECT * FROM orders WHERE {_sql}"


@query("SELECT * FROM orders WHERE o_custkey = 3")
def filter_replaced(spark, d):
    return table(spark, d, "orders").query().filter(cond.eq("o_orderstatus", "F")).filter(cond.eq("o_custkey", 3)).to_df()


# order, offset, limit, cursors


@query("SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10)")
def order_offset_limit(spark, d):
    return numbered(table(spark, d, "orders").query().order("-o_totalprice").offset(10).limit(25).to_df(), F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 30 OFFSET 15")
def filter_offset_limit(spark, d):
    return table(spark, d, "orders").query().filter(cond.eq("o_orderstatus", "O")).offset(15).limit(30).to_df()


@query("SELECT * FROM orders ORDER BY o_orderkey OFFSET 14900")
def offset_only(spark, d):
    return table(spark, d, "orders").query().offset(14900).to_df()


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal < 7000.5 OR (c_acctbal = 7000.5 AND c_custkey > 12)) ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def after_deleted_cursor(spark, d):
    return table(spark, d, "customer").query().with_("segment_balance", Point(c_mktsegment="BUILDING")).after({"c_mktsegment": "BUILDING", "c_acctbal": 7000.5, "c_custkey": 12}).limit(10).to_df()


@query("SELECT * FROM orders WHERE o_custkey = 7 AND o_orderkey > 500")
def after_keyset(spark, d):
    return table(spark, d, "orders").query().with_("cust", Point(o_custkey=7)).after({"o_custkey": 7, "o_orderkey": 500}).to_df()


@query("SELECT * FROM orders WHERE o_orderkey < 300 ORDER BY o_orderkey DESC LIMIT 20")
def after_reverse(spark, d):
    return table(spark, d, "orders").query().reverse().after({"o_orderkey": 300}).limit(20).to_df()


@query("""WITH c AS (SELECT o_totalprice AS p, o_orderkey AS k FROM orders WHERE o_orderkey = 40)
SELECT o.* FROM orders o, c WHERE o_totalprice < p OR (o_totalprice = p AND o_orderkey > k) ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def after_sorted(spark, d):
    return table(spark, d, "orders").query().order("-o_totalprice").after({"o_orderkey": 40}).limit(15).to_df()


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def after_sorted_missing(spark, d):
    return table(spark, d, "orders").query().order("-o_totalprice").after({"o_orderkey": -1}).limit(15).to_df()


# intersections


def _both(spark, d):
    q = table(spark, d, "orders").query()
    return q.with_("status", Point(o_orderstatus="F")).intersects(q.with_("priority", Point(o_orderpriority="2-HIGH")))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def intersect_2(spark, d):
    return _both(spark, d).to_df()


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_custkey BETWEEN 1 AND 60")
def intersect_3(spark, d):
    q = table(spark, d, "orders").query()
    return _both(spark, d).intersects(q.with_("cust", Range({"o_custkey": 1}, {"o_custkey": 60}))).to_df()


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def intersect_offset_limit(spark, d):
    return _both(spark, d).offset(5).limit(10).to_df()


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice > 1000 ORDER BY o_totalprice, o_orderkey LIMIT 10")
def intersect_filter_sort(spark, d):
    return _both(spark, d).filter(cond.gt("o_totalprice", 1000.0)).order("o_totalprice").limit(10).to_df()


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderkey > 700 ORDER BY o_orderkey LIMIT 10")
def intersect_after(spark, d):
    return _both(spark, d).after({"o_orderkey": 700}).limit(10).to_df()


@query("SELECT * FROM part WHERE p_brand = 'Brand#12' AND p_size >= 10")
def intersect_multi_key(spark, d):
    q = table(spark, d, "part").query()
    return q.with_("brand_or_type", Point(label="Brand#12")).intersects(q.with_("brand_size", Range({"p_brand": "Brand#12", "p_size": 10}, {"p_brand": "Brand#12"}))).to_df()


# writes, through a store


def _store(spark: SparkSession, d: str, name: str, condition: str | None = None) -> Table:
    """A new store with one table, filled from the folder's."""
    src = table(spark, d, name)
    t = Catalog(spark, scratch(spark, name)).table(src.definition)
    rows = src.df()
    t.unsafe_insert(rows.where(condition) if condition else rows)
    return t


def inserted_halves(spark: SparkSession, d: str) -> Table:
    """All orders in a new store: one half to begin with, the other inserted."""
    t = _store(spark, d, "orders", "o_orderkey % 2 = 0")
    t.insert(table(spark, d, "orders").df().where("o_orderkey % 2 != 0"))
    return t


@query("SELECT * FROM orders WHERE o_custkey < 200")
def insert_then_scan(spark, d):
    return inserted_halves(spark, d).scan().where("o_custkey < 200")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_last_wins(spark, d):
    t = _store(spark, d, "customer")
    even = table(spark, d, "customer").df().where("c_custkey % 2 = 0")
    first, second = (even.withColumn("c_acctbal", F.lit(float(k))).withColumn(merge.SEQ, F.lit(k).cast("long")) for k in (1, 2))
    t.update(first.unionByName(second))
    return t.scan()


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL")
def upsert_fold(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    t = Catalog(spark, scratch(spark, "lineitem")).table(TableDef("lineitem", 20, rows.schema, ["l_orderkey", "l_linenumber"]))
    t.upsert(rows, lambda old, new: {"l_quantity": old.l_quantity + new.l_quantity, "l_discount": F.least(old.l_discount, new.l_discount)})
    return t.scan()


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL")
def upsert_rules(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    t = Catalog(spark, scratch(spark, "lineitem")).table(TableDef("lineitem", 20, rows.schema, ["l_orderkey", "l_linenumber"]))
    half = F.xxhash64("l_orderkey", "l_quantity") % 2 == 0
    t.upsert(rows.where(half), {"l_quantity": "sum", "l_discount": "max"})
    t.upsert(rows.where(~half), {"l_quantity": "sum", "l_discount": "max"})
    return t.scan()


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey <= 700 THEN -1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey > 300 OR c_custkey <= 700")
def upsert_replace(spark, d):
    t = _store(spark, d, "customer", "c_custkey > 300")
    t.upsert(table(spark, d, "customer").df().where("c_custkey <= 700").withColumn("c_acctbal", F.lit(-1.0)))
    return t.scan()


@query("SELECT * FROM orders WHERE o_custkey NOT BETWEEN 50 AND 90")
def delete_anti(spark, d):
    t = _store(spark, d, "orders")
    t.delete(table(spark, d, "orders").df().where("o_custkey BETWEEN 50 AND 90"))
    return t.scan()


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey < 20 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey < 20 OR s_suppkey > 10")
def unsafe_insert(spark, d):
    t = _store(spark, d, "supplier", "s_suppkey > 10")
    t.unsafe_insert(table(spark, d, "supplier").df().where("s_suppkey < 20").withColumn("s_acctbal", F.lit(0.0)))
    return t.scan()


@query("SELECT * FROM supplier WHERE s_suppkey > 5 AND s_suppkey <> 50")
def batch_atomic(spark, d):
    from .operators.batch import Batch

    t = _store(spark, d, "supplier", "s_suppkey > 20")
    b = Batch(t.catalog)
    t.insert(table(spark, d, "supplier").df().where("s_suppkey <= 20"), b)
    t.delete([{"s_suppkey": 50}], b)
    t.delete(t.df(b).where("s_suppkey <= 5"), b)
    b.commit()
    return t.scan()


@query("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def reindex_projection(spark, d):
    t = _store(spark, d, "orders")
    t.reindex("urgent")
    return t.projection("urgent")


@query("SELECT * FROM customer WHERE c_custkey % 3 <> 0")
def compacted(spark, d):
    t = _store(spark, d, "customer")
    t.delete(table(spark, d, "customer").df().where("c_custkey % 3 = 0"))
    t.catalog.compact()
    return t.scan()


@query("SELECT * FROM supplier")
def dump_restore(spark, d):
    t = _store(spark, d, "supplier")
    to = scratch(spark, "dump")
    t.catalog.dump(to)
    other = Catalog(spark, scratch(spark, "restored"))
    other.restore(to)
    return other.table(t.definition).scan()


# raw keys, key filters, inspection, backups


@query("SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000300' AND NOT (c_name >= 'Customer#000000150' AND c_name < 'Customer#000000200')")
def kv_range(spark, d):
    store = kv.KeyValues(Catalog(spark, scratch(spark, "kv")))
    rows = spark.read.parquet(f"{d}/customer.parquet")
    store.put(rows.select(F.col("c_name").cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value")))
    store.delete_range(b"Customer#000000150", b"Customer#000000200")
    found = store.range(b"Customer#000000100", b"Customer#000000300")
    return found.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query("SELECT CAST(0 AS BIGINT) AS missed, true AS rare")
def bloom_no_false_negatives(spark, d):
    orders = table(spark, d, "orders").df().select("o_orderkey")
    f = keyfilter.KeyFilter.build(orders, ["o_orderkey"], 10_000, 0.01, 16)
    there = f.may_contain(orders).where("NOT may_contain")
    absent = orders.select((F.col("o_orderkey") + 10**12).alias("o_orderkey"))
    wrong = f.may_contain(absent).agg(F.avg(F.col("may_contain").cast("int")).alias("p"))
    return there.agg(F.count("*").alias("missed")).crossJoin(wrong.select((F.col("p") < 0.05).alias("rare")))


@query("SELECT * FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 30")
def inspect_query(spark, d):
    return Inspect([table(spark, d, "customer")]).query_df("customer", "nation", {"c_nationkey": 3}, {"c_mktsegment": "BUILDING"}, 30)


@query("SELECT * FROM (VALUES ('orders', 'primary'), ('orders', 'cust'), ('orders', 'cust_recent'), ('orders', 'urgent'), ('orders', 'status'), ('orders', 'priority')) v(table_name, index_name)")
def inspect_indexes(spark, d):
    i = Inspect([table(spark, d, "orders")])
    return spark.createDataFrame([("orders", x) for x in i.indexes("orders")], "table_name string, index_name string")


@query("SELECT * FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_acctbal', 'double')) v(field, kind)")
def inspect_fields(spark, d):
    i = Inspect([table(spark, d, "supplier")])
    return spark.createDataFrame(list(i.entry_fields("supplier").items()), "field string, kind string")


@query("SELECT 'complete' AS kind, CAST(0 AS BIGINT) AS seq, CAST(1 AS BIGINT) AS chain UNION ALL SELECT 'incremental', 1, 1 UNION ALL SELECT 'complete', 0, 2")
def backup_groups(spark, d):
    t = _store(spark, d, "supplier")
    to = scratch(spark, "backup")
    b = backup.Backups(t.catalog.files, to)
    b.backup(t.catalog, "complete", "2026-01-01T00:00:00")
    t.delete([{"s_suppkey": 1}])
    b.backup(t.catalog, "incremental", "2026-01-02T00:00:00")
    b.backup(t.catalog, "complete", "2026-01-03T00:00:00")
    return backup.groups(spark, b.list()).select("kind", "seq", "chain")


@query("SELECT * FROM supplier WHERE s_suppkey <> 1")
def backup_restore_set(spark, d):
    t = _store(spark, d, "supplier")
    to, back = scratch(spark, "backup"), scratch(spark, "back")
    b = backup.Backups(t.catalog.files, to)
    b.backup(t.catalog, "complete", "2026-01-01T00:00:00")
    t.delete([{"s_suppkey": 1}])
    b.backup(t.catalog, "incremental", "2026-01-02T00:00:00")
    t.delete([{"s_suppkey": 2}])
    b.backup(t.catalog, "incremental", "2026-01-03T00:00:00")
    b.restore(back, before="2026-01-02T12:00:00")
    return Catalog(spark, back).table(t.definition).scan()


@query("SELECT * FROM supplier")
def stream_upsert(spark, d):
    from .streaming import upsert_stream

    src = table(spark, d, "supplier")
    t = Catalog(spark, scratch(spark, "stream")).table(src.definition)
    given = spark.readStream.schema(src.definition.schema).option("pathGlobFilter", "supplier.parquet").parquet(d)
    q = upsert_stream(given, t, scratch(spark, "progress"))
    q.awaitTermination()
    return t.scan()
