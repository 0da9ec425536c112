import pytest

from ledgerlight.sources import bounded_sql as guard


@pytest.fixture(scope="module")
def orders(spark):
    df = spark.range(1500).selectExpr("id AS order_id", "cast(id % 7 as string) AS region", "id * 1.0D AS revenue")
    df.createOrReplaceTempView("orders")
    return df


@pytest.mark.parametrize("text, rows", [
    ("SELECT sum(revenue) FROM orders", 1), ("select region, count(*) from orders group by region;", 7),
    ("WITH big AS (SELECT * FROM orders WHERE revenue > 10) SELECT count(*) FROM big", 1),
    ("```sql\nSELECT region FROM orders LIMIT 5\n```", 5), ("SELECT * FROM orders", 200),
    ("SELECT * FROM orders LIMIT 999999", 1000), ("SELECT * FROM orders LIMIT 5 -- five", 5),
    ("SELECT 'drop table; reflect' AS x FROM orders LIMIT 1", 1),
    ("SELECT * FROM orders LIMIT 500 -- note", 500), ("SELECT * FROM orders LIMIT 500 OFFSET 2", 500),
    ("SELECT extract(YEAR FROM DATE'2024-01-01') AS y FROM orders LIMIT 3", 3),
    ("SELECT region FROM orders WHERE order_id IN (SELECT max(order_id) FROM orders)", 1),
])
def test_accepted(spark, orders, text, rows):
    assert guard.bounded_select(spark, text, allowed=["orders"]).count() == rows


def test_order_survives_the_bound(spark, orders):
    rows = guard.bounded_select(spark, "SELECT order_id FROM orders ORDER BY order_id DESC LIMIT 3").collect()
    assert [r[0] for r in rows] == [1499, 1498, 1497]


@pytest.mark.parametrize("text", [
    "", ";;", "hello there", "SELECT 1; DROP TABLE orders", "DROP TABLE orders", "DELETE FROM orders",
    "INSERT INTO orders VALUES (1)", "UPDATE orders SET revenue = 0", "CREATE TABLE t AS SELECT 1", "ALTER TABLE orders RENAME TO x",
    "SET spark.sql.ansi.enabled=false", "CACHE TABLE orders", "SHOW TABLES", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM csv.`/etc/passwd`",
    "SELECT java_method('java.lang.System', 'exit', '1')", "SELECT reflect('java.lang.System', 'getenv')",
    "SELECT try_reflect('java.lang.System', 'getenv')", "SELECT $$x$$", "SELECT * FROM secrets", "SELECT 1) AS a; DROP TABLE orders; SELECT * FROM (SELECT 1",
    "SELECT * FROM orders, secrets", "SELECT * FROM `secrets`", "SELECT * FROM (TABLE secrets)", "SELECT * FROM /**/ secrets",
    "SELECT * FROM other.orders", "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets",
    "SELECT (SELECT max(id) FROM secrets) AS x FROM orders", "SELECT `reflect`('java.lang.System', 'getenv')",
    "SELECT * FROM IDENTIFIER('sec' || 'rets')", "SELECT TRANSFORM(order_id) USING 'cat' AS (x) FROM orders",
    "SELECT 1 FROM orders) UNION (SELECT 2", "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM x",
])
def test_refused(spark, orders, text):
    spark.range(3).createOrReplaceTempView("secrets")
    with pytest.raises(guard.RefusedQuery):
        guard.bounded_select(spark, text, allowed=["orders"]).collect()
    assert spark.catalog.tableExists("orders")


def test_deadline(spark, orders):
    with pytest.raises(guard.DeadlineExceeded):
        guard.run_bounded(spark, "SELECT sum(id % 7) FROM range(300000000000)", seconds=2, allowed=["range"])
    assert guard.run_bounded(spark, "SELECT count(*) FROM orders")[0][0] == 1500


def test_result_tells_when_it_was_cut(spark, orders):
    cut = guard.run_bounded(spark, "SELECT * FROM orders")
    assert len(cut) == 200 and cut.cut
    whole = guard.run_bounded(spark, "SELECT * FROM orders LIMIT 150")
    assert len(whole) == 150 and not whole.cut
    assert guard.run_bounded(spark, "SELECT * FROM orders LIMIT 5000").cut


def test_frames_are_seen_by_their_query_alone(spark, orders):
    one = guard.bounded_select(spark, "SELECT count(*) AS n FROM orders;", tables={"orders": spark.range(7)})
    assert one.first()["n"] == 7 and spark.table("orders").count() == 1500
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bounded_")]
