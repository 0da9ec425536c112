import pytest

from ledgerlight.operators import relationships as rel, star
from ledgerlight.operators.cells import cells as cells_of
from ledgerlight.plans import pipelines
from ledgerlight.sources.warehouse import Warehouse


def proposed(tables):
    return {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]): r for r in rel.detect(tables).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    """Order and customer numbers overlap, so that only meaning and uniqueness tell them apart."""
    orders = [(i, 1 + i % 6, 1 + i % 5, 10.0 * i) for i in range(1, 13)]
    return {
        "orders": spark.createDataFrame(orders, "order_id bigint, customer_id bigint, product_id bigint, revenue double"),
        "customers": spark.createDataFrame(
            [(i, f"name {i}", "UK" if i % 2 else "IE") for i in range(1, 7)], "customer_id bigint, name string, country string"
        ),
        "products": spark.createDataFrame([(i, f"thing {i}") for i in range(1, 6)], "product_id bigint, label string"),
    }


@pytest.fixture(scope="module")
def confirmed(tables):
    return rel.decide(rel.detect(tables), {
        ("orders", "customer_id", "customers", "customer_id"): True,
        ("orders", "product_id", "products", "product_id"): True,
    })


def test_detection_with_overlapping_keys(tables):
    found = proposed(tables)
    assert ("orders", "customer_id", "customers", "customer_id") in found
    assert ("orders", "product_id", "products", "product_id") in found
    assert not any(k[0] == "orders" and k[1] == "order_id" for k in found)
    assert all(r["confirmed"] is None for r in found.values())


def pair(spark, source, target, target_name="customers", key="customer_id", types="bigint bigint"):
    kind_from, kind_to = types.split()
    return {
        "orders": spark.createDataFrame([(v, 1.5) for v in source], f"customer_id {kind_from}, revenue double"),
        target_name: spark.createDataFrame([(v, "x" if i % 2 else "y") for i, v in enumerate(target)], f"{key} {kind_to}, kind string"),
    }


def keys_of(found):
    return {k for k in found if k[1] == "customer_id" and k[0] == "orders"}


def test_orphans_at_the_limit(spark):
    target = list(range(1, 81))
    assert keys_of(proposed(pair(spark, range(1, 101), target)))
    assert not keys_of(proposed(pair(spark, range(2, 102), target)))  # 79 of 100
    # The other direction holds fully, so the row is looked up by its name.
    row = proposed(pair(spark, range(1, 101), target))["orders", "customer_id", "customers", "customer_id"]
    assert (row["containment"], row["confidence"]) == (0.8, 0.85)


def test_target_must_be_unique(spark):
    assert not keys_of(proposed(pair(spark, range(9), [*range(9), 8])))


def test_nulls_in_the_target_do_not_matter(spark):
    assert keys_of(proposed(pair(spark, range(9), [*range(9), None, None])))


def test_small_targets_need_a_matching_name(spark):
    assert keys_of(proposed(pair(spark, [1, 2, 3] * 3, [1, 2, 3])))
    assert not keys_of(proposed(pair(spark, [1, 2, 3] * 3, [1, 2, 3], "sizes", "size_id")))


def test_types_must_be_comparable(spark):
    assert not keys_of(proposed(pair(spark, range(9), map(str, range(9)), types="bigint string")))
    assert keys_of(proposed(pair(spark, range(9), map(float, range(9)), types="bigint double")))


@pytest.mark.parametrize("target_name, key, agree", [
    ("customers", "customer_id", True), ("customers", "id", True), ("people", "customer_ref", True),
    ("people", "id", False), ("customers", "name", False),
])
def test_names(spark, target_name, key, agree):
    F = rel.F
    row = spark.range(1).select(rel.names_agree(F.lit("customer_id"), F.lit(target_name), F.lit(key)).alias("x"))
    assert row.first()["x"] is agree


def test_many_columns_need_several_masks(spark):
    width = 70
    wide = spark.range(20).selectExpr(*[f"id + {i} AS k{i}_id" for i in range(width)])
    target = spark.range(200).selectExpr("id AS any_id", "'x' AS v")
    found = proposed({"wide": wide, "targets": target})
    assert sum(k[0] == "wide" for k in found) == width


def test_one_table_is_not_enough(tables):
    with pytest.raises(ValueError):
        rel.detect({"orders": tables["orders"]})


def test_decisions_survive_redetection(tables, confirmed):
    again = rel.merge_decisions(confirmed, rel.detect(tables)).where("confirmed").count()
    assert again == 2
    with pytest.raises(ValueError):
        rel.decide(confirmed, {("a", "b", "c", "d"): True})


def test_star_keeps_rows_and_sums(spark, tables, confirmed):
    orphan = spark.createDataFrame([(99, 77, None, 5.0)], tables["orders"].schema)
    grown = {**tables, "orders": tables["orders"].union(orphan)}
    wide = star.star("orders", grown, confirmed)
    assert wide.count() == 13 and wide.selectExpr("sum(revenue)").first()[0] == 785.0
    assert wide.columns == ["order_id", "customer_id", "product_id", "revenue", "customers_name", "customers_country", "products_label"]
    by_country = {r[0]: r[1] for r in wide.groupBy("customers_country").sum("revenue").collect()}
    assert by_country == {"UK": 420.0, "IE": 360.0, None: 5.0}


def test_roles_and_summary(spark, tables, confirmed):
    roles = {r["table"]: r["role"] for r in star.table_roles(spark, tables, confirmed).collect()}
    assert roles == {"orders": "fact", "customers": "dimension", "products": "dimension"}
    nothing = confirmed.withColumn("confirmed", rel.F.lit(None).cast("boolean"))
    assert {r["role"] for r in star.table_roles(spark, tables, nothing).collect()} == {"unknown"}
    described = {r["column"]: r["description"] for r in star.star_columns("orders", tables, confirmed).collect()}
    assert described["customers_country"] == "string, from customers via customer_id"


def test_two_edges_to_one_dimension(spark):
    people = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "person_id bigint, name string")
    deals = spark.createDataFrame([(i % 6, (i + 1) % 6) for i in range(9)], "buyer_id bigint, seller_id bigint")
    tables = {"deals": deals, "people": people}
    edges = rel.detect(tables).withColumn("confirmed", rel.F.lit(True))
    wide = star.star("deals", tables, edges)
    assert wide.columns == ["buyer_id", "seller_id", "people_name", "people_seller_id_name"]
    first = wide.where("buyer_id = 2").first()
    assert (first["people_name"], first["people_seller_id_name"]) == ("p2", "p3")


def test_star_views_come_and_go(spark, tables, confirmed):
    store = Warehouse(spark)
    for name, df in tables.items():
        store.write("clean", name, df)
    assert pipelines.build_model(store, list(tables), confirmed) == ["orders"]
    assert store.target("orders") == "star.orders" and store.target("products") == "clean.products"
    assert spark.table("star.orders").selectExpr("sum(revenue)").first()[0] == 780.0
    assert pipelines.propose_model(store, list(tables), confirmed).where("confirmed").count() == 2
    pipelines.build_model(store, list(tables), confirmed.where("1 = 0"))
    assert not store.exists("star", "orders")
    for name in tables:
        store.drop(name)


def test_equal_numbers_of_different_types_share_a_key(spark):
    from ledgerlight.operators import cells

    df = spark.sql("""SELECT * FROM VALUES
        (9007199254740993L, CAST(9007199254740993 AS DECIMAL(20,0)), CAST(1.50 AS DECIMAL(18,2)), CAST(1.5 AS DECIMAL(10,1)), 1.5D),
        (7L, CAST(7 AS DECIMAL(20,0)), CAST(0.10 AS DECIMAL(18,2)), CAST(0.1 AS DECIMAL(10,1)), 0.1D) AS t(a, b, c, d, e)""")
    keyed = cells.cells(df, list(enumerate(df.columns))).collect()
    keys = [{tuple(r)[1:5] for r in keyed if r["slot"] == n} for n in range(5)]
    assert keys[0] == keys[1] and keys[2] == keys[3] == keys[4]


def test_index_reads_changed_tables_only(spark, tables, monkeypatch):
    whole = rel.index_values(tables)
    read = []
    monkeypatch.setattr(rel, "cells", lambda df, columns, **kw: read.append(len(columns)) or cells_of(df, columns, **kw))
    assert rel.index_values(tables, whole, []) is whole and not read
    grown = {**tables, "customers": tables["customers"].where("customer_id < 4"), "extra": tables["products"]}
    del grown["products"]
    merged = rel.index_values(grown, whole, ["customers"])
    assert read == [3, 2]  # of customers and extra
    for got, wanted in ((merged, rel.index_values(grown)),):
        assert got.columns.drop("slot").collect() == wanted.columns.drop("slot").collect()
        assert rel.propose(got).collect() == rel.propose(wanted).collect()
    assert merged.presence.where("w0 = 0").count() == 0


def test_kept_index_follows_the_tables(spark, tables, monkeypatch):
    store = Warehouse(spark)
    names = list(tables)
    for name, df in tables.items():
        store.write("clean", name, df)
    first = pipelines.propose_model(store, names, name="kept").collect()
    groups = []
    monkeypatch.setattr(rel, "cells", lambda df, columns, **kw: groups.append(df.columns) or cells_of(df, columns, **kw))
    assert pipelines.propose_model(store, names, name="kept").collect() == first and not groups
    store.write("clean", "products", tables["products"].where("product_id < 3"))
    found = {(r["from_column"], r["to_table"]) for r in pipelines.propose_model(store, names, name="other").collect()}
    assert ("product_id", "products") not in found
    groups.clear()
    index = pipelines.current_index(store, names, "kept")
    assert groups == [["product_id", "label"]]
    assert rel.propose(index).count() == len(found)
    store.keep("kept_columns", index.columns.limit(0))  # as if an update had broken off
    assert rel.propose(pipelines.current_index(store, names, "kept")).count() == len(found)
    for name in tables:
        store.drop(name)
