import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import profile as prof, rows as row_tools
from ledgerlight.operators.quantiles import exact_quantiles


def by_column(frame):
    return {row["column"]: row for row in frame.collect()}


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_quantiles_do_not_depend_on_how_they_are_found(spark, ranges):
    draw = random.Random(3)
    rows = [
        (
            draw.gauss(0, 1), float(draw.randrange(3)), 5.0 if draw.random() < 0.4 else draw.expovariate(1) ** 6,
            None if i % 3 else float(i), 7.0,
        )
        for i in range(3001)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    columns = {c: [r[i] for r in rows if r[i] is not None] for i, c in enumerate("abcde")}
    fractions = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = exact_quantiles(df, list(columns), fractions, ranges)
    for name, values in columns.items():
        assert found[name] == pytest.approx(list(np.quantile(values, fractions)), rel=1e-12)


@pytest.mark.parametrize("share", [0.1, 0.25, 0.4, 0.6, 1.0])
def test_quantiles_with_nan_end_and_leave_it_out(spark, share):
    rows = [(math.nan if i < 1000 * share else float(i % 37),) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double")
    values = [v for (v,) in rows if not math.isnan(v)]
    found = exact_quantiles(df, ["a"], (0.25, 0.5, 0.75), ranges=9)["a"]
    assert found == (pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75]))) if values else [None] * 3)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (i, 10.0 if i < 95 else 1000.0 + i, f" name {i % 4}" if i % 10 == 0 else f"name {i % 4}", None, "UK",
         "N/A" if i % 20 == 0 else f"${i},000.50", i % 2 == 0, "x" * 500 + str(i % 3))
        for i in range(100)
    ]
    return spark.createDataFrame(
        rows, "id bigint, amount double, name string, hollow string, country string, price string, flag boolean, long string"
    ).withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")))


def test_profile(mixed):
    rows = by_column(prof.profile(mixed, "t"))
    assert rows["id"]["distinct_count"] == 100 and rows["id"]["distinct_fraction"] == 1.0
    assert rows["id"]["median_value"] == 49.5 and rows["id"]["q1"] == 24.75
    assert rows["amount"]["outlier_count"] == 0  # no spread between the quartiles
    assert rows["hollow"]["is_empty"] and rows["hollow"]["blank_count"] is None
    assert rows["country"]["is_constant"] and not rows["hollow"]["is_constant"]
    assert rows["name"]["whitespace_count"] == 10 and rows["name"]["distinct_count"] == 6
    assert rows["price"]["null_token_count"] == 5 and rows["price"]["numeric_like_fraction"] == 1.0
    assert rows["flag"]["data_type"] == "boolean" and rows["flag"]["distinct_count"] == 2
    assert (rows["day"]["min_date"], rows["day"]["max_date"]) == ("2026-01-01", "2026-04-10")
    top = rows["name"]["top_values"]
    assert [(t["value"], t["count"]) for t in top[:2]] == [("name 1", 25), ("name 3", 25)]
    assert sum(t["fraction"] for t in top) == pytest.approx(1.0)


def test_long_text_is_counted_and_shown_whole(mixed):
    row = by_column(prof.profile(mixed, "t", columns=["long"]))["long"]
    assert row["distinct_count"] == 3
    assert [t["value"] for t in row["top_values"]] == ["x" * 500 + str(i) for i in range(3)]


def test_long_text_keeps_its_shape(spark):
    rows = [(" " * 300,), (" " * 200 + "N/A",), ("1" + "0" * 200 + " ",), ("word " * 60 + ".",), ("ok",)]
    row = by_column(prof.profile(spark.createDataFrame(rows, "v string"), "t"))["v"]
    assert (row["blank_count"], row["null_token_count"], row["whitespace_count"]) == (1, 2, 3)
    assert row["numeric_like_fraction"] == pytest.approx(1 / 3)


def test_profile_does_not_depend_on_partitioning(mixed):
    # Sums of doubles depend on their order in the last digits.
    rounded = {"stddev_value": F.round("stddev_value", 9), "mean_value": F.round("mean_value", 9)}
    one, many = (prof.profile(mixed.repartition(n), "t").withColumns(rounded).collect() for n in (1, 7))
    assert one == many


def test_outliers_and_awkward_doubles(spark):
    values = [float(i) for i in range(100)] + [1e6, -1e6, 0.0, -0.0]
    row = by_column(prof.profile(spark.createDataFrame([(v,) for v in values], "v double"), "t"))["v"]
    assert row["outlier_count"] == 2 and row["distinct_count"] == 102


def test_empty_table(spark):
    rows = by_column(prof.profile(spark.createDataFrame([], "a int, b string"), "t"))
    assert rows["a"]["row_count"] == 0 and not rows["a"]["is_empty"] and rows["b"]["null_fraction"] == 0.0


def test_nested_columns_get_base_statistics_only(spark):
    df = spark.sql("SELECT array(id % 2) AS a, named_struct('x', id) AS s FROM range(6)")
    rows = by_column(prof.profile(df, "t"))
    assert rows["a"]["data_type"] == "unknown" and rows["a"]["distinct_count"] == 2
    assert rows["s"]["distinct_count"] == 6 and rows["s"]["min_value"] is None


def test_exact_large_integers_and_decimals(spark):
    df = spark.sql("SELECT 9007199254740992 + id AS n, cast(id as decimal(30,5)) / 7 AS d FROM range(8)")
    rows = by_column(prof.profile(df, "t", base_only=True))
    assert rows["n"]["distinct_count"] == 8 and rows["d"]["distinct_count"] == 8


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a")] * 3 + [(2, None)] * 2 + [(3, "c")], "a int, b string")
    assert prof.duplicate_rows(df) == 3
    assert prof.duplicate_rows(df.limit(0)) == 0


def test_row_digests_tell_rows_apart(spark):
    df = spark.sql("""
        SELECT map('a', 1, 'b', 2) AS m, array(map('x', 0.0D)) AS a, CAST(NULL AS string) AS s, 0.0D AS d
        UNION ALL SELECT map('b', 2, 'a', 1), array(map('x', -0.0D)), NULL, -0.0D
        UNION ALL SELECT map('b', 2, 'a', 1), array(map('x', 0.0D)), '', 0.0D
        UNION ALL SELECT map('b', 2), array(map('x', 0.0D)), '', 0.0D
        UNION ALL SELECT NULL, NULL, 'null', double('NaN')
        UNION ALL SELECT NULL, NULL, 'null', double('NaN')
    """)
    assert row_tools.duplicate_summary(df).first() == (6, 2)
    assert row_tools.distinct_rows(df).count() == row_tools.distinct_count(df) == 4
    shifted = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("1:a", "-"), ("1", ":a-")], "_digest string, b string")
    assert row_tools.distinct_rows(shifted).columns == ["_digest", "b"] and row_tools.distinct_count(shifted) == 4


def test_distinct_rows_move_only_repeated_ones(spark):
    df = spark.range(1000).selectExpr("id % 990 AS a", "concat('text ', id % 990) AS b")
    got = row_tools.distinct_rows(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.distinct().collect()))
    assert prof.survey(df)[1] == 10 and prof.survey(df, duplicates=False)[1] == 0


def test_a_survey_moves_and_stores_little_of_unlike_rows(spark, monkeypatch, tmp_path):
    """Row digests are short, and only counts of numbers are stored."""
    kept = []
    monkeypatch.setattr(prof, "stored", lambda df: kept.append(df) or df)
    df = spark.range(60).selectExpr("id AS n", "concat('text ', id) AS t", "concat('few ', id % 3) AS f")
    rows, repeated = prof.survey(df.union(df.limit(2)))
    found = by_column(rows)
    assert repeated == 2 and found["t"]["distinct_count"] == 60 and found["n"]["median_value"] == 28.5
    assert [(t["value"], t["count"]) for t in found["f"]["top_values"]] == [("few 0", 21), ("few 1", 21), ("few 2", 20)]
    assert [{r["text"] for r in frame.collect()} for frame in kept] == [{None}]
    assert df.select(F.max(F.length(row_tools.row_digest(df)))).first()[0] == 20
    assert row_tools.duplicate_summary(df.union(df.limit(2))).first() == (62, 2)


def test_survey_of_numbers_alone_and_of_no_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (3, None)], "a int, b double")
    rows, repeated = prof.survey(df)
    found = by_column(rows)
    assert repeated == 1 and (found["a"]["row_count"], found["b"]["null_count"], found["b"]["mean_value"]) == (3, 1, 2.0)
    assert prof.survey(df, columns=[])[1] == 1 and prof.survey(df, columns=["b"], duplicates=False)[1] == 0


def test_distinct_rows_join_no_tables(spark, monkeypatch):
    """Rows meet a bitmap and no table of digests; rows that share its bits only are all kept."""
    from ledgerlight.operators import bitmaps

    monkeypatch.setattr(bitmaps, "MOST_BITS", 2)
    monkeypatch.setattr(bitmaps, "LEAST_BITS", 2)
    df = spark.range(500).selectExpr("id % 450 AS `a b`", "CASE WHEN id % 450 > 3 THEN concat('t', id % 450) END AS _hash")
    got = row_tools.distinct_rows(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))
    assert got.columns == ["a b", "_hash"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
