import pytest

from ledgerlight import types as lt
from ledgerlight.operators import cleaning, quality
from ledgerlight.plans import pipelines
from ledgerlight.session import small_frame
from ledgerlight.sources.warehouse import Warehouse


def profile_rows(spark, *rows):
    """Hand-made profile rows; what is not given is unremarkable."""
    base = {
        "table": "t", "layer": "raw", "data_type": "string", "row_count": 100, "null_count": 0,
        "null_fraction": 0.0, "distinct_count": 5, "distinct_fraction": 0.05, "is_constant": False,
        "is_empty": False, "blank_count": 0, "null_token_count": 0, "whitespace_count": 0,
        "numeric_like_fraction": 0.0, "date_like_fraction": 0.0, "boolean_like_fraction": 0.0,
    }
    records = [{**base, "position": i, "column": f"c{i}", **row} for i, row in enumerate(rows)]
    return small_frame(spark, [[r.get(n) for n in lt.PROFILE.fieldNames()] for r in records], lt.PROFILE)


def planned(spark, **row):
    return cleaning.plan_cleaning(profile_rows(spark, row), 0).first()


@pytest.mark.parametrize("row, actions, kind", [
    ({}, [], "string"),
    ({"whitespace_count": 3}, ["trim_whitespace"], "string"),
    ({"null_token_count": 1}, ["trim_whitespace", "normalize_null_tokens"], "string"),
    ({"numeric_like_fraction": 0.95}, ["cast_to_number"], "decimal"),
    ({"numeric_like_fraction": 0.949}, [], "string"),
    ({"date_like_fraction": 1.0, "numeric_like_fraction": 1.0}, ["cast_to_date"], "date"),
    ({"boolean_like_fraction": 1.0, "numeric_like_fraction": 1.0}, ["cast_to_boolean"], "boolean"),
    ({"data_type": "integer", "whitespace_count": 9}, [], "integer"),
])
def test_plans(spark, row, actions, kind):
    plan = planned(spark, **row)
    assert (plan["actions"], plan["resulting_type"]) == (actions, kind)


def test_reasons_count_correctly(spark):
    assert planned(spark, whitespace_count=1)["reason"].startswith("1 value lost")
    assert planned(spark, whitespace_count=2)["reason"].startswith("2 values lost")


def test_deduplication_is_planned_only_when_needed_and_wanted(spark):
    rows = profile_rows(spark, {})
    assert cleaning.is_noop(cleaning.plan_cleaning(rows, 0))
    assert cleaning.is_noop(cleaning.plan_cleaning(rows, 4, deduplicate=False))
    assert [r["actions"] for r in cleaning.audit(cleaning.plan_cleaning(rows, 4)).collect()] == [["deduplicate_rows"]]


@pytest.mark.parametrize("row, codes", [
    ({"is_empty": True, "null_fraction": 1.0}, {"empty_column"}),
    ({"null_fraction": 0.5}, {"high_null_rate"}),
    ({"is_constant": True}, {"constant_column"}),
    ({"numeric_like_fraction": 0.5}, {"mixed_types"}),
    ({"numeric_like_fraction": 0.95}, set()),
    ({"distinct_fraction": 0.9}, {"high_cardinality"}),
    ({"distinct_fraction": 1.0, "row_count": 10}, set()),
    ({"data_type": "decimal", "outlier_count": 5}, {"outliers"}),
    ({"data_type": "decimal", "outlier_count": 4}, set()),
])
def test_column_rules(spark, row, codes):
    assert {r["code"] for r in quality.column_issues(profile_rows(spark, row)).collect()} == codes


def test_table_rules_and_score(spark):
    rows = profile_rows(spark, {"is_empty": True}, {"is_constant": True}, {}, {})
    score = lambda issues, n: quality.quality_score(issues, n).first()["score"]
    assert score(quality.quality_issues(rows, 100, 0), 4) == 93  # 100 - 25/4 - 2/4
    severe = {r["code"]: r["severity"] for r in quality.quality_issues(rows, 100, 2).collect()}
    assert severe["duplicate_rows"] == "warning"
    assert quality.quality_issues(rows, 100, 1).where("code = 'duplicate_rows'").first()["severity"] == "info"
    assert [r["code"] for r in quality.quality_issues(rows, 0, 0).collect()] == ["empty_dataset"]
    assert score(quality.quality_issues(rows, 100, 0), 0) == 0
    assert score(quality.quality_issues(rows, 100, 0).limit(0), 4) == 100


MESSY = """Ticket,Client,Paid,Joined,Memo,Nation,Current
1,  Grace ,"$2,000.75",2025-03-01,,UK,yes
2,Alan,N/A,2025-03-02,,UK,no
3,Edith,$310.00,2025-03-03,,UK,Y
3,Edith,$310.00,2025-03-03,,UK,Y
4,Kurt,"€1,500",2025-03-04,,UK,n
"""


@pytest.fixture
def messy(spark, write_file):
    store = Warehouse(spark)
    pipelines.ingest(spark, store, write_file("messy.csv", MESSY))
    yield store
    store.drop("messy")


def test_messy_file_end_to_end(spark, messy):
    before = sorted(map(str, messy.read("raw", "messy").collect()))
    done = pipelines.clean_table(messy, "messy")
    report = done.report.first()
    assert (report["raw_rows"], report["clean_rows"], report["rows_removed"]) == (5, 4, 1)
    assert dict(done.table.dtypes) == {
        "ticket": "bigint", "client": "string", "paid": "double", "joined": "date",
        "memo": "string", "nation": "string", "current": "boolean",
    }
    values = {r["ticket"]: (r["client"], r["paid"], r["current"]) for r in done.table.collect()}
    assert values == {
        1: ("Grace", 2000.75, True), 2: ("Alan", None, False), 3: ("Edith", 310.0, True), 4: ("Kurt", 1500.0, False),
    }
    assert {r["code"] for r in done.issues.collect()} == {"empty_column", "constant_column", "duplicate_rows"}
    actions = {r["column"]: r["actions"] for r in done.actions.collect()}
    assert actions["paid"] == ["trim_whitespace", "normalize_null_tokens", "cast_to_number"]
    assert actions[None] == ["deduplicate_rows"]
    assert sorted(map(str, messy.read("raw", "messy").collect())) == before

    again = pipelines.clean_table(messy, "messy")
    assert again.table.count() == 4 and again.report.first() == report
    assert pipelines.clean_table(messy, "messy", deduplicate=False).table.count() == 5


def test_rows_made_equal_by_cleaning_stay_unless_raw_had_copies(spark):
    df = spark.createDataFrame([("a ", "1"), ("a", "1")], "x string, y string")
    from ledgerlight.operators.profile import duplicate_rows, profile

    plan = cleaning.plan_cleaning(profile(df), duplicate_rows(df))
    assert cleaning.clean(df, plan).count() == 2


def test_metrics_of_the_messy_file(spark, write_file):
    done, analysed = pipelines.run_pipeline(spark, write_file("messy.csv", MESSY), table="messy_two")
    found = {r["key"]: float(r["value"]) for r in analysed.kpis.collect()}
    assert found["row_count"] == 4 and "unique_customers" in found
    Warehouse(spark).drop("messy_two")
