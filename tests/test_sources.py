import random

import pytest

from ledgerlight.sources import delimited, naming, pages, records, warehouse


def test_headers():
    assert naming.header_names(["Net Total (EUR)", "Sum", "sum", "", "2026", "order", "  padded  ", "ÉTÉ 2026", "99 x"]) == [
        "net_total_eur", "sum", "sum_2", "column_4", "col_2026", "order_col", "padded", "ete_2026", "col_99_x",
    ]
    assert len(naming.header_names(["x" * 300])[0]) == 120


def test_slugs():
    assert naming.table_slug("Sales Report 2026.csv") == "sales_report_2026"
    assert naming.table_slug("2026.csv") == "t_2026"
    assert naming.table_slug("---.csv") == "dataset"
    assert naming.table_slug("a.csv", ["a", "a_2"]) == "a_3"
    with pytest.raises(naming.InvalidName):
        naming.table_slug("a.csv", ["a", *(f"a_{i}" for i in range(2, 200))])


@pytest.mark.parametrize("name", ["Robert'); drop", "a-b", "1a", "A", "", "a" * 121, "a\n"])
def test_bad_identifiers(name):
    with pytest.raises(naming.InvalidName):
        naming.identifier(name)


def test_unsupported_suffix():
    with pytest.raises(naming.InvalidName):
        naming.separator_for("report.pdf")


FILE = 'Order ID,Client Name,Booked On,Paid (GBP),Is New,At\n' \
    '1,"Ada, L",2026-01-05,10.5,true,2026-01-05 10:00\n' \
    '2,Bob,2026-02-06,,false,2026-01-06 11:30:15\n' \
    '3,"say ""hi""",2026-03-07,7,TRUE,2026-01-07 00:00\n'


def test_types_and_names_from_a_file(spark, write_file):
    df = delimited.read_delimited(spark, write_file("orders.csv", FILE))
    assert dict(df.dtypes) == {
        "order_id": "bigint", "client_name": "string", "booked_on": "date", "paid_gbp": "double",
        "is_new": "boolean", "at": "timestamp_ntz",
    }
    rows = df.orderBy("order_id").collect()
    assert rows[0]["client_name"] == "Ada, L" and rows[2]["client_name"] == 'say "hi"'
    assert rows[1]["paid_gbp"] is None and rows[2]["is_new"] is True
    schema = {r["normalized_name"]: r for r in delimited.detect_schema(df).collect()}
    assert schema["paid_gbp"]["nullable"] and not schema["order_id"]["nullable"]
    assert schema["paid_gbp"]["name"] == "Paid (GBP)"
    assert schema["order_id"]["sample_values"] == ["1", "2", "3"]
    assert schema["booked_on"]["data_type"] == "date"


def test_tab_separated_ragged_and_duplicate_headers(spark, write_file):
    path = write_file("x.tsv", "A\tA\n1\t2\t3\n4\n")
    assert [tuple(r) for r in delimited.read_delimited(spark, path).collect()] == [(1, 2), (4, None)]


def test_line_breaks_inside_quotes(spark, write_file):
    path = write_file("x.csv", 'a,b\n1,"two\nlines"\n')
    for one_task in (True, False):
        assert [tuple(r) for r in delimited.read_delimited(spark, path, one_task).collect()] == [(1, "two\nlines")]
    assert records.broken_records(spark, write_file("y.csv", 'a,b\n1,"say ""so"", x"\n5" pipe,x\n'), ",") is None


def odd_lines(separator):
    """Broken and whole cells, doubled quotes, stray quotes, text after a closing quote, blank lines."""
    draw = random.Random(4)
    cells = ['plain', '"quoted"', '"a ""b"" c"', '5" pipe', '"two\nlines"', '"x\n\n""y""\nz"', '', '""', '"end""\n"',
             f'"in{separator}side"', '"after" word', ' "not open', '"\n"', '"one\ntwo" tail', "it's", '"cr\r\nlf"']
    rows = [separator.join(draw.choice(cells) for _ in range(3)) for _ in range(400)]
    long = '"' + "\n".join(["long, " * 20] * 200) + '"'
    rows[150] = separator.join([long, "x", long])
    rows[300] += "\n\n"
    return rows


@pytest.mark.parametrize("name,separator", [("x.csv", ","), ("x.tsv", "\t")])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_give_the_records_of_one_task(spark, write_file, name, separator, end):
    texts = [e.join([separator.join(["a", '"b\n2"', "c"]), *odd_lines(separator)]) + e for e in (end, "\n")]
    path, plain = (write_file(place + name, text) for place, text in zip("pq", texts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert records._lines(spark, path).rdd.getNumPartitions() > 20
        one, many = (delimited.read_delimited(spark, p, t) for p, t in ((plain, True), (path, False)))
        assert one.dtypes == many.dtypes
        assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect())) and many.count() >= 390
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_range_is_composed_from_either_state():
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(draw.choice('ab,"\n') for _ in range(draw.randint(1, 60)))
        lines = text.split("\n")
        inside, wanted = False, []
        for line in lines:
            wanted.append(inside)
            inside = records.ends_inside(line, ",", inside)
        begins = sorted(draw.sample(range(1, len(lines)), min(len(lines) - 1, 3))) if len(lines) > 1 else []
        rows = []
        for begin, end in zip([0, *begins], [*begins, len(lines)]):
            own = [line for line in lines[begin:end] if '"' in line]
            state = [False, True, False, False]
            for line in own:
                state[:2] = (records.ends_inside(line, ",", s) for s in state[:2])
                state[2:] = state[2] or state[0], state[3] or not state[1]
            if own:
                rows.append(dict(zip(
                    ("file", "begin", "from_start", "from_inside", "breaks", "closed"), ("f", begin, *state)
                )))
        states = records.States(rows)
        assert [states.at("f", b)[0] for b in [0, *begins]] == [wanted[b] for b in [0, *begins]]


def test_days_first(spark, write_file):
    path = write_file("x.csv", "a,b,c,d\n31/12/2025,05-06-2025,31/12/2025 10:30,12/31/2025\n01/2/2026,7-8-2025,1/1/2026 00:00:01.5,12/30/2025\n")
    read = delimited.read_delimited(spark, path)
    assert dict(read.dtypes) == {"a": "date", "b": "date", "c": "timestamp_ntz", "d": "string"}
    assert [str(v) for v in read.collect()[1]] == ["2026-02-01", "2025-08-07", "2026-01-01 00:00:01.500000", "12/30/2025"]
    mixed = delimited.read_delimited(spark, write_file("y.csv", "a\n31/12/2025\n2025-12-30\n"))
    assert dict(mixed.dtypes) == {"a": "string"}


def test_a_misfit_in_the_last_row_keeps_the_column_text(spark, write_file):
    path = write_file("x.csv", "a,b\n" + "".join(f"{n},{n}\n" for n in range(12_000)) + "A-0,7\n")
    read = delimited.read_delimited(spark, path)
    assert dict(read.dtypes) == {"a": "string", "b": "bigint"}
    assert read.where("a IS NULL").count() == 0 and read.count() == 12_001
    assert dict(delimited.read_sample(spark, path, rows=50).dtypes)["a"] == "bigint"


def test_empty_file(spark, write_file):
    with pytest.raises(delimited.UnreadableFile):
        delimited.read_delimited(spark, write_file("x.csv", ""))


def test_sample_is_bounded(spark, write_file):
    path = write_file("x.csv", "a\n" + "\n".join(map(str, range(50))))
    assert delimited.read_sample(spark, path, rows=7).count() == 7


def test_samples_of_sparse_columns_come_from_beyond_the_head(spark):
    df = spark.range(500).selectExpr("id", "if(id > 490, cast(id as string), null) as rare").coalesce(1)
    rare = delimited.detect_schema(df).collect()[1]
    assert rare["sample_values"] == ["491", "492", "493", "494", "495"]


def test_warehouse(spark):
    store = warehouse.Warehouse(spark)
    df = spark.range(30).toDF("id")
    store.write("raw", "numbers", df)
    store.write("raw", "numbers", df)
    assert store.row_count("raw", "numbers") == 30 and store.exists("raw", "numbers")
    page = store.preview("numbers", limit=5, offset=3, order_by=["id"])
    assert [r["id"] for r in page.collect()] == [3, 4, 5, 6, 7]
    assert store.preview("numbers", limit=0).count() == 1
    with pytest.raises(LookupError):
        store.preview("numbers", layer="clean")
    store.write("clean", "numbers", df.where("id < 10"))
    assert store.layer_of("numbers") == "clean" and store.target("numbers") == "clean.numbers"
    found = store.query("SELECT count(*) AS n FROM clean.numbers WHERE id > :low", low=7)
    assert found.first()["n"] == 2
    store.drop("numbers")
    assert not store.exists("raw", "numbers") and not store.exists("clean", "numbers")


def test_a_failed_load_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    store = warehouse.Warehouse(spark, str(tmp_path / "place"))
    store.write("raw", "loads", spark.range(5).toDF("id"))
    before, reading = store.version("raw", "loads"), store.read("raw", "loads")

    with pytest.raises(Exception):  # fails while it writes
        store.write("raw", "loads", spark.range(5).selectExpr("raise_error('no') AS id"))
    assert store.row_count("raw", "loads") == 5 and store.version("raw", "loads") == before

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:  # killed between the write and the switch
        patch.setattr(store, "_switch", killed)
        with pytest.raises(KeyboardInterrupt):
            store.write("raw", "loads", spark.range(9).toDF("id"))
    assert store.row_count("raw", "loads") == 5 and reading.count() == 5

    store.write("raw", "loads", store.read("raw", "loads").selectExpr("id", "id * 2 AS twice"))  # from itself
    assert store.read("raw", "loads").columns == ["id", "twice"] and store.version("raw", "loads") != before
    assert before.split(".")[1] not in [t.name for t in spark.catalog.listTables(store.versions)]
    store.drop("loads")
    assert store.version("raw", "loads") is None
    spark.range(2).write.saveAsTable("raw.plain_loads")  # a plain table gives way to a version
    assert store.write("raw", "plain_loads", spark.range(3)).count() == 3 and store.version("raw", "plain_loads")
    store.drop("plain_loads")


def test_pages_read_their_ranges_only(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 7 AS kind", "1000 - id AS id", "map('a', id) AS m")
    pages.ordered_copy(df, ["kind"], 13).write.partitionBy(pages.RANGE).parquet(f"{tmp_path}/copy")
    found = pages.Pages.of(spark.read.parquet(f"{tmp_path}/copy"))
    wanted = [(r["kind"], r["id"]) for r in df.orderBy("kind", "id").collect()]
    assert found.rows == 1000 and len(found.sizes) > 9
    for limit, offset in ((10, 0), (50, 333), (1, 999), (5, 998), (10, 1000), (2000, 0), (0, 4), (3, -1)):
        got = [(r["kind"], r["id"]) for r in found.page(limit, offset).collect()]
        assert got == wanted[max(0, offset):max(0, offset) + max(1, limit)]
    page = found.page(5, 600)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({pages.RANGE}" in plan or f"PartitionFilters: [{pages.RANGE}" in plan


def test_stored_pages_follow_the_table(spark, tmp_path):
    store = warehouse.Warehouse(spark, str(tmp_path / "paged"))
    store.write("clean", "paged", spark.range(100).selectExpr("id", "id % 3 AS kind"))
    first = [tuple(r) for r in store.preview("paged", limit=3, offset=40, order_by=["kind"]).collect()]
    assert first == [(19, 1), (22, 1), (25, 1)]  # 34 of kind 0 come before
    copy = store.version("meta", "paged_pages")
    store.preview("paged", limit=3, order_by=["kind"])
    assert store.version("meta", "paged_pages") == copy
    store.write("clean", "paged", spark.range(5).selectExpr("9 - id AS id", "0 AS kind"))
    assert [r["id"] for r in store.preview("paged", limit=2, offset=1, order_by=["id"]).collect()] == [6, 7]
    assert store.version("meta", "paged_pages") != copy
    store.drop("paged")
    assert not store.exists("meta", "paged_pages")


def test_tables_are_stored_in_zstd(spark):
    store = warehouse.Warehouse(spark)
    rows = store.write("raw", "packed", spark.range(10).selectExpr("id", "concat('text ', id) AS t"))
    assert all(name.endswith(".zstd.parquet") for name in rows.inputFiles()) and rows.count() == 10
    store.drop("packed")
