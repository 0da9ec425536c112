"""The registered queries as plain SQL for another engine, to check results against.

Written from the definitions, not from the library's code: window functions, correlated
conditions and ``quantile_cont`` in place of cells, masks and narrowing.
"""

from __future__ import annotations


TOKENS = "('', 'na', 'n/a', 'n.a.', 'null', 'none', 'nil', '-', '--', '?', 'unknown')"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"
WORDS = "('true', 'yes', 'y', 't', '1', 'false', 'no', 'n', 'f', '0')"

SALES = """sales AS (
    SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
           o_orderdate AS order_date, l_extendedprice * (1 - l_discount) AS revenue,
           l_quantity AS units, l_quantity * p_retailprice AS unit_cost, l_linestatus AS status,
           l_returnflag AS return_class, o_orderpriority AS priority_class
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
CUSTOMERS = """customers AS (
    SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
           c_nationkey AS nation_id, c_acctbal AS balance FROM customer)"""
PRODUCTS = """products AS (
    SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category,
           p_size AS size, p_retailprice AS list_price FROM part)"""
MESSY = """messy AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS order_no,
           CASE WHEN l_linenumber = 3 THEN '  Customer ' || (l_suppkey % 97) || ' '
                ELSE 'Customer ' || (l_suppkey % 97) END AS customer,
           CASE WHEN l_orderkey % 50 = 0 THEN 'N/A'
                ELSE '$' || format('{:,.2f}', l_extendedprice) END AS revenue,
           CASE WHEN l_orderkey % 40 = 1 THEN strftime(l_shipdate, '%Y/%m/%d')
                ELSE strftime(l_shipdate, '%Y-%m-%d') END AS order_date,
           CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'no' END AS active,
           CAST(NULL AS VARCHAR) AS notes, 'UK' AS country,
           CASE WHEN l_partkey % 10 < 6 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
                ELSE 'lot ' || (l_partkey % 7) END AS remark,
           l_orderkey || '-' || l_partkey || '-' || l_suppkey AS tracking,
           CASE WHEN l_orderkey % 3 = 0
                THEN CASE WHEN l_orderkey % 2 = 0 THEN ' unknown' ELSE 'gift' END END AS wrap
    FROM lineitem, (VALUES (1), (2)) AS twice(copy)
    WHERE copy = 1 OR l_orderkey % 100 = 7)"""
MESSY_COLUMNS = (
    "order_no", "customer", "revenue", "order_date", "active", "notes", "country", "remark",
    "tracking", "wrap",
)
_AS_NUMBER = r"TRY_CAST(regexp_replace({0}, '[$€£,\s]', '', 'g') AS DOUBLE)"
CLEANED = f"""cleaned AS (
    SELECT DISTINCT TRY_CAST(order_no AS DOUBLE) AS order_no, trim(customer) AS customer,
           CASE WHEN lower(trim(revenue)) IN {TOKENS} THEN NULL
                ELSE {_AS_NUMBER.format('trim(revenue)')} END AS revenue,
           strftime(TRY_CAST(replace(order_date, '/', '-') AS DATE), '%Y-%m-%d') AS order_date,
           CASE WHEN lower(active) IN ('true', 'yes', 'y', 't', '1') THEN TRUE
                WHEN lower(active) IN ('false', 'no', 'n', 'f', '0') THEN FALSE END AS active,
           notes, country, remark, tracking,
           CASE WHEN lower(trim(wrap)) IN {TOKENS} THEN NULL ELSE trim(wrap) END AS wrap
    FROM messy)"""


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _base(table: str, column: str, kind: str = "", source: str | None = None) -> str:
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", '{kind}' AS data_type,
        count(*) AS row_count, count(*) - count("{column}") AS null_count,
        count(DISTINCT "{column}") AS distinct_count FROM {source or table}"""


def _text_stats() -> str:
    """Text shape counts and base counts of every messy column."""
    parts = []
    for position, c in enumerate(MESSY_COLUMNS):
        real = f"({c} IS NOT NULL AND lower(trim({c})) NOT IN {TOKENS})"
        bare = rf"regexp_replace(trim({c}), '[$€£,\s]', '', 'g')"
        parts.append(f"""SELECT {position} AS position, '{c}' AS "column", count(*) AS row_count,
            count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
            count(*) FILTER (WHERE trim({c}) = '') AS blank_count,
            count(*) FILTER (WHERE lower(trim({c})) IN {TOKENS}) AS null_token_count,
            count(*) FILTER (WHERE {c} <> trim({c})) AS whitespace_count,
            count(*) FILTER (WHERE {real} AND regexp_matches({bare}, '{NUMBER}')) AS numbers,
            count(*) FILTER (WHERE {real} AND regexp_matches(trim({c}), '{DATE}')
                AND TRY_CAST(replace(trim({c}), '/', '-') AS DATE) IS NOT NULL) AS dates,
            count(*) FILTER (WHERE {real} AND lower(trim({c})) IN {WORDS}) AS words,
            NULLIF(count(*) FILTER (WHERE {real}), 0) AS real FROM messy""")
    return f"stats AS ({_union(parts)})"


def _profile_string() -> str:
    return f"""WITH {MESSY}, {_text_stats()}
    SELECT "column", blank_count, null_token_count, whitespace_count,
           round(numbers / real, 6) AS numeric_like_fraction,
           round(dates / real, 6) AS date_like_fraction,
           round(words / real, 6) AS boolean_like_fraction
    FROM stats WHERE null_count < row_count"""


def _duplicates() -> str:
    return "dup AS (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS extra FROM messy)"


def _count(count: str, noun: str) -> str:
    return f"{count} || CASE WHEN {count} = 1 THEN ' {noun}' ELSE ' {noun}s' END"


def _percent(share: str) -> str:
    return f"CAST(round_even(({share}) * 100, 0) AS BIGINT) || '%'"


def _cleaning_plan() -> str:
    return f"""WITH {MESSY}, {_text_stats()}, {_duplicates()}, planned AS (
        SELECT "column",
            concat_ws(' ', CASE WHEN whitespace_count > 0 OR null_token_count > 0 THEN 'trim_whitespace' END,
                CASE WHEN null_token_count > 0 THEN 'normalize_null_tokens' END,
                CASE WHEN words / real >= 0.95 THEN 'cast_to_boolean'
                     WHEN dates / real >= 0.95 THEN 'cast_to_date'
                     WHEN numbers / real >= 0.95 THEN 'cast_to_number' END) AS actions,
            CASE WHEN words / real >= 0.95 THEN 'boolean' WHEN dates / real >= 0.95 THEN 'date'
                 WHEN numbers / real >= 0.95 THEN 'decimal' ELSE 'string' END AS resulting_type,
            concat_ws('; ', CASE WHEN whitespace_count > 0 THEN {_count("whitespace_count", "value")} || ' lost padding' END,
                CASE WHEN null_token_count > 0 THEN {_count("null_token_count", "placeholder")} || ' became NULL' END,
                CASE WHEN words / real >= 0.95 THEN 'true/false words became booleans'
                     WHEN dates / real >= 0.95 THEN 'text dates became dates'
                     WHEN numbers / real >= 0.95 THEN 'numbers were read after dropping currency signs and separators' END) AS why
        FROM stats)
    SELECT "column", actions, resulting_type, upper(why[1]) || why[2:] || '.' AS reason FROM planned WHERE actions <> ''
    UNION ALL SELECT '*', 'deduplicate_rows', '-', 'Rows that repeat another row exactly were dropped.' FROM dup WHERE extra > 0"""


def _issues() -> str:
    rules = [
        ("null_count = row_count", "empty_column", "'error'", "'has no values at all.'"),
        ("null_count < row_count AND null_count / row_count >= 0.5", "high_null_rate", "'warning'",
         f"'is ' || {_percent('null_count / row_count')} || ' null, so its totals and means mislead.'"),
        ("null_count < row_count AND distinct_count = 1 AND row_count > 1", "constant_column", "'info'",
         "'never changes and explains nothing.'"),
        ("null_count < row_count AND numbers / real >= 0.5 AND numbers / real < 0.95", "mixed_types", "'warning'",
         f"'is ' || {_percent('numbers / real')} || ' numbers and the rest text; it stayed text.'"),
        ("null_count < row_count AND distinct_count / row_count >= 0.9 AND row_count > 10", "high_cardinality", "'info'",
         "'has nearly as many values as rows, like an identifier.'"),
    ]
    parts = [
        f"""SELECT "column" AS column_name, '{code}' AS code, {severity} AS severity,
            chr(39) || "column" || chr(39) || ' ' || {message} AS message FROM stats WHERE {holds}"""
        for holds, code, severity, message in rules
    ]
    parts.append(f"""SELECT '*', 'duplicate_rows', CASE WHEN extra / rows > 0.01 THEN 'warning' ELSE 'info' END,
        {_count("extra", "repeated row")} || ' dropped, or ' || {_percent("extra / rows")} || ' of the table.'
        FROM dup WHERE extra > 0""")
    return f"{MESSY}, {_text_stats()}, {_duplicates()}, issues AS ({_union(parts)})"


def _quality_report() -> str:
    weight = "CASE severity WHEN 'error' THEN 25.0 WHEN 'warning' THEN 10.0 ELSE 2.0 END"
    return f"""WITH {_issues()}, {CLEANED}
    SELECT count(*) AS issue_count,
        count(*) FILTER (WHERE severity = 'error') AS error_count,
        count(*) FILTER (WHERE severity = 'warning') AS warning_count,
        count(*) FILTER (WHERE severity = 'info') AS info_count,
        CAST(greatest(0, least(100, round_even(100 - sum(CASE WHEN column_name = '*' THEN {weight}
            ELSE {weight} / {len(MESSY_COLUMNS)} END), 0))) AS INTEGER) AS score,
        (SELECT rows FROM dup) AS raw_rows, (SELECT count(*) FROM cleaned) AS clean_rows,
        (SELECT rows FROM dup) - (SELECT count(*) FROM cleaned) AS rows_removed
    FROM issues"""


def _profile_base() -> str:
    columns = [
        *[("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")],
        *[("events", c) for c in ("event_id", "ts", "user_id", "event_type", "value", "props")],
        *[("messy", c) for c in MESSY_COLUMNS],
    ]
    parts = _union(_base("messy_sales" if t == "messy" else t, c, source=t) for t, c in columns)
    return f"""WITH {MESSY}, found AS ({parts})
    SELECT "table", "column", row_count, null_count, distinct_count,
        round(null_count / row_count, 6) AS null_fraction,
        round(distinct_count / row_count, 6) AS distinct_fraction,
        distinct_count = 1 AND row_count > 1 AS is_constant, null_count = row_count AS is_empty
    FROM found"""


_NUMBERS = [
    *(("lineitem", f"l_{c}") for c in (
        "orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax",
    )),
    *(("events", c) for c in ("event_id", "user_id", "value")),
]


def _profile_numeric() -> str:
    return _union(
        f"""SELECT '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 4) AS min_value,
            round(CAST(max({c}) AS DOUBLE), 4) AS max_value, round(avg({c}), 4) AS mean_value,
            round(CAST(median({c}) AS DOUBLE), 4) AS median_value, round(stddev_samp({c}), 4) AS stddev_value,
            round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q1,
            round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q3 FROM {t}"""
        for t, c in _NUMBERS
    )


def _outliers() -> str:
    return _union(
        f"""SELECT '{c}' AS "column", count(*) AS outlier_count FROM {t},
            (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t})
            WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"""
        for t, c in _NUMBERS
    )


def _temporal() -> str:
    day = lambda t, c: f"""SELECT '{c}' AS "column", strftime(min({c}), '%Y-%m-%dT%H:%M:%S') AS min_date,
        strftime(max({c}), '%Y-%m-%dT%H:%M:%S') AS max_date FROM {t}"""
    exact = """SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS min_date,
        strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS max_date FROM events"""
    return _union([day("orders", "o_orderdate"), exact, day("lineitem", "l_shipdate")])


def _top_values() -> str:
    parts = _union(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count,
            (SELECT count(*) FROM messy) AS rows, count(*) OVER () AS groups
            FROM messy WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in MESSY_COLUMNS
    )
    return f"""WITH {MESSY}, counted AS ({parts}), placed AS (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS place FROM counted)
    SELECT "column", CAST(place AS INTEGER) AS place, value, count, round(count / rows, 6) AS fraction
    FROM placed WHERE place <= 10 AND groups <= 50"""


_SALES_TYPES = {
    "order_id": "integer", "customer_id": "integer", "product_id": "integer",
    "order_date": "timestamp", "revenue": "decimal", "units": "decimal", "unit_cost": "decimal",
    "status": "string", "return_class": "string", "priority_class": "string",
}
_EVENT_TYPES = {
    "event_id": "integer", "ts": "timestamp", "user_id": "integer", "event_type": "string",
    "value": "decimal", "props": "string",
}
# The words of column names by tag.
_TAGS = (
    ("discount", "discount|markdown|rebate"), ("cost", "cost|cogs|expense|spend"),
    ("rating", "rating|score|nps|satisfaction"),
    ("monetary", "revenue|sales|amount|total|price|subtotal|gross|net|turnover|value|payment|charge"),
    ("quantity", "qty|quantity|units|volume|items"),
    ("customer_key", "customer|client|account|user|buyer|member"),
    ("product_key", "product|sku|item|article"),
    ("order_key", "order|invoice|transaction|purchase|booking"),
    ("geography", "country|region|city|state|province|territory|zone|market|store"),
    ("category", "category|segment|type|group|class|channel|brand"),
    ("status", "status|state|stage|phase"),
    ("event_date", "date|time|day|month|year|created|updated|timestamp"),
)


def _semantics(table: str, types: dict[str, str], prelude: str) -> str:
    tag = " ".join(
        f"""WHEN regexp_matches("column", '(^|_)({words})') THEN '{name}'""" for name, words in _TAGS
    )
    is_key = """regexp_matches("column", '(^|_)(id|key|code|ref|number|no)$')"""
    return f"""WITH {prelude} found AS ({_union(_base(table, c, t) for c, t in types.items())}),
    tagged AS (SELECT *, CASE {tag} END AS tag, {is_key} AS is_key FROM found),
    ruled AS (SELECT *, CASE
        WHEN null_count / row_count >= 0.95 OR distinct_count = 1 THEN 'ignored'
        WHEN data_type IN ('date', 'timestamp') THEN 'time'
        WHEN data_type IN ('integer', 'decimal') AND (is_key OR tag IN ('customer_key', 'product_key', 'order_key')) THEN 'identifier'
        WHEN data_type = 'integer' AND row_count >= 50 AND distinct_count / row_count >= 0.99 THEN 'identifier'
        WHEN data_type IN ('integer', 'decimal') THEN 'measure'
        WHEN is_key OR distinct_count > 1000 OR (row_count >= 50 AND distinct_count / row_count >= 0.5) THEN 'identifier'
        ELSE 'dimension' END AS role FROM tagged)
    SELECT "column", data_type, role, CASE WHEN role = 'time' THEN 'event_date'
        WHEN tag IS NOT NULL THEN tag WHEN role = 'measure' THEN 'quantity'
        WHEN role = 'dimension' THEN 'category' ELSE '' END AS tags FROM ruled"""


def _kpi(key, label, form, sql, places=4) -> str:
    return f"SELECT '{key}' AS key, '{label}' AS label, '{form}' AS format, round(CAST(({sql}) AS DOUBLE), {places}) AS value"


def _kpis(table: str, revenue: str, customer: str, order=None, quantity=None, cost=None, places=4) -> list[str]:
    f = f"FROM {table}"
    repeat = (
        f"SELECT count(*) FILTER (WHERE n > 1) / count(*) FROM "
        f"(SELECT count(*) AS n {f} WHERE {customer} IS NOT NULL GROUP BY {customer})"
    )
    kpi = lambda *a: _kpi(*a, places)
    found = [
        kpi("row_count", "Records", "number", f"SELECT count(*) {f}"),
        kpi("total_revenue", "Total revenue", "currency", f"SELECT sum({revenue}) {f}"),
        kpi("average_transaction", "Average transaction", "currency", f"SELECT avg({revenue}) {f}"),
        kpi("unique_customers", "Unique customers", "number", f"SELECT count(DISTINCT {customer}) {f}"),
        kpi("revenue_per_customer", "Revenue per customer", "currency", f"SELECT sum({revenue}) / count(DISTINCT {customer}) {f}"),
        kpi("repeat_customer_rate", "Repeat customer rate", "percent", repeat),
    ]
    if quantity:
        found.append(kpi("total_units", "Total units", "number", f"SELECT sum({quantity}) {f}"))
    if order:
        found.append(kpi("order_count", "Orders", "number", f"SELECT count(DISTINCT {order}) {f}"))
        found.append(kpi("average_order_value", "Average order value", "currency", f"SELECT sum({revenue}) / count(DISTINCT {order}) {f}"))
    if cost:
        found.append(kpi("gross_margin", "Gross margin", "percent", f"SELECT (sum({revenue}) - sum({cost})) / sum({revenue}) {f}"))
    return found


def _series(grain: str, time: str, value: str, source: str, where: str = "TRUE") -> str:
    return (
        f"SELECT date_trunc('{grain}', {time}) AS period, {value} AS value FROM {source} "
        f"WHERE {time} IS NOT NULL AND {where} GROUP BY 1"
    )


def _timeseries(grain: str, sales: bool) -> str:
    inner = _series(grain, "order_date", "sum(revenue)", "sales") if sales else _series(grain, "ts", "sum(value)", "events")
    return f"WITH {SALES}, s AS ({inner}) SELECT strftime(period, '%Y-%m-%d') AS period, round(value, 4) AS value FROM s"


_ID_COLUMNS = {
    "numeric": (("sales", "order_id"), ("sales", "customer_id"), ("sales", "product_id"),
                ("customers", "customer_id"), ("customers", "nation_id"), ("products", "product_id")),
    "text": (("sales", "status"), ("sales", "return_class"), ("sales", "priority_class"),
             ("customers", "customer_name"), ("customers", "segment"), ("products", "product_name"),
             ("products", "brand"), ("products", "category")),
}


def _pairs() -> str:
    ends = [(t, c, f) for f, columns in _ID_COLUMNS.items() for t, c in columns]
    vals = _union(
        f"SELECT '{t}' AS t, '{c}' AS c, '{f}' AS f, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
        for t, c, f in ends
    )
    return f"""{SALES}, {CUSTOMERS}, {PRODUCTS}, vals AS ({vals}),
    ends AS (SELECT t, c, f, count(*) AS d, sum(n) AS present FROM vals GROUP BY t, c, f),
    pairs AS (
        SELECT a.t AS from_table, a.c AS from_column, b.t AS to_table, b.c AS to_column, b.d AS to_distinct,
            (SELECT count(*) FROM vals x WHERE x.t = a.t AND x.c = a.c AND EXISTS
                (SELECT 1 FROM vals y WHERE y.t = b.t AND y.c = b.c AND y.v = x.v)) / a.d AS containment,
            a.c = b.c AS name_match
        FROM ends a JOIN ends b ON a.f = b.f AND a.t <> b.t
        WHERE b.d >= 2 AND b.d = b.present AND b.d / a.d >= 0.8)"""


def _edges() -> str:
    return f"""{_pairs()}, scored AS (
        SELECT *, least(1.0, round(containment, 4) + CASE WHEN name_match THEN 0.05 ELSE 0 END) AS confidence
        FROM pairs WHERE containment >= 0.8 AND (to_distinct >= 5 OR name_match)),
    edges AS (SELECT * FROM scored QUALIFY row_number() OVER (
        PARTITION BY from_table, from_column ORDER BY confidence DESC, name_match DESC, to_table, to_column) = 1)"""


_WHY = f"""{_percent("containment")} || ' of the values of ' || from_table || '.' || from_column || ' are among the '
    || to_distinct || ' of ' || to_table || '.' || to_column || CASE WHEN name_match THEN ', and the names agree' ELSE '' END
    || CASE WHEN containment < 1 THEN '; ' || {_percent("1 - containment")} || ' have no match' ELSE '' END || '.'"""

_STAR_COLUMNS = {
    "customers": {"customer_name": "string", "segment": "string", "nation_id": "integer", "balance": "decimal"},
    "products": {
        "product_name": "string", "brand": "string", "category": "string", "size": "integer", "list_price": "decimal",
    },
}
_STAR = """star AS (
    SELECT s.*, c.customer_name AS customers_customer_name, c.segment AS customers_segment,
        c.nation_id AS customers_nation_id, c.balance AS customers_balance,
        p.product_name AS products_product_name, p.brand AS products_brand,
        p.category AS products_category, p.size AS products_size, p.list_price AS products_list_price
    FROM sales s LEFT JOIN customers c ON s.customer_id = c.customer_id
        LEFT JOIN products p ON s.product_id = p.product_id)"""


# The 0.9 quantile of Student's t for 2 to 21 degrees of freedom.
_STUDENT_90 = (
    1.8856180831641267, 1.6377443536962102, 1.5332062740589438, 1.4758840488244818, 1.4397557472652386,
    1.4149239276505079, 1.396815309742625, 1.3830287383966327, 1.3721836411103363, 1.3634303180205409,
    1.3562173340231978, 1.3501712887800554, 1.3450303744546506, 1.3406056078504547, 1.3367571673273149,
    1.3333793897216262, 1.3303909435699098, 1.3277282090267981, 1.3253407069850462, 1.3231878738651732,
)


def _forecast(by: str | None) -> str:
    key, keyed = (f"{by}, ", f"{by} AS k") if by else ("", "0 AS k")
    critical = " ".join(f"WHEN {n} THEN {value}" for n, value in enumerate(_STUDENT_90, start=4))
    return f"""WITH {SALES}, s AS (
        SELECT {keyed}, date_trunc('year', order_date) AS period, sum(revenue) AS value FROM sales
        GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period) - 1 AS x FROM s),
    f AS (SELECT k, count(*) AS n, regr_slope(value, x) AS b, regr_intercept(value, x) AS a,
            avg(x) AS xm, regr_sxx(value, x) AS sxx, max(period) AS last, avg(value) AS mean FROM p GROUP BY k),
    r AS (SELECT p.k, sqrt(sum((value - a - b * x) * (value - a - b * x)) / (max(n) - 2)) AS s,
            stddev_samp(value - a - b * x) AS sd FROM p JOIN f ON p.k = f.k GROUP BY p.k),
    o AS (SELECT f.*, s, sd, h, a + b * (n - 1 + h) AS y,
            (CASE n {critical} END) * s * sqrt(1 + 1 / n + (n - 1 + h - xm) * (n - 1 + h - xm) / sxx) AS m
        FROM f JOIN r ON f.k = r.k, range(1, 7) AS steps(h))
    SELECT {'k AS ' + key if by else ''}strftime(last + to_months(CAST(12 * h AS INTEGER)), '%Y-%m-%d') AS period,
        round(greatest(y, 0), 2) AS value, round(greatest(y - m, 0), 2) AS lower,
        round(greatest(y + m, 0), 2) AS upper, 'linear_trend' AS method, n AS history_points,
        round(sd / abs(mean), 6) AS noise_ratio FROM o"""


def _anomalies(series: str, by: str | None, sensitivity: float) -> str:
    return f"""WITH {SALES}, s AS ({series}),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period) - 1 AS x FROM s),
    f AS (SELECT k, count(*) AS n, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM p GROUP BY k),
    r AS (SELECT p.*, a + b * x AS expected, value - a - b * x AS res FROM p JOIN f ON p.k = f.k WHERE n >= 5),
    m AS (SELECT k, median(res) AS med, stddev_samp(res) AS sd FROM r GROUP BY k),
    d AS (SELECT r.k, median(abs(res - med)) * 1.4826 AS mad FROM r JOIN m ON r.k = m.k GROUP BY r.k),
    z AS (SELECT r.*, (res - med) / CASE WHEN mad > 0 THEN mad ELSE sd END AS z
        FROM r JOIN m ON r.k = m.k JOIN d ON r.k = d.k)
    SELECT {f'k AS {by},' if by else ''} strftime(period, '%Y-%m-%d') AS period, round(value, 4) AS value,
        round(expected, 2) AS expected, round(res / abs(expected), 6) AS deviation_ratio,
        round(z, 4) AS z_score, CASE WHEN res > 0 THEN 'above' ELSE 'below' END AS direction,
        CASE WHEN abs(z) >= {sensitivity * 1.5} THEN 'serious' ELSE 'warning' END AS severity
    FROM z WHERE abs(z) >= {sensitivity}"""


_RFM = f"""{SALES}, rfm AS (
    SELECT CAST(customer_id AS VARCHAR) AS customer,
        CAST(floor((epoch((SELECT max(order_date) FROM sales)) - epoch(max(order_date))) / 86400) AS BIGINT) AS recency_days,
        count(*) AS frequency, sum(revenue) AS monetary,
        CAST(floor((epoch(max(order_date)) - epoch(min(order_date))) / 86400) AS BIGINT) AS tenure_days
    FROM sales WHERE customer_id IS NOT NULL AND order_date IS NOT NULL GROUP BY customer_id),
    cut AS (SELECT round_even(greatest(30, quantile_cont(CAST(recency_days AS DOUBLE), 0.7)), 0) AS cutoff_days FROM rfm)"""

_STEPS = 12


def _newton_sql() -> str:
    """Newton steps for the weighted ridge logistic, each an aggregate and a 4x4 Cholesky solution."""
    x = ["1", "x1", "x2", "x3"]
    parts = ["b0 AS (SELECT 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3)"]
    for k in range(1, _STEPS + 1):
        gradient = ", ".join(f"sum(w * (p - y) * {x[i]}){f' + max(c{i})' if i else ''} AS g{i}" for i in range(4))
        curve = ", ".join(
            f"sum(w * p * (1 - p) * {x[i]} * {x[j]}){' + 1' if i == j and i else ''} AS h{i}{j}"
            for i in range(4) for j in range(i, 4)
        )
        lower = []
        for i in range(4):
            for j in range(i + 1):
                rest = "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
                lower.append(f"sqrt(h{i}{i}{rest}) AS l{i}{i}" if i == j else f"(h{j}{i}{rest}) / l{j}{j} AS l{i}{j}")
            lower.append(f"(g{i}{''.join(f' - l{i}{m} * q{m}' for m in range(i))}) / l{i}{i} AS q{i}")
        for i in reversed(range(4)):
            lower.append(f"(q{i}{''.join(f' - l{m}{i} * d{m}' for m in range(i + 1, 4))}) / l{i}{i} AS d{i}")
        parts.append(f"""a{k} AS MATERIALIZED (SELECT {gradient}, {curve} FROM (
            SELECT x.*, c.*, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2 + c3 * x3))) AS p FROM x, b{k - 1} c))""")
        parts.append(f"""b{k} AS MATERIALIZED (SELECT {", ".join(f"c{i} - d{i} AS c{i}" for i in range(4))}
            FROM (SELECT *, {", ".join(lower)} FROM a{k}), b{k - 1})""")
    return ", ".join(parts)


def _churn() -> str:
    kinds = ("frequency", "monetary", "tenure_days")
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(kinds, 1))
    scaled = ", ".join(f"({c} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS x{i}" for i, c in enumerate(kinds, 1))
    return f"""{_RFM}, labelled AS (SELECT rfm.*, cutoff_days, (recency_days > cutoff_days)::INT AS y FROM rfm, cut),
    facts AS (SELECT count(*) AS n, sum(y) AS gone, max(cutoff_days) AS cutoff_days, {moments} FROM labelled),
    x AS MATERIALIZED (SELECT l.*, {scaled}, CASE WHEN y = 1 THEN n / (2 * gone) ELSE n / (2 * (n - gone)) END AS w
        FROM labelled l, facts),
    {_newton_sql()}, scored AS (
        SELECT x.*, c.*, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2 + c3 * x3))) AS risk FROM x, b{_STEPS} c)"""


def _churn_model() -> str:
    labels = ("number of purchases", "total spend", "days as a customer")
    parts = _union(
        f"""SELECT '{c}' AS feature, '{label}' AS label, round(c{i}, 6) AS coefficient,
            CASE WHEN c{i} > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction FROM b{_STEPS}"""
        for i, (c, label) in enumerate(zip(("frequency", "monetary", "tenure_days"), labels), 1)
    )
    return f"""WITH {_churn()} SELECT d.*, cutoff_days, n AS customers, gone::BIGINT AS lapsed,
        (SELECT round(avg(((risk > 0.5)::INT = y)::INT), 6) FROM scored) AS accuracy,
        'Lapsed: no purchase in the ' || cutoff_days::BIGINT || ' days up to '
            || strftime((SELECT max(order_date) FROM sales), '%Y-%m-%d') || ', the newest date in the data. '
            || 'The limit is the 70th percentile of days since the last purchase.' AS definition
        FROM ({parts}) d, facts"""


def _churn_scores() -> str:
    return f"""WITH {_churn()} SELECT customer, round(risk, 4) AS risk,
        CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS band,
        recency_days, frequency, round(monetary, 4) AS monetary,
        'Bought ' || frequency || ' time(s) for ' || format('{{:,.0f}}', monetary) || ' in all, the last '
            || recency_days || ' day(s) ago.' AS reason
        FROM scored ORDER BY scored.risk DESC, customer LIMIT 10"""


# Order in which metrics are shown.
_SHOWN = (
    "total_revenue", "gross_margin", "order_count", "average_order_value", "unique_customers",
    "repeat_customer_rate", "revenue_per_customer", "total_units", "average_transaction", "row_count",
)


def _kpis_shown(prelude: str, found: list[str], time: str, value: str, source: str) -> str:
    places = " ".join(f"WHEN '{key}' THEN {n}" for n, key in enumerate(_SHOWN))
    return f"""WITH {prelude} k AS ({_union(found)}), s AS ({_series('month', time, f'sum({value})', source)}),
    g AS (SELECT *, lag(value) OVER (ORDER BY period) AS previous FROM s ORDER BY period DESC LIMIT 1)
    SELECT CAST(row_number() OVER (ORDER BY CASE key {places} END) - 1 AS INTEGER) AS rank, k.*,
        strftime(g.period, '%Y-%m-%d') AS growth_period, round(g.value, 4) AS growth_value,
        round(g.previous, 4) AS growth_previous, round((g.value - g.previous) / g.previous, 6) AS growth_change
    FROM k LEFT JOIN g ON key = 'total_revenue' AND previous IS NOT NULL"""


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def oracle_sql() -> dict[str, str]:
    star = f"WITH {SALES}, {CUSTOMERS}, {PRODUCTS}, {_STAR}"
    found = {
        "scan_preview": "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
        "scan_pages": """SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders
            ORDER BY o_orderpriority, orders.o_orderdate, o_orderkey LIMIT 50 OFFSET 1000""",
        "row_counts": _union(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}""" for t in _TABLES),
        "normalise_headers": "SELECT c_custkey AS customer_id, c_name AS full_name, c_nationkey AS col_2026_nation, c_acctbal AS balance_usd, c_mktsegment AS group_col FROM customer",
        "scan_delimited": "SELECT o_orderkey AS order_id, o_totalprice AS total_price_usd, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS priority, o_orderkey % 2 = 0 AS is_even, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS order_id_2 FROM orders",
        "detect_schema": """SELECT * FROM (VALUES
            (0, 'Order ID', 'order_id', 'integer', FALSE), (1, 'Total Price (USD)', 'total_price_usd', 'decimal', FALSE),
            (2, 'Order Date', 'order_date', 'date', FALSE), (3, 'Priority', 'priority', 'string', FALSE),
            (4, 'Is Even', 'is_even', 'boolean', FALSE),
            (5, 'Order ID ', 'order_id_2', 'integer', (SELECT count(*) FILTER (WHERE o_custkey % 5 = 0) > 0 FROM orders)))
            AS t(position, name, normalized_name, data_type, nullable)""",
        "bounded_select": f"WITH {SALES} SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS lines FROM sales GROUP BY 1 ORDER BY lines DESC, month LIMIT 5",
        "profile_base": _profile_base(),
        "profile_numeric": _profile_numeric(),
        "profile_outliers": _outliers(),
        "profile_temporal": _temporal(),
        "profile_string": _profile_string(),
        "profile_top_values": _top_values(),
        "duplicate_count": f"WITH {MESSY}, {_duplicates()} SELECT rows, extra AS duplicate_rows FROM dup",
        "cleaning_plan": _cleaning_plan(),
        "clean_messy_sales": f"WITH {MESSY}, {CLEANED} SELECT * FROM cleaned",
        "quality_issues": f"WITH {_issues()} SELECT * FROM issues",
        "quality_report": _quality_report(),
        "semantics_sales": _semantics("sales", _SALES_TYPES, SALES + ","),
        "semantics_events": _semantics("events", _EVENT_TYPES, ""),
        "kpis_sales": _kpis_shown(
            f"{SALES},", _kpis("sales", "revenue", "customer_id", "order_id", "units", "unit_cost"),
            "order_date", "revenue", "sales",
        ),
        "kpis_events": _kpis_shown("", _kpis("events", "value", "user_id"), "ts", "value", "events"),
        "churn_model": _churn_model(),
        "churn_scores": _churn_scores(),
        "timeseries_records": f"WITH s AS ({_series('day', 'ts', 'count(*)', 'events')}) SELECT strftime(period, '%Y-%m-%d') AS period, CAST(value AS DOUBLE) AS value FROM s",
        "growth_month": f"""WITH {SALES}, s AS ({_series('month', 'order_date', 'sum(revenue)', 'sales')}),
            g AS (SELECT *, lag(value) OVER (ORDER BY period) AS previous FROM s)
            SELECT strftime(period, '%Y-%m-%d') AS period, round(value, 4) AS value, round(previous, 4) AS previous,
                round((value - previous) / previous, 6) AS change FROM g ORDER BY period DESC LIMIT 1""",
        "breakdown_segment": f"{star} SELECT customers_segment AS label, round(sum(revenue), 4) AS value FROM star WHERE customers_segment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
        "breakdown_records": "SELECT props AS label, CAST(count(*) AS DOUBLE) AS value FROM events WHERE props IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7",
        "containment_pairs": f"WITH {_pairs()} SELECT from_table, from_column, to_table, to_column, to_distinct, round(containment, 6) AS containment FROM pairs",
        "detect_relationships": f"WITH {_edges()} SELECT from_table, from_column, to_table, to_column, round(containment, 4) AS containment, CAST(confidence AS DOUBLE) AS confidence, to_distinct AS distinct_values, name_match, {_WHY} AS rationale FROM edges",
        "merge_decisions": f"""WITH {_edges()} SELECT from_table, from_column, to_table, to_column, CAST(confidence AS DOUBLE) AS confidence,
            CASE WHEN from_table = 'sales' AND from_column IN ('customer_id', 'product_id') THEN TRUE
                 WHEN from_column = 'nation_id' THEN FALSE END AS confirmed FROM edges""",
        "star_sales": f"{star} SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date, round(revenue, 4) AS revenue) FROM star",
        "star_reconcile": f"{star} SELECT customers_segment, products_category, count(*) AS rows, round(sum(revenue), 4) AS revenue FROM star GROUP BY 1, 2",
        "table_roles": """SELECT 'sales' AS "table", 'fact' AS role, count(*) AS rows, 'customers on customer_id, products on product_id' AS joined_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
            UNION ALL SELECT 'customers', 'dimension', count(*), '' FROM customer UNION ALL SELECT 'products', 'dimension', count(*), '' FROM part""",
        "star_columns": f"{star} " + _union(
            f"SELECT '{t}_{c}' AS \"column\", '{kind}, from {t} via {t[:-1]}_id' AS description, count({t}_{c}) AS filled FROM star"
            for t, columns in _STAR_COLUMNS.items() for c, kind in columns.items()
        ),
        "model_job": f"{star} SELECT customers_segment, products_category, count(*) AS rows, round(sum(revenue), 4) AS revenue FROM star GROUP BY 1, 2",
        "forecast_seasonal_bands": f"""WITH {SALES}, s AS (SELECT max(date_trunc('month', order_date)) AS last,
            count(DISTINCT date_trunc('month', order_date)) AS n FROM sales)
            SELECT strftime(last + to_months(CAST(h AS INTEGER)), '%Y-%m-%d') AS period, 'holt_winters' AS method,
            n AS history_points, round(sqrt(h), 4) AS width_ratio FROM s, range(1, 7) AS steps(h)""",
        "scan_delimited_odd": """SELECT CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'A-' || o_orderkey
            ELSE o_orderkey::VARCHAR END AS order_id,
            CASE WHEN o_orderkey % 7 = 0 THEN 'two' || chr(10) || 'lines, "quoted" ' ELSE '' END || o_orderpriority AS note,
            o_custkey AS customer FROM orders""",
        "scan_sample": """SELECT s_suppkey AS supplier, s_name AS name, s_nationkey::BIGINT AS nation,
            'bigint, string, bigint' AS types FROM supplier ORDER BY s_suppkey LIMIT 6""",
        "upload_names": """WITH f AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 > 0
                THEN (n_nationkey % 5) || ' ' || 'Nation' || substr(n_name, 7) || ' sales' ELSE 'Sales' END AS stem,
                CASE n_nationkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN ' (2).TSV' WHEN 2 THEN '.txt' ELSE '.xls' END AS ending FROM nation),
            g AS (SELECT *, trim(regexp_replace(lower(stem || CASE WHEN ending LIKE ' (2)%' THEN ' (2)' ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_') AS plain FROM f),
            h AS (SELECT *, CASE WHEN regexp_matches(plain, '^[0-9]') THEN 't_' || plain ELSE plain END AS slug FROM g WHERE ending <> '.xls'),
            i AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY k) AS copy FROM h),
            j AS (SELECT k, CASE WHEN slug = 'sales_2' THEN 'sales_2_' || (copy + 1)
                WHEN copy > 1 THEN slug || '_' || copy ELSE slug END AS slug FROM i)
            SELECT stem || ending AS file, coalesce(slug, '') AS slug, CASE WHEN ending = '.xls' THEN 'refused'
                WHEN ending LIKE '%TSV' THEN 'tab' ELSE ',' END AS separator FROM f LEFT JOIN j USING (k)""",
        "warehouse_loads": _union(
            f"SELECT '{step}' AS step, '{layer}' AS layer, {rows} AS rows FROM orders"
            for step, layer, rows in (
                ("loaded", "raw", "count(*)"), ("loaded", "clean", "count(*) FILTER (o_orderstatus = 'F')"),
                ("loaded again", "raw", "count(*) FILTER (o_custkey % 2 = 0)"),
                ("loaded again", "clean", "count(*) FILTER (o_orderstatus = 'F')"),
                ("dropped", "raw", "-1 * count(*) // greatest(count(*), 1)"), ("dropped", "clean", "-1 * count(*) // greatest(count(*), 1)"),
            )
        ),
        "parametric_query": """SELECT o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
            FROM orders WHERE o_totalprice >= 1000 GROUP BY 1""",
        "quality_numbers": f"""WITH t AS (SELECT l_quantity, pow(l_extendedprice, 6) AS steep,
                CASE WHEN l_linenumber = 7 THEN l_extendedprice END AS rare FROM lineitem),
            n AS (SELECT count(*) AS rows, count(rare) AS held, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS different FROM t),
            q AS (SELECT quantile_cont(steep, 0.25) AS q1, quantile_cont(steep, 0.75) AS q3 FROM t),
            o AS (SELECT count(*) AS out FROM t, q WHERE steep < q1 - 1.5 * (q3 - q1) OR steep > q3 + 1.5 * (q3 - q1))
            SELECT 'full' AS "table", 'rare' AS column_name, 'high_null_rate' AS code, 'warning' AS severity, chr(39) || 'rare' || chr(39)
                || ' is ' || {_percent("(rows - held) / rows")} || ' null, so its totals and means mislead.' AS message FROM n WHERE (rows - held) / rows >= 0.5
            UNION ALL SELECT 'full', 'steep', 'outliers', 'info', chr(39) || 'steep' || chr(39) || ' has ' || out || ' extreme values, '
                || {_percent("out / rows")} || ' of those present.' FROM o, n WHERE out / rows >= 0.05
            UNION ALL SELECT 'full', '*', 'duplicate_rows', CASE WHEN (rows - different) / rows > 0.01 THEN 'warning' ELSE 'info' END,
                {_count("(rows - different)", "repeated row")} || ' dropped, or ' || {_percent("(rows - different) / rows")} || ' of the table.'
                FROM n WHERE rows > different
            UNION ALL SELECT 'empty', '*', 'empty_dataset', 'error', 'The table has no rows.' FROM n WHERE rows > 0""",
        "stored_roles": """SELECT * FROM (VALUES
            ('order_id', 'integer', 'identifier', TRUE), ('customer_id', 'integer', 'identifier', TRUE),
            ('product_id', 'integer', 'identifier', TRUE), ('order_date', 'timestamp', 'time', TRUE),
            ('revenue', 'decimal', 'measure', TRUE), ('units', 'decimal', 'ignored', TRUE),
            ('status', 'boolean', 'dimension', FALSE), ('return_class', 'string', 'dimension', TRUE),
            ('priority_class', 'string', 'dimension', TRUE), ('price', 'decimal', 'measure', FALSE))
            AS t("column", data_type, role, kept), (SELECT 'anomalies churn dimensions forecast' AS capabilities FROM lineitem LIMIT 1)""",
        "finite_numbers": """SELECT event_type, count(*) FILTER (event_id % 10 NOT IN (3, 4, 5)) AS finite,
            round(sum(value) FILTER (event_id % 10 NOT IN (3, 4, 5)), 4) AS total,
            CASE WHEN count(*) FILTER (event_id % 10 IN (3, 4, 5)) = 0 THEN round(sum(value), 4) END AS with_all,
            CAST(NULL AS DOUBLE) AS per_nothing FROM events GROUP BY event_type""",
        "rfm_text_dates": "WITH " + _RFM.replace("FROM sales", "FROM (SELECT * FROM sales WHERE order_id % 50 <> 0)")
            + " SELECT customer, recency_days, frequency, round(monetary, 4) AS monetary, tenure_days FROM rfm",
        "forecast_linear": _forecast(None),
        "forecast_linear_by_status": _forecast("status"),
        "anomalies": _anomalies("SELECT 0 AS k, date_trunc('month', order_date) AS period, sum(revenue) AS value FROM sales GROUP BY 1, 2", None, 3.0),
        "anomalies_by_type": _anomalies("SELECT event_type AS k, date_trunc('day', ts) AS period, sum(value) AS value FROM events GROUP BY 1, 2", "event_type", 1.5),
        "rfm_features": f"WITH {_RFM} SELECT customer, recency_days, frequency, round(monetary, 4) AS monetary, tenure_days FROM rfm",
        "churn_cutoff": f"WITH {_RFM} SELECT cutoff_days FROM cut",
        "churn_labels": f"WITH {_RFM} SELECT recency_days > cutoff_days AS lapsed, count(*) AS customers, max(recency_days) AS longest, min(recency_days) AS shortest FROM rfm, cut GROUP BY 1",
        "pipeline_kpis": f"WITH {MESSY}, {CLEANED}, k AS ({_union(_kpis('cleaned', 'revenue', 'customer', 'order_no'))}) SELECT key, value FROM k",
    }
    for grain in ("day", "week"):
        found[f"timeseries_{grain}"] = _timeseries(grain, sales=False)
    for grain in ("month", "quarter", "year"):
        found[f"timeseries_{grain}"] = _timeseries(grain, sales=True)
    return found
