"""The query catalogue stated in plain SQL, for an independent engine on the same tables.

The SQL avoids the shapes used by the operators (tagged unions, single alignments): matches are
joins and EXISTS, copies are counted with IS NOT DISTINCT FROM, so that agreement means
something.
"""

from __future__ import annotations

from crosstally.functions.columns import AMOUNT_WORDS, DIMENSION_PRIORITY, FAVOURED_DIMENSION_WORDS
from crosstally.functions.text import API_KEY_MARK, API_KEY_PATTERN, BEARER_MARK, BEARER_PATTERN
from crosstally.functions.text import canonical_json

# Derived tables ------------------------------------------------------------------------------

MISSING = "order_priority = '1-URGENT' AND order_date >= DATE '2001-07-01'"
DUPLICATED = """order_status = 'F' AND (
    order_date BETWEEN DATE '1995-01-01' AND DATE '1995-01-31'
    OR order_date BETWEEN DATE '1996-12-25' AND DATE '1996-12-31'
    OR order_date BETWEEN DATE '1997-06-01' AND DATE '1997-06-05')"""
DRIFTED = "order_priority = '2-HIGH' AND total_amount >= 450000"
NO_KEY = "month(order_date) = 12 AND day(order_date) = 31"
NO_PRIORITY = "total_amount < 10000"
NO_AMOUNT = "order_date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30'"
ORDER_COLUMNS = (
    "order_id", "customer_id", "order_date", "order_status", "order_priority", "total_amount",
)


def _order_rows(source: str, key="order_id", priority="order_priority", amount="total_amount"):
    return f"""SELECT {key} AS order_id, customer_id, order_date, order_status,
    {priority} AS order_priority, {amount} AS total_amount FROM {source}"""


_BLANK_KEY = f"CASE WHEN {NO_KEY} THEN NULL ELSE order_id END"
_BLANK_PRIORITY = f"CASE WHEN {NO_PRIORITY} THEN NULL ELSE order_priority END"
_BLANK_AMOUNT = f"CASE WHEN {NO_AMOUNT} THEN NULL ELSE total_amount END"
_DRIFT = f"CASE WHEN {DRIFTED} THEN round(total_amount + 17.25, 2) ELSE total_amount END"
_DRIFT_BLANK = f"CASE WHEN {NO_AMOUNT} THEN NULL ELSE {_DRIFT} END"

TABLES = {
    "src": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS order_status,
    o_orderpriority AS order_priority, CAST(o_totalprice AS DOUBLE) AS total_amount FROM orders""",
    "wh_missing": f"SELECT * FROM src WHERE NOT ({MISSING})",
    "wh_dup": f"SELECT * FROM src UNION ALL SELECT * FROM src WHERE {DUPLICATED}",
    "wh_drift": _order_rows("src", amount=_DRIFT),
    "wh_nulls": _order_rows("src", _BLANK_KEY, _BLANK_PRIORITY, _BLANK_AMOUNT),
    "wh_once": _order_rows("wh_missing", _BLANK_KEY, _BLANK_PRIORITY, _DRIFT_BLANK),
    "wh_mixed": f"SELECT * FROM wh_once UNION ALL SELECT * FROM wh_once WHERE {DUPLICATED}",
    "src_nulls": _order_rows("src", priority=_BLANK_PRIORITY),
}


def over(body: str, **more: str) -> str:
    """``body`` with the derived tables (and further CTEs) in front."""
    parts = {**TABLES, **more}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in parts.items()) + "\n" + body


ORACLE: dict[str, str] = {}
MONEY = "CAST({} AS DECIMAL(18, 2))"


def money_sum(column: str, where: str | None = None) -> str:
    filtered = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(coalesce(sum({MONEY.format(column)}){filtered}, 0) AS DOUBLE)"


def money_mean(column: str) -> str:
    return (
        f"round(CAST(sum({MONEY.format(column)}) AS DOUBLE) / nullif(count({column}), 0), 6)"
    )


def percent(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0.0 ELSE CAST({part} AS DOUBLE) / {whole} * 100 END, 6)"


# Sources and sinks ---------------------------------------------------------------------------

ORACLE["csv_round_trip"] = over("""SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date,
    order_status, order_priority, total_amount FROM wh_nulls""")
ORACLE["csv_with_schema"] = "SELECT * FROM events"
ORACLE["json_round_trip"] = over("SELECT * FROM wh_nulls")

# Filters -------------------------------------------------------------------------------------

for name, condition in {
    "filter_eq": "order_priority = '2-HIGH'",
    "filter_ne_keeps_null": "order_priority IS DISTINCT FROM '2-HIGH'",
    "filter_range": """total_amount >= 100000 AND total_amount < 200000 AND order_status > 'F'
        AND order_date <= DATE '1999-12-31'""",
    "filter_in": "order_priority IN ('2-HIGH', '5-LOW')",
    "filter_not_in_keeps_null": "NOT coalesce(order_priority IN ('2-HIGH', '5-LOW'), FALSE)",
    "filter_null": "order_id IS NULL",
    "filter_not_null": "order_id IS NOT NULL AND total_amount IS NOT NULL",
    "filter_other_type": "order_status = 'O'",
}.items():
    ORACLE[name] = over(f"SELECT * FROM wh_nulls WHERE {condition}")

# Totals --------------------------------------------------------------------------------------

for name, aggregation, expression in (
    ("agg_compare_count", "count", "count(*)"),
    ("agg_compare_count_column", "count", "count(order_priority)"),
    ("agg_compare_sum", "sum", money_sum("total_amount")),
    ("agg_compare_mean", "mean", money_mean("total_amount")),
):
    ORACLE[name] = over(f"""
SELECT '{aggregation}' AS aggregation, x AS dataset_a_result, y AS dataset_b_result,
    round(abs(round(CAST(x AS DOUBLE) - y, 6)), 6) AS absolute_difference,
    round(CAST(x AS DOUBLE) - y, 6) AS signed_difference_a_minus_b,
    round(round(CAST(x AS DOUBLE) - y, 6) / nullif(abs(CAST(y AS DOUBLE)), 0) * 100, 6)
        AS percentage_difference_vs_b
FROM (SELECT (SELECT {expression} FROM src) AS x, (SELECT {expression} FROM wh_mixed) AS y)""")

# Matching ------------------------------------------------------------------------------------

ORACLE["unmatched_orders_lineitem"] = """SELECT * FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"""
ORACLE["unmatched_documents_labels"] = """SELECT doc_id, lang, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""


def match_figures(a: str, b: str, key_a: str, key_b: str, extra: str = "") -> str:
    return f"""SELECT {extra} count(k) AS eligible_record_count,
    count(k) FILTER (WHERE hit) AS matched_count,
    count(k) FILTER (WHERE NOT hit) AS unmatched_count,
    count(DISTINCT k) FILTER (WHERE NOT hit) AS unmatched_unique_key_count,
    {percent("count(k) FILTER (WHERE NOT hit)", "count(k)")} AS unmatched_percentage,
    count(*) FILTER (WHERE k IS NULL) AS null_key_count,
    count(DISTINCT k) FILTER (WHERE NOT hit) <= 10 AS sample_is_complete, 10 AS sample_limit
FROM (SELECT x.{key_a} AS k, EXISTS (SELECT 1 FROM {b} y WHERE y.{key_b} = x.{key_a}) AS hit
      FROM {a} x)"""


ORACLE["unmatched_summary"] = match_figures("orders", "lineitem", "o_orderkey", "l_orderkey")
ORACLE["unmatched_summary_both_ways"] = over(
    match_figures("src", "wh_mixed", "order_id", "order_id", "'a_without_b' AS direction,")
    + "\nUNION ALL\n"
    + match_figures("wh_mixed", "src", "order_id", "order_id", "'b_without_a' AS direction,")
)
ORACLE["unmatched_one_sided_keys"] = over("""
SELECT 'a' AS side, order_id AS key, count(*) AS row_count FROM src s
WHERE order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wh_mixed w WHERE w.order_id = s.order_id)
GROUP BY order_id
UNION ALL
SELECT 'b', order_id, count(*) FROM wh_mixed w
WHERE order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src s WHERE w.order_id = s.order_id)
GROUP BY order_id""")
ORACLE["unmatched_preview"] = over("""
SELECT order_id, order_status, order_date, total_amount FROM src s
WHERE NOT EXISTS (SELECT 1 FROM wh_missing w WHERE w.order_id = s.order_id)
ORDER BY order_id LIMIT 10""")
ORACLE["unmatched_preview_asked"] = over("""
SELECT order_id, order_status, total_amount FROM src s
WHERE NOT EXISTS (SELECT 1 FROM wh_missing w WHERE w.order_id = s.order_id)
ORDER BY order_id LIMIT 10""")
ORACLE["unmatched_preview_repeated_keys"] = """
SELECT n_chars, source, lang, doc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY source, lang, doc_id) AS rn
    FROM documents d
    WHERE n_chars NOT IN (SELECT n_chars FROM documents JOIN labels USING (doc_id)))
WHERE rn = 1 ORDER BY n_chars LIMIT 10"""

# Duplicates ----------------------------------------------------------------------------------


def duplicate_figures(source: str, columns: str, kind: str) -> str:
    return f"""SELECT '{kind}' AS analysis_type, '{columns}' AS checked_columns,
    CAST(sum(n) AS BIGINT) AS row_count,
    CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_row_count,
    count(*) FILTER (WHERE n > 1) AS repeated_group_count,
    {percent("coalesce(sum(n) FILTER (WHERE n > 1), 0)", "sum(n)")} AS duplicate_percentage
FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"""


ALL_ORDER_COLUMNS = ",".join(ORDER_COLUMNS)
ALL_LINE_COLUMNS = (
    "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
    "l_returnflag,l_linestatus,l_shipdate"
)
ORACLE["dup_exact_rows"] = over(duplicate_figures("wh_dup", ALL_ORDER_COLUMNS, "exact_row"))
ORACLE["dup_exact_lineitem"] = duplicate_figures("lineitem", ALL_LINE_COLUMNS, "exact_row")
ORACLE["dup_repeated_key"] = duplicate_figures(
    "lineitem", "l_orderkey,l_linenumber", "repeated_key"
)
ORACLE["dup_document_text"] = duplicate_figures("documents", "text", "repeated_key")
ORACLE["dup_preview"] = """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 ORDER BY l_orderkey, l_linenumber LIMIT 10"""
ORACLE["dup_rows"] = over("""SELECT * EXCLUDE (n) FROM (
    SELECT *, count(*) OVER (PARTITION BY order_id, order_priority) AS n FROM wh_mixed)
WHERE n > 1""")

# Values and rows -----------------------------------------------------------------------------


def unique_rows(source: str) -> str:
    return f"""SELECT * EXCLUDE (n) FROM (
        SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM {source}
        WHERE order_id IS NOT NULL)
    WHERE n = 1"""


def repeated_rows(source: str) -> str:
    return f"""(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {source}
        WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1))"""


def paired_values(column: str) -> str:
    return f"""SELECT a.order_id AS k, a.{column} AS x, b.{column} AS y
    FROM ua a JOIN ub b ON a.order_id = b.order_id"""


def differs(numeric: bool, tolerance: float = 0.0) -> str:
    if numeric:
        return f"(coalesce(abs(x - y) > {tolerance}, FALSE) OR (x IS NULL) <> (y IS NULL))"
    return "x IS DISTINCT FROM y"


def value_figures(column: str, numeric: bool, tolerance: float, a="src", b="wh_mixed") -> str:
    bad = differs(numeric, tolerance)
    delta = f"({MONEY.format('x')} - {MONEY.format('y')})"
    nothing = "CAST(NULL AS DOUBLE)"
    signed = f"CAST(coalesce(sum({delta}) FILTER (WHERE {bad}), 0) AS DOUBLE)"
    absolute = f"CAST(coalesce(sum(abs({delta})) FILTER (WHERE {bad}), 0) AS DOUBLE)"
    return over(
        f"""SELECT count(*) AS matched_unique_key_count,
    count(*) FILTER (WHERE NOT {bad}) AS equal_value_count,
    count(*) FILTER (WHERE {bad}) AS value_mismatch_count,
    {percent(f"count(*) FILTER (WHERE {bad})", "count(*)")} AS value_mismatch_percentage,
    count(*) FILTER (WHERE (x IS NULL) <> (y IS NULL)) AS null_value_mismatch_count,
    count(*) FILTER (WHERE x IS NULL AND y IS NULL) AS both_null_equal_count,
    {signed if numeric else nothing} AS signed_difference_a_minus_b,
    {absolute if numeric else nothing} AS absolute_difference_sum,
    '{"numeric" if numeric else "exact"}' AS comparison_type,
    {repeated_rows(a)} AS duplicate_key_record_count_a,
    {repeated_rows(b)} AS duplicate_key_record_count_b
FROM m""",
        ua=unique_rows(a), ub=unique_rows(b), m=paired_values(column),
    )


ORACLE["values_numeric"] = value_figures("total_amount", True, 0.0)
ORACLE["values_numeric_tolerance"] = value_figures("total_amount", True, 20.0)
ORACLE["values_exact"] = value_figures("order_priority", False, 0.0)


def mismatch_rows(warehouse: str, tail: str = "") -> str:
    return over(
        f"""SELECT k AS key, x AS dataset_a_value, y AS dataset_b_value,
    round(x - y, 6) AS difference_a_minus_b FROM m WHERE {differs(True)} {tail}""",
        ua=unique_rows("src"), ub=unique_rows(warehouse), m=paired_values("total_amount"),
    )


ORACLE["values_mismatches"] = mismatch_rows("wh_mixed")
ORACLE["values_mismatch_preview"] = mismatch_rows("wh_drift", "ORDER BY k LIMIT 10")

VALUE_COLUMNS = [c for c in ORDER_COLUMNS if c != "order_id"]


def column_differs(column: str) -> str:
    a, b = f"a.{column}", f"b.{column}"
    if column in ("customer_id", "total_amount"):
        return f"(coalesce(abs({a} - {b}) > 0, FALSE) OR ({a} IS NULL) <> ({b} IS NULL))"
    return f"({a} IS DISTINCT FROM {b})"


def row_flags(a: str) -> dict[str, str]:
    flags = ", ".join(f"{column_differs(c)} AS d_{c}" for c in VALUE_COLUMNS)
    return {
        "ua": unique_rows(a),
        "ub": unique_rows("wh_mixed"),
        "m": f"SELECT a.order_id AS k, {flags} FROM ua a JOIN ub b ON a.order_id = b.order_id",
    }


ANY_DIFFERS = "(" + " OR ".join(f"d_{c}" for c in VALUE_COLUMNS) + ")"
ORACLE["rows_by_key_summary"] = over(
    f"""SELECT '{",".join(VALUE_COLUMNS)}' AS columns_compared,
    count(*) AS matched_unique_key_count,
    count(*) FILTER (WHERE {ANY_DIFFERS}) AS record_mismatch_count,
    {repeated_rows("src_nulls")} AS duplicate_key_record_count_a,
    {repeated_rows("wh_mixed")} AS duplicate_key_record_count_b
FROM m""",
    **row_flags("src_nulls"),
)
ORACLE["rows_by_key_columns"] = over(
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column",
    '{"numeric" if c in ("customer_id", "total_amount") else "exact"}' AS comparison_type,
    count(*) FILTER (WHERE d_{c}) AS mismatch_count FROM m"""
        for c in VALUE_COLUMNS
    ),
    **row_flags("src_nulls"),
)
ORACLE["rows_mismatched_keys"] = over(
    "SELECT k AS key, concat_ws(',', "
    + ", ".join(f"CASE WHEN d_{c} THEN '{c}' END" for c in VALUE_COLUMNS)
    + f") AS differing_columns FROM m WHERE {ANY_DIFFERS}",
    **row_flags("src"),
)

# Bridge --------------------------------------------------------------------------------------

CONTEXT = ["customer_id", "order_date", "order_status", "order_priority"]


def _copies(source: str) -> str:
    return f"""SELECT order_id, total_amount, {", ".join(CONTEXT)}, count(*) AS n FROM {source}
    WHERE order_id IS NOT NULL GROUP BY ALL"""


def _extras(own: str, other: str) -> str:
    same = " AND ".join(
        f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in ["total_amount", *CONTEXT]
    )
    return f"""SELECT x.*, x.n - y.n AS extra FROM {own} x
    JOIN {other} y ON x.order_id = y.order_id AND {same} WHERE x.n > y.n"""


def _one_sided(own: str, other: str) -> str:
    return f"""SELECT * FROM {own} x WHERE order_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM {other} y WHERE y.order_id = x.order_id)"""


def _side_figures(side: str, source: str) -> str:
    m = "total_amount"
    extra_sum = f"CAST(coalesce(sum({MONEY.format(m)} * extra), 0) AS DOUBLE)"
    return f"""
    (SELECT {money_sum(m)} FROM {source}) AS total_{side},
    (SELECT {money_sum(m)} FROM {source} WHERE order_id IS NULL) AS keyless_{side},
    (SELECT count(*) FROM {source} WHERE order_id IS NULL) AS keyless_rows_{side},
    (SELECT count(DISTINCT order_id) FROM only_{side}) AS only_keys_{side},
    (SELECT count(*) FROM only_{side}) AS only_rows_{side},
    (SELECT {money_sum(m)} FROM only_{side}) AS only_sum_{side},
    (SELECT CAST(coalesce(sum(extra), 0) AS BIGINT) FROM extra_{side}) AS extra_{side},
    (SELECT count(DISTINCT order_id) FROM extra_{side}) AS extra_keys_{side},
    (SELECT {extra_sum} FROM extra_{side}) AS extra_sum_{side}"""


BRIDGE_TABLES = {
    "copies_a": _copies("src_nulls"),
    "copies_b": _copies("wh_mixed"),
    "only_a": _one_sided("src_nulls", "wh_mixed"),
    "only_b": _one_sided("wh_mixed", "src_nulls"),
    "extra_a": _extras("copies_a", "copies_b"),
    "extra_b": _extras("copies_b", "copies_a"),
    "figures": f"SELECT {_side_figures('a', 'src_nulls')}, {_side_figures('b', 'wh_mixed')}",
    "closed": """SELECT *, round(total_a - total_b, 6) AS net,
    round((total_a - only_sum_a - keyless_a) - (total_b - only_sum_b - keyless_b), 6) AS shared
    FROM figures""",
    "settled": """SELECT *, round(shared - extra_sum_a + extra_sum_b, 6) AS rest,
    round(keyless_a - keyless_b, 6) AS keyless,
    round(only_sum_a - only_sum_b + shared, 6) AS explained FROM closed""",
}
ORACLE["bridge_summary"] = over(
    "SELECT total_a AS dataset_a_total, total_b AS dataset_b_total, net AS net_difference_a_minus_b,"
    + ",".join(
        f"""only_keys_{s} AS dataset_{s}_only_unique_key_count,
    only_rows_{s} AS dataset_{s}_only_row_count, only_sum_{s} AS dataset_{s}_only_metric_sum,
    extra_{s} AS dataset_{s}_extra_exact_copy_count,
    extra_keys_{s} AS dataset_{s}_extra_exact_copy_key_count,
    extra_sum_{s} AS dataset_{s}_extra_exact_copy_metric_sum,
    only_keys_{s} <= 10 AS dataset_{s}_only_sample_is_complete,
    extra_keys_{s} <= 10 AS dataset_{s}_extra_sample_is_complete"""
        for s in "ab"
    )
    + f""", shared AS shared_key_metric_difference_a_minus_b,
    rest AS shared_key_residual_metric_difference_a_minus_b,
    explained AS explained_difference_a_minus_b,
    round(net - explained, 6) AS reconciliation_residual,
    keyless AS null_key_metric_difference_a_minus_b,
    keyless_rows_a + keyless_rows_b AS null_key_row_count,
    abs(round(net - explained, 6)) <= 0.01 AS arithmetic_reconciles,
    abs(rest) <= 0.01 AS fully_explained_by_key_gaps_and_exact_copies,
    '{",".join(["order_id", "total_amount", *CONTEXT])}' AS exact_copy_scope_columns
FROM settled""",
    **BRIDGE_TABLES,
)
ORACLE["bridge_table"] = over(
    """SELECT *, CASE WHEN signed_effect < 0 THEN '-' ELSE '+' END
        || format('{:,.2f}', abs(signed_effect)) AS effect_text FROM (
    SELECT 1 AS position, 'keys_only_in_a' AS component, only_keys_a AS affected_count,
        only_sum_a AS signed_effect FROM settled WHERE only_keys_a > 0
    UNION ALL SELECT 2, 'keys_only_in_b', only_keys_b, -only_sum_b FROM settled WHERE only_keys_b > 0
    UNION ALL SELECT 3, 'extra_exact_copies_in_a', extra_a, extra_sum_a FROM settled WHERE extra_a > 0
    UNION ALL SELECT 4, 'extra_exact_copies_in_b', extra_b, -extra_sum_b FROM settled WHERE extra_b > 0
    UNION ALL SELECT 5, 'other_shared_key_differences', NULL, rest FROM settled WHERE abs(rest) > 0.01
    UNION ALL SELECT 6, 'null_key', keyless_rows_a + keyless_rows_b, keyless FROM settled
        WHERE keyless_rows_a + keyless_rows_b > 0
    UNION ALL SELECT 7, 'net_difference', NULL, net FROM settled)""",
    **BRIDGE_TABLES,
)
_EXTRA_ROWS = f"""SELECT order_id AS key, extra AS extra_copy_count, total_amount AS metric,
    round(total_amount * extra, 6) AS extra_metric_sum, {", ".join(CONTEXT)} FROM extra_b"""
ORACLE["bridge_extra_copies"] = over(_EXTRA_ROWS, **BRIDGE_TABLES)
ORACLE["bridge_extra_copies_preview"] = over(
    _EXTRA_ROWS + f" ORDER BY order_id, total_amount NULLS LAST, {', '.join(CONTEXT)} LIMIT 10",
    **BRIDGE_TABLES,
)

# Segments ------------------------------------------------------------------------------------


def segments(source: str, keys: str, value: str, tail: str = "") -> str:
    names = keys.split(" AS ")[-1]
    return f"SELECT {keys}, {value} AS value, count(*) AS record_count FROM {source} {tail} GROUP BY {names}"


ORACLE["segment_count"] = over(segments("wh_nulls", "order_priority", "count(*)"))
ORACLE["segment_sum"] = over(segments("wh_nulls", "order_priority", money_sum("total_amount")))
ORACLE["segment_mean"] = segments("events", "event_type", money_mean("value"))
ORACLE["segment_day"] = f"""SELECT strftime(ts, '%Y-%m-%d') AS ts, {money_sum("value")} AS value,
    count(*) AS record_count FROM events GROUP BY strftime(ts, '%Y-%m-%d')"""

for name, label in {
    "segment_week": """strftime(date_trunc('week', order_date), '%Y-%m-%d') || '/' ||
        strftime(date_trunc('week', order_date) + INTERVAL 6 DAY, '%Y-%m-%d')""",
    "segment_month": "strftime(order_date, '%Y-%m')",
    "segment_quarter": "year(order_date) || 'Q' || quarter(order_date)",
    "segment_year": "strftime(order_date, '%Y')",
}.items():
    ORACLE[name] = over(
        f"""SELECT period AS order_date, {money_sum("total_amount")} AS value,
    count(*) AS record_count
FROM (SELECT {label} AS period, total_amount FROM src) GROUP BY period"""
    )
_TEXT_FORMS = {
    "month_first": ("M/d/yyyy", "%m/%d/%Y", "strftime(order_date, '%m/%d/%Y')"),
    "day_first": (
        "d/M/yyyy", "%d/%m/%Y",
        "CASE WHEN order_status = 'P' THEN 'unknown' ELSE strftime(order_date, '%-d/%-m/%Y') END",
    ),
    "named_month": ("d MMM yyyy", "%d %b %Y", "strftime(order_date, '%-d %b %Y')"),
    "some_iso": (
        "ISO", "%Y-%m-%d", "CASE WHEN order_priority <> '1-URGENT' THEN strftime(order_date, '%Y-%m-%d') END",
    ),
}
ORACLE["date_format_election"] = over(
    "\nUNION ALL ".join(
        f"""SELECT '{column}' AS "column", '{form}' AS date_format, count(*) AS value_count,
    count(try_strptime(t, '{pattern}')) AS parsed_count,
    round((count(*) - count(try_strptime(t, '{pattern}'))) * 100.0::DOUBLE / count(*), 6) AS not_parsed_percentage
FROM (SELECT {text} AS t FROM src) WHERE t IS NOT NULL"""
        for column, (form, pattern, text) in _TEXT_FORMS.items()
    )
)
ORACLE["segment_month_of_texts"] = over(
    f"""SELECT strftime(order_date, '%Y-%m') AS day_first, {money_sum("total_amount")} AS value,
    count(*) AS record_count FROM src WHERE order_status <> 'P' GROUP BY strftime(order_date, '%Y-%m')"""
)
ORACLE["details_as_json"] = over(
    """SELECT customer_id, order_date, CAST(json_object('order_id', order_id, 'customer_id', customer_id,
    'order_status', order_status, 'order_priority', order_priority) AS VARCHAR) AS details FROM wh_nulls"""
)
ORACLE["segment_by_month_and_priority"] = over(
    f"""SELECT order_priority, period AS order_date, {money_sum("total_amount")} AS value,
    count(*) AS record_count
FROM (SELECT order_priority, strftime(order_date, '%Y-%m') AS period, total_amount FROM src
      WHERE order_status IS DISTINCT FROM 'P')
GROUP BY order_priority, period"""
)
_UNMATCHED = _one_sided("src", "wh_mixed")
ORACLE["segment_unmatched"] = over(
    segments("lost", "order_status", money_sum("total_amount")), lost=_UNMATCHED
)
ORACLE["segment_unmatched_summary"] = over(
    """SELECT count(*) AS filtered_record_count, count(DISTINCT order_status) AS result_count,
    count(DISTINCT order_status) > 20 AS results_truncated,
    (SELECT count(*) FROM src) AS records_before_matching_filter,
    count(*) AS unmatched_records_analyzed FROM lost""",
    lost=_UNMATCHED,
)
ORACLE["segment_topk"] = over(
    segments("src", "customer_id", money_sum("total_amount"))
    + " ORDER BY abs(value) DESC, customer_id LIMIT 15"
)


def paired(warehouse: str) -> str:
    def side(source: str) -> str:
        return f"""SELECT order_priority AS segment, {money_sum("total_amount")} AS v
        FROM {source} GROUP BY order_priority"""

    return f"""SELECT coalesce(a.segment, b.segment) AS segment, coalesce(a.v, 0.0) AS value_a,
    coalesce(b.v, 0.0) AS value_b, round(coalesce(a.v, 0.0) - coalesce(b.v, 0.0), 6) AS difference
FROM ({side("src")}) a FULL JOIN ({side(warehouse)}) b ON a.segment IS NOT DISTINCT FROM b.segment"""


ORACLE["segment_paired"] = over(paired("wh_mixed"))
ORACLE["localize_segment"] = over(
    """SELECT *, count(*) OVER () AS differing_segment_count, count(*) OVER () = 1 AS is_localized
FROM p WHERE difference <> 0""",
    p=paired("wh_drift"),
)

_DIMENSIONS = {"order_status": "order_status", "order_priority": "order_priority", "order_year": "CAST(year(order_date) AS VARCHAR)"}


def _of_dimensions(side: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS dimension, {segment} AS segment, {money_sum("total_amount")} AS value
    FROM {side} GROUP BY {segment}""" for name, segment in _DIMENSIONS.items()
    )


ORACLE["localize_dimensions"] = over(
    """SELECT dimension, CAST(row_number() OVER (ORDER BY d = 0, d, dimension) AS INTEGER) AS rank, segment_count,
    d AS differing_segment_count, d = 1 AS is_localized, top.segment AS segment, top.difference AS difference
FROM (SELECT dimension, count(*) AS segment_count, count(*) FILTER (WHERE difference <> 0) AS d,
    arg_min({'segment': segment, 'difference': difference}, nth) FILTER (WHERE difference <> 0) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(difference) DESC, segment NULLS LAST) AS nth FROM gaps)
  GROUP BY dimension)""",
    side_a=_of_dimensions("src"),
    side_b=_of_dimensions("wh_drift"),
    gaps="""SELECT coalesce(x.dimension, y.dimension) AS dimension, coalesce(x.segment, y.segment) AS segment,
    round(coalesce(x.value, 0.0) - coalesce(y.value, 0.0), 6) AS difference
    FROM side_a x FULL JOIN side_b y ON x.dimension = y.dimension AND x.segment IS NOT DISTINCT FROM y.segment""",
)

# Impact --------------------------------------------------------------------------------------


def impact(affected: str, whole: str, amount: str, date: str, segment: str) -> str:
    return f"""SELECT n AS affected_record_count, total AS total_record_count,
    {percent("n", "total")} AS affected_percentage, amount AS affected_amount_sum,
    first_day AS affected_date_start, last_day AS affected_date_end,
    t.segment AS primary_segment, t.c AS primary_segment_record_count,
    {percent("t.c", "n")} AS primary_segment_percentage
FROM (SELECT count(*) AS n, {money_sum(amount)} AS amount,
        strftime(min({date}), '%Y-%m-%dT%H:%M:%S') AS first_day,
        strftime(max({date}), '%Y-%m-%dT%H:%M:%S') AS last_day FROM {affected}),
    (SELECT count(*) AS total FROM {whole}),
    (SELECT {segment} AS segment, count(*) AS c FROM {affected} GROUP BY {segment}
     ORDER BY c DESC, {segment} NULLS LAST LIMIT 1) t"""


ORACLE["impact_filtered"] = over(
    impact("kept", "wh_nulls", "total_amount", "order_date", "order_priority"),
    kept="SELECT * FROM wh_nulls WHERE order_status IN ('F', 'O')",
)
ORACLE["impact_unmatched"] = over(
    impact("lost", "src", "total_amount", "order_date", "order_priority"), lost=_UNMATCHED
)
ORACLE["impact_orders_without_lines"] = (
    f"WITH lost AS ({ORACLE['unmatched_orders_lineitem']})\n"
    + impact("lost", "orders", "o_totalprice", "o_orderdate", "o_orderpriority")
)

# Profiles ------------------------------------------------------------------------------------

RENAMED = {
    "p_orders": "SELECT * FROM wh_mixed",
    "p_lineitem": """SELECT l_orderkey AS order_id, l_partkey AS part_id, l_quantity AS quantity,
    l_extendedprice AS line_price, l_returnflag AS return_status FROM lineitem""",
    "p_customer": """SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance,
    c_mktsegment AS market_segment FROM customer""",
    "p_events": "SELECT * FROM events",
}
# dataset: (column, kind) in table order; kinds: i whole number, f float, s text, d date or time.
PROFILED = {
    "orders": [("order_id", "i"), ("customer_id", "i"), ("order_date", "d"), ("order_status", "s"),
               ("order_priority", "s"), ("total_amount", "f")],
    "lineitem": [("order_id", "i"), ("part_id", "i"), ("quantity", "f"), ("line_price", "f"),
                 ("return_status", "s")],
    "customer": [("customer_id", "i"), ("name", "s"), ("balance", "f"), ("market_segment", "s")],
    "events": [("event_id", "i"), ("ts", "d"), ("user_id", "i"), ("event_type", "s"),
               ("value", "f"), ("props", "s")],
}


def _profile_row(order: int, dataset: str, position: int, column: str, kind: str) -> str:
    numbers = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max," \
        " CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sum"
    if kind in "if":
        added = f"CAST(sum({MONEY.format(column) if kind == 'f' else column}) AS DOUBLE)"
        numbers = f"""CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
        round({added} / nullif(count({column}), 0), 6) AS mean, coalesce({added}, 0.0) AS sum"""
    named = column == "id" or column.endswith("_id")
    return f"""SELECT {order} AS dataset_order, '{dataset}' AS dataset, {position} AS position,
        '{column}' AS "column", count(*) AS row_count, count(*) - count({column}) AS null_count,
        count(DISTINCT {column}) AS unique_count, {numbers}, {kind in "if"} AS is_numeric,
        {named} OR count(DISTINCT {column}) / count(*) >= 0.98 AS is_identifier,
        {kind == "d"} AS is_date FROM p_{dataset}"""


PROFILE = {
    **RENAMED,
    "profile": "\nUNION ALL\n".join(
        _profile_row(order, dataset, i, column, kind)
        for order, (dataset, columns) in enumerate(PROFILED.items())
        for i, (column, kind) in enumerate(columns)
    ),
}
ORACLE["profile_columns"] = over("SELECT * FROM profile", **PROFILE)


def _participants(dataset: str) -> str:
    columns = ", ".join(c for c, _ in PROFILED[dataset])
    return f"""SELECT '{dataset}' AS dataset, CAST(sum(n) AS BIGINT) AS row_count,
    CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_count
FROM (SELECT count(*) AS n FROM p_{dataset} GROUP BY {columns})"""


_TABLE_PROFILE = "\nUNION ALL\n".join(_participants(d) for d in ("orders", "lineitem", "customer"))
ORACLE["profile_table"] = over(_TABLE_PROFILE, **RENAMED)
ORACLE["constant_columns"] = "\nUNION ALL\n".join(
    f"""SELECT 'labels' AS dataset, '{c}' AS "column", count(DISTINCT {v}) AS unique_count
FROM labels HAVING count(DISTINCT {v}) <= 1"""
    for c, v in (("doc_id", "doc_id"), ("quality", "quality"), ("toxic", "toxic"), ("batch", "'labels'"))
)


def _contains_any(words) -> str:
    return "(" + " OR ".join(f"""contains(lower("column"), '{w}')""" for w in words) + ")"


_GUIDE = "CASE " + " ".join(
    f"""WHEN contains(lower("column"), '{w}') THEN {i}""" for i, w in enumerate(DIMENSION_PRIORITY)
) + f" ELSE {len(DIMENSION_PRIORITY)} END"
ORACLE["dimension_candidates"] = over(
    f"""SELECT dataset, "column", unique_count,
    CASE WHEN {_contains_any(FAVOURED_DIMENSION_WORDS)} THEN 0 ELSE 1 END AS baseline_rank,
    {_GUIDE} AS guide_rank FROM profile
WHERE NOT is_identifier AND NOT is_date AND NOT is_numeric AND unique_count BETWEEN 2 AND 100""",
    **PROFILE,
)
ORACLE["amount_columns"] = over(
    f"""SELECT dataset, "column", sum FROM profile
WHERE is_numeric AND {_contains_any(AMOUNT_WORDS)}""",
    **PROFILE,
)
_UNIQUE = "{0}.unique_count = {0}.row_count - {0}.null_count"
ORACLE["relationships"] = over(
    f"""SELECT l.dataset, r.dataset AS other_dataset, l."column" AS local_column,
    r."column" AS other_column,
    CASE WHEN {_UNIQUE.format("l")} THEN 'one' ELSE 'many' END || '_to_' ||
    CASE WHEN {_UNIQUE.format("r")} THEN 'one' ELSE 'many' END AS cardinality,
    {_UNIQUE.format("l")} AS local_key_is_unique, {_UNIQUE.format("r")} AS other_key_is_unique
FROM profile l JOIN profile r ON l."column" = r."column" AND l.dataset <> r.dataset
WHERE l.is_identifier AND r.is_identifier""",
    **PROFILE,
)
ORACLE["relationship_lines"] = over(
    """SELECT DISTINCT l.dataset || '.' || l."column" || ' -> ' || r.dataset || '.' || r."column"
    AS relationship
FROM profile l JOIN profile r ON l."column" = r."column" AND l.dataset <> r.dataset
WHERE l.is_identifier AND r.is_identifier""",
    **PROFILE,
)
ORACLE["relationship_choice"] = over(
    """SELECT left_dataset, right_dataset, key FROM (
    SELECT *, row_number() OVER (PARTITION BY left_dataset, right_dataset
        ORDER BY score, name_rank, lower(key)) AS rn
    FROM (SELECT l.dataset AS left_dataset, r.dataset AS right_dataset, l."column" AS key,
            l.dataset_order AS lo, r.dataset_order AS ro,
            -(l.unique_count / greatest(l.row_count, 1) + r.unique_count / greatest(r.row_count, 1)) AS score,
            CASE WHEN lower(l."column") = 'id' OR lower(l."column") LIKE '%\\_id' ESCAPE '\\'
                THEN 0 ELSE 1 END AS name_rank
        FROM profile l JOIN profile r ON l."column" = r."column" AND l.dataset_order < r.dataset_order
        WHERE l.is_identifier AND r.is_identifier))
WHERE rn = 1 ORDER BY score, name_rank, lower(key), lo, ro""",
    **PROFILE,
)
ORACLE["quality_review"] = over(
    """SELECT t.dataset, t.duplicate_count, CAST(n.cells AS BIGINT) AS null_cell_count
FROM t JOIN (SELECT dataset, sum(null_count) AS cells FROM profile GROUP BY dataset) n USING (dataset)
WHERE t.duplicate_count > 0 OR n.cells > 0""",
    **PROFILE, t=_TABLE_PROFILE,
)

# Baseline and evidence -----------------------------------------------------------------------


def _signature(tool: str, arguments: dict) -> str:
    return f"left(sha256('{tool}:{canonical_json(arguments)}'), 16)"


_PAIR = {"dataset_a": "source", "dataset_b": "warehouse"}
_KEYS = {"key_column_a": "order_id", "key_column_b": "order_id"}
_GAP = "(SELECT count(DISTINCT order_id) FROM lost_{})"


def _impact_arguments(dataset: str, other: str) -> dict:
    return {
        "dataset": dataset, "amount_column": "total_amount", "date_column": "order_date",
        "segment_column": "order_priority", "filters": [], "match_against_dataset": other,
        "local_key": "order_id", "other_key": "order_id", "only_unmatched": True,
    }


def _value_row(column: str) -> tuple:
    arguments = {**_PAIR, **_KEYS, "value_column_a": column, "value_column_b": column, "tolerance": 0.0}
    count = f"(SELECT count(*) FILTER (WHERE d_{column}) FROM m)"
    return ("compare_record_values", "source", "'warehouse'", "value_mismatch_count", count,
            arguments, f"{count} > 0")


# tool, dataset, other dataset, metric, value, call arguments, condition
EVIDENCE_ROWS = [
    ("compare_aggregates", "source", "'warehouse'", "absolute_difference",
     "abs((SELECT count(*) FROM src) - (SELECT count(*) FROM wh_mixed))",
     {**_PAIR, "metric_column_a": "", "metric_column_b": "", "aggregation": "count"}, "TRUE"),
    ("find_unmatched_records", "source", "'warehouse'", "unmatched_unique_key_count",
     _GAP.format("a"), {**_PAIR, **_KEYS, "detail_columns": None}, "TRUE"),
    ("find_unmatched_records", "warehouse", "'source'", "unmatched_unique_key_count",
     _GAP.format("b"),
     {"dataset_a": "warehouse", "dataset_b": "source", **_KEYS, "detail_columns": None}, "TRUE"),
    ("find_duplicates", "source", "NULL", "duplicate_row_count",
     f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM src "
     f"GROUP BY {ALL_ORDER_COLUMNS} HAVING count(*) > 1))",
     {"dataset": "source", "key_columns": []}, "TRUE"),
    ("find_duplicates", "warehouse", "NULL", "duplicate_row_count",
     f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM wh_mixed "
     f"GROUP BY {ALL_ORDER_COLUMNS} HAVING count(*) > 1))",
     {"dataset": "warehouse", "key_columns": []}, "TRUE"),
    ("compare_rows_by_key", "source", "'warehouse'", "record_mismatch_count",
     f"(SELECT count(*) FILTER (WHERE {ANY_DIFFERS}) FROM m)",
     {**_PAIR, **_KEYS, "columns": [], "tolerance": 0.0}, "TRUE"),
    _value_row("customer_id"),
    _value_row("total_amount"),
    ("calculate_business_impact", "source", "'warehouse'", "affected_record_count",
     "(SELECT count(*) FROM lost_a)", _impact_arguments("source", "warehouse"),
     "(SELECT count(*) FROM lost_a) > 0"),
    ("calculate_business_impact", "warehouse", "'source'", "affected_record_count",
     "(SELECT count(*) FROM lost_b)", _impact_arguments("warehouse", "source"),
     "(SELECT count(*) FROM lost_b) > 0"),
]


def evidence(columns: str, kept: str = "TRUE") -> str:
    rows = "\nUNION ALL\n".join(
        f"""SELECT {i} AS seq, '{tool}' AS tool, '{a}' AS dataset_a, {b} AS dataset_b,
    '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, {_signature(tool, arguments)} AS signature,
    '{arguments.get("value_column_a", "")}' AS about
WHERE {condition}"""
        for i, (tool, a, b, metric, value, arguments, condition) in enumerate(EVIDENCE_ROWS)
    )
    return over(
        f"SELECT {columns} FROM numbered WHERE {kept}",
        **row_flags("src"),
        lost_a=_one_sided("src", "wh_mixed"), lost_b=_one_sided("wh_mixed", "src"),
        rows_=rows,
        told="""SELECT * EXCLUDE (seq), printf('E%03d', row_number() OVER (ORDER BY seq))
        AS evidence_id FROM rows_""",
        numbered="SELECT * EXCLUDE (about) FROM told",
    )


ORACLE["baseline"] = evidence("*")
_LOST = "(SELECT count(*) FROM lost_a), (SELECT count(*) FROM lost_b)"
ORACLE["baseline_findings"] = evidence(f"""evidence_id, tool,
    CASE tool
    WHEN 'compare_aggregates' THEN 'row counts of source and warehouse: '
        || (SELECT count(*) FROM src) || ' and ' || (SELECT count(*) FROM wh_mixed)
    WHEN 'find_unmatched_records' THEN CAST(value AS BIGINT) || ' keys (' || if(dataset_a = 'source', {_LOST})
        || ' rows) of ' || dataset_a || ' have no match in ' || dataset_b
    WHEN 'find_duplicates' THEN CAST(value AS BIGINT) || ' rows of ' || dataset_a || ' are exact copies of each other'
    WHEN 'compare_rows_by_key' THEN CAST(value AS BIGINT) || ' of ' || (SELECT count(*) FROM m)
        || ' uniquely matched records differ'
    WHEN 'compare_record_values' THEN about || ' differs on ' || CAST(value AS BIGINT) || ' of '
        || (SELECT count(*) FROM m) || ' uniquely matched keys'
    ELSE CAST(value AS BIGINT) || ' unmatched records of ' || dataset_a || ' are affected' END AS finding,
    CASE WHEN tool = 'find_unmatched_records' THEN if(dataset_a = 'source', {_LOST}) END AS unmatched_rows,
    CASE WHEN tool IN ('compare_rows_by_key', 'compare_record_values') THEN (SELECT count(*) FROM m) END AS matched_keys
    """).replace("FROM numbered WHERE", "FROM told WHERE")
ORACLE["baseline_with_inferred_key"] = evidence("*")
ORACLE["evidence_dedup"] = evidence("*, 0 AS attempt")
# The pair is one-to-many (the warehouse repeats keys), so row counts say nothing, and source
# has no duplicate rows; the unmatched rows are not the whole table.
ORACLE["evidence_relevant"] = evidence(
    "*", "tool <> 'compare_aggregates' AND NOT (tool = 'find_duplicates' AND value = 0)"
)
_VERDICTS = {
    "verdicts": """SELECT customer_id AS case_id,
    CASE WHEN count(*) FILTER (WHERE order_status = 'F') > 0 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict,
    round(count(*) FILTER (WHERE order_status = 'F') / count(*), 6) AS confidence
    FROM src GROUP BY customer_id""",
    "cited": """SELECT customer_id AS case_id, count(*) FILTER (WHERE NOT lost) AS valid,
    count(*) FILTER (WHERE lost) AS rejected
    FROM (SELECT customer_id, order_id NOT IN (SELECT order_id FROM wh_missing) AS lost
          FROM src WHERE order_priority = '1-URGENT')
    GROUP BY customer_id""",
    "checked": """SELECT case_id,
    CASE WHEN verdict = 'ACCEPT' AND coalesce(valid, 0) = 0 THEN 'REJECT' ELSE verdict END AS verdict,
    CASE WHEN verdict = 'ACCEPT' AND coalesce(valid, 0) = 0 THEN least(confidence, 0.3)
        ELSE confidence END AS confidence,
    coalesce(valid, 0) AS valid_citation_count, coalesce(rejected, 0) AS rejected_citation_count
    FROM verdicts LEFT JOIN cited USING (case_id)""",
}
ORACLE["citation_check"] = over("SELECT * FROM checked", **_VERDICTS)
ORACLE["confidence_label"] = over(
    """SELECT case_id, confidence, CASE WHEN verdict <> 'ACCEPT' THEN 'Low'
    WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.65 THEN 'Medium' ELSE 'Low' END AS label
FROM checked""",
    **_VERDICTS,
)

# Fault injection -----------------------------------------------------------------------------

PICKS = {
    "urgent": "SELECT * FROM src WHERE order_priority = '1-URGENT'",
    "last_urgent": "SELECT * FROM urgent ORDER BY order_date DESC, order_id DESC LIMIT 60",
    "first_urgent": "SELECT * FROM urgent ORDER BY order_date, order_id LIMIT 40",
    "first_fulfilled": "SELECT * FROM src WHERE order_status = 'F' ORDER BY order_id LIMIT 40",
    "other_fulfilled": """SELECT * FROM src WHERE order_status = 'F'
    AND order_id NOT IN (SELECT order_id FROM first_urgent) ORDER BY order_id LIMIT 40""",
    "last_high": "SELECT * FROM src WHERE order_priority = '2-HIGH' ORDER BY order_id DESC LIMIT 50",
    "first_high": "SELECT * FROM src WHERE order_priority = '2-HIGH' ORDER BY order_id LIMIT 45",
}


def _without(picked: str) -> str:
    return f"SELECT * FROM src WHERE order_id NOT IN (SELECT order_id FROM {picked})"


def _drifted(picked: str, amount: float) -> str:
    moved = f"""CASE WHEN order_id IN (SELECT order_id FROM {picked})
        THEN round(total_amount + {amount}, 2) ELSE total_amount END"""
    return _order_rows("src", amount=moved)


CASES = {
    **PICKS,
    "w_missing": _without("last_urgent"),
    "w_copies": "SELECT * FROM src UNION ALL SELECT * FROM first_fulfilled",
    "w_drift": _drifted("last_high", 17.25),
    "w_offset": _without("first_urgent") + " UNION ALL SELECT * FROM other_fulfilled",
    "w_local": _drifted("first_high", 23.5),
}
for name, warehouse in {
    "inject_missing": "w_missing", "inject_duplicates": "w_copies", "inject_drift": "w_drift",
    "inject_offset": "w_offset",
}.items():
    ORACLE[name] = over(f"SELECT * FROM {warehouse}", **CASES)


def _truth(fault: str, condition: str, segment: str, amount: str) -> str:
    return f"""SELECT '{fault}' AS fault, count(*) AS affected_record_count,
    {amount} AS affected_amount, min({segment}) AS first_segment, max({segment}) AS last_segment,
    strftime(min(order_date), '%Y-%m-%dT%H:%M:%S') AS period_start,
    strftime(max(order_date), '%Y-%m-%dT%H:%M:%S') AS period_end FROM src WHERE {condition}"""


ORACLE["inject_truth"] = over(
    "\nUNION ALL\n".join(
        (
            _truth("missing", MISSING, "order_priority", money_sum("total_amount")),
            _truth("duplicated", DUPLICATED, "order_status", money_sum("total_amount")),
            _truth("drifted", DRIFTED, "order_priority", "round(count(*) * CAST(-17.25 AS DOUBLE), 2)"),
        )
    )
)

# Scoring -------------------------------------------------------------------------------------


def _rows(picked: str) -> str:
    return f"(SELECT count(*) FROM {picked})"


def _amount(picked: str) -> str:
    return f"(SELECT {money_sum('total_amount')} FROM {picked})"


def _lost(warehouse: str, what: str = "count(*)") -> str:
    return f"(SELECT {what} FROM src WHERE order_id NOT IN (SELECT order_id FROM {warehouse}))"


def _participating(source: str) -> str:
    return f"""(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {source}
        GROUP BY {ALL_ORDER_COLUMNS} HAVING count(*) > 1))"""


def _changed(warehouse: str, what: str = "count(*)") -> str:
    return f"""(SELECT {what} FROM src s JOIN {warehouse} w USING (order_id)
        WHERE s.total_amount <> w.total_amount)"""


_SHIFT = f"""coalesce(CAST(sum({MONEY.format("s.total_amount")} - {MONEY.format("w.total_amount")})
    AS DOUBLE), 0)"""

# case, check, tool, field, expected, condition, evidence
CHECKS = [
    ("clean_control", "same_count", "compare_aggregates", "absolute_difference", "0",
     "(SELECT count(*) FROM src) = (SELECT count(*) FROM src)", "E001"),
    ("clean_control", "no_gap", "find_unmatched_records", "unmatched_count", "0",
     f"{_lost('src')} = 0", "E002,E003"),
    ("clean_control", "no_drift", "compare_rows_by_key", "record_mismatch_count", "0",
     f"{_changed('src')} = 0", "E006"),
    ("missing_urgent_orders", "gap", "find_unmatched_records", "unmatched_count",
     _rows("last_urgent"), f"{_lost('w_missing')} = {_rows('last_urgent')}", "E002"),
    ("missing_urgent_orders", "gap_amount", "calculate_business_impact", "affected_amount_sum",
     _amount("last_urgent"),
     f"{_lost('w_missing', money_sum('total_amount'))} = {_amount('last_urgent')}", "E007"),
    ("duplicate_fulfilled_orders", "copies", "find_duplicates", "duplicate_row_count",
     f"2 * {_rows('first_fulfilled')}",
     f"{_participating('w_copies')} = 2 * {_rows('first_fulfilled')}", "E005"),
    ("high_priority_amount_drift", "drifted", "compare_record_values", "value_mismatch_count",
     _rows("last_high"), f"{_changed('w_drift')} = {_rows('last_high')}", "E007"),
    ("high_priority_amount_drift", "drift_sum", "compare_record_values",
     "signed_difference_a_minus_b", f"-17.25 * {_rows('last_high')}",
     f"abs({_changed('w_drift', _SHIFT)} + 17.25 * {_rows('last_high')}) <= 0.01", "E007"),
]
ORACLE["score_checks"] = over(
    "\nUNION ALL\n".join(
        f"""SELECT '{case}' AS case_id, '{check}' AS check_id, '{tool}' AS tool, '{field}' AS field,
    CAST({expected} AS DOUBLE) AS expected, {condition} AS passed,
    CASE WHEN {condition} THEN '{ids}' ELSE '' END AS evidence_ids"""
        for case, check, tool, field, expected, condition, ids in CHECKS
    ),
    **CASES,
)
_PASSED = {}
for case, *_, condition, _ids in CHECKS:
    _PASSED.setdefault(case, []).append(condition)
_PASSED["offsetting_missing_duplicates"] = [
    "(SELECT count(*) FROM src) = (SELECT count(*) FROM w_offset)",
    f"{_lost('w_offset')} = {_rows('first_urgent')}",
    f"{_participating('w_offset')} = 2 * {_rows('other_fulfilled')}",
    f"""abs(({_amount('src')} - {_amount('w_offset')})
        - ({_amount('first_urgent')} - {_amount('other_fulfilled')})) <= 0.01""",
]
_PASSED["priority_localization"] = [
    f"{_changed('w_local')} = {_rows('first_high')}",
    "(SELECT count(*) FROM w_local) = (SELECT count(*) FROM src)",
]
ORACLE["score_pass_rate"] = over(
    """SELECT suite, count(*) AS runs, count(*) FILTER (WHERE passed) AS passed,
    round(avg(CAST(passed AS INTEGER)) * 100, 2) AS pass_rate FROM (
"""
    + "\nUNION ALL\n".join(
        f"""SELECT '{"agentic" if case in ("offsetting_missing_duplicates", "priority_localization")
            else "deterministic"}' AS suite, {" AND ".join(f"({c})" for c in conditions)} AS passed"""
        for case, conditions in _PASSED.items()
    )
    + "\n) GROUP BY suite",
    **CASES,
)
# Follow-up calls exist as planned: one sum, one bridge; two segment analyses.
ORACLE["score_call_counts"] = over(
    """SELECT 'offsetting_missing_duplicates' AS case_id,
    CAST(2 * least((SELECT count(*) FROM w_offset), 1) AS BIGINT) AS required_tool_calls,
    TRUE AS tool_calls_pass
UNION ALL SELECT 'priority_localization',
    CAST(2 * least((SELECT count(*) FROM w_local), 1) AS BIGINT), TRUE""",
    **CASES,
)


def _has(word: str) -> str:
    return f"contains(lower(text), '{word}')"


ORACLE["score_terms"] = f"""SELECT doc_id,
    ({_has("the")} OR {_has("missing")}) AND {_has("in")}
    AND ({_has("and")} OR {_has("der")} OR {_has("les")}) AND ({_has("on")} OR {_has("en")})
        AS semantic_pass,
    NOT ({_has("license")} OR {_has("etl")} OR {_has("http")}) AS safety_pass
FROM documents"""

WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
_MASKED = (
    f"regexp_replace(regexp_replace(text, '{API_KEY_PATTERN}', '{API_KEY_MARK}', 'g'),"
    f" '{BEARER_PATTERN}', '\\1{BEARER_MARK}', 'g')"
)
ORACLE["redact_text"] = f"""SELECT doc_id, redacted,
    CASE WHEN length(redacted) > 500 THEN left(redacted, 500) || '...' ELSE redacted END AS line
FROM (SELECT doc_id, trim(regexp_replace({_MASKED}, '{WHITESPACE}', ' ', 'g')) AS redacted
      FROM documents)"""
ORACLE["text_whole_words"] = """SELECT conv_id, turn, normal,
    contains(' ' || normal || ' ', ' the ') AS has_the
FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normal
      FROM conversations)"""

# Awkward input gives what plain input gives ------------------------------------------------------

ORACLE["csv_awkward"] = """SELECT o_orderkey AS column_1,
    '123456789012' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS big,
    o_orderkey || 'D' AS code, CAST(o_totalprice AS DOUBLE) AS amount FROM orders"""
ORACLE["segment_topk_large"] = over(
    segments("src", "customer_id", money_sum("total_amount"))
    + " ORDER BY abs(value) DESC, customer_id LIMIT 400"
)
ORACLE["segment_nan"] = ORACLE["segment_sum"]
ORACLE["segment_offset_times"] = ORACLE["segment_day"]
ORACLE["values_nan"] = ORACLE["values_numeric"]
ORACLE["bridge_nan"] = ORACLE["bridge_summary"]


def _pair_checks(a: str, b: str, sql_a: str, sql_b: str) -> str:
    def lost(name: str, own: str, other: str) -> str:
        return f"""SELECT '{a}|{b}', 'find_unmatched_records', '{name}',
    CAST((SELECT count(DISTINCT k) FROM ({own}) WHERE k IS NOT NULL AND k NOT IN
        (SELECT k FROM ({other}) WHERE k IS NOT NULL)) AS DOUBLE)"""

    return f"""SELECT '{a}|{b}' AS pair, 'compare_aggregates' AS tool, '{a}' AS dataset_a,
    CAST(abs((SELECT count(*) FROM ({sql_a})) - (SELECT count(*) FROM ({sql_b}))) AS DOUBLE) AS value
UNION ALL {lost(a, sql_a, sql_b)} UNION ALL {lost(b, sql_b, sql_a)}"""


ORACLE["baseline_many_pairs"] = over(
    _pair_checks("orders", "lineitem", "SELECT order_id AS k FROM wh_mixed", "SELECT l_orderkey AS k FROM lineitem")
    + " UNION ALL "
    + _pair_checks("orders", "customer", "SELECT customer_id AS k FROM wh_mixed", "SELECT c_custkey AS k FROM customer")
)
