"""DuckDB SQL with the same answers as the registered queries.

Written from the rules, over the raw tables, with none of the library's code:
each statement unpivots the table it checks and applies the rule directly.
"""

from __future__ import annotations

from itertools import combinations

from columnary import vocab

from .inputs import DIRTY, EXACT, GAPPED, GAPS, LATE, WIDE_COLUMNS, WIDE_GAPS_TABLE, WIDE_TABLE

# -- tables -----------------------------------------------------------------------
COLUMNS = {
    "lineitem": "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:long l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:text l_linestatus:text l_shipdate:day",
    "dirty": "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:long l_extendedprice:double order_quantity:double discount_rate:double net_price:double spike:double mixed:text const:text near_const:text order_code:text return_status:text is_open:bool priority:text ship_text:text",
    "orders": "o_orderkey:long o_custkey:long o_orderstatus:text o_totalprice:double o_orderdate:day o_orderpriority:text",
    "customer_by_name": "c_custkey:long c_name:text c_nationkey:long c_acctbal:double c_mktsegment:text",
    "gaps": "day_code:text o_orderkey:long o_totalprice:double o_custkey:long o_orderstatus:text",
    "late": "o_orderkey:long grade:text parcel:text contact_text:text",
    "order_pairs": "o_orderstatus:text o_orderpriority:text",
    "customer": "c_custkey:long c_name:text c_nationkey:long c_acctbal:double c_mktsegment:text",
    "part": "p_partkey:long p_name:text p_brand:text p_type:text p_size:long p_retailprice:double",
    "events": "event_id:long ts:time user_id:long event_type:text value:double props:text",
    "documents": "doc_id:long text:text lang:text source:text n_chars:long",
}
ORDER = {
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "dirty": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice",
    "orders": "o_orderkey", "late": "o_orderkey", "customer_by_name": "c_name", "gaps": "day_code NULLS FIRST, o_orderkey", "order_pairs": "o_orderstatus, o_orderpriority", "customer": "c_custkey", "part": "p_partkey",
    "events": "ts, event_id", "documents": "doc_id",
}
DIRTY_SQL = DIRTY.format(text="VARCHAR", slash_date="strftime(l_shipdate, '%Y/%m/%d')")
NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "dirty": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "order_quantity", "discount_rate", "net_price", "spike"],
    "events": ["event_id", "user_id", "value"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
}


def columns(data: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[data].split()]


def source(data: str) -> str:
    if data == "dirty":
        return f"({DIRTY_SQL})"
    if data == "customer_by_name":
        return "customer"
    if data == "gaps":
        return f"({GAPS.format(text='VARCHAR')})"
    if data == "late":
        return f"({LATE.format(text='VARCHAR')})"
    return "orders" if data == "order_pairs" else data


NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _cells(i: int, name: str, lane: str) -> str:
    text = {
        "bool": f"CASE WHEN {name} THEN 'True' WHEN NOT {name} THEN 'False' END",
        "day": f"CAST(CAST({name} AS DATE) AS VARCHAR)",
    }.get(lane, f"CAST({name} AS VARCHAR)")
    number = {
        "long": f"CAST({name} AS DOUBLE)", "double": f"CAST({name} AS DOUBLE)",
        "text": f"CASE WHEN regexp_full_match(trim({name}), '{NUMBER}') THEN TRY_CAST(trim({name}) AS DOUBLE) END",
    }.get(lane, "CAST(NULL AS DOUBLE)")
    dated = {
        "day": f"{name} IS NOT NULL", "time": f"{name} IS NOT NULL",
        "text": f"regexp_full_match({name}, '[0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}') AND TRY_CAST(replace({name}, '/', '-') AS DATE) IS NOT NULL",
    }.get(lane, "FALSE")
    return f"SELECT {i} AS ordinal, '{name}' AS name, '{lane}' AS lane, rid, {text} AS t, {number} AS x, coalesce({dated}, FALSE) AS d FROM src"


def base(data: str) -> str:
    """src (rows with rid) and long (one row per cell)."""
    cells = "\nUNION ALL ".join(_cells(i, n, lane) for i, (n, lane) in enumerate(columns(data)))
    return f"src AS (SELECT *, row_number() OVER (ORDER BY {ORDER[data]}) - 1 AS rid FROM {source(data)}),\nlong AS ({cells})"


BOOLEANS = "('true','false','yes','no','y','n','0','1')"
DATE_LIKE = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2})|(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4})|(?:\d{1,2}:\d{2})"


def words(text: str) -> str:
    return f"[w FOR w IN [lower(w) FOR w IN string_split_regex(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+')] IF w <> '']"


def has(names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names.split())
    return f"list_has_any(tokens, [{listed}])"


DATE_NAMES = "date time timestamp created updated month year day"


def profile(data: str, strict: bool = False) -> str:
    """CTEs up to prof: every fact and decision, one row per column."""
    url = "regexp_matches(trim(t), '^(https?://|www\\.)', 'i')" if strict else "regexp_full_match(trim(t), '(https?://|www\\.)', 'i')"
    wordy = " AND inferred_type IN ('categorical', 'text')" if strict else ""
    scales = " OR ".join(
        f"list_has_all([{s}], normalized)" for s in (
            "'low','medium','high'", "'low','med','high'", "'poor','fair','good','excellent'", "'small','medium','large'",
            "'bronze','silver','gold','platinum'", "'very low','low','medium','high','very high'")
    )
    return f"""{base(data)},
vc AS (SELECT ordinal, t, count(*) AS n FROM long WHERE t IS NOT NULL GROUP BY ordinal, t),
tops AS (SELECT ordinal, max(n) AS top_n, -sum(n * log2(n / total)) / max(total) AS bits
         FROM (SELECT *, sum(n) OVER (PARTITION BY ordinal) AS total FROM vc) GROUP BY ordinal),
facts AS (
  SELECT ordinal, name, lane, count(*) AS row_n, count(t) AS non_null, count(*) - count(t) AS missing, count(DISTINCT t) AS uniq,
         count(*) FILTER (lower(trim(t)) IN {BOOLEANS}) AS bool_n, count(x) AS num_n, count(DISTINCT x) AS num_unique,
         count(*) FILTER (d) AS date_n, coalesce(bool_and(x > -1 AND x < 2), FALSE) AS unit_like,
         CASE WHEN lane IN ('text', 'bool') THEN coalesce(avg(length(t)), 0) ELSE 0 END AS mean_length,
         coalesce(avg(CASE WHEN x IS NOT NULL THEN (abs(x - round_even(x, 0)) <= 1e-9 + 1e-5 * abs(round_even(x, 0)))::INT END), 0) AS int_ratio,
         coalesce(avg((x >= 0)::INT), 0) AS nonneg, coalesce(avg((x BETWEEN -90 AND 90)::INT), 0) AS lat, coalesce(avg((x BETWEEN -180 AND 180)::INT), 0) AS lng,
         greatest(coalesce(avg((x BETWEEN 0 AND 1)::INT), 0), coalesce(avg((x BETWEEN 0 AND 100)::INT), 0)) AS pct_share
  FROM long GROUP BY ordinal, name, lane),
ranked AS (SELECT ordinal, t, row_number() OVER (PARTITION BY ordinal ORDER BY rid) AS rk FROM long WHERE t IS NOT NULL),
samp AS (
  SELECT ordinal,
         coalesce(avg(regexp_full_match(trim(t), '[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{{2,}}', 'i')::INT) FILTER (trim(t) <> ''), 0) AS email_share,
         coalesce(avg(regexp_full_match(trim(t), '\\+?[0-9][0-9\\-\\s().]{{6,}}')::INT) FILTER (trim(t) <> ''), 0) AS phone_share,
         coalesce(avg({url}::INT) FILTER (trim(t) <> ''), 0) AS url_share,
         coalesce(avg(regexp_matches(trim(t), '{DATE_LIKE}')::INT), 0) AS date_share,
         list(DISTINCT regexp_replace(lower(trim(t)), '\\s+', ' ', 'g')) FILTER (trim(t) <> '') AS normalized,
         string_agg(t, '|' ORDER BY rk) FILTER (rk <= 5) AS sample_values
  FROM ranked GROUP BY ordinal),
ratios AS (
  SELECT f.*, s.* EXCLUDE (ordinal), tops.top_n, coalesce(tops.bits, 0) AS bits, {words('f.name')} AS tokens,
         CASE WHEN non_null > 0 THEN bool_n / non_null ELSE 0 END AS bool_ratio,
         CASE WHEN non_null > 0 THEN num_n / non_null ELSE 0 END AS num_ratio,
         CASE WHEN non_null > 0 THEN uniq / non_null ELSE 0 END AS unique_ratio
  FROM facts f LEFT JOIN samp s USING (ordinal) LEFT JOIN tops USING (ordinal)),
looked AS (SELECT *, non_null > 0 AND ({has(DATE_NAMES)} OR date_share >= 0.6 OR lane IN ('day', 'time')) AS looks_date FROM ratios),
dated AS (SELECT *, CASE WHEN looks_date THEN date_n / non_null ELSE 0 END AS date_ratio FROM looked),
typed AS (
  SELECT *, CASE WHEN non_null = 0 THEN 'unknown' WHEN bool_ratio >= 0.95 THEN 'boolean'
                 WHEN date_ratio >= 0.9 AND uniq > 1 THEN 'datetime'
                 WHEN num_ratio >= 0.9 THEN CASE WHEN unit_like AND num_unique <= 2 THEN 'boolean' ELSE 'numeric' END
                 WHEN mean_length > 32 AND unique_ratio > 0.5 THEN 'text' ELSE 'categorical' END AS inferred_type
  FROM dated),
sem AS (
  SELECT *, CASE
      WHEN non_null = 0 THEN 'unknown:0.0'
      WHEN {has('id identifier')} THEN 'identifier:0.99'
      WHEN {has('email mail')} OR (email_share >= 0.9{wordy}) THEN 'email:0.97'
      WHEN {has('phone mobile telephone cell')} OR (phone_share >= 0.9{wordy}) THEN 'phone:0.95'
      WHEN {has('url uri website site web link')} OR (url_share >= 0.9{wordy}) THEN 'url:0.95'
      WHEN {has('zip postal postcode pincode')} THEN 'postal_code:0.95'
      WHEN inferred_type = 'boolean' THEN 'binary_flag:0.98'
      WHEN inferred_type = 'datetime' THEN CASE WHEN {has(DATE_NAMES)} THEN 'event_timestamp:0.94' ELSE 'datetime:0.9' END
      WHEN inferred_type = 'numeric' THEN CASE
          WHEN {has('lat latitude')} AND lat >= 0.95 THEN 'latitude:0.96'
          WHEN {has('lon lng longitude')} AND lng >= 0.95 THEN 'longitude:0.96'
          WHEN {has('revenue charge charges cost price amount payment fee salary income spend')} THEN 'currency:0.9'
          WHEN {has('percent percentage pct rate ratio share')} AND pct_share >= 0.95 THEN 'percentage:0.92'
          WHEN {has('duration tenure seconds minutes hours days weeks months years time')} THEN 'duration:0.86'
          WHEN {has('count counts calls visits clicks qty quantity number messages orders tickets')} AND int_ratio >= 0.95 AND nonneg >= 0.98 THEN 'count:0.88'
          ELSE 'numeric_continuous:0.72' END
      WHEN len(normalized) > 0 AND ({scales}) THEN 'ordinal_category:0.9'
      WHEN {has('city state region province country')} THEN 'location_label:0.78'
      WHEN inferred_type = 'text' THEN 'free_text:0.82'
      ELSE 'categorical_label:0.74' END AS meaning
  FROM typed),
named AS (
  SELECT *, split_part(meaning, ':', 1) AS semantic_type, CAST(split_part(meaning, ':', 2) AS DOUBLE) AS semantic_confidence FROM sem),
prof AS (
  SELECT *, CASE
      WHEN semantic_type IN ('identifier', 'email', 'phone', 'url') THEN 'identifier'
      WHEN semantic_type = 'postal_code' AND unique_ratio >= 0.5 THEN 'identifier'
      WHEN list_has_any({words('lower(trim(name))')}, ['id', 'identifier']) OR (unique_ratio >= 0.98 AND uniq > 0.9 * greatest(row_n, 1)) THEN 'identifier'
      WHEN inferred_type = 'datetime' THEN 'datetime' WHEN inferred_type = 'boolean' THEN 'boolean'
      WHEN inferred_type = 'numeric' THEN CASE WHEN uniq BETWEEN 2 AND greatest(20, floor(row_n * 0.05)) THEN 'target-candidate' ELSE 'numeric' END
      WHEN inferred_type IN ('categorical', 'text') THEN CASE WHEN uniq BETWEEN 2 AND greatest(25, floor(row_n * 0.1)) THEN 'target-candidate' ELSE 'categorical' END
      ELSE 'unknown' END AS likely_role,
      round(missing / greatest(row_n, 1), 4) AS missing_pct, round(uniq / greatest(row_n, 1), 4) AS unique_pct
  FROM named)"""


ORACLES: dict[str, str] = {}


def add(name: str, data: str, sql: str, extra: str = "", strict: bool = False) -> None:
    ORACLES[name] = f"WITH {profile(data, strict)}{extra}\n{sql}"


# -- A. sources, sinks, row order ----------------------------------------------------
ORACLES["preview_rows"] = """
SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props
FROM events QUALIFY row_id < 20"""
ORACLES["row_ordinals"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders"
ORACLES["csv_round_trip"] = f"""
WITH src AS (SELECT * FROM ({DIRTY_SQL}))
SELECT 0 AS ordinal, 'l_orderkey' AS name, 'long' AS data_type, count(l_orderkey) AS non_null, count(*) - count(l_orderkey) AS missing, count(DISTINCT l_orderkey) AS unique_count FROM src
UNION ALL SELECT 1, 'order_quantity', 'double', count(order_quantity), count(*) - count(order_quantity), count(DISTINCT order_quantity) FROM src
UNION ALL SELECT 2, 'mixed', 'text', count(mixed), count(*) - count(mixed), count(DISTINCT mixed) FROM src
UNION ALL SELECT 3, 'return_status', 'text', count(return_status), count(*) - count(return_status), count(DISTINCT return_status) FROM src
UNION ALL SELECT 4, 'is_open', 'bool', count(is_open), count(*) - count(is_open), count(DISTINCT is_open) FROM src
UNION ALL SELECT 5, 'ship_text', 'text', count(ship_text), count(*) - count(ship_text), count(DISTINCT ship_text) FROM src"""
_missing = ", ".join(f"'{t}'" for t in vocab.MISSING_TOKENS)
ORACLES["csv_multiline"] = f"""
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) AS line_breaks,
       CASE WHEN lang NOT IN ({_missing}) THEN lang END AS lang, CASE WHEN source NOT IN ({_missing}) THEN source END AS source, CAST(n_chars AS BIGINT) AS n_chars
FROM (SELECT *, CASE WHEN text NOT IN ({_missing}) THEN text END AS t FROM documents)"""
add("report_sink", "part", "SELECT CAST(2 AS BIGINT) AS analysis_id, ordinal, name, inferred_type, uniq AS unique_count, non_null AS non_null_count FROM prof")

add("report_sink_replaced", "orders", "SELECT name, inferred_type, CAST(3 AS BIGINT) AS analysis_id, 'types' AS section FROM prof")

# -- B. column profile ------------------------------------------------------------------
PROFILE_SELECT = """SELECT ordinal, name, inferred_type, semantic_type, semantic_confidence, likely_role, non_null AS non_null_count,
       round(non_null / greatest(row_n, 1), 4) AS non_null_pct, missing AS missing_count, missing_pct, uniq AS unique_count, unique_pct,
       coalesce(sample_values, '') AS sample_values FROM prof"""
for _data in ("lineitem", "dirty", "orders", "customer", "part", "events", "documents"):
    add("column_profile" if _data == "lineitem" else f"column_profile_{_data}", _data, PROFILE_SELECT)
add("column_counts", "dirty", "SELECT name, non_null AS non_null_count, round(non_null / greatest(row_n, 1), 4) AS non_null_pct, missing AS missing_count, missing_pct, uniq AS unique_count, unique_pct FROM prof")
ORACLES["sample_values"] = f"""WITH {base('customer')}
SELECT name, rank, t AS value FROM (SELECT name, t, row_number() OVER (PARTITION BY ordinal ORDER BY rid) AS rank FROM long WHERE t IS NOT NULL) WHERE rank <= 5"""
add("parse_ratios", "dirty", "SELECT name, round(bool_ratio, 6) AS bool_ratio, round(num_ratio, 6) AS num_ratio, looks_date, round(date_ratio, 6) AS date_ratio, round(mean_length, 6) AS mean_length FROM prof")
add("column_types", "dirty", "SELECT name, inferred_type FROM prof")
add("header_tokens", "dirty", "SELECT name, unnest(list_distinct(tokens)) AS token FROM prof")
add("pattern_shares", "dirty", "SELECT name, email_share, phone_share, url_share FROM prof")
add("integer_ratio", "dirty", "SELECT name, round(int_ratio, 6) AS int_ratio FROM prof WHERE num_n > 0")
add("semantic_types_late_values", "late", "SELECT name, inferred_type, semantic_type, likely_role FROM prof")
ORACLES["column_counts_decimal"] = f"""WITH src AS ({EXACT})
SELECT 'exact_amount' AS name, count(exact_amount) AS non_null_count, count(DISTINCT exact_amount) AS unique_count FROM src
UNION ALL SELECT 'l_returnflag', count(l_returnflag), count(DISTINCT l_returnflag) FROM src"""
ORACLES["duplicate_rows_decimal"] = f"""SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_row_count, (sum(n) - count(*))::BIGINT AS duplicate_row_count
FROM (SELECT count(*) AS n FROM ({EXACT}) GROUP BY exact_amount, l_returnflag)"""
add("semantic_types", "dirty", "SELECT name, semantic_type, semantic_confidence FROM prof")
add("semantic_types_strict", "orders", "SELECT name, semantic_type, semantic_confidence, likely_role FROM prof", strict=True)
add("column_roles", "dirty", "SELECT name, likely_role FROM prof")
KINDS = "(VALUES ('numeric'), ('categorical'), ('boolean'), ('datetime'), ('text'), ('unknown')) AS k(inferred_type)"
add("type_counts", "dirty", f"SELECT k.inferred_type, count(prof.name) AS column_count FROM {KINDS} LEFT JOIN prof ON prof.inferred_type = k.inferred_type GROUP BY 1")
add("key_columns", "dirty", """SELECT 'identifier' AS kind, name FROM prof WHERE likely_role = 'identifier'
UNION ALL SELECT 'target_candidate', name FROM prof WHERE likely_role IN ('target-candidate', 'boolean')""")
add("type_mix", "dirty", "SELECT inferred_type, count(*) AS column_count, round(100.0 * count(*) / (SELECT count(*) FROM prof), 4) AS pct FROM prof GROUP BY 1")
add("schema_groups", "dirty", """SELECT 'Identifiers' AS group_title, name FROM prof WHERE likely_role = 'identifier'
UNION ALL SELECT 'Target candidates', name FROM prof WHERE likely_role IN ('target-candidate', 'boolean')
UNION ALL SELECT 'Numeric fields', name FROM prof WHERE inferred_type = 'numeric'
UNION ALL SELECT 'Categorical fields', name FROM prof WHERE inferred_type = 'categorical'""")
ORACLES["unsupported_columns"] = "SELECT 'embedding' AS name, count(*) AS row_count, CAST(2 AS INT) AS column_count FROM embeddings"

# -- C. data quality ---------------------------------------------------------------------
add("missing_by_column", "dirty", 'SELECT name AS "column", missing AS missing_count, missing_pct FROM prof WHERE missing > 0')
add("missing_cells", "dirty", "SELECT CAST(sum(missing) AS BIGINT) AS total_missing_values, round(sum(missing) / (max(row_n) * count(*)), 6) AS total_missing_pct FROM prof")
ORACLES["duplicate_rows"] = """SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_row_count, (sum(n) - count(*))::BIGINT AS duplicate_row_count
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)"""
ORACLES["duplicate_rows_text"] = """SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_row_count, (sum(n) - count(*))::BIGINT AS duplicate_row_count
FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)"""
NEAR = "uniq > 1 AND top_n / non_null >= 0.95 AND top_n / non_null < 1"
INVALID = "inferred_type NOT IN ('numeric', 'datetime') AND num_ratio >= 0.2 AND num_ratio < 0.9"
WIDE = "inferred_type NOT IN ('numeric', 'datetime') AND uniq / greatest(row_n, 1) > 0.5 AND uniq > 25"
add("constant_columns", "dirty", 'SELECT name AS "column" FROM prof WHERE uniq <= 1')
add("near_constant_columns", "dirty", f'SELECT name AS "column", top_n AS dominant_count, round(top_n / non_null, 4) AS dominant_value_ratio FROM prof WHERE {NEAR}')
add("invalid_numeric_columns", "dirty", f'SELECT name AS "column", num_n AS numeric_count, round(num_ratio, 4) AS numeric_parse_ratio FROM prof WHERE {INVALID}')
add("high_cardinality_columns", "dirty", f'SELECT name AS "column", uniq AS unique_count, unique_pct FROM prof WHERE {WIDE}')
QUART = """,
nums AS (SELECT long.ordinal, long.name, long.x FROM long JOIN prof USING (ordinal) WHERE inferred_type = 'numeric' AND long.x IS NOT NULL),
quart AS (SELECT ordinal, name, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi FROM nums GROUP BY 1, 2),
fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM quart),
outs AS (SELECT f.ordinal, f.name, n, q1, q2, q3, lo, hi, lower_fence, upper_fence,
                count(*) FILTER (q3 > q1 AND (x < lower_fence OR x > upper_fence)) AS out_n
         FROM fences f JOIN nums USING (ordinal) GROUP BY ALL)"""
add("iqr_outliers", "dirty", 'SELECT name AS "column", n AS valid_count, out_n AS outlier_count, round(out_n / n, 4) AS outlier_pct, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence FROM outs WHERE n >= 10 AND out_n > 0', QUART)


def pairs(data: str, names: list[str] | None = None) -> str:
    """CTE of the correlation of every numeric pair."""
    chosen = names or NUMERIC[data]
    ordinals = {n: i for i, (n, _) in enumerate(columns(data))}
    body = "\nUNION ALL ".join(
        f"SELECT {ordinals[a]} AS oa, {ordinals[b]} AS ob, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM src" for a, b in combinations(chosen, 2)
    )
    return f",\npairs AS ({body})"


add("high_correlations", "dirty", "SELECT a AS column_a, b AS column_b, round(r, 4) AS correlation FROM pairs WHERE abs(r) >= 0.85", pairs("dirty"))
add("quality_flags", "dirty", f"""SELECT name AS "column", 'constant' AS flag, CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS ratio FROM prof WHERE uniq <= 1
UNION ALL SELECT name, 'near_constant', top_n, round(top_n / non_null, 4) FROM prof WHERE {NEAR}
UNION ALL SELECT name, 'high_cardinality', uniq, unique_pct FROM prof WHERE {WIDE}
UNION ALL SELECT name, 'invalid_numeric', num_n, round(num_ratio, 4) FROM prof WHERE {INVALID}
UNION ALL SELECT name, 'outlier', out_n, round(out_n / n, 4) FROM outs WHERE n >= 10 AND out_n > 0""", QUART)


def measures(data: str) -> str:
    """CTE m: one row with the counts and shares behind the score."""
    if data in NUMERIC:
        extra = QUART + pairs(data)
        corr = "(SELECT count(*) FROM pairs WHERE abs(round(r, 12)) >= 0.85)"
    else:
        extra, corr = QUART, "0"
    return extra + f""",
dups AS (SELECT (sum(n) - count(*))::BIGINT AS dup FROM (SELECT {', '.join(n for n, _ in columns(data))}, count(*) AS n FROM src GROUP BY ALL)),
m AS (SELECT max(row_n) AS row_count, count(*) AS column_count, sum(missing)::BIGINT AS total_missing, coalesce(max(missing_pct), 0) AS max_missing,
             count(*) FILTER (missing > 0) AS missing_columns, count(*) FILTER (uniq <= 1) AS constants, count(*) FILTER ({NEAR}) AS nears,
             count(*) FILTER ({WIDE}) AS wides, coalesce(sum((1 - round(num_ratio, 4)) * 6) FILTER ({INVALID}), 0) AS invalid_weight,
             (SELECT count(*) FROM outs WHERE n >= 10 AND out_n > 0) AS out_columns,
             (SELECT coalesce(avg(round(out_n / n, 4)), 0) FROM outs WHERE n >= 10 AND out_n > 0) AS mean_out,
             count(*) FILTER (inferred_type = 'numeric') AS numeric_columns, count(*) FILTER (inferred_type = 'categorical') AS categorical_columns,
             count(*) FILTER (likely_role IN ('target-candidate', 'boolean')) AS candidates,
             {corr} AS high_corr, (SELECT dup FROM dups) AS dup
      FROM prof)"""


def penalties(constant: str) -> str:
    return f""",
pen AS (SELECT max_missing * 25 + total_missing / (row_count * column_count) * 20 AS missing, least(dup / row_count * 40, 20) AS duplicates,
               {constant} AS constant, least(nears * 1.5, 12) AS near_constant, least(wides * 2.0, 12) AS high_cardinality,
               least(invalid_weight, 12) AS invalid_numeric,
               least(CASE WHEN numeric_columns > 0 THEN out_columns / numeric_columns ELSE 0 END * 12 + mean_out * 20, 20) AS outliers,
               least(high_corr * 4.0, 12) AS correlations FROM m),
score AS (SELECT *, greatest(0, least(100, 100 - (missing + duplicates + constant + near_constant + high_cardinality + invalid_numeric + outliers + correlations))) AS s FROM pen)"""


SHARE, COUNT = "least(constants / column_count * 20, 16)", "least(constants * 8.0, 16)"
PENALTY_SELECT = "SELECT " + ", ".join(
    f"CAST(round({p}, 6) AS DOUBLE) AS {p}" for p in ("missing", "duplicates", "constant", "near_constant", "high_cardinality", "invalid_numeric", "outliers", "correlations")
) + ", CAST(round(s, 2) AS DOUBLE) AS quality_score FROM score"
add("quality_score", "dirty", PENALTY_SELECT, measures("dirty") + penalties(SHARE))
add("quality_score_count", "dirty", PENALTY_SELECT, measures("dirty") + penalties(COUNT))
add("quality_score_clean", "lineitem", PENALTY_SELECT, measures("lineitem") + penalties(SHARE))
add("quality_recommendations", "dirty", """
SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS position, text FROM (
  SELECT 0 AS p, 'Review columns with more than 20% missing values before running models or reports.' AS text FROM m WHERE missing_columns > 0
  UNION ALL SELECT 1, 'Drop constant columns — they don''t carry useful information.' FROM m WHERE constants > 0
  UNION ALL SELECT 2, 'Consider dropping one column from highly correlated pairs to reduce overlap.' FROM m WHERE high_corr > 0
  UNION ALL SELECT 3, 'Check numeric outliers to separate data entry mistakes from genuinely unusual values.' FROM m WHERE out_columns > 0
  UNION ALL SELECT 4, 'Quality looks good — no major cleanup needed before exploring the data.' FROM m WHERE missing_columns + constants + high_corr + out_columns = 0)""", measures("dirty"))
add("dataset_posture", "dirty", """SELECT CASE WHEN column_count >= 40 THEN 'Wide dataset' WHEN column_count >= 15 THEN 'Balanced shape' ELSE 'Compact table' END AS width_label,
  row_count, column_count, round(greatest(100 - total_missing / (row_count * column_count) * 100, 0), 4) AS density_pct, total_missing AS total_missing_values,
  candidates AS target_candidate_count, CAST(round(round(s, 2), 1) AS DOUBLE) AS quality_score, dup AS duplicate_row_count FROM m, score""", measures("dirty") + penalties(COUNT))
COMPLETE = """SELECT round(greatest(0, (row_count * column_count - total_missing) / (row_count * column_count) * 100), 4) AS completeness_pct,
  round(greatest(0, (row_count - dup) / row_count * 100), 4) AS uniqueness_pct FROM m"""
add("completeness", "order_pairs", COMPLETE, measures("order_pairs"))
add("completeness_dirty", "dirty", COMPLETE, measures("dirty"))

# -- D. statistics -------------------------------------------------------------------------
NUMERIC_SELECT = """SELECT name AS "column", count(*) AS count, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS std,
  round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(skewness(x), 6) AS skew
  FROM nums GROUP BY name"""
add("numeric_summary", "lineitem", NUMERIC_SELECT.replace("round(avg(x), 6)", "round(avg(x), 4)"), QUART)
add("numeric_summary_dirty", "dirty", NUMERIC_SELECT, QUART)
LABELS = """,
labels AS (SELECT long.ordinal, long.name, coalesce(long.t, '<missing>') AS t FROM long JOIN prof USING (ordinal) WHERE inferred_type IN ('categorical', 'boolean', 'text')),
counted AS (SELECT ordinal, name, t, count(*) AS n FROM labels GROUP BY 1, 2, 3),
toplab AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, t) AS rk, count(*) OVER (PARTITION BY ordinal) AS uniq, sum(n) OVER (PARTITION BY ordinal) AS total FROM counted)"""
LABEL_SELECT = 'SELECT name AS "column", uniq AS unique_count, CAST(rk - 1 AS INT) AS position, {value} AS value, n AS count, round(n / total, 4) AS pct FROM toplab WHERE rk <= 10'
add("categorical_summary", "dirty", LABEL_SELECT.format(value="t"), LABELS)
add("categorical_summary_documents", "documents", LABEL_SELECT.format(value="sha256(t)"), LABELS)
ORACLES["categorical_ties_long_text"] = """WITH t AS (SELECT repeat('the same beginning of all texts, ', 5) || text AS body FROM documents),
c AS (SELECT body, count(*) AS n FROM t GROUP BY body)
SELECT row_number() OVER (ORDER BY n DESC, body)::INT AS rank, sha256(body) AS value, n FROM c ORDER BY n DESC, body LIMIT 10"""
ISO = "CASE WHEN microsecond({v}) % 1000000 = 0 THEN strftime({v}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({v}, '%Y-%m-%dT%H:%M:%S.%f') END"
ORACLES["datetime_summary"] = f"""
WITH a AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events)
SELECT 'ts' AS "column", {ISO.format(v="lo")} AS min, {ISO.format(v="hi")} AS max, date_sub('day', lo, hi) AS span_days FROM a"""
ORACLES["datetime_summary_text"] = """
WITH a AS (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem)
SELECT 'ship_text' AS "column", strftime(lo, '%Y-%m-%dT00:00:00') AS min, strftime(hi, '%Y-%m-%dT00:00:00') AS max, date_sub('day', lo, hi) AS span_days FROM a"""


_WIDE_NAMES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", *[f"w{i:02d}" for i in range(WIDE_COLUMNS)]]
_WIDE_PAIRS = list(combinations(_WIDE_NAMES, 2))
ORACLES["correlation_matrix_wide"] = "WITH src AS (" + WIDE_TABLE + "), r AS (SELECT " + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for a, b in _WIDE_PAIRS) + """ FROM src)
SELECT split_part(pair, '__', 1) AS x, split_part(pair, '__', 2) AS y, round(v, 4) AS value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME pair VALUE v)"""

_GAP_PAIRS = list(combinations(["l_orderkey", *GAPPED], 2))
ORACLES["correlation_matrix_wide_gaps"] = "WITH src AS (" + WIDE_GAPS_TABLE + "), r AS (SELECT " + ", ".join(
    f"corr({a}, {b}) AS {a}__{b}" for a, b in _GAP_PAIRS) + """ FROM src)
SELECT split_part(pair, '__', 1) AS x, split_part(pair, '__', 2) AS y, round(v, 4) AS value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME pair VALUE v)"""


def matrix(data: str, limit: int) -> tuple[str, str]:
    names = NUMERIC[data][:limit]
    diagonal = " UNION ALL ".join(f"SELECT '{n}' AS x, '{n}' AS y, CASE WHEN stddev_pop({n}) > 0 THEN 1.0::DOUBLE END AS value FROM src" for n in names)
    sql = f"""SELECT x, y, round(value, 4) AS value FROM (SELECT a AS x, b AS y, r AS value FROM pairs UNION ALL SELECT b, a, r FROM pairs UNION ALL {diagonal}) WHERE value IS NOT NULL"""
    return sql, pairs(data, names)


for _key, _data, _limit in (("correlation_matrix", "lineitem", 12), ("correlation_matrix_dirty", "dirty", 12), ("correlation_heatmap", "dirty", 10)):
    _sql, _extra = matrix(_data, _limit)
    ORACLES[_key] = f"WITH {base(_data)}{_extra}\n{_sql}"
ORACLES["strongest_correlations"] = f"WITH {base('dirty')}{pairs('dirty')}\nSELECT a AS x, b AS y, round(r, 4) AS value FROM pairs ORDER BY abs(round(r, 4)) DESC, a, b LIMIT 8"
add("skewed_fields", "dirty", """SELECT name AS "column", round(skew, 6) AS skew FROM (SELECT ordinal, name, skewness(x) AS skew FROM nums GROUP BY 1, 2)
WHERE abs(round(skew, 6)) >= 1 ORDER BY abs(round(skew, 6)) DESC, ordinal LIMIT 6""", QUART)
add("dominant_categories", "dirty", """SELECT name AS "column", uniq AS unique_count, t AS value, n AS count, round(n / total, 4) AS pct FROM toplab WHERE rk = 1
ORDER BY round(n / total, 4) DESC, ordinal LIMIT 6""", LABELS)

# -- E. chart tables and drift ---------------------------------------------------------------
add("missingness", "dirty", 'SELECT name AS "column", round(missing_pct * 100, 2) AS missing_pct, missing AS missing_count FROM prof WHERE missing_pct > 0')
HIST = """,
firsts AS (SELECT ordinal FROM prof WHERE inferred_type = 'numeric' ORDER BY ordinal LIMIT 8),
spans AS (SELECT ordinal, name, least(12, greatest(4, floor(sqrt(n))))::INT AS k, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
          FROM quart WHERE ordinal IN (SELECT ordinal FROM firsts)),
placed AS (SELECT s.ordinal, len([i FOR i IN range(1, s.k) IF x >= s.lo + i * ((s.hi - s.lo) / s.k)]) AS b FROM nums JOIN spans s USING (ordinal)),
bins AS (SELECT ordinal, name, k, lo, hi, CAST(unnest(range(0, k)) AS INT) AS b FROM spans),
hist AS (SELECT bins.ordinal, bins.name, bins.b, round(lo + bins.b * ((hi - lo) / k), 6) AS s, round(CASE WHEN bins.b = k - 1 THEN hi ELSE lo + (bins.b + 1) * ((hi - lo) / k) END, 6) AS e, count(placed.b) AS n
         FROM bins LEFT JOIN placed ON placed.ordinal = bins.ordinal AND placed.b = bins.b GROUP BY ALL)"""
add("histograms", "lineitem", 'SELECT name AS "column", b AS bin, s AS start, e AS "end", n AS count FROM hist', QUART + HIST)
BOX = """,
boxes AS (SELECT ordinal, name, round(lo, 6) AS lo, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(hi, 6) AS hi, out_n FROM outs ORDER BY ordinal LIMIT 8)"""
add("boxplots", "dirty", 'SELECT name AS "column", lo AS min, q1, q2 AS median, q3, hi AS max, out_n AS outlier_count FROM boxes', QUART + BOX)
add("top_categories", "dirty", """SELECT name AS "column", t AS label, n AS count, rk AS rank FROM toplab WHERE rk <= 10 AND ordinal IN (SELECT DISTINCT ordinal FROM toplab ORDER BY ordinal LIMIT 6)""", LABELS)
ORACLES["pairwise_scatter"] = f"WITH {base('events')}{pairs('events')}\n" + """
SELECT a AS x_column, b AS y_column, round(r, 4) AS correlation, row, round(x, 6) AS x, round(y, 6) AS y FROM pairs JOIN (
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS pa, '{b}' AS pb, CAST(row_number() OVER (ORDER BY rid) AS INT) AS row, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in combinations(NUMERIC["events"], 2)
) + "\n) pts ON pts.pa = pairs.a AND pts.pb = pairs.b WHERE row <= 220 AND r IS NOT NULL"


def drift(late: str) -> str:
    """CTEs for both kinds of drift; ``late`` is the condition on src."""
    return LABELS + f""",
halves AS (SELECT rid, {late} AS late FROM src),
ndrift AS (
  SELECT ordinal, name, avg(x) FILTER (NOT late) AS a, avg(x) FILTER (late) AS b, stddev_pop(x) AS sd
  FROM long JOIN prof USING (ordinal, name) JOIN halves USING (rid) WHERE inferred_type = 'numeric' AND x IS NOT NULL GROUP BY 1, 2
  ORDER BY ordinal LIMIT 8),
lab2 AS (SELECT long.ordinal, long.name, late, coalesce(t, '<missing>') AS t, count(*) AS n FROM long JOIN prof USING (ordinal) JOIN halves USING (rid)
         WHERE inferred_type IN ('categorical', 'boolean', 'text') GROUP BY ALL),
lead2 AS (SELECT *, row_number() OVER (PARTITION BY ordinal, late ORDER BY n DESC, t) AS rk, sum(n) OVER (PARTITION BY ordinal, late) AS total FROM lab2),
cdrift AS (
  SELECT e.ordinal, e.name, e.t AS ta, l.t AS tb, e.n / e.total AS a, l.n / l.total AS b FROM lead2 e JOIN lead2 l USING (ordinal)
  WHERE e.rk = 1 AND l.rk = 1 AND NOT e.late AND l.late AND ordinal IN (SELECT DISTINCT ordinal FROM lab2 ORDER BY ordinal LIMIT 6)),
alld AS (
  SELECT ordinal, name AS "column", 'numeric' AS kind, 'First half mean' AS baseline_label, 'Second half mean' AS recent_label,
         round(a, 6) AS baseline_value, round(b, 6) AS recent_value, round((b - a) / greatest(abs(a), 1e-6) * 100, 4) AS delta_pct,
         round(abs(b - a) / greatest(CASE WHEN sd = 0 THEN 1 ELSE sd END, 1e-6), 4) AS change_score,
         CAST(NULL AS VARCHAR) AS baseline_top, CAST(NULL AS VARCHAR) AS recent_top, CAST(NULL AS DOUBLE) AS baseline_share, CAST(NULL AS DOUBLE) AS recent_share
  FROM ndrift WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT ordinal, name, 'categorical', 'First half top category', 'Second half top category', NULL, NULL, NULL, round(abs(b - a), 4), ta, tb, round(a, 4), round(b, 4) FROM cdrift)"""


HALF = "rid >= greatest(1, (SELECT count(*) FROM src) // 2)"
DRIFT_TOP = "SELECT * EXCLUDE (ordinal) FROM alld ORDER BY change_score DESC, kind DESC, ordinal LIMIT 10"
add("drift_numeric", "events", 'SELECT "column", kind, baseline_label, recent_label, baseline_value, recent_value, delta_pct, change_score FROM alld WHERE kind = \'numeric\'', drift(HALF))
add("drift_categorical", "events", 'SELECT "column", kind, baseline_label, recent_label, baseline_top, recent_top, baseline_share, recent_share, change_score FROM alld WHERE kind = \'categorical\'', drift(HALF))
add("drift_checks", "orders", DRIFT_TOP, drift(HALF))
add("drift_no_key", "events", DRIFT_TOP, drift(HALF))
add("drift_text_key", "customer_by_name", DRIFT_TOP, drift(HALF))
add("drift_null_key", "gaps", DRIFT_TOP, drift(HALF))
add("drift_by_time", "dirty", DRIFT_TOP, drift("ship_text >= '1999/01/01'"))


def pick(label: str, subject: str, detail: str, value: str, share: str, low: str, high: str, rest: str) -> str:
    return f"(SELECT '{label}' AS pick, {subject} AS subject, {detail} AS detail, CAST({value} AS DOUBLE) AS value, CAST({share} AS DOUBLE) AS share, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high FROM {rest})"


FIRST_HIST = "hist WHERE ordinal = (SELECT min(ordinal) FROM hist)"
FIRST_LAB = "toplab WHERE rk <= 10 AND ordinal = (SELECT min(ordinal) FROM toplab)"
MISS = "(SELECT ordinal, name, round(missing_pct * 100, 2) AS p FROM prof WHERE missing_pct > 0 ORDER BY p DESC, ordinal LIMIT 6)"
BOX6 = "(SELECT * FROM boxes ORDER BY ordinal LIMIT 6)"
add("chart_picks", "events", "\nUNION ALL ".join([
    pick("strongest_positive", "a", "b", "round(r, 4)", "NULL", "NULL", "NULL", "pairs WHERE round(r, 4) > 0 ORDER BY round(r, 4) DESC, oa, ob LIMIT 1"),
    pick("strongest_negative", "a", "b", "round(r, 4)", "NULL", "NULL", "NULL", "pairs WHERE round(r, 4) < 0 ORDER BY round(r, 4), oa, ob LIMIT 1"),
    pick("densest_bin", "name", "CAST(NULL AS VARCHAR)", "n", f"round(n / (SELECT sum(n) FROM {FIRST_HIST}), 4)", "s", "e", f"{FIRST_HIST} ORDER BY n DESC, b LIMIT 1"),
    pick("leading_category", "name", "t", "n", f"round(n / (SELECT sum(n) FROM {FIRST_LAB}), 4)", "NULL", "NULL", f"{FIRST_LAB} AND rk = 1"),
    pick("runner_up_category", "name", "t", "n", f"round(n / (SELECT sum(n) FROM {FIRST_LAB}), 4)", "NULL", "NULL", f"{FIRST_LAB} AND rk = 2"),
    pick("most_outliers", "name", "CAST(NULL AS VARCHAR)", "out_n", "NULL", "NULL", "NULL", f"{BOX6} ORDER BY out_n DESC, ordinal LIMIT 1"),
    pick("widest_range", "name", "CAST(NULL AS VARCHAR)", "hi - lo", "NULL", "lo", "hi", f"{BOX6} ORDER BY hi - lo DESC, ordinal LIMIT 1"),
    pick("most_missing", "name", "CAST(NULL AS VARCHAR)", "p", "NULL", "NULL", "NULL", f"{MISS} ORDER BY p DESC, ordinal LIMIT 1"),
    pick("least_missing", "name", "CAST(NULL AS VARCHAR)", "p", "NULL", "NULL", "NULL", f"{MISS} ORDER BY p, ordinal LIMIT 1"),
    pick("largest_drift", '"column"', "kind", "change_score", "NULL", "NULL", "NULL", "alld ORDER BY change_score DESC, kind DESC, ordinal LIMIT 1"),
]), QUART + HIST + BOX + pairs("events") + drift(HALF))

# -- F. insights --------------------------------------------------------------------------------
def sentences(data: str) -> str:
    pair = "(SELECT a || ' and ' || b || ' (' || CAST(round(r, 4) AS VARCHAR) || ').' FROM pairs WHERE abs(r) >= 0.85 ORDER BY oa, ob LIMIT 1)" if data in NUMERIC else "CAST(NULL AS VARCHAR)"
    return measures(data) + f""",
sk AS (SELECT count(*) FILTER (abs(s) >= 1) AS skewed FROM (SELECT round(skewness(x), 6) AS s FROM nums GROUP BY ordinal)),
worst AS (SELECT name, missing_pct FROM prof WHERE missing > 0 ORDER BY missing_pct DESC, ordinal LIMIT 1),
lines AS (
  SELECT 'finding' AS kind, 0 AS p, '{data} contains ' || format('{{:,}}', row_count) || ' rows across ' || column_count || ' columns with ' || numeric_columns || ' numeric and ' || categorical_columns || ' categorical fields.' AS text FROM m
  UNION ALL SELECT 'finding', 1, 'The highest missingness is in ' || name || ' at ' || printf('%.1f', missing_pct * 100) || '% missing values.' FROM worst
  UNION ALL SELECT 'finding', 2, 'The dataset includes ' || format('{{:,}}', dup) || ' duplicate rows that may skew summaries or downstream models.' FROM m WHERE dup > 0
  UNION ALL SELECT 'finding', 3, constants || ' columns are constant and can be dropped without losing information.' FROM m WHERE constants > 0
  UNION ALL SELECT 'finding', 4, 'Strong correlation detected between ' || {pair} FROM m WHERE high_corr > 0
  UNION ALL SELECT 'finding', 5, skewed || ' numeric fields are heavily skewed, which may need transformation before modeling.' FROM sk WHERE skewed > 0
  UNION ALL SELECT 'next_step', 0, 'Decide whether to fill in or remove heavily missing columns before running models.' FROM worst
  UNION ALL SELECT 'next_step', 1, 'Remove duplicate rows before running final analysis or models.' FROM m WHERE dup > 0
  UNION ALL SELECT 'next_step', 2, 'Check highly correlated columns for overlap before running ML.' FROM m WHERE high_corr > 0
  UNION ALL SELECT 'next_step', 3, CASE WHEN candidates > 0 OR numeric_columns >= 2 THEN 'This dataset looks ready for ML if you want to explore it.'
                                        ELSE 'Review and clean the data first — there isn''t enough structure for ML yet.' END FROM m),
said AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY p) - 1 AS INT) AS position, text FROM lines)"""


add("insights", "dirty", "SELECT kind, position, text FROM said", sentences("dirty"))
add("insights_duplicates", "order_pairs", "SELECT kind, position, text FROM said", sentences("order_pairs"))
add("insight_summary", "dirty", "SELECT string_agg(text, ' ' ORDER BY position) AS summary FROM said WHERE kind = 'finding' AND position < 3", sentences("dirty"))
add("modelling_readiness", "dirty", "SELECT candidates > 0 OR numeric_columns >= 2 AS is_ready, candidates AS target_candidate_count, numeric_columns AS numeric_fields FROM m", measures("dirty"))

# -- G. target recommendation ---------------------------------------------------------------------
BONUS_EXACT = "'churn','attrition','cancel','cancellation','retention','renewal','default','fraud','response','outcome','target','label','converted','conversion','class','status','result'"
BONUS_PART = "churn|attrition|cancel|retention|renewal|default|fraud|response|outcome|target|label|converted|conversion"
TARGETS = f""",
tails AS (SELECT ordinal, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.9) AS q90 FROM long WHERE x IS NOT NULL GROUP BY 1),
sig AS (SELECT prof.*, q10, q90, lower(trim(name)) AS h,
   CASE WHEN lower(trim(name)) IN ({BONUS_EXACT}) THEN 0.16 WHEN regexp_matches(lower(name), '{BONUS_PART}') THEN 0.09 ELSE 0 END::DOUBLE AS bonus,
   CASE WHEN contains(lower(name), 'plan') THEN 0.08 WHEN regexp_matches(lower(name), 'segment|tier|band|bucket|group') THEN 0.05 ELSE 0 END::DOUBLE AS penalty,
   (lower(trim(name)) = 'id' OR regexp_matches(lower(trim(name)), '( id|_id| code|zip)$|identifier|area code|postal|pincode')) AS code,
   CASE WHEN uniq > 1 THEN greatest(0, least(1, bits / log2(uniq))) ELSE 0 END AS entropy,
   greatest(0, least(1, 1 - missing_pct * 1.6)) AS coverage, least(1, non_null / 500) AS support,
   non_null / greatest(uniq, 1) AS per_class, CASE WHEN non_null > 0 THEN top_n / non_null ELSE 1 END AS dom, greatest(8, floor(row_n * 0.08)) AS many,
   likely_role NOT IN ('target-candidate', 'boolean') AS wrong_role,
   semantic_type IN ('email', 'phone', 'url', 'identifier', 'postal_code') AS contact, semantic_type IN ('latitude', 'longitude', 'free_text') AS coord, semantic_type = 'location_label' AS place,
   CASE WHEN likely_role = 'identifier' OR unique_pct >= 0.95 THEN 'near_unique' WHEN uniq < 2 THEN 'single' WHEN missing_pct > 0.35 THEN 'sparse'
        WHEN inferred_type IN ('boolean', 'categorical') OR (inferred_type = 'numeric' AND uniq BETWEEN 2 AND 10) THEN 'classification'
        WHEN inferred_type = 'numeric' THEN 'regression' ELSE 'unsuitable' END AS branch
   FROM prof LEFT JOIN tails USING (ordinal)),
raws AS (SELECT *, CASE branch
   WHEN 'classification' THEN 0.08 + coverage * 0.18 + entropy * 0.22 + least(1, per_class / 180) * 0.14 + greatest(0, least(1, 1 - greatest(0, uniq - 2) / 18)) * 0.12 + support * 0.06
     + CASE WHEN inferred_type = 'boolean' THEN 0.04 ELSE 0 END + CASE WHEN semantic_type = 'ordinal_category' THEN 0.03 ELSE 0 END + bonus - penalty
     - CASE WHEN contact THEN 0.28 ELSE 0 END - CASE WHEN coord THEN 0.16 ELSE 0 END - CASE WHEN place THEN 0.05 ELSE 0 END
     - CASE WHEN dom > 0.7 THEN least(0.22, (dom - 0.7) * 0.55) ELSE 0 END - CASE WHEN per_class < 40 THEN least(0.18, (40 - per_class) / 40 * 0.18) ELSE 0 END
     - CASE WHEN uniq > many THEN least(0.14, (uniq - many) * 0.015) ELSE 0 END - CASE WHEN wrong_role THEN 0.18 ELSE 0 END - CASE WHEN code THEN 0.32 ELSE 0 END
   WHEN 'regression' THEN 0.1 + coverage * 0.2 + least(1, uniq / greatest(30, num_n * 0.45)) * 0.14 + least(1, unique_pct / 0.85) * 0.18 + CASE WHEN q90 > q10 THEN 0.16 ELSE 0 END + support * 0.1
     - CASE WHEN uniq < 12 THEN least(0.22, (12 - uniq) / 12 * 0.22) ELSE 0 END + least(0.12, bonus) + CASE WHEN semantic_type IN ('currency', 'percentage', 'count', 'duration') THEN 0.03 ELSE 0 END
     - least(0.06, penalty) - CASE WHEN contact THEN 0.28 ELSE 0 END - CASE WHEN unique_pct > 0.9 THEN least(0.16, (unique_pct - 0.9) * 1.2) ELSE 0 END
     - CASE WHEN num_n < 80 THEN least(0.14, (80 - num_n) / 80 * 0.14) ELSE 0 END - CASE WHEN q90 <= q10 THEN 0.18 ELSE 0 END
     - CASE WHEN dom > 0.08 THEN least(0.12, (dom - 0.08) * 0.8) ELSE 0 END - CASE WHEN wrong_role THEN 0.18 ELSE 0 END - CASE WHEN code THEN 0.3 ELSE 0 END
     - CASE WHEN coord THEN 0.16 ELSE 0 END - CASE WHEN place THEN 0.05 ELSE 0 END
   ELSE 0 END AS raw FROM sig),
scored AS (SELECT *, CASE WHEN branch IN ('classification', 'regression') THEN branch ELSE 'none' END AS task, round(greatest(0, least(1, raw)), 4)::DOUBLE AS score,
   CASE WHEN branch = 'classification' THEN CASE WHEN raw >= 0.78 THEN 'good classification target' WHEN raw >= 0.62 THEN 'usable classification target' ELSE 'weak target' END
        WHEN branch = 'regression' THEN CASE WHEN raw >= 0.74 THEN 'good regression target' WHEN raw >= 0.58 THEN 'usable regression target' ELSE 'weak target' END
        ELSE 'bad target' END AS verdict FROM raws)"""
add("normalized_entropy", "dirty", 'SELECT name AS "column", round(entropy, 6) AS normalized_entropy FROM sig', TARGETS)
add("header_signals", "dirty", "SELECT name, bonus AS outcome_bonus, penalty AS feature_penalty, code AS code_like FROM sig", TARGETS)
add("target_scores", "dirty", 'SELECT name AS "column", task AS recommended_task, semantic_type, verdict, score FROM scored', TARGETS)
add("target_top8", "dirty", 'SELECT name AS "column", task AS recommended_task, verdict, score FROM scored ORDER BY score DESC, lower(name) LIMIT 8', TARGETS)
add("preferred_target", "dirty", "SELECT name AS \"column\" FROM scored WHERE task <> 'none' ORDER BY score DESC, lower(name) LIMIT 1", TARGETS)
add("probe_blend", "dirty", f"""SELECT name AS "column", CASE WHEN inferred_type = 'numeric' THEN round(greatest(0, least(1, score * 0.78 + unique_pct * 0.22)), 4) ELSE score END AS score,
  CASE WHEN inferred_type = 'numeric' THEN score END AS heuristic_score, CASE WHEN inferred_type = 'numeric' THEN unique_pct END AS probe_score,
  CAST(reason_n + CASE WHEN inferred_type = 'numeric' THEN 1 ELSE 0 END AS INT) AS reason_count
  FROM scored JOIN (SELECT ordinal, count(*) AS reason_n FROM reasons GROUP BY 1) USING (ordinal)""", "")

ROLE_TEXT = "The profiling pass reads this more like an input feature than a direct business outcome."
CODE_TEXT = "The header looks like a routing or code field, which is often metadata rather than the business outcome you want to predict."
OUTCOME_TEXT = "The header reads like a business outcome, so it is more likely to be the target you want to predict."
GROUP_TEXT = "The header reads like a feature flag or grouping field, which often works better as an input than as the outcome to predict."
MISSING_TEXT = "Missing target values will reduce usable training rows."
_RULES = [
    ("branch = 'near_unique'", "'Almost every row has a unique value, so the column behaves like an identifier.'"),
    ("branch = 'single'", "'The column has fewer than two distinct values, so it cannot act as a useful target.'"),
    ("branch = 'sparse'", "'Too many target values are missing for a stable supervised workflow.'"),
    ("branch = 'unsuitable'", "'The column type is not a strong fit for direct supervised learning.'"),
    ("branch = 'classification'", "'The column has a limited number of classes, which fits classification.'"),
    ("branch = 'classification' AND inferred_type = 'boolean'", "'Binary outcomes are usually easier to benchmark clearly than multi-class targets.'"),
    ("branch = 'classification' AND semantic_type = 'ordinal_category'", "'The values look ordered, which can still produce a clean classification target even without numeric encoding.'"),
    ("branch = 'classification' AND bonus > 0", f"'{OUTCOME_TEXT}'"),
    ("branch = 'classification' AND penalty > 0", f"'{GROUP_TEXT}'"),
    ("branch = 'classification' AND contact", "'The semantic profile reads more like contact, routing, or identifier data than a business outcome.'"),
    ("branch = 'classification' AND coord", "'The semantic profile reads more like descriptive or coordinate data than a stable supervised target.'"),
    ("branch = 'classification' AND place", "'Location labels are often better used as inputs unless the dataset is explicitly about regional classification.'"),
    ("branch = 'classification' AND missing_pct > 0.15", f"'{MISSING_TEXT}'"),
    ("branch = 'classification' AND dom > 0.7", "'The largest class represents ' || printf('%.1f', dom * 100) || '% of usable rows, so minority recall may be harder to learn.'"),
    ("branch = 'classification' AND dom <= 0.7", "'Class balance looks stable enough for a benchmark to be informative.'"),
    ("branch = 'classification' AND per_class < 40", "'Average support is only about ' || printf('%.0f', per_class) || ' rows per class, which makes the holdout scores less stable.'"),
    ("branch = 'classification' AND uniq > many", "'There are enough classes that class imbalance or sparsity may become a problem.'"),
    ("branch = 'classification' AND wrong_role", f"'{ROLE_TEXT}'"),
    ("branch = 'classification' AND code", f"'{CODE_TEXT}'"),
    ("branch = 'regression'", "'The column is numeric with enough spread to support regression.'"),
    ("branch = 'regression' AND uniq < 12", "'Low numeric variety may make regression unstable or unnecessary.'"),
    ("branch = 'regression' AND bonus > 0", f"'{OUTCOME_TEXT}'"),
    ("branch = 'regression' AND semantic_type IN ('currency', 'percentage', 'count', 'duration')", "'The semantic profile matches a numeric business measure, which is a more natural fit for regression.'"),
    ("branch = 'regression' AND penalty > 0", f"'{GROUP_TEXT}'"),
    ("branch = 'regression' AND contact", "'The semantic profile reads more like contact, routing, or identifier data than a numeric business outcome.'"),
    ("branch = 'regression' AND unique_pct > 0.9", "'Very high uniqueness can indicate a near-identifier rather than a business target.'"),
    ("branch = 'regression' AND missing_pct > 0.15", f"'{MISSING_TEXT}'"),
    ("branch = 'regression' AND num_n < 80", "'There are not many usable target rows, so regression scores may move more between runs.'"),
    ("branch = 'regression' AND q90 <= q10", "'The target shows limited spread across the middle of the distribution, which reduces learnable signal.'"),
    ("branch = 'regression' AND dom > 0.08", "'A repeated dominant value takes up a noticeable share of rows, which makes the target less informative for regression.'"),
    ("branch = 'regression' AND wrong_role", f"'{ROLE_TEXT}'"),
    ("branch = 'regression' AND code", f"'{CODE_TEXT}'"),
    ("branch = 'regression' AND coord", "'The semantic profile reads more like descriptive or coordinate data than a stable numeric target.'"),
    ("branch = 'regression' AND place", "'Location labels are often better used as inputs unless the dataset is explicitly about regional forecasting.'"),
]
REASONS = ",\nrules AS (" + "\nUNION ALL ".join(f"SELECT ordinal, name, {i} AS p, {text} AS reason FROM scored WHERE {cond}" for i, (cond, text) in enumerate(_RULES)) + """),
reasons AS (SELECT ordinal, name, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY p) - 1 AS INT) AS position, reason FROM rules)"""
add("target_reasons", "dirty", 'SELECT name AS "column", position, reason FROM reasons', TARGETS + REASONS)
_blend = ORACLES["probe_blend"].index("\nSELECT name")
ORACLES["probe_blend"] = ORACLES["probe_blend"][:_blend] + TARGETS + REASONS + ORACLES["probe_blend"][_blend:]
add("capability_gates", "dirty", """
SELECT 'unsupervised' AS capability, numeric_columns >= 2 AND row_count >= 10 AS available,
  CASE WHEN numeric_columns >= 2 AND row_count >= 10 THEN 'At least two numeric columns are available for clustering, PCA, and anomaly detection.'
       ELSE 'Need at least two numeric columns and 10 rows for unsupervised analysis.' END AS reason FROM m
UNION ALL SELECT 'supervised', candidates > 0 OR (SELECT count(*) FROM scored WHERE task <> 'none') > 0,
  CASE WHEN candidates > 0 OR (SELECT count(*) FROM scored WHERE task <> 'none') > 0 THEN 'Choose a target column to compare dataset-specific supervised models.'
       ELSE 'No obvious target candidates were inferred automatically, but you can still choose a valid target column manually.' END FROM m""", measures("dirty") + TARGETS)

from . import oracles_ml  # noqa: E402  (adds the model and archive statements)

ORACLES.update(oracles_ml.statements(base, source, columns))
