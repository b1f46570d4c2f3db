"""DuckDB statements for the benchmark, scan and archive operators."""

from __future__ import annotations

from .inputs import BAND_GAP, GAPPED, WIDE_GAPS_TABLE

YES_NO = """preds AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS actual, CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END AS prediction,
  l_returnflag = 'R' AS positive, l_quantity / 50.0 AS score FROM lineitem)"""
THREE = "preds AS (SELECT l_returnflag AS actual, CASE WHEN l_linenumber <= 2 THEN 'A' WHEN l_linenumber <= 5 THEN 'N' ELSE 'Z' END AS prediction FROM lineitem)"

CLASS_METRICS = """per AS (
  SELECT a.label, support, hits, coalesce(predicted, 0) AS predicted, coalesce(hits / nullif(predicted, 0), 0) AS p, hits / support AS r
  FROM (SELECT actual AS label, count(*) AS support, count(*) FILTER (actual = prediction) AS hits FROM preds GROUP BY 1) a
  LEFT JOIN (SELECT prediction AS label, count(*) AS predicted FROM preds GROUP BY 1) b USING (label)),
met AS (SELECT sum(hits) / sum(support) AS accuracy, avg(r) AS balanced_accuracy, sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support) AS f1,
               sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall FROM per)"""
MET_SELECT = "SELECT round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM met"
AUC = """sc AS (SELECT score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM preds GROUP BY 1),
auc AS (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc))"""


def rule_models() -> str:
    """Metrics of three rule-made classifiers in one table ``mm``."""
    parts = []
    ctes = []
    for i, (name, limit) in enumerate((("Low Cut", 10), ("Middle Cut", 25), ("High Cut", 40))):
        body = CLASS_METRICS.replace("preds", f"preds{i}").replace("per AS", f"per{i} AS").replace("FROM per)", f"FROM per{i})").replace("met AS", f"met{i} AS")
        ctes.append(f"preds{i} AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS actual, CASE WHEN l_quantity > {limit} THEN 'yes' ELSE 'no' END AS prediction FROM lineitem),\n{body}")
        parts.append(f"SELECT {i} AS position, '{name}' AS model, * FROM met{i}")
    return ",\n".join(ctes) + ",\nmm AS (" + " UNION ALL ".join(parts) + ")"


def slice_sql(src: str, target: str, numbers: list[str], labels: list[str], mode: str, task_label: str, positive: str | None) -> str:
    """Numeric bands and common categories against a target."""
    y = f"CAST({target} AS DOUBLE)" if mode == "regression" else "CAST(NULL AS DOUBLE)"
    work = f"work AS (SELECT *, {y} AS y, CAST({target} AS VARCHAR) AS ly FROM {src} WHERE {target} IS NOT NULL)"
    order = {n: i for i, n in enumerate(numbers)}
    feats = " UNION ALL ".join(f"SELECT '{n}' AS feature, {order[n]} AS pos, CAST({n} AS DOUBLE) AS x, y, ly FROM work" for n in numbers)
    score = {"regression": "abs(corr(x, y))", "binary": f"abs(corr(x, (ly = '{positive}')::INT))", "multi": "stddev_pop(x)"}[mode]
    cats = " UNION ALL ".join(f"SELECT '{n}' AS feature, {i} AS pos, coalesce(CAST({n} AS VARCHAR), '<missing>') AS label, y, ly FROM work" for i, n in enumerate(labels))
    if mode == "multi":
        value = """SELECT {keys}, sum(c)::BIGINT AS count, max(c) / sum(c) AS v, arg_min(ly, (-c, ly)) AS cls FROM (SELECT {keys}, ly, count(*) AS c FROM {rows} GROUP BY ALL) GROUP BY {keys}"""
    else:
        measure = "avg(y)" if mode == "regression" else f"avg((ly = '{positive}')::INT)"
        value = "SELECT {keys}, count(*) AS count, " + measure + " AS v, CAST(NULL AS VARCHAR) AS cls FROM {rows} GROUP BY {keys}"
    return f"""WITH {work},
feats AS (SELECT * FROM ({feats}) WHERE x IS NOT NULL),
lead AS (SELECT feature, pos, least(5, count(DISTINCT x)) AS bands, {score} AS s FROM feats GROUP BY 1, 2 HAVING count(*) >= 20 ORDER BY coalesce(s, 0) DESC, pos LIMIT 4),
probs AS (SELECT feature, unnest(range(0, bands + 1)) / bands AS p FROM lead),
edges AS (SELECT feature, list_sort(list_distinct(CASE max(bands) {' '.join(f'WHEN {b} THEN quantile_cont(x, [{", ".join(f"{i} / {b}" for i in range(b + 1))}])' for b in range(1, 6))} END)) AS e FROM feats JOIN lead USING (feature) GROUP BY 1),
banded AS (SELECT f.feature, e, y, ly, len([i FOR i IN e[2:len(e) - 1] IF i < x]) AS b FROM feats f JOIN edges USING (feature) WHERE len(e) >= 2),
num AS ({value.format(keys="feature, e, b", rows="banded")}),
cats AS ({cats}),
top AS (SELECT feature, pos, label, rk FROM (SELECT feature, pos, label, count(*) AS c, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, label) AS rk,
        count(*) OVER (PARTITION BY feature) AS kinds FROM cats GROUP BY 1, 2, 3) WHERE rk <= 6 AND c >= 5 AND kinds >= 2),
chosen AS (SELECT feature FROM top GROUP BY feature ORDER BY min(pos) LIMIT (SELECT 6 - count(DISTINCT feature) FROM num)),
catrows AS (SELECT c.feature, c.label, rk, y, ly FROM cats c JOIN top USING (feature, label) WHERE c.feature IN (SELECT feature FROM chosen)),
cat AS ({value.format(keys="feature, label, rk", rows="catrows")})
SELECT feature, 'numeric' AS feature_type, CAST(b + 1 AS INT) AS bucket, round(e[b + 1], 6) AS lower, round(e[b + 2], 6) AS upper, CAST(NULL AS VARCHAR) AS label, count, '{task_label}' AS target_label, round(v, 6) AS target_value, cls AS target_class FROM num
UNION ALL SELECT feature, 'categorical', CAST(rk AS INT), NULL, NULL, label, count, '{task_label}', round(v, 6), cls FROM cat"""


RUNS = """runs AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS display_name, lower(c_mktsegment) || '.csv' AS source_filename,
  CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS status, c_name AS dataset_name, 'Segment ' || c_mktsegment AS summary, c_acctbal > 2000 AS is_ready FROM customer),
allexp AS (SELECT o_custkey AS analysis_id, printf('exp_%08d', o_orderkey) AS experiment_id, CASE WHEN o_orderkey % 3 = 0 THEN 'unsupervised' ELSE 'supervised' END AS experiment_type,
  strftime(o_orderdate, '%Y-%m-%d') AS created_at, 'Status ' || o_orderstatus AS summary, o_orderstatus FROM orders),
exp AS (SELECT * FROM allexp WHERE o_orderstatus <> 'F'),
latest AS (SELECT analysis_id, count(*) OVER (PARTITION BY analysis_id) AS n, experiment_id, summary AS latest_summary FROM exp
           QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC, experiment_id DESC) = 1),
listing AS (SELECT runs.*, CAST(coalesce(n, 0) AS INT) AS experiment_count, experiment_id AS latest_id, latest_summary FROM runs LEFT JOIN latest ON latest.analysis_id = runs.id)"""
FLAT = "SELECT id, user_id, display_name, source_filename, status, dataset_name, is_ready, experiment_count, latest_id, latest_summary FROM listing"
HAY = "lower(concat_ws(' ', dataset_name, source_filename, summary, status, latest_summary))"


def statements(base, source, columns) -> dict[str, str]:
    out: dict[str, str] = {}
    dirty = source("dirty")
    number_lanes = ("long", "double", "bool")

    # -- H. supervised benchmark
    tasks = " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count({n}) AS usable_rows, CASE WHEN count(DISTINCT {n}) > 10 AND {str(lane in number_lanes).upper()} THEN 'regression' ELSE 'classification' END AS task FROM src"
        for n, lane in columns("dirty")
    )
    out["task_types"] = f"WITH src AS (SELECT * FROM {dirty}) {tasks}"
    quota = """sizes AS (SELECT {g} AS label, count(*) AS n FROM orders GROUP BY 1),
exact AS (SELECT label, n, {total} * n / (SELECT sum(n) FROM sizes) AS e FROM sizes),
part AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY floor(e) - e, label) AS rk FROM exact),
fill AS (SELECT label, n, CAST(f + CASE WHEN rk <= {total} - (SELECT sum(f) FROM part) THEN 1 ELSE 0 END AS BIGINT) AS k FROM part)"""
    out["stratified_split"] = "WITH " + quota.format(g="o_orderpriority", total="(SELECT ceil(0.2 * count(*)) FROM orders)") + """
SELECT label, 'test' AS side, k AS n FROM fill UNION ALL SELECT label, 'train', n - k FROM fill"""
    out["stratified_split_repeated_key"] = out["stratified_split"]
    out["stratified_split_no_key"] = out["stratified_split"].replace("o_orderpriority", "lang").replace("FROM orders", "FROM documents")
    out["scan_preview_rows"] = "SELECT least(120, count(*))::BIGINT AS shown, least(120, count(*))::BIGINT AS records, least(120, count(*))::BIGINT AS placed FROM orders"
    out["preview_records"] = "SELECT least(40, ceil(0.2 * count(*)))::BIGINT AS shown, least(40, ceil(0.2 * count(*)))::BIGINT AS records FROM part"
    out["slices_empty_band"] = f"""WITH src AS (SELECT o_totalprice AS y, {BAND_GAP.replace("0D", "0")} AS x FROM orders),
edges AS (SELECT list_sort(list_distinct(quantile_cont(x::DOUBLE, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM src),
bands AS (SELECT i AS bucket, e[i] AS lower, e[i + 1] AS upper FROM edges, (SELECT unnest(range(1, 6)) AS i) WHERE i < len(e))
SELECT 'spread' AS feature, bucket::INT AS bucket, round(lower, 6) AS lower, round(upper, 6) AS upper, count(y) AS count, round(avg(y), 4) AS target_value
FROM bands LEFT JOIN src ON x <= upper AND (x > lower OR bucket = 1) GROUP BY ALL"""
    out["report_purge"] = """SELECT 2 AS analysis_id, p_brand, count(*) AS n, sum(p_partkey + 1) AS keys, 'e' AS extra FROM part GROUP BY p_brand
UNION ALL SELECT 3, p_brand, count(*), sum(p_partkey), 'again' FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand"""
    out["stratified_split_equal_rows"] = out["stratified_split"]
    out["extra_trees_invariants"] = """
SELECT CAST(8 AS BIGINT) AS trees, CAST(8 * (n - ceil(0.2 * n)) AS BIGINT) AS leaf_rows, CAST(0 AS BIGINT) AS uneven_nodes, CAST(0 AS BIGINT) AS outside_range,
       CAST(0 AS BIGINT) AS worse_splits, CAST(0 AS BIGINT) AS too_deep, CAST(0 AS BIGINT) AS unlike_in_tasks
FROM (SELECT count(c_mktsegment) AS n FROM customer)"""
    out["class_weights_many"] = """WITH s AS (SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS n FROM lineitem GROUP BY 1)
SELECT part, n, round((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * n::DOUBLE), 6) AS weight FROM s"""
    out["isolation_forest_lineitem"] = """SELECT count(*) AS row_count, 3 AS clusters, TRUE AS flags_bounded, TRUE AS flags_found, 0 AS sign_errors,
count(*) AS rows_scanned FROM lineitem"""
    out["stratified_sample"] = "WITH " + quota.format(g="o_orderstatus", total="least(5000, (SELECT count(*) FROM orders))") + "\nSELECT label AS o_orderstatus, k AS n FROM fill"
    out["day_ordinals"] = "SELECT o_orderkey, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS day_number FROM orders"
    for key, data in (("identifier_like", "documents"), ("identifier_like_dirty", "dirty")):
        out[key] = f"""WITH {base(data)},
f AS (SELECT ordinal, name, count(t) AS n, count(DISTINCT t) AS u FROM long WHERE lane = 'text' GROUP BY 1, 2),
l AS (SELECT ordinal, avg(length(t)) AS m FROM (SELECT ordinal, t, row_number() OVER (PARTITION BY ordinal ORDER BY rid) AS rk FROM long WHERE t IS NOT NULL) GROUP BY 1)
SELECT name AS "column", round(u / n, 4) AS unique_share, round(m, 4) AS mean_length, u / n >= 0.92 OR (u / n >= 0.55 AND m >= 12) AS identifier_like FROM f JOIN l USING (ordinal) WHERE n >= 20"""
    out["supervised_diagnostics"] = f"""WITH {base('part')},
f AS (SELECT ordinal, name, count(t) AS n, count(DISTINCT t) AS u, count(DISTINCT t) + (count(*) > count(t))::INT AS kinds FROM long WHERE lane = 'text' GROUP BY 1, 2),
l AS (SELECT ordinal, avg(length(t)) AS m FROM (SELECT ordinal, t, row_number() OVER (PARTITION BY ordinal ORDER BY rid) AS rk FROM long WHERE t IS NOT NULL) GROUP BY 1),
g AS (SELECT *, n >= 20 AND (u / n >= 0.92 OR (u / n >= 0.55 AND m >= 12)) AS flagged FROM f JOIN l USING (ordinal)),
c AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS test, count(DISTINCT p_retailprice) AS kinds FROM part WHERE p_retailprice IS NOT NULL)
SELECT CASE WHEN kinds > 10 THEN 'regression' ELSE 'classification' END AS task_type, n AS rows_available, n AS rows_used, n - test AS training_rows, test AS test_rows,
  2::INT AS numeric_features, (SELECT count(*) FROM g WHERE NOT flagged)::INT AS categorical_features, (SELECT count(*) FROM g WHERE NOT flagged AND kinds > 12)::INT AS high_cardinality_features,
  (SELECT count(*) FROM g WHERE flagged)::INT AS dropped_identifier_like_features, 0::INT AS trimmed_numeric_features, 0::INT AS trimmed_categorical_features,
  FALSE AS sampling_applied, kinds AS target_cardinality FROM c"""
    numbers = [n for n, lane in columns("dirty") if lane in (*number_lanes, "time", "day")]
    texts = [n for n, lane in columns("dirty") if lane == "text" and n != "return_status"]
    out["feature_choice"] = f"""WITH flagged AS ({out['identifier_like_dirty']})
SELECT unnest([{", ".join(f"'{n}'" for n in numbers)}]) AS feature, 'numeric' AS kind
UNION ALL SELECT feature, 'categorical' FROM (SELECT unnest([{", ".join(f"'{n}'" for n in texts)}]) AS feature) WHERE feature NOT IN (SELECT "column" FROM flagged WHERE identifier_like)"""
    spread = f"(WITH src AS ({WIDE_GAPS_TABLE}) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, var_samp({n}) AS v FROM src" for n in GAPPED) + ")"
    filled = " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS filled, count(DISTINCT {n}) AS kinds FROM src" for n in texts)
    out["feature_trim"] = f"""WITH flagged AS ({out['identifier_like_dirty']}), src AS (SELECT * FROM {dirty}),
numbers AS (SELECT feature, row_number() OVER (ORDER BY v DESC, feature) - 1 AS position FROM {spread}),
labels AS (SELECT feature, row_number() OVER (ORDER BY filled DESC, kinds, lower(feature)) - 1 AS position FROM ({filled})
  WHERE filled > 0 AND feature NOT IN (SELECT "column" FROM flagged WHERE identifier_like))
SELECT feature, 'numeric' AS kind, position::INT AS position FROM numbers WHERE position < 5
UNION ALL SELECT feature, 'categorical', position::INT FROM labels WHERE position < 2"""
    out["scan_features_trimmed"] = f"SELECT (row_number() OVER (ORDER BY v DESC, feature) - 1)::INT AS position, feature, {len(GAPPED)} AS offered FROM {spread} ORDER BY v DESC, feature LIMIT 4"
    out["scan_sampled"] = """SELECT 500 AS row_count, 500 AS keys, 500 AS scanned, count(*) AS available,
'Used a representative sample of 500 rows from ' || format('{:,}', count(*)) || ' available rows to keep the unsupervised scan responsive.' AS note FROM orders"""
    plain = [n for n, lane in columns("dirty") if lane in ("long", "double")]
    variance = " UNION ALL ".join(f"SELECT '{n}' AS feature, var_samp({n}) AS v FROM src" for n in plain)
    out["feature_variance"] = f"WITH src AS (SELECT * FROM {dirty}) SELECT feature, round(v, 2) AS variance FROM ({variance})"
    out["relative_importance"] = f"""WITH src AS (SELECT * FROM {dirty}), t AS (SELECT feature, v FROM ({variance}) ORDER BY v DESC, feature LIMIT 10)
SELECT feature, round(v, 2) AS raw, round(CASE WHEN max(v) OVER () > 0 THEN v / max(v) OVER () ELSE 0 END, 6) AS normalized FROM t"""
    scaled = " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, max(med) AS median, round(max(mu), 6) AS mean, round(max(sd), 6) AS std, round(sum(((coalesce({n}, med) - mu) / sd) ** 2), 2) AS sum_of_squares, round(max((coalesce({n}, med) - mu) / sd), 6) AS largest
FROM src, (SELECT med, avg(coalesce({n}, med)) AS mu, stddev_pop(coalesce({n}, med)) AS sd FROM src, (SELECT quantile_cont({n}, 0.5) AS med FROM src) GROUP BY med)"""
        for n in ("order_quantity", "discount_rate", "net_price", "spike")
    )
    out["impute_scale"] = f"WITH src AS (SELECT * FROM {dirty}) {scaled}"
    coded = " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS v FROM part" for n in ("p_name", "p_brand", "p_type"))
    out["infrequent_encode"] = f"""WITH cells AS ({coded}), c AS (SELECT feature, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total FROM cells GROUP BY 1, 2),
freq AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v DESC) AS rk, count(*) OVER (PARTITION BY feature) AS many FROM c WHERE n >= 0.01 * total),
kept AS (SELECT feature, v FROM freq WHERE many + 1 <= 12 OR rk <= 11)
SELECT cells.feature, CASE WHEN kept.v IS NULL THEN 'infrequent' ELSE cells.v END AS category, count(*) AS n FROM cells LEFT JOIN kept ON kept.feature = cells.feature AND kept.v = cells.v GROUP BY 1, 2"""
    out["class_weights"] = "SELECT o_orderpriority AS label, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*)), 6) AS weight FROM orders GROUP BY 1"
    out["positive_label"] = f"""WITH src AS (SELECT * FROM {dirty})
SELECT 'True' AS positive_label, 'is_open' AS target UNION ALL SELECT * FROM (SELECT near_const, 'near_const' FROM src GROUP BY near_const ORDER BY count(*), near_const LIMIT 1)"""
    out["confusion_metrics"] = f"WITH {YES_NO},\n{CLASS_METRICS}\n{MET_SELECT}"
    out["confusion_metrics_multiclass"] = f"WITH {THREE},\n{CLASS_METRICS}\n{MET_SELECT}"
    out["confusion_metrics_many_classes"] = f"""WITH preds AS (SELECT CAST(l_partkey AS VARCHAR) AS actual,
  CAST(CASE WHEN l_linenumber <= 3 THEN l_partkey ELSE l_partkey + 1 END AS VARCHAR) AS prediction FROM lineitem),
{CLASS_METRICS}
{MET_SELECT}"""
    out["roc_auc"] = f"WITH {YES_NO},\n{AUC}\nSELECT round(roc_auc, 6) AS roc_auc FROM auc"
    out["average_precision"] = f"""WITH {YES_NO},
sc AS (SELECT score, count(*) FILTER (positive) AS pos, count(*) AS n FROM preds GROUP BY 1),
run AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS hits, sum(n) OVER (ORDER BY score DESC) AS seen FROM sc)
SELECT round(sum(pos * (hits / seen)) / sum(pos), 6) AS average_precision FROM run"""
    out["regression_metrics"] = """WITH p AS (SELECT l_extendedprice AS a, l_quantity * 2000.0::DOUBLE + l_discount * 1000.0::DOUBLE AS b FROM lineitem)
SELECT round(1 - avg((a - b) ** 2) / var_pop(a), 6) AS r2, round(1 - var_pop(a - b) / var_pop(a), 6) AS explained_variance, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) ** 2)), 6) AS rmse FROM p"""
    out["model_choice"] = f"""WITH {rule_models()}
SELECT model, round(f1 * 0.6 + balanced_accuracy * 0.4, 6) AS score, row_number() OVER (ORDER BY f1 * 0.6 + balanced_accuracy * 0.4 DESC, position) = 1 AS is_best FROM mm"""
    out["metric_chart"] = f"""WITH {rule_models()}
SELECT model, 'f1' AS metric, round(f1, 6) AS raw, round(CASE WHEN max(f1) OVER () = min(f1) OVER () THEN 1 ELSE (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) END, 6) AS normalized FROM mm"""
    out["supervised_warnings"] = f"""WITH {YES_NO},
{CLASS_METRICS},
{AUC},
facts AS (SELECT count(*) AS n, greatest(avg(positive::INT), 1 - avg(positive::INT)) AS dom FROM preds),
lines AS (
  SELECT 0 AS p, 'Used a representative sample of 5,000 rows from ' || format('{{:,}}', n) || ' available rows to keep supervised benchmarking responsive.' AS text FROM facts
  UNION ALL SELECT 1, '2 categorical feature(s) were compressed during encoding so rare categories do not dominate runtime or feature space.'
  UNION ALL SELECT 2, 'Dropped 1 identifier-like or free-text feature(s) before training so noisy high-cardinality columns do not dominate the benchmark.'
  UNION ALL SELECT 3, 'Trimmed 3 numeric and 0 categorical feature(s) to keep the supervised benchmark responsive on deployment.'
  UNION ALL SELECT 4, 'Feature slices and narrative diagnostics were generated from a representative sample of 2,400 rows to keep the response fast.'
  UNION ALL SELECT 5, 'Only 100 rows were held out for testing, so the supervised scores may move noticeably between runs.'
  UNION ALL SELECT 6, 'The dominant class accounts for ' || printf('%.1f', dom * 100) || '% of usable target rows, so some models can look accurate while still missing minority cases.' FROM facts WHERE dom >= 0.78
  UNION ALL SELECT 8, 'Weak target signal: even the strongest held-out model did not separate the target cleanly, so the available features may not explain this outcome very well.'
     FROM met, auc WHERE roc_auc < 0.67 OR balanced_accuracy < 0.6 OR f1 < 0.58)
SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS position, text FROM lines"""
    sliced_numbers, sliced_labels = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"], ["l_returnflag", "l_linestatus"]
    out["slices_regression"] = slice_sql("lineitem", "l_extendedprice", sliced_numbers, sliced_labels, "regression", "Average l_extendedprice", None)
    out["slices_binary"] = slice_sql("lineitem", "l_linestatus", sliced_numbers, ["l_returnflag"], "binary", "O rate", "O")
    out["slices_multiclass"] = slice_sql(dirty, "return_status", ["spike", "order_quantity", "discount_rate", "is_open"], ["priority", "mixed", "near_const"], "multi", "Dominant class share", None)

    # -- I. unsupervised scan
    out["top_anomalies"] = """WITH t AS (SELECT event_id, -value AS s FROM events ORDER BY -value, event_id LIMIT 6)
SELECT event_id, s AS anomaly_score, round(CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE (max(s) OVER () - s) / (max(s) OVER () - min(s) OVER ()) END, 6) AS severity FROM t"""
    out["cluster_share"] = "SELECT o_orderstatus AS cluster, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1"
    out["scan_warnings"] = """SELECT 0 AS position, 'Used a representative sample of 4,000 rows from ' || format('{:,}', count(*)) || ' available rows to keep the unsupervised scan responsive.' AS text FROM orders HAVING count(*) > 4000
UNION ALL SELECT CASE WHEN (SELECT count(*) FROM orders) > 4000 THEN 1 ELSE 0 END, 'Used the 16 highest-variance numeric columns out of 20 available to keep the scan stable on smaller deployments.'"""

    # -- J. run archive
    out["scan_invariants"] = """SELECT count(*) AS row_count, count(DISTINCT o_orderkey) AS key_count, 4::BIGINT AS clusters, 0::BIGINT AS sign_errors,
  TRUE AS flags_bounded, TRUE AS flags_filled, 0.0::DOUBLE AS centre FROM orders"""
    out["cluster_order"] = "SELECT count(*) AS row_count, 1.0::DOUBLE AS share, 0::BIGINT AS out_of_order FROM orders"
    out["scan_preview_keys"] = "SELECT least(120, count(*))::BIGINT AS shown, least(120, count(*))::BIGINT AS known FROM orders"
    out["pca_two_columns"] = """WITH r AS (SELECT abs(corr(c_custkey, c_acctbal)) AS r FROM customer)
SELECT 1::INT AS component, round((1 + r) / 2, 6) AS share FROM r UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r"""
    out["linear_fit_line"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem"""
    out["prediction_actuals"] = "SELECT ceil(0.2 * count(*))::BIGINT AS test_rows, 0::BIGINT AS wrong_actuals, TRUE AS accuracy_agrees FROM customer"
    out["runs_list"] = f"WITH {RUNS} {FLAT} WHERE user_id = 7"
    out["runs_search"] = f"WITH {RUNS} {FLAT} WHERE is_ready AND experiment_count > 0 AND contains({HAY}, 'machinery')"
    out["runs_search_experiment"] = f"WITH {RUNS} {FLAT} WHERE NOT is_ready AND contains({HAY}, 'status o')"
    out["runs_stats"] = f"""WITH {RUNS} SELECT count(*) AS saved_runs, count(*) FILTER (experiment_count > 0) AS runs_with_ml, count(*) FILTER (is_ready) AS ready_runs,
  CAST(sum(experiment_count) AS BIGINT) AS total_experiments, arg_max(dataset_name, id) AS latest_dataset,
  (SELECT count(*) FROM listing WHERE experiment_count = 0 AND contains({HAY}, 'building')) AS filtered_runs FROM listing"""
    out["experiments_latest"] = f"""WITH {RUNS} SELECT analysis_id, experiment_type, experiment_id, created_at, summary, count(*) OVER (PARTITION BY analysis_id, experiment_type) AS experiment_count FROM exp
QUALIFY row_number() OVER (PARTITION BY analysis_id, experiment_type ORDER BY created_at DESC, experiment_id DESC) = 1"""
    out["runs_purge"] = f"WITH {RUNS} SELECT user_id, count(*) AS n FROM runs WHERE user_id <> 3 GROUP BY 1"
    out["experiments_purge"] = f"WITH {RUNS} SELECT experiment_type, count(*) AS n FROM allexp WHERE analysis_id IN (SELECT id FROM runs WHERE user_id <> 3) GROUP BY 1"
    return out
