"""The SQL each query is compared with, written for the same parquet tables.

Formulas differ from the Spark side on purpose where they can: ranks by window
instead of hash cutoffs, AUC by rank sums, sweeps by one filter per threshold.
"""

from __future__ import annotations

from faultline import fixtures, schema as S

RAW = fixtures.as_sql(fixtures.SENSOR_RAW, "lineitem")
WIDE = fixtures.as_sql(fixtures.SENSOR_WIDE, "lineitem")
_KEY = [("row_key", fixtures.LINE_KEY)]
RAW_KEYED = fixtures.as_sql(_KEY + fixtures.SENSOR_RAW, "lineitem")
WIDE_KEYED = fixtures.as_sql(_KEY + fixtures.SENSOR_WIDE, "lineitem")
PREDICTIONS = fixtures.as_sql(fixtures.PREDICTIONS, "events")

SENSORS = [n for n, _ in fixtures.SENSOR_RAW if n != "class"]
WIDE_SENSORS = [n for n, _ in fixtures.SENSOR_WIDE if n != "class"]
MODEL_FEATURES = [f.lower() for f in S.TOP_FEATURES]
CONSTANT = ["cd_000", "cr_000"]
THIN = ["ab_000", "bm_000", "bn_000", "bo_000", "bp_000", "bq_000", "br_000"]
P = "failure_probability"

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{_NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _strict(c: str) -> str:
    return f"CAST(TRY_CAST(NULLIF(trim({c}), 'na') AS DECIMAL(38,0)) AS BIGINT)"


def _list(columns, form="{c}") -> str:
    return ", ".join(form.format(c=c) for c in columns)


def _typed(raw: str, sensors, lead: str = "class") -> str:
    return f"SELECT {lead}, " + ", ".join(f"{_num(c)} AS {c}" for c in sensors) + f" FROM ({raw}) r"


TYPED = _typed(RAW, SENSORS)
TYPED_KEYED = _typed(RAW_KEYED, SENSORS, "row_key, class")
TYPED_WIDE = _typed(WIDE, WIDE_SENSORS)
TYPED_WIDE_KEYED = _typed(WIDE_KEYED, WIDE_SENSORS, "row_key, class")
LABEL = "CASE class WHEN 'neg' THEN 0 WHEN 'pos' THEN 1 END"

_TOKENS = ", ".join(f"'{t}'" for t in S.INGEST_NA_TOKENS)


def _profile(typed: str, columns) -> str:
    """Long form: name, rows, non-null count, distinct values."""
    parts = [
        f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS different FROM t" for i, c in enumerate(columns, start=1)
    ]
    return f"WITH t AS ({typed}), p AS (" + " UNION ALL ".join(parts) + ")"


def _median_filled(typed: str, columns, lead: str) -> str:
    medians = ", ".join(f"median({c}) AS {c}" for c in columns)
    filled = ", ".join(f"round(coalesce(t.{c}, m.{c}), 6) AS {c}" for c in columns)
    return f"WITH t AS ({typed}), m AS (SELECT {medians} FROM t) SELECT {lead}, {filled} FROM t CROSS JOIN m"


def _hash(seed: int = S.SEED, key: str = "row_key") -> str:
    return f"md5('{seed}' || {key})"


def _stratified(rows: str) -> str:
    """CTEs ending in ``s``: the rows with a split of train or test, class shares kept."""
    return f"""
    r AS ({rows}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_hash()}) AS rn FROM r),
    c AS (SELECT class, count(*) AS n FROM r GROUP BY class),
    q0 AS (SELECT class, n, sum(n) OVER () AS total FROM c),
    q1 AS (SELECT class, total - ceil(total * 0.2 - 1e-9) AS train,
                  (total - ceil(total * 0.2 - 1e-9)) * n / total AS exact FROM q0),
    q2 AS (SELECT class, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, class)
                  <= train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM q1),
    s AS (SELECT ranked.*, CASE WHEN rn <= quota THEN 'train' ELSE 'test' END AS split
          FROM ranked JOIN q2 ON ranked.class = q2.class)"""


_MEAN = f"CAST(round(avg({P}), 4) AS DOUBLE)"


def _sum(test: str) -> str:
    return f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"


def _share(part: str, whole: str = "count(*)", digits: int = 2) -> str:
    return f"round(CAST({part} AS DOUBLE) * 100.0 / NULLIF({whole}, 0), {digits})"


_PRIORITY = f"CASE WHEN {P} >= 0.95 THEN 'CRITICAL' WHEN {P} >= 0.80 THEN 'URGENT' WHEN {P} >= 0.50 THEN 'MONITOR' ELSE 'NORMAL' END"
_RISK = f"CASE WHEN {P} >= 0.70 THEN 'HIGH' WHEN {P} >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END"
_SHOWN = f"prediction_id, prediction_label, {P}, risk_level"
WITH_PRIORITY = f"SELECT {_SHOWN}, {_PRIORITY} AS maintenance_priority, created_at FROM ({PREDICTIONS}) p"
WITH_ACTION = f"""SELECT {_SHOWN}, maintenance_priority, CASE maintenance_priority
    WHEN 'CRITICAL' THEN 'Immediate inspection and preventive maintenance'
    WHEN 'URGENT' THEN 'Schedule maintenance as soon as possible'
    WHEN 'MONITOR' THEN 'Increase monitoring frequency'
    ELSE 'Continue normal operation and routine monitoring' END AS recommended_action, created_at
    FROM ({WITH_PRIORITY}) q"""
HIGH = f"SELECT {_SHOWN}, created_at FROM ({PREDICTIONS}) p WHERE risk_level = 'HIGH'"
DASHBOARD = f"""SELECT count(*) AS total_predictions,
    {_sum("prediction_label = 'FAILURE'")} AS predicted_failures,
    {_sum("prediction_label = 'NO_FAILURE'")} AS predicted_non_failures,
    {_MEAN} AS avg_failure_probability,
    {_sum("maintenance_priority = 'CRITICAL'")} AS critical_count,
    {_sum("maintenance_priority = 'URGENT'")} AS urgent_count,
    {_sum("maintenance_priority = 'MONITOR'")} AS monitor_count,
    {_sum("maintenance_priority = 'NORMAL'")} AS normal_count,
    {_share(_sum("maintenance_priority IN ('CRITICAL', 'URGENT')"))} AS action_required_percentage
    FROM ({WITH_ACTION}) a"""

COUNTS = f"""SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM ({PREDICTIONS}) p"""
_NAMED = "tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives"


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0)"


_PREC, _REC, _F1 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
_ACC = _div("tp + tn", "tp + tn + fp + fn")

TWO_MODELS = f"""SELECT label, 'baseline' AS model, {P} AS score FROM ({PREDICTIONS}) p UNION ALL
    SELECT label, 'challenger', CASE WHEN label = 1 THEN 1 - (1 - {P}) / 2 ELSE {P} END FROM ({PREDICTIONS}) p"""


def _metrics(rows: str) -> str:
    """CTEs ending in ``mm``: counts, AUC by rank sums and average precision per model."""
    return f"""
    x AS ({rows}),
    rk AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
                  + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM x),
    auc AS (SELECT model, (CAST(sum(r) FILTER (WHERE label = 1) AS DOUBLE)
                  - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS roc_auc
            FROM rk GROUP BY model),
    g AS (SELECT model, score, sum(label) AS pos, count(*) AS n FROM x GROUP BY model, score),
    cum AS (SELECT model, pos, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS up,
                   sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS upn FROM g),
    ap AS (SELECT model, sum(CAST(pos AS DOUBLE) * up / upn) / sum(pos) AS average_precision FROM cum GROUP BY model),
    k AS (SELECT model, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
                 count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
                 count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
                 count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM x GROUP BY model),
    mm AS (SELECT k.model, tn + fp + fn + tp AS test_rows, tn, fp, fn, tp, {_ACC} AS accuracy, {_PREC} AS "precision",
                  {_REC} AS recall, {_F1} AS f1, roc_auc, average_precision
           FROM k JOIN auc ON k.model = auc.model JOIN ap ON k.model = ap.model)"""


_SIX = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")
_ROUNDED = ", ".join(f'round("{m}", 9) AS "{m}"' for m in _SIX)
ONE_MODEL = f"SELECT label, 'only' AS model, {P} AS score FROM ({PREDICTIONS}) p"

SWEEP = f"""SELECT h / 100.0 AS threshold, round({_PREC}, 4) AS "precision", round({_REC}, 4) AS recall,
    round({_F1}, 4) AS f1, fp AS false_positives, fn AS false_negatives, tp AS true_positives, tn AS true_negatives
    FROM (SELECT h, count(*) FILTER (WHERE label = 0 AND {P} < h / 100.0) AS tn,
                 count(*) FILTER (WHERE label = 0 AND {P} >= h / 100.0) AS fp,
                 count(*) FILTER (WHERE label = 1 AND {P} < h / 100.0) AS fn,
                 count(*) FILTER (WHERE label = 1 AND {P} >= h / 100.0) AS tp
          FROM ({PREDICTIONS}) p CROSS JOIN (SELECT unnest(range(10, 91, 5)) AS h) t GROUP BY h) c"""

_PHI = {
    "aa_000": "(l_quantity - 25) / 50", "ci_000": "l_discount * -10",
    "ck_000": "l_tax * 5", "bj_000": "(l_linenumber - 4) / 8.0",
}
IMPORTANCE = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(abs({e})) AS v FROM lineitem" for f, e in _PHI.items())
_RANKED = f"SELECT feature, v, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM ({IMPORTANCE}) i"
TOP_LINE = f"""SELECT {fixtures.LINE_KEY} AS row_key, * FROM lineitem
    ORDER BY l_extendedprice DESC, {fixtures.LINE_KEY} LIMIT 1"""
_VALUES = {"aa_000": "l_quantity", "ci_000": "l_discount", "ck_000": "l_tax", "bj_000": "l_linenumber"}
EXPLAINED = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({_VALUES[f]} AS DOUBLE) AS feature_value, CAST({e} AS DOUBLE) AS phi, "
    f"l_extendedprice / 110000.0 AS p FROM top" for f, e in _PHI.items())

_ZERO_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in MODEL_FEATURES)
COMPLETE = f"SELECT row_key, class, {LABEL} AS label, {_ZERO_FILLED} FROM ({TYPED_WIDE_KEYED}) t"
ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS class, o_totalprice FROM orders"
_RANKED_ORDERS = f"SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_hash()}) AS rn FROM ({ORDERS}) o"

_KEPT = [c for c in SENSORS if c not in (*CONSTANT, *THIN)]
_WIDE_KEPT = [c for c in WIDE_SENSORS if c not in (*CONSTANT, *THIN)]


def _preprocessed(typed: str, columns, lead: str) -> str:
    return _median_filled(typed, columns, lead)


_TOP = [f.lower() for f in S.TOP_FEATURES]
_EXCLUDED = [f.lower() for f in S.EXCLUDED_FEATURES]
_FINAL = [c for c in WIDE_SENSORS if c not in _EXCLUDED]
FINAL = "SELECT row_key, class, " + ", ".join(f"coalesce({_strict(c)}, 0) AS {c}" for c in _FINAL) + f" FROM ({WIDE_KEYED}) r"


def _balanced(rows: str) -> str:
    return f"""SELECT * FROM r WHERE class = 'pos' UNION ALL
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY {_hash()}) AS rn FROM r WHERE class = 'neg') n
    WHERE rn <= {S.BALANCE_NEGATIVES}"""


def _unions(rows) -> str:
    return " UNION ALL ".join(rows)


def _report() -> str:
    rows = []
    names = {"Normal": ("tn", "fn", "fp"), "Failure": ("tp", "fp", "fn")}
    for name, (hit, over, under) in names.items():
        values = {
            "precision": _div(hit, f"{hit} + {over}"), "recall": _div(hit, f"{hit} + {under}"),
            "f1-score": _div(f"2 * {hit}", f"2 * {hit} + {over} + {under}"), "support": f"{hit} + {under}",
        }
        names[name] = values
        rows += [(name, m, v) for m, v in values.items()]
    rows.append(("accuracy", "accuracy", _ACC))
    a, b = names["Normal"], names["Failure"]
    for m in ("precision", "recall", "f1-score"):
        rows.append(("macro avg", m, f"({a[m]} + {b[m]}) / 2"))
        rows.append(("weighted avg", m, f"({a[m]} * (tn + fp) + {b[m]} * (tp + fn)) / (tn + fp + fn + tp)"))
    rows += [(n, "support", "tn + fp + fn + tp") for n in ("macro avg", "weighted avg")]
    body = _unions(
        f"SELECT '{c}' AS class, '{m}' AS metric, round(CAST({v} AS DOUBLE), 9) AS value FROM k" for c, m, v in rows)
    return f"WITH k AS ({COUNTS}) {body}"


def _summary(rows: list[tuple[str, str, str]]) -> str:
    return _unions(
        f"SELECT '{m}' AS metric, {k} AS key, CAST({v} AS DOUBLE) AS value FROM t" for m, k, v in rows)


def _missing(columns) -> str:
    return " + ".join(f"count(*) - count({c})" for c in columns)


_CLASS_ROWS = "SELECT 'class_count' AS metric, {k} AS key, CAST(count(*) AS DOUBLE) AS value FROM t GROUP BY class"
_PLACE = "row_number() OVER (ORDER BY CASE risk_level WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 END)"
_PARTS = """(SELECT CAST(total - ceil(total * 0.2 - 1e-9) AS BIGINT) AS train, CAST(ceil(total * 0.2 - 1e-9) AS BIGINT) AS test, total
    FROM (SELECT count(*) AS total FROM lineitem) n)"""
_LOGREG = f"""SELECT train AS train_rows, test AS test_rows, total AS equal_scores, total AS equal_classes, TRUE AS at_minimum
    FROM {_PARTS} n"""
_BOOSTED = """SELECT count(*) AS row_count, count(*) AS equal_scores, CAST(300 AS BIGINT) AS trees, TRUE AS depth_kept
    FROM lineitem"""
_EPISODES = """e AS (SELECT user_id AS unit, ts, event_type = 'error' AS failed FROM events),
        s AS (SELECT unit, min(ts) AS first FROM e GROUP BY unit),
        f AS (SELECT DISTINCT unit, ts FROM e WHERE failed),
        x AS (SELECT f.unit, coalesce(lag(ts) OVER (PARTITION BY f.unit ORDER BY ts), s.first) AS a, ts AS b, TRUE AS failed FROM f JOIN s ON s.unit = f.unit
            UNION ALL SELECT s.unit, coalesce(m, s.first), TIMESTAMP '2024-02-01', FALSE
            FROM s LEFT JOIN (SELECT unit, max(ts) AS m FROM f GROUP BY unit) l ON l.unit = s.unit),
        r AS (SELECT unit, unit % 3 AS fleet, CAST(floor(CAST(epoch_us(b) - epoch_us(a) AS DOUBLE) / 3600000000) AS BIGINT) AS duration, failed FROM x),
        c AS (SELECT fleet, duration, count(*) FILTER (failed) AS failures, count(*) FILTER (NOT failed) AS censored FROM r GROUP BY ALL),
        n AS (SELECT *, CAST(sum(failures + censored) OVER (PARTITION BY fleet ORDER BY duration DESC) AS BIGINT) AS at_risk FROM c),
        curve AS (SELECT *, CAST(failures AS DOUBLE) / at_risk AS hazard, product(1 - CAST(failures AS DOUBLE) / at_risk) OVER (
            PARTITION BY fleet ORDER BY duration) AS survival FROM n)"""
ORACLES: dict[str, str] = {
    "recommended_actions": """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS machine, 'repair' AS action, CAST(1 + user_id % 7 AS DOUBLE) AS cost,
            round(sum(value), 2) AS benefit FROM events GROUP BY user_id),
        r AS (SELECT *, sum(cost) OVER (ORDER BY benefit / cost DESC ROWS UNBOUNDED PRECEDING) AS running FROM o)
        SELECT machine, action, round(cost, 6) AS cost, round(benefit, 6) AS benefit FROM r WHERE running <= 200""",
    "survival_curves": f"""WITH {_EPISODES} SELECT fleet, duration, at_risk, failures, censored, round(hazard, 9) AS hazard,
        round(survival, 9) AS survival FROM curve""",
    "remaining_life": f"""WITH {_EPISODES},
        u AS (SELECT unit, fleet, duration AS age FROM r WHERE NOT failed),
        reached AS (SELECT unit, u.fleet, age, coalesce(arg_max(survival, duration) FILTER (duration < age), 1.0) AS s,
            arg_max(survival, duration) AS last FROM u JOIN curve USING (fleet) GROUP BY ALL)
        SELECT q.unit, q.fleet, q.age, CASE WHEN s > 0 THEN round(last / s, 9) END AS survival_share,
            CASE WHEN s > 0 THEN min(duration) FILTER (duration >= age AND survival <= s * 0.5 + 1e-12) - age END AS median_left
        FROM reached q JOIN curve USING (fleet) GROUP BY q.unit, q.fleet, q.age, s, last""",
    # Sources and sinks
    "src_preamble_csv": TYPED_KEYED,
    "src_skip_rows_csv": TYPED_KEYED,
    "src_na_tokens": "SELECT row_key, class, " + _list(
        SENSORS, f"CASE WHEN trim({{c}}) IN ({_TOKENS}) THEN NULL ELSE {{c}} END AS {{c}}") + f" FROM ({RAW_KEYED}) r",
    "src_chunk_scan": _profile(TYPED, ["class", *SENSORS]) + " SELECT column_name, row_count, non_null FROM p",
    "src_single_column": f"SELECT class, count(*) AS class_count FROM ({RAW}) r GROUP BY class",
    "src_table": "SELECT * FROM events",
    "src_table_features": "SELECT " + ", ".join(f"{c} AS {c.upper()}" for c in _TOP) + f", class AS CLASS FROM ({FINAL}) f",
    "ctas_stage": RAW_KEYED,
    "sink_processed": _preprocessed(TYPED_KEYED, _KEPT, f"row_key, {LABEL} AS class"),
    "sink_result_tables": f"""WITH top AS ({TOP_LINE}), e AS ({EXPLAINED})
        SELECT 'threshold_analysis' AS table_name, printf('%.2f', threshold) AS name, round(f1, 9) AS value FROM ({SWEEP}) w UNION ALL
        SELECT 'feature_importance', feature, round(v, 9) FROM ({_RANKED}) k UNION ALL
        SELECT 'individual_explanation', feature, round(phi, 9) FROM e UNION ALL
        SELECT 'predictions', risk_level, CAST(count(*) AS DOUBLE) FROM ({PREDICTIONS}) p GROUP BY risk_level""",
    "sink_predictions_append": f"""SELECT CASE WHEN label = 0 THEN 'first' ELSE 'second' END AS batch_id, risk_level,
        count(*) AS row_count, round(avg({P}), 6) AS mean_probability, count(*) AS row_keys FROM ({PREDICTIONS}) p GROUP BY 1, 2""",
    "stored_ids": f"""WITH p AS (SELECT label, count(*) AS n FROM ({PREDICTIONS}) p GROUP BY label)
        SELECT 'first' AS batch_id, CAST(1 AS BIGINT) AS first_id, n AS last_id, n AS distinct_ids FROM p WHERE label = 0 UNION ALL
        SELECT 'second', 1 + (SELECT n FROM p WHERE label = 0), n + (SELECT n FROM p WHERE label = 0), n FROM p WHERE label = 1""",
    "sql_views": DASHBOARD,
    "sql_view_risks": f"""SELECT risk_level, count(*) AS prediction_count,
        round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
        FROM ({PREDICTIONS}) p GROUP BY risk_level""",
    "dense_prediction_id": """SELECT count(*) AS row_count, count(*) AS distinct_ids, CAST(1 AS BIGINT) AS first_id,
        count(*) AS last_id FROM events""",
    "verify_predictions": f"""WITH p AS ({PREDICTIONS})
        SELECT 'total_rows' AS part, 'all' AS key, count(*) AS value FROM p UNION ALL
        SELECT 'risk_counts', risk_level, count(*) FROM p GROUP BY risk_level UNION ALL
        SELECT 'latest', CAST((SELECT count(*) FROM p) - i AS VARCHAR), 1 FROM range(0, 10) t(i)""",
    # Projections, filters and cleaning
    "trim_column_names": RAW_KEYED,
    "upper_column_names": "SELECT " + ", ".join(f'{c} AS "{c.upper()}"' for c in ["row_key", "class", *SENSORS]) + f" FROM ({RAW_KEYED}) r",
    "to_numeric": TYPED_WIDE_KEYED,
    "clean_numeric_strict": "SELECT row_key, class, " + ", ".join(f"{_strict(c)} AS {c}" for c in SENSORS) + f" FROM ({RAW_KEYED}) r",
    "exclude_columns": f"SELECT * EXCLUDE ({', '.join(_EXCLUDED)}) FROM ({WIDE_KEYED}) r",
    "select_top_features": f"SELECT row_key, class, {', '.join(_TOP)} FROM ({WIDE_KEYED}) r",
    "zero_impute": "SELECT row_key, class, " + _list(SENSORS, "coalesce({c}, 0) AS {c}") + f" FROM ({TYPED_KEYED}) t",
    "zero_impute_count": f"SELECT CAST({_missing(SENSORS)} AS BIGINT) AS filled_cells FROM ({TYPED}) t",
    "encode_target": f"SELECT row_key, class, {LABEL} AS label FROM ({RAW_KEYED}) r",
    "drop_incomplete_rows": f"SELECT row_key, {', '.join(_TOP)}, {LABEL} AS label FROM ({TYPED_WIDE_KEYED}) t WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in _TOP),
    "split_features_target": f"SELECT row_key, CAST(label AS DOUBLE) AS label, {', '.join(MODEL_FEATURES)} FROM ({COMPLETE}) c",
    "require_features": f"SELECT row_key, class, {', '.join(MODEL_FEATURES)} FROM ({TYPED_WIDE_KEYED}) t",
    "filter_class": f"SELECT * FROM ({RAW_KEYED}) r WHERE class = 'pos'",
    "union_all": f"SELECT * FROM ({RAW_KEYED}) r WHERE class IN ('pos', 'neg')",
    "threshold_label": f"SELECT prediction_id, CASE WHEN {P} >= 0.65 THEN 1 ELSE 0 END AS prediction FROM ({PREDICTIONS}) p",
    "prediction_label": f"SELECT prediction_id, prediction_label FROM ({PREDICTIONS}) p",
    "risk_level": f"SELECT prediction_id, {_RISK} AS risk_level FROM ({PREDICTIONS}) p",
    "high_risk": HIGH,
    "maintenance_priority": WITH_PRIORITY,
    "maintenance_actions": WITH_ACTION,
    "format_percent": f"""SELECT prediction_id, {P}, format('{{:.2f}}%', {P} * 100) AS {P}_text FROM ({PREDICTIONS}) p""",
    "prediction_frame": f"""SELECT prediction_id, prediction,
        CASE prediction WHEN 0 THEN 'NO_FAILURE' WHEN 1 THEN 'FAILURE' END AS prediction_label, {P},
        {_RISK} AS risk_level FROM ({PREDICTIONS}) p""",
    # Data-quality profile
    "profile_structure": f"""SELECT CAST({len(WIDE_SENSORS) + 1} AS BIGINT) AS column_count, count(*) AS row_count,
        '{",".join(["class", *WIDE_SENSORS][:20])}' AS first_columns FROM ({WIDE}) r""",
    "missing_profile": _profile(TYPED_WIDE, ["class", *WIDE_SENSORS]) + """ SELECT column_name,
        row_count - non_null AS missing_count, round((row_count - non_null) * 100.0 / row_count, 6) AS missing_percentage FROM p""",
    "missing_limits": _profile(TYPED_WIDE, ["class", *WIDE_SENSORS]) + """ SELECT
        count(*) FILTER (WHERE (row_count - non_null) * 100.0 / row_count > 50) AS above_50_percent,
        count(*) FILTER (WHERE (row_count - non_null) * 100.0 / row_count > 90) AS above_90_percent FROM p""",
    "top_missing": _profile(TYPED_WIDE, ["class", *WIDE_SENSORS]) + """ SELECT column_name,
        row_count - non_null AS missing_count, round((row_count - non_null) * 100.0 / row_count, 6) AS missing_percentage
        FROM p ORDER BY (row_count - non_null) DESC, ordinal LIMIT 10""",
    "total_missing": f"SELECT CAST({_missing(['class', *SENSORS])} AS BIGINT) AS total_missing FROM ({TYPED}) t",
    "constant_columns_ignore_null": _profile(TYPED, SENSORS) + " SELECT column_name FROM p WHERE different = 1",
    "constant_columns_null_counts": _profile(TYPED, SENSORS) + """ SELECT column_name FROM p
        WHERE different + CASE WHEN non_null < row_count THEN 1 ELSE 0 END <= 1""",
    "drop_constant": f"SELECT * EXCLUDE ({', '.join(CONSTANT)}) FROM ({TYPED_KEYED}) t",
    "high_missing_columns": _profile(TYPED_WIDE, WIDE_SENSORS) + """ SELECT column_name,
        round((row_count - non_null) * 100.0 / row_count, 2) AS missing_percentage FROM p
        WHERE (row_count - non_null) * 2 > row_count""",
    "drop_high_missing": f"SELECT * EXCLUDE (ab_000, cr_000) FROM ({TYPED_KEYED}) t",
    "target_profile": f"""SELECT class, count(*) AS class_count,
        round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 4) AS percentage FROM ({RAW}) r GROUP BY class""",
    "duplicate_rows": f"""WITH x AS ({TYPED_WIDE}), t AS (
            SELECT * FROM x UNION ALL SELECT * FROM x WHERE bj_000 = 1 AND aa_000 < 10
            UNION ALL SELECT * FROM x WHERE bj_000 = 1 AND aa_000 < 2)
        SELECT (SELECT count(*) FROM t) AS rows_analyzed,
               (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t) d) AS duplicate_rows""",
    "dataset_summary": f"WITH t AS ({TYPED}) " + _summary([
        ("rows", "NULL", "count(*)"), ("columns", "NULL", f"max({len(SENSORS) + 1})"),
        ("total_missing", "NULL", _missing(["class", *SENSORS])),
        ("dtype", "'double'", f"max({len(SENSORS)})"), ("dtype", "'string'", "max(1)"),
    ]) + " UNION ALL " + _CLASS_ROWS.format(k="class"),
    "dataset_head": f"SELECT * FROM ({TYPED_KEYED}) t ORDER BY row_key LIMIT 5",
    "preprocess_summary": f"WITH t AS ({TYPED}) " + _summary([
        ("rows", "NULL", "count(*)"), ("columns", "NULL", f"max({len(_KEPT) + 1})"),
        ("features", "NULL", f"max({len(_KEPT)})"), ("total_missing", "NULL", "max(0)"),
    ]) + f""" UNION ALL {_CLASS_ROWS.format(k=f"CAST({LABEL} AS VARCHAR)")} UNION ALL
        SELECT 'class_percent', CAST({LABEL} AS VARCHAR),
        round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 4) FROM t GROUP BY class""",
    "class_balance": f"""WITH {_stratified(RAW_KEYED)}
        SELECT split, {LABEL} AS label, count(*) AS row_count FROM s GROUP BY split, class""",
    "assert_raw": f"""WITH t AS ({TYPED})
        SELECT 'row_count' AS "check", true AS passed, count(*) AS observed FROM t UNION ALL
        SELECT 'column_count', true, CAST(10 AS BIGINT) UNION ALL
        SELECT 'classes', count(DISTINCT class) = 2, count(*) FILTER (WHERE class NOT IN ('neg', 'pos')) FROM t""",
    "assert_processed": f"""WITH t AS ({TYPED})
        SELECT 'no_missing' AS "check", true AS passed, CAST(0 AS BIGINT) AS observed UNION ALL
        SELECT 'target_is_binary', count(DISTINCT class) = 2, count(*) FILTER (WHERE class NOT IN ('neg', 'pos')) FROM t UNION ALL
        SELECT 'row_count', true, count(*) FROM t UNION ALL SELECT 'feature_count', true, {len(_KEPT)}""",
    # Imputation, scaling and the two preparation routes
    "median_impute": _median_filled(TYPED_KEYED, SENSORS, "row_key, class"),
    "standardize": f"""WITH {_stratified(COMPLETE)},
        f AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in MODEL_FEATURES)} FROM s WHERE split = 'train')
        SELECT row_key, split, {", ".join(f"round(({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END, 6) AS {c}"
                                          for c in MODEL_FEATURES)} FROM s CROSS JOIN f""",
    "preprocess_dataset": _preprocessed(TYPED_WIDE_KEYED, _WIDE_KEPT, f"row_key, {LABEL} AS class"),
    "warehouse_features": f"""WITH r AS ({FINAL}), b AS ({_balanced("r")}),
        k AS (SELECT row_key, class, {", ".join(_TOP)}, row_number() OVER (PARTITION BY class ORDER BY {_hash(S.SEED + 1)}) AS rn FROM b)
        SELECT * EXCLUDE (rn), CASE WHEN rn <= {S.TRAIN_ROWS_PER_CLASS} THEN 'train' ELSE 'test' END AS split FROM k""",
    # Sampling and splits
    "balance_classes": f"WITH r AS ({RAW_KEYED}) {_balanced('r')}",
    "train_split_per_class": f"SELECT * EXCLUDE (rn) FROM ({_RANKED_ORDERS}) k WHERE rn <= {S.TRAIN_ROWS_PER_CLASS}",
    "test_split_per_class": f"SELECT * EXCLUDE (rn) FROM ({_RANKED_ORDERS}) k WHERE rn > {S.TRAIN_ROWS_PER_CLASS}",
    "exact_stratified_split": f"WITH {_stratified(RAW_KEYED)} SELECT row_key, class, split FROM s",
    "sample_n": f"SELECT * FROM ({RAW_KEYED}) r ORDER BY {_hash()} LIMIT {S.EXPLAIN_SAMPLE}",
    "row_number_global": f"""SELECT row_key, class FROM (SELECT *, row_number() OVER (ORDER BY {_hash()}) AS rn
        FROM ({RAW_KEYED}) r WHERE class = 'neg') k WHERE rn <= 1000""",
    "row_number_per_class": f"""SELECT * EXCLUDE (rn), CAST(rn AS BIGINT) AS row_number FROM ({_RANKED_ORDERS}) k
        WHERE rn <= {S.TRAIN_ROWS_PER_CLASS}""",
    "qualify": f"""SELECT row_key, class FROM ({RAW_KEYED}) r
        QUALIFY row_number() OVER (PARTITION BY class ORDER BY {_hash()}) > {S.TRAIN_ROWS_PER_CLASS}""",
    # Monitoring
    "monitoring_summary": f"""SELECT count(*) AS total_predictions, {_sum("prediction = 1")} AS predicted_failures,
        {_sum("prediction = 0")} AS predicted_non_failures, {_MEAN} AS avg_failure_probability,
        {_sum("risk_level = 'HIGH'")} AS high_risk_count, {_sum("risk_level = 'MEDIUM'")} AS medium_risk_count,
        {_sum("risk_level = 'LOW'")} AS low_risk_count, {_share(_sum("risk_level = 'HIGH'"))} AS high_risk_percentage
        FROM ({PREDICTIONS}) p""",
    "risk_distribution": f"""SELECT risk_level, count(*) AS prediction_count, CAST({_PLACE} AS INTEGER) AS place,
        round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
        FROM ({PREDICTIONS}) p GROUP BY risk_level""",
    "dashboard_summary": DASHBOARD,
    "dashboard_kpis": DASHBOARD,
    "prediction_summary": "WITH t AS (" + PREDICTIONS + ") " + _unions(
        f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM t" for m, v in [
            ("total_predictions", "count(*)"), ("predicted_failures", "count(*) FILTER (WHERE prediction = 1)"),
            ("predicted_non_failures", "count(*) FILTER (WHERE prediction = 0)"),
            ("average_probability", f"round(avg({P}), 4)"),
            *((f"risk_{r.lower()}", f"count(*) FILTER (WHERE risk_level = '{r}')") for r in ("HIGH", "MEDIUM", "LOW")),
        ]),
    "risk_counts": f"SELECT risk_level, count(*) AS row_count FROM ({PREDICTIONS}) p GROUP BY risk_level",
    "total_rows": "SELECT count(*) AS total_rows FROM events",
    "column_listagg": _profile(TYPED, ["class", *SENSORS]) + """ SELECT
        string_agg('COALESCE(' || column_name || ', 0) AS ' || column_name, ', ' ORDER BY ordinal) AS column_list
        FROM p WHERE non_null < row_count""",
    "prediction_trends": f"""SELECT date_trunc('day', created_at) AS period_start, date_trunc('day', created_at) + INTERVAL 1 DAY AS period_end,
        count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 1) AS predicted_failures,
        count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_count, {_MEAN} AS avg_failure_probability
        FROM ({PREDICTIONS}) p GROUP BY 1, 2""",
    "share_of_total": """SELECT event_type, count(*) AS row_count,
        round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM events GROUP BY event_type""",
    "order_by_case": f"SELECT risk_level, count(*) AS row_count, CAST({_PLACE} AS INTEGER) AS place FROM ({PREDICTIONS}) p GROUP BY risk_level",
    "top_high_risk": f"{HIGH} ORDER BY {P} DESC, prediction_id LIMIT 20",
    "top_actions": f"{WITH_ACTION} ORDER BY {P} DESC, prediction_id LIMIT 20",
    "latest_predictions": f"SELECT {_SHOWN}, created_at FROM ({PREDICTIONS}) p ORDER BY prediction_id DESC LIMIT 10",
    # Weights, storage and scoring facts that SQL can state
    "scale_pos_weight": f"""SELECT count(*) FILTER (WHERE class = 'neg') AS negatives,
        count(*) FILTER (WHERE class = 'pos') AS positives, round(CAST(count(*) FILTER (WHERE class = 'neg') AS DOUBLE)
        / count(*) FILTER (WHERE class = 'pos'), 9) AS scale_pos_weight FROM ({RAW}) r""",
    "balanced_class_weight": f"""WITH t AS ({RAW}) SELECT {LABEL} AS label, count(*) AS row_count,
        round(CAST((SELECT count(*) FROM t) AS DOUBLE) / (2 * count(*)), 9) AS class_weight FROM t GROUP BY class""",
    "sink_model": "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS different FROM lineitem",
    "sink_metrics": f"WITH {_metrics(ONE_MODEL)}, runs AS (SELECT unnest(['run-1', 'run-2']) AS run_id) " + _unions(
        f"""SELECT run_id, 'value score' AS model, 'events' AS dataset, CAST(0 AS BIGINT) AS train_rows, test_rows,
        CAST(1 AS INTEGER) AS features, '{name}' AS metric, round(CAST("{c}" AS DOUBLE), 6) AS value FROM mm CROSS JOIN runs"""
        for name, c in [("true_negatives", "tn"), ("false_positives", "fp"), ("false_negatives", "fn"),
                        ("true_positives", "tp"), *((m, m) for m in _SIX)]),
    "score_stream": """SELECT count(*) AS row_count, count(*) AS distinct_rows, CAST(1 AS BIGINT) AS first_id,
        count(*) AS last_id, CAST(count(*) AS DOUBLE) * (count(*) + 1) / 2 AS id_sum, CAST(0 AS BIGINT) AS wrong_rows, TRUE AS scores_differ
        FROM lineitem""",
    "batch_score_job": """SELECT count(*) AS row_count, count(*) AS distinct_rows, CAST(1 AS BIGINT) AS first_id,
        count(*) AS last_id, CAST(count(*) AS DOUBLE) * (count(*) + 1) / 2 AS id_sum, CAST(0 AS BIGINT) AS wrong_rows,
        TRUE AS scores_differ, (SELECT CAST(""" + _missing(_TOP) + f""" AS BIGINT) FROM ({TYPED_WIDE}) t) AS filled_cells
        FROM lineitem""",
    "batch_scores_match": "SELECT count(*) AS row_count, count(*) AS equal_scores FROM lineitem",
    "model_tables": f"WITH {_stratified(COMPLETE)} SELECT split, label, count(*) AS row_count FROM s GROUP BY split, label",
    "train_logreg": _LOGREG,
    "train_logreg_balanced": _LOGREG,
    "train_boosted": _BOOSTED,
    "train_boosted_weighted": _BOOSTED,
    "train_second_order_weighted": """SELECT count(*) AS row_count, count(*) AS equal_scores, TRUE AS loss_falls,
        CAST(300 AS BIGINT) AS trees, TRUE AS depth_kept FROM lineitem""",
    "second_order_leaves": """SELECT CAST(3 AS BIGINT) AS trees, TRUE AS leaves_at_minimum, TRUE AS covers_equal,
        TRUE AS children_weigh_enough, TRUE AS trees_grew""",
    "training_route": f"""SELECT test AS test_rows, CAST(17 AS BIGINT) AS thresholds, CAST(1 AS BIGINT) AS chosen,
        CAST(0 AS BIGINT) AS better_ones FROM {_PARTS} n""",
    "score_proba": f"SELECT row_key, TRUE AS follows_formula FROM ({RAW_KEYED}) r",
    "score_class": f"SELECT row_key, TRUE AS follows_formula FROM ({RAW_KEYED}) r",
    "tree_shap": "SELECT count(*) AS row_count, count(*) AS equal_rows FROM lineitem",
    "explain_model": f"""SELECT least(count(*), {S.EXPLAIN_SAMPLE}) AS sample_rows, CAST(20 AS BIGINT) AS explained_features,
        TRUE AS riskiest_row, CAST(20 AS BIGINT) AS equal_ranks, CAST(20 AS BIGINT) AS features FROM lineitem""",
    "tree_shap_additivity": "SELECT count(*) AS row_count, count(*) AS additive_rows FROM lineitem",
    # Evaluation
    "confusion_matrix": f"SELECT {_NAMED} FROM ({COUNTS}) k",
    "accuracy": f"SELECT round({_ACC}, 9) AS accuracy FROM ({COUNTS}) k",
    "precision_recall_f1": f"""SELECT round({_PREC}, 9) AS "precision", round({_REC}, 9) AS recall, round({_F1}, 9) AS f1
        FROM ({COUNTS}) k""",
    "roc_auc": f"WITH {_metrics(ONE_MODEL)} SELECT round(roc_auc, 9) AS roc_auc FROM mm",
    "average_precision": f"WITH {_metrics(ONE_MODEL)} SELECT round(average_precision, 9) AS average_precision FROM mm",
    "classification_report": _report(),
    "default_threshold_eval": f"WITH {_metrics(ONE_MODEL)} SELECT test_rows, {_NAMED}, {_ROUNDED} FROM mm",
    "threshold_sweep": SWEEP,
    "select_threshold": f"""SELECT * FROM ({SWEEP}) w ORDER BY CASE WHEN recall >= 0.85 THEN 1 ELSE 0 END DESC,
        CASE WHEN recall >= 0.85 THEN f1 ELSE recall END DESC, threshold LIMIT 1""",
    "model_metrics": f"WITH {_metrics(TWO_MODELS)} SELECT model, test_rows, {_NAMED}, {_ROUNDED} FROM mm",
    "model_comparison": f"""WITH {_metrics(TWO_MODELS)}, b AS (SELECT * FROM mm WHERE model = 'baseline')
        SELECT mm.model, {", ".join(f'round(mm."{m}", 4) AS "{m}"' for m in _SIX[:5])},
        {", ".join(f'round((mm."{m}" - b."{m}") * 100, 2) AS {m}_points' for m in _SIX[:5])},
        mm.f1 = (SELECT max(f1) FROM mm) AS is_best FROM mm CROSS JOIN b""",
    "benchmark_models": f"""WITH {_metrics(TWO_MODELS)},
        v AS (SELECT model, 'roc_auc' AS measure, roc_auc AS v FROM mm UNION ALL SELECT model, 'average_precision', average_precision FROM mm),
        d AS (SELECT model, measure, 'value' AS kind, v AS e FROM v
            UNION ALL SELECT c.model, c.measure, 'difference', c.v - b.v FROM v c JOIN v b ON b.measure = c.measure AND b.model = 'baseline'
            WHERE c.model = 'challenger')
        SELECT model, measure, kind, round(e, 9) AS estimate, TRUE AS inside, TRUE AS spread, CAST(200 AS BIGINT) AS replicates FROM d""",
    # Explanation tables on given contributions
    "shap_importance": f"SELECT feature, round(v, 9) AS mean_absolute_shap FROM ({IMPORTANCE}) i",
    "shap_importance_ranked": f"SELECT feature, round(v, 9) AS mean_abs_shap, rank FROM ({_RANKED}) k",
    "rank_by_importance": f"SELECT feature, rank FROM ({_RANKED}) k",
    "top_importance": f"SELECT feature, round(v, 9) AS mean_absolute_shap FROM ({_RANKED}) k WHERE rank <= 3",
    "feature_selection_topk": f"SELECT feature, rank FROM ({_RANKED}) k WHERE rank <= 3",
    "highest_risk_row": f"SELECT row_key, round(l_extendedprice / 110000.0, 9) AS {P} FROM ({TOP_LINE}) t",
    "explain_row": f"""WITH top AS ({TOP_LINE}), e AS ({EXPLAINED})
        SELECT feature, feature_value, round(phi, 9) AS shap_value, round(abs(phi), 9) AS absolute_shap,
        CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank, round(p, 9) AS risk_probability FROM e""",
    "drift_scores": f"""WITH t AS ({fixtures.as_sql(fixtures.SIDES, "lineitem")}),
        long AS ({_unions(f"SELECT earlier, '{f}' AS f, CAST({f} AS DOUBLE) AS v FROM t" for f in fixtures.DRIFT_FEATURES)}),
        ranks AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n,
            max(v) OVER (PARTITION BY f) AS m FROM long WHERE earlier AND v IS NOT NULL),
        cuts AS (SELECT DISTINCT f, v FROM ranks, range(1, 20) i(i) WHERE rn = CAST(ceil(i / 20.0::DOUBLE * n) AS BIGINT) AND v < m),
        names AS (SELECT DISTINCT f FROM long),
        edges AS (SELECT names.f, coalesce(list(v ORDER BY v) FILTER (v IS NOT NULL), []) AS es FROM names LEFT JOIN cuts ON cuts.f = names.f GROUP BY 1),
        placed AS (SELECT long.f, earlier, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(es, lambda e: e < v)) END AS bucket
            FROM long JOIN edges ON edges.f = long.f),
        counts AS (SELECT f, bucket, count(*) FILTER (earlier) AS a, count(*) FILTER (NOT earlier) AS b FROM placed GROUP BY f, bucket),
        grid AS (SELECT f, len(es) + 2 AS k, unnest(range(-1, len(es) + 1)) AS bucket FROM edges),
        filled AS (SELECT g.f, g.k, g.bucket, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM grid g LEFT JOIN counts c ON c.f = g.f AND c.bucket = g.bucket),
        sums AS (SELECT *, sum(a) OVER (PARTITION BY f) AS a_all, sum(b) OVER (PARTITION BY f) AS b_all,
            sum(a) FILTER (bucket >= 0) OVER (PARTITION BY f) AS a_p, sum(b) FILTER (bucket >= 0) OVER (PARTITION BY f) AS b_p,
            coalesce(sum(a) FILTER (bucket >= 0) OVER (PARTITION BY f ORDER BY bucket), 0) AS a_u,
            coalesce(sum(b) FILTER (bucket >= 0) OVER (PARTITION BY f ORDER BY bucket), 0) AS b_u FROM filled),
        shares AS (SELECT *, (a + 0.5::DOUBLE) / (a_all + 0.5::DOUBLE * k) AS x, (b + 0.5::DOUBLE) / (b_all + 0.5::DOUBLE * k) AS y FROM sums),
        done AS (SELECT f AS feature, sum((y - x) * ln(y / x)) AS psi,
            max(abs(a_u / nullif(CAST(a_p AS DOUBLE), 0) - b_u / nullif(CAST(b_p AS DOUBLE), 0))) AS max_distance,
            CAST(max(a_all) AS BIGINT) AS reference_rows, CAST(max(b_all) AS BIGINT) AS current_rows,
            CAST(max(a_all) - max(a_p) AS BIGINT) AS reference_missing, CAST(max(b_all) - max(b_p) AS BIGINT) AS current_missing
            FROM shares GROUP BY f)
        SELECT feature, round(psi, 9) AS psi, round(max_distance, 9) AS max_distance, reference_rows, current_rows, reference_missing,
            current_missing, CASE WHEN psi >= 0.25 THEN 'shifted' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level FROM done""",
    "quality_history": f"""WITH t AS ({fixtures.as_sql(fixtures.SIDES, "lineitem")}),
        long AS ({_unions(f"SELECT '{f}' AS f, CAST({f} AS DOUBLE) AS v FROM t WHERE quarter(shipped) IN (1, 3)" for f in fixtures.DRIFT_FEATURES)})
        SELECT f AS column_name, count(*) AS row_count, count(*) - count(v) AS missing_count, count(*) FILTER (v = 0) AS zero_count,
            round(min(v), 6) AS minimum, round(max(v), 6) AS maximum, TRUE AS distinct_near FROM long GROUP BY f""",
    "late_label_performance": f"""WITH p AS ({PREDICTIONS}),
        l AS (SELECT event_id, ts + to_hours(CAST(event_id % 72 AS INTEGER)) AS labelled_at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y
            FROM events WHERE event_id % 5 <> 0),
        j AS (SELECT p.created_at, p.failure_probability AS q, p.prediction AS g, l.y FROM p LEFT JOIN l
            ON l.event_id = p.prediction_id - 1 AND labelled_at >= created_at AND labelled_at <= created_at + INTERVAL 2 DAY),
        c AS (SELECT date_trunc('day', created_at) AS d, count(*) AS n, count(y) AS known, count(*) FILTER (g = 1 AND y = 1) AS tp,
            count(*) FILTER (g = 1 AND y = 0) AS fp, count(*) FILTER (g = 0 AND y = 1) AS fn, count(*) FILTER (g = 0 AND y = 0) AS tn,
            avg((q - y) * (q - y)) AS brier FROM j GROUP BY 1)
        SELECT CAST(d AS TIMESTAMP) AS period_start, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AS period_end, n AS predictions, known AS labelled,
            n - known AS unlabelled, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
            round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS "precision", round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 9) AS recall,
            round(brier, 9) AS brier FROM c""",
    "alert_episodes": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS machine, ts AS seen_at, max(value / 150.0) AS p, count(*) AS n FROM events GROUP BY ALL),
        s AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.7 THEN 1 WHEN p < 0.5 THEN 0 END IGNORE NULLS) OVER (
            PARTITION BY machine ORDER BY seen_at ROWS UNBOUNDED PRECEDING), 0) AS st FROM r),
        t AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY machine ORDER BY seen_at), 0) AS earlier FROM s),
        o AS (SELECT *, last_value(CASE WHEN st = 1 AND earlier = 0 THEN seen_at END IGNORE NULLS) OVER (
            PARTITION BY machine ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS stretch FROM t),
        k AS (SELECT machine, stretch, max(p) FILTER (st = 1) AS peak, sum(n) FILTER (st = 1) AS n, min(seen_at) FILTER (st = 0 AND earlier = 1) AS closed
            FROM o WHERE st = 1 OR earlier = 1 GROUP BY machine, stretch),
        f AS (SELECT *, CASE WHEN stretch <= lag(closed) OVER (PARTITION BY machine ORDER BY stretch) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM k),
        e AS (SELECT *, sum(fresh) OVER (PARTITION BY machine ORDER BY stretch) AS episode FROM f)
        SELECT machine, CAST(min(stretch) AS TIMESTAMP) AS opened_at, CAST((list(closed ORDER BY stretch))[count(*)] AS TIMESTAMP) AS closed_at,
            round(max(peak), 9) AS peak, CAST(sum(n) AS BIGINT) AS rows, count(*) - 1 AS reopened FROM e GROUP BY machine, episode""",
}
