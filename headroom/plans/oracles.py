"""The same results in plain SQL, for checking against another engine.

Each statement is put together from named steps (common table expressions)
listed in ``STEPS``; a step may use the ones it names.
"""

from __future__ import annotations

from headroom.functions.rounding import BREAK
from headroom.operators.recurrent import Network

ORACLES: dict[str, str] = {}

# name -> (steps it reads, SQL)
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, sql: str, *needs: str) -> None:
    STEPS[name] = (needs, sql)


def _ordered(needs: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in needs:
        _ordered(STEPS[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def oracle(name: str, select: str, *needs: str) -> None:
    steps = [f"{s} AS MATERIALIZED ({STEPS[s][1]})" for s in _ordered(needs, [])]
    # recursive steps cannot be materialised hints in every engine; plain text is enough
    steps = [t.replace(" AS MATERIALIZED (", " AS (", 1) if "UNION" in t else t for t in steps]
    ORACLES[name] = (f"WITH RECURSIVE {', '.join(steps)} " if steps else "") + select


def rounded(expression: str, digits: int = 8) -> str:
    """Rounded as the queries are, see there."""
    return f"round(({expression}) * 1e{digits} - {BREAK}::double) / 1e{digits} + 0.0"


def r(expression: str, name: str, digits: int = 8) -> str:
    return f"{rounded(expression, digits)} AS {name}"


def rs(names: str, digits: int = 8) -> str:
    return ", ".join(r(n, n, digits) for n in names.split())


# --- tables -----------------------------------------------------------------------------

step(
    "trace",
    """SELECT printf('machine_%04d', user_id) AS machine_id, event_id,
    'cluster_' || (user_id % 8)::varchar AS cluster, ts AS time, ts AS start_time,
    CASE WHEN event_id % 97 = 0 THEN ts ELSE ts + INTERVAL 5 MINUTE END AS end_time,
    value / 100.0::double AS average_usage,
    (value / 100.0::double) * (1 + k / 100.0::double) AS maximum_usage,
    k / 50.0::double AS resource_request,
    CASE WHEN event_type <> 'error' THEN 0.5::double + k / 100.0::double END AS assigned_memory
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)
step(
    "filled",
    """SELECT * REPLACE (coalesce(
    last_value(assigned_memory IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY time, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(assigned_memory IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY time, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS assigned_memory) FROM trace""",
    "trace",
)
_VALID = "average_usage BETWEEN 0 AND 1.5 AND maximum_usage >= 0 AND end_time > start_time"
step("valid", f"SELECT * FROM filled WHERE {_VALID}", "filled")
_OUTLIERS = ("average_usage", "maximum_usage", "resource_request")


def _iqr_bounds(table: str) -> str:
    parts = []
    for c in _OUTLIERS:
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        parts += [f"{q1} - 1.5 * ({q3} - {q1}) AS low_{c}", f"{q3} + 1.5 * ({q3} - {q1}) AS high_{c}"]
    return f"SELECT {', '.join(parts)} FROM {table}"


def _z_bounds(table: str) -> str:
    parts = []
    for c in _OUTLIERS:
        parts += [
            f"avg({c}) - 3 * stddev_samp({c}) AS low_{c}",
            f"avg({c}) + 3 * stddev_samp({c}) AS high_{c}",
        ]
    return f"SELECT {', '.join(parts)} FROM {table}"


_CAPPED = ", ".join(f"least(greatest({c}, greatest(0, low_{c})), high_{c}) AS {c}" for c in _OUTLIERS)
step("trace_iqr", _iqr_bounds("trace"), "trace")
step("trace_z", _z_bounds("trace"), "trace")
step("valid_iqr", _iqr_bounds("valid"), "valid")
step(
    "cleaned",
    f"SELECT valid.* REPLACE ({_CAPPED}) FROM valid, valid_iqr",
    "valid",
    "valid_iqr",
)


def _windowed(table: str, minutes: int) -> str:
    width = minutes * 60_000_000
    return f"""SELECT machine_id, make_timestamp((epoch_us(time) // {width}::BIGINT) * {width}::BIGINT) AS time,
    avg(average_usage) AS average_usage_mean, stddev_samp(average_usage) AS average_usage_std,
    min(average_usage) AS average_usage_min, max(average_usage) AS average_usage_max,
    avg(maximum_usage) AS maximum_usage_mean, max(maximum_usage) AS maximum_usage_max,
    avg(resource_request) AS resource_request_mean, max(resource_request) AS resource_request_max,
    avg(assigned_memory) AS assigned_memory_mean FROM {table} GROUP BY 1, 2"""


step("hourly", _windowed("trace", 60), "trace")
step("daily", _windowed("trace", 1440), "trace")
step("cleaned_daily", _windowed("cleaned", 1440), "cleaned")
step(
    "profiles",
    """SELECT *, cpu_std / (cpu_mean + 1e-10) AS cpu_cv, request_mean / (cpu_mean + 1e-10) AS over_provision_ratio
    FROM (SELECT machine_id, avg(average_usage_mean) AS cpu_mean, stddev_samp(average_usage_mean) AS cpu_std,
    max(average_usage_mean) AS cpu_max, min(average_usage_mean) AS cpu_min, max(maximum_usage_max) AS peak_usage,
    avg(resource_request_mean) AS request_mean, avg(assigned_memory_mean) AS memory_mean,
    count(*) AS n_observations FROM daily GROUP BY 1)""",
    "daily",
)
FEATURES = "cpu_mean cpu_std cpu_cv peak_usage over_provision_ratio memory_mean".split()
step(
    "raw_features",
    "SELECT machine_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES) + " FROM profiles",
    "profiles",
)
step(
    "feature_scale",
    "SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in FEATURES)
    + " FROM raw_features",
    "raw_features",
)
step(
    "features",
    "SELECT machine_id, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES) + " FROM raw_features, feature_scale",
    "raw_features",
    "feature_scale",
)
step(
    "quadrants",
    "SELECT *, (cpu_mean > 0)::int + 2 * (cpu_cv > 0)::int AS cluster FROM features",
    "features",
)
step("emb", "SELECT vec_id AS id, embedding::double[] AS x, label AS cluster FROM embeddings")
step(
    "series",
    """SELECT machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY time) - 1 AS step, time, y FROM (
    SELECT l_suppkey::varchar AS machine_id,
    make_timestamp((epoch_us(l_shipdate) // 2592000000000::BIGINT) * 2592000000000::BIGINT) AS time,
    avg(l_quantity) / 50.0::double AS y FROM lineitem GROUP BY 1, 2)""",
)
step(
    "cleaned_series",
    """SELECT machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY time) - 1 AS step,
    average_usage_mean AS y FROM cleaned_daily""",
    "cleaned_daily",
)
_MOVING = """CASE WHEN step < 12
    THEN avg(y) OVER (PARTITION BY machine_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ELSE avg(y) OVER (PARTITION BY machine_id ORDER BY step ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END"""
step("predicted", f"SELECT *, {_MOVING} AS predicted FROM series", "series")
step(
    "split",
    """SELECT *, CASE WHEN pos <= cut THEN 'train' ELSE 'test' END AS part,
    CASE WHEN pos > cut THEN (pos - cut)::int END AS h FROM (
    SELECT *, step + 1 AS pos, floor(count(*) OVER (PARTITION BY machine_id) * 0.8::double)::bigint AS cut FROM series)""",
    "series",
)
step("train", "SELECT machine_id, step, y FROM split WHERE part = 'train'", "split")
step("test", "SELECT machine_id, h, y FROM split WHERE part = 'test'", "split")

# --- cleaning ------------------------------------------------------------------------------

_COLUMNS = (
    "machine_id event_id cluster time start_time end_time average_usage maximum_usage resource_request assigned_memory"
).split()
oracle(
    "trace_summary",
    "SELECT count(*) AS total_rows, count(DISTINCT machine_id) AS unique_machines, min(time) AS time_start, "
    "max(time) AS time_end, 10::bigint AS n_columns, "
    + ", ".join(f"count(*) - count({c}) AS nulls_{c}" for c in _COLUMNS)
    + " FROM trace",
    "trace",
)
oracle(
    "density_report",
    f"""SELECT count(*) AS total_rows, min(time) AS time_start, max(time) AS time_end,
    {r('(epoch_us(max(time)) - epoch_us(min(time))) / 1000000.0::double', 'duration_seconds', 6)},
    count(DISTINCT machine_id) AS unique_machines FROM trace""",
    "trace",
)
oracle(
    "top_machines",
    "SELECT machine_id, count(*) AS n_rows FROM trace GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "trace",
)
oracle(
    "time_gaps",
    f"""SELECT machine_id, count(*) AS n_gaps, {r('avg(gap)', 'mean_gap', 4)}, {r('stddev_samp(gap)', 'std_gap', 4)},
    {r('min(gap)', 'min_gap', 4)}, {r('quantile_cont(gap, 0.25)', 'q25', 4)}, {r('quantile_cont(gap, 0.5)', 'q50', 4)},
    {r('quantile_cont(gap, 0.75)', 'q75', 4)}, {r('max(gap)', 'max_gap', 4)} FROM (
    SELECT machine_id, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY machine_id ORDER BY time)) / 1000000.0::double
    AS gap FROM trace) WHERE gap IS NOT NULL GROUP BY 1""",
    "trace",
)
oracle(
    "parse_metric",
    "SELECT event_id, "
    + r(
        """CASE event_type WHEN 'click' THEN value
    WHEN 'view' THEN (value + CAST(json_extract_string(props, '$.k') AS INTEGER)) / 2
    WHEN 'purchase' THEN value ELSE 0 END""",
        "metric",
    )
    + " FROM events",
)
oracle(
    "sample_machines",
    f"""SELECT machine_id, event_id, {rs('average_usage')} FROM trace WHERE machine_id IN (
    SELECT machine_id FROM (SELECT DISTINCT machine_id FROM trace) ORDER BY md5('42:' || machine_id), machine_id LIMIT 20)""",
    "trace",
)
oracle(
    "fill_missing",
    f"SELECT machine_id, event_id, time, {rs('average_usage assigned_memory')} FROM filled",
    "filled",
)
oracle(
    "remove_invalid",
    f"SELECT machine_id, event_id, start_time, end_time, {rs('average_usage maximum_usage')} FROM trace WHERE {_VALID}",
    "trace",
)
for _method, _bounds in (("iqr", "trace_iqr"), ("zscore", "trace_z")):
    oracle(
        f"cap_outliers_{_method}",
        f"SELECT machine_id, event_id, {rs(' '.join(_OUTLIERS))} FROM "
        f"(SELECT trace.* REPLACE ({_CAPPED}) FROM trace, {_bounds})",
        "trace",
        _bounds,
    )
oracle(
    "clean_trace",
    f"""SELECT machine_id, event_id, cluster, time, start_time, end_time,
    {rs('average_usage maximum_usage resource_request assigned_memory')} FROM cleaned""",
    "cleaned",
)
_OUTSIDE = " + ".join(f"({c} < low_{c} OR {c} > high_{c})::int" for c in _OUTLIERS)
oracle(
    "cleaning_report",
    f"""SELECT 'missing_values_handled' AS metric, (count(*) - count(assigned_memory))::bigint AS value FROM trace
    UNION ALL SELECT 'invalid_rows_removed', ((SELECT count(*) FROM trace) - count(*))::bigint FROM valid
    UNION ALL SELECT 'outliers_capped', sum({_OUTSIDE})::bigint FROM valid, valid_iqr""",
    "trace",
    "valid",
    "valid_iqr",
)

# --- windows and features --------------------------------------------------------------------

_WINDOW_COLUMNS = """average_usage_mean average_usage_std average_usage_min average_usage_max maximum_usage_mean
maximum_usage_max resource_request_mean resource_request_max assigned_memory_mean"""
for _name, _table in (
    ("window_aggregate", "hourly"),
    ("window_aggregate_daily", "daily"),
    ("stream_window_aggregate", "hourly"),
):
    oracle(_name, f"SELECT machine_id, time, {rs(_WINDOW_COLUMNS)} FROM {_table}", _table)
oracle(
    "temporal_features",
    f"""SELECT machine_id, time, {r('sin(2 * pi() * hour(time) / 24)', 'hour_sin')},
    {r('cos(2 * pi() * hour(time) / 24)', 'hour_cos')}, {r('sin(2 * pi() * (isodow(time) - 1) / 7)', 'dow_sin')},
    {r('cos(2 * pi() * (isodow(time) - 1) / 7)', 'dow_cos')}, (isodow(time) >= 6)::int AS is_weekend,
    (hour(time) BETWEEN 9 AND 17)::int AS is_business_hours FROM hourly""",
    "hourly",
)
oracle(
    "workload_features",
    f"""SELECT machine_id, time,
    {r('(maximum_usage_max - average_usage_mean) / (average_usage_mean + 1e-10)', 'burstiness', 6)},
    {r('1 / (1 + average_usage_std / (average_usage_mean + 1e-10))', 'stability', 6)} FROM daily""",
    "daily",
)
oracle(
    "over_provisioning",
    f"""SELECT machine_id, time,
    {r('resource_request_mean / (average_usage_mean + 1e-10)', 'over_provision_ratio', 6)},
    {r('greatest(0, resource_request_mean - average_usage_mean)', 'wasted_resources', 6)},
    {r('least(1, greatest(0, average_usage_mean / (resource_request_mean + 1e-10)))', 'utilization_efficiency', 6)}
    FROM daily""",
    "daily",
)
oracle(
    "machine_profiles",
    "SELECT machine_id, n_observations, "
    + rs("cpu_mean cpu_std cpu_max cpu_min peak_usage request_mean memory_mean cpu_cv over_provision_ratio")
    + " FROM profiles",
    "profiles",
)
oracle("scaled_features", f"SELECT machine_id, {rs(' '.join(FEATURES), 7)} FROM features", "features")
oracle("usage_series", f"SELECT machine_id, step, time, {rs('y')} FROM series", "series")
oracle(
    "lag_sequences",
    f"""SELECT machine_id, step, list_transform(x, lambda v: {rounded('v')}) AS x, {r('y', 'target')} FROM (
    SELECT *, list(y) OVER (PARTITION BY machine_id ORDER BY step ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x
    FROM series) WHERE step >= 12""",
    "series",
)
oracle("train_test_split", f"SELECT machine_id, step, part, h, {rs('y')} FROM split", "split")
oracle("long_series", "SELECT machine_id, count(*) AS n FROM series GROUP BY 1 HAVING count(*) >= 84", "series")
oracle("last_values", f"SELECT machine_id, {r('arg_max(y, step)', 'last_value')} FROM series GROUP BY 1", "series")

# --- clusters --------------------------------------------------------------------------------

step(
    "centre_values",
    """SELECT cluster, pos, avg(v) AS v, var_samp(v) AS spread, count(*) AS n FROM (
    SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM emb) GROUP BY 1, 2""",
    "emb",
)
step("centres", "SELECT cluster, list(v ORDER BY pos) AS centre, any_value(n) AS n FROM centre_values GROUP BY 1", "centre_values")
step(
    "inertia_of",
    "SELECT sum(pow(list_distance(x, centre), 2)) AS inertia FROM emb JOIN centres USING (cluster)",
    "emb",
    "centres",
)
oracle(
    "nearest_centroid",
    f"""SELECT id, arg_min(c.cluster, d) AS cluster, {r('min(d)', 'distance')} FROM (
    SELECT emb.id, centres.cluster, list_distance(emb.x, centres.centre) AS d FROM emb, centres) AS c GROUP BY 1""",
    "emb",
    "centres",
)
oracle("inertia", f"SELECT {rs('inertia', 6)} FROM inertia_of", "inertia_of")
oracle(
    "calinski_harabasz",
    f"""SELECT {r('(b / (k - 1)) / (inertia / (n - k))', 'calinski_harabasz', 6)} FROM (
    SELECT sum(centre_values.n * pow(v - m, 2)) AS b FROM centre_values JOIN (
        SELECT pos, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM emb) GROUP BY 1)
    USING (pos)), (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM emb), inertia_of""",
    "emb",
    "centre_values",
    "inertia_of",
)
oracle(
    "davies_bouldin",
    f"""SELECT {r('avg(worst)', 'davies_bouldin', 6)} FROM (
    SELECT a.cluster, max((a.width + b.width) / list_distance(a.centre, b.centre)) AS worst
    FROM widths a JOIN widths b ON a.cluster <> b.cluster GROUP BY 1)""".replace(
        "widths",
        "(SELECT cluster, any_value(centre) AS centre, avg(list_distance(x, centre)) AS width "
        "FROM emb JOIN centres USING (cluster) GROUP BY 1)",
    ),
    "emb",
    "centres",
)
step(
    "distance_means",
    """SELECT a.id, a.cluster AS own, b.cluster, sum(list_distance(a.x, b.x)) AS total, count(*) AS n
    FROM emb a, emb b GROUP BY 1, 2, 3""",
    "emb",
)
_SILHOUETTE = """SELECT own, CASE WHEN max(CASE WHEN cluster = own THEN n END) = 1 THEN 0
    ELSE (min(CASE WHEN cluster <> own THEN total / n END) - max(CASE WHEN cluster = own AND n > 1 THEN total / (n - 1) END))
    / greatest(min(CASE WHEN cluster <> own THEN total / n END), max(CASE WHEN cluster = own AND n > 1 THEN total / (n - 1) END))
    END AS s FROM {table} GROUP BY id, own"""
oracle(
    "silhouette_exact",
    f"SELECT {r('avg(s)', 'silhouette')} FROM ({_SILHOUETTE.format(table='distance_means')})",
    "distance_means",
)
step(
    "squared_means",
    """SELECT a.id, a.cluster AS own, b.cluster, sum(pow(list_distance(a.x, b.x), 2)) AS total, count(*) AS n
    FROM emb a, emb b GROUP BY 1, 2, 3""",
    "emb",
)
oracle(
    "silhouette_squared",
    f"SELECT {r('avg(s)', 'silhouette_squared')} FROM ({_SILHOUETTE.format(table='squared_means')})",
    "squared_means",
)
_TYPE = """CASE WHEN cpu_mean_mean < 0.3 AND cpu_cv_mean < 0.3 THEN 'stable_low_load'
    WHEN cpu_cv_mean > 0.6 AND cpu_mean_mean > 0.5 THEN 'volatile' WHEN cpu_cv_mean > 0.6 THEN 'bursty'
    ELSE 'periodic' END"""
_REPORT_NAME = """CASE workload_type WHEN 'periodic' THEN 'Seasonal_ARIMA' WHEN 'bursty' THEN 'LSTM'
    WHEN 'volatile' THEN 'Conservative_Baseline' ELSE 'ARIMA' END"""
_MODEL_NAME = """CASE workload_type WHEN 'periodic' THEN 'seasonal_arima' WHEN 'bursty' THEN 'lstm'
    WHEN 'volatile' THEN 'conservative' ELSE 'arima' END"""
step(
    "stats",
    f"SELECT *, {_TYPE} AS workload_type FROM (SELECT cluster, count(*) AS size, "
    "count(*) / (SELECT count(*) FROM quadrants)::double * 100 AS percentage, "
    + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in FEATURES)
    + " FROM quadrants GROUP BY 1)",
    "quadrants",
)
_STAT_COLUMNS = " ".join(f"{c}_mean {c}_std" for c in FEATURES)
oracle(
    "cluster_stats",
    f"SELECT cluster, size, workload_type, {rs('percentage ' + _STAT_COLUMNS, 6)} FROM stats",
    "stats",
)
oracle(
    "cluster_summary",
    "SELECT cluster, "
    + ", ".join(
        r(f"{f}({c})", f"{c}_{n}", 6)
        for c in FEATURES
        for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )
    + " FROM quadrants GROUP BY 1",
    "quadrants",
)
oracle("cluster_sizes", "SELECT cluster, count(*) AS size FROM quadrants GROUP BY 1", "quadrants")
oracle(
    "cluster_report",
    f"""SELECT cluster, size, printf('%.1f%%', percentage) AS percentage, workload_type,
    {_REPORT_NAME} AS prediction_strategy, printf('%.3f', cpu_mean_mean) AS avg_cpu,
    printf('%.3f', cpu_cv_mean) AS cpu_variability, printf('%.2f', over_provision_ratio_mean) AS over_provision_ratio
    FROM stats""",
    "stats",
)
oracle(
    "workload_types",
    f"SELECT cluster, workload_type, {rs('cpu_mean_mean cpu_cv_mean', 6)} FROM stats",
    "stats",
)
oracle(
    "strategy_assignment",
    f"""SELECT machine_id, quadrants.cluster, workload_type, {_REPORT_NAME} AS prediction_strategy,
    {_MODEL_NAME} AS strategy FROM quadrants JOIN stats USING (cluster)""",
    "quadrants",
    "stats",
)
oracle(
    "radar_values",
    "SELECT cluster, workload_type, "
    + ", ".join(
        r(f"least({c}, 1)", c, 6)
        for c in ("cpu_mean_mean", "cpu_cv_mean", "over_provision_ratio_mean", "memory_mean_mean")
    )
    + " FROM stats",
    "stats",
)

# --- density ---------------------------------------------------------------------------------

step("pts", f"SELECT machine_id AS id, [{', '.join(FEATURES)}]::double[] AS x FROM features", "features")
step(
    "near",
    "SELECT a.id, b.id AS other FROM pts a, pts b WHERE list_distance(a.x, b.x) <= 0.9",
    "pts",
)
step("core", "SELECT id FROM near GROUP BY 1 HAVING count(*) >= 5", "near")
step(
    "links",
    "SELECT near.id, near.other FROM near JOIN core a ON near.id = a.id JOIN core b ON near.other = b.id",
    "near",
    "core",
)
step(
    "reach",
    "SELECT id, id AS root FROM core UNION SELECT links.other, reach.root FROM reach JOIN links ON links.id = reach.id",
    "core",
    "links",
)
step("core_labels", "SELECT id, min(root) AS label FROM reach GROUP BY 1", "reach")
step(
    "member_labels",
    """SELECT id, label FROM core_labels UNION ALL SELECT near.id, min(label) FROM near JOIN core_labels
    ON near.other = core_labels.id WHERE near.id NOT IN (SELECT id FROM core) GROUP BY 1""",
    "near",
    "core",
    "core_labels",
)
step(
    "dbscan",
    """SELECT pts.id, coalesce(number, -1)::int AS cluster FROM pts LEFT JOIN member_labels USING (id) LEFT JOIN (
    SELECT label, row_number() OVER (ORDER BY label) - 1 AS number FROM (SELECT DISTINCT label FROM core_labels))
    USING (label)""",
    "pts",
    "member_labels",
    "core_labels",
)
oracle("dbscan_labels", "SELECT id AS machine_id, cluster FROM dbscan", "dbscan")
step("member_points", "SELECT id, x, cluster FROM pts JOIN dbscan USING (id) WHERE cluster <> -1", "pts", "dbscan")
step(
    "member_distances",
    """SELECT a.id, a.cluster AS own, b.cluster, sum(list_distance(a.x, b.x)) AS total, count(*) AS n
    FROM member_points a, member_points b GROUP BY 1, 2, 3""",
    "member_points",
)
oracle(
    "dbscan_metrics",
    f"""SELECT n_clusters, n_noise, {r('n_noise / n', 'noise_ratio', 6)},
    CASE WHEN n_clusters > 1 AND members > n_clusters THEN {rounded('s', 6)} END AS silhouette FROM (
    SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count(*) FILTER (cluster = -1) AS n_noise,
    count(*)::double AS n, count(*) FILTER (cluster <> -1) AS members FROM dbscan),
    (SELECT avg(s) AS s FROM ({_SILHOUETTE.format(table='member_distances')}))""",
    "dbscan",
    "member_distances",
)
oracle(
    "noise_pattern",
    "SELECT cluster = -1 AS is_noise, "
    + ", ".join(r(f"avg({c})", c, 6) for c in FEATURES)
    + " FROM features JOIN dbscan ON features.machine_id = dbscan.id GROUP BY 1",
    "features",
    "dbscan",
)
step(
    "kth",
    """SELECT id, d FROM (SELECT a.id, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x)) AS n FROM pts a, pts b) WHERE n = 10""",
    "pts",
)
oracle("k_distances", f"SELECT id AS machine_id, {r('d', 'distance', 6)} FROM kth", "kth")
oracle(
    "k_distance_eps",
    f"""SELECT {r('d', 'eps', 6)} FROM (SELECT d, row_number() OVER (ORDER BY d, id) AS n,
    d - 2 * lag(d, 1) OVER (ORDER BY d, id) + lag(d, 2) OVER (ORDER BY d, id) AS bend FROM kth)
    WHERE bend IS NOT NULL ORDER BY bend DESC, n LIMIT 1""",
    "kth",
)

# --- forecasts -------------------------------------------------------------------------------

step("horizon", "SELECT unnest(range(1, 7))::int AS h")
oracle(
    "forecast_naive",
    f"""SELECT machine_id, 'naive' AS strategy, h, {r('last', 'y_pred')} FROM
    (SELECT machine_id, arg_max(y, step) AS last FROM series GROUP BY 1), horizon""",
    "series",
    "horizon",
)
oracle(
    "forecast_conservative",
    f"""SELECT machine_id, 'conservative' AS strategy, h, {r('level', 'y_pred')} FROM
    (SELECT machine_id, quantile_cont(y, 0.75) AS level FROM series GROUP BY 1), horizon""",
    "series",
    "horizon",
)
_WEIGHTS = "[" + ", ".join(f"0.3::double * pow(0.7::double, {i})" for i in range(12)) + "]"


LONGEST_TEST = 60  # walks go at least as far as the longest test part


def _weighted(table: str, last_step: int) -> str:
    return f"""SELECT machine_id, 0 AS h, list(y ORDER BY step) AS tail, {_WEIGHTS} AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY step DESC) AS back,
    count(*) OVER (PARTITION BY machine_id) AS n FROM {table}) WHERE back <= 12 AND n >= 12 GROUP BY 1
    UNION ALL SELECT machine_id, h + 1, list_append(tail[2:],
    least(1, greatest(0, list_dot_product(tail, w) / list_sum(w)))), w FROM {{name}} WHERE h < {last_step}"""


step("weighted", _weighted("series", 6).format(name="weighted"), "series")
step("weighted_train", _weighted("train", LONGEST_TEST).format(name="weighted_train"), "train")
step(
    "short",
    "SELECT machine_id, arg_max(y, step) AS last FROM series GROUP BY 1 HAVING count(*) < 12",
    "series",
)
oracle(
    "forecast_weighted",
    f"""SELECT machine_id, 'weighted' AS strategy, h, {r('tail[12]', 'y_pred')} FROM weighted WHERE h > 0
    UNION ALL SELECT machine_id, 'weighted', h, {rounded('least(1, greatest(0, last))')} FROM short, horizon""",
    "weighted",
    "short",
    "horizon",
)
step(
    "ar1_fit",
    """SELECT machine_id, coalesce(sum(d * d1) / nullif(sum(d1 * d1), 0), 0) AS phi,
    arg_max(y, step) AS last, arg_max(d, step) AS change, any_value(n) AS n FROM (
    SELECT *, lag(d) OVER (PARTITION BY machine_id ORDER BY step) AS d1 FROM (
    SELECT *, y - lag(y) OVER (PARTITION BY machine_id ORDER BY step) AS d,
    count(*) OVER (PARTITION BY machine_id) AS n FROM series)) GROUP BY 1""",
    "series",
)
step(
    "ar1",
    """SELECT machine_id, phi, n, 0 AS h, last AS y, CASE WHEN n >= 20 THEN change ELSE 0 END AS change FROM ar1_fit
    UNION ALL SELECT machine_id, phi, n, h + 1, y + phi * change, phi * change FROM ar1 WHERE h < 6""",
    "ar1_fit",
)
oracle(
    "forecast_ar1",
    f"""SELECT machine_id, 'ar1' AS strategy, h,
    {r('CASE WHEN n >= 20 THEN least(1, greatest(0, y)) ELSE y END', 'y_pred')} FROM ar1 WHERE h > 0""",
    "ar1",
)
oracle(
    "forecast_default",
    f"""SELECT machine_id, h, {r('coalesce(last, 0.5)', 'y_pred')} FROM
    (SELECT machine_id, CASE WHEN count(*) >= 84 THEN arg_max(y, step) END AS last FROM series GROUP BY 1),
    (SELECT h FROM horizon WHERE h <= 3)""",
    "series",
    "horizon",
)
step(
    "weighted_values",
    f"""SELECT machine_id, h, y_pred FROM (SELECT machine_id, h, tail[12] AS y_pred FROM weighted_train WHERE h > 0
    UNION ALL SELECT machine_id, h, last FROM (
    SELECT machine_id, least(1, greatest(0, arg_max(y, step))) AS last FROM train GROUP BY 1 HAVING count(*) < 12),
    (SELECT unnest(range(1, {LONGEST_TEST + 1})) AS h)) SEMI JOIN test USING (machine_id, h)""",
    "weighted_train",
    "train",
    "test",
)
oracle(
    "forecast_evaluation",
    f"""SELECT {r('sqrt(avg(pow(y - y_pred, 2)))', 'rmse')}, {r('avg(abs(y - y_pred))', 'mae')},
    {r('avg(abs((y - y_pred) / (y + 1e-10))) * 100', 'mape')} FROM test JOIN weighted_values USING (machine_id, h)""",
    "test",
    "weighted_values",
)

# Least squares in SQL: sums of products per machine as rows of a list, then elimination.


def linear_solver(name: str, table: str) -> None:
    """Add ``{name}_solved``: ``phi`` for each system ``m`` (rows with the right side last)."""
    swept = """list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k + 1
    THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])
    ELSE list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)"""
    step(
        f"{name}_swept",
        f"""SELECT *, 0 AS k FROM {table}
    UNION ALL SELECT * REPLACE (k + 1 AS k, {swept} AS m) FROM {name}_swept WHERE k < len(m)""",
        table,
    )
    step(
        f"{name}_solved",
        f"""SELECT * EXCLUDE (k, m), list_transform(m, lambda r: r[len(r)]) AS phi
    FROM {name}_swept WHERE k = len(m)""",
        f"{name}_swept",
    )


def normal_equations(name: str, table: str, size: int, keys: str = "machine_id") -> None:
    """Add ``{name}``: the system of sums over the rows ``z`` (inputs, then the target)."""
    step(
        name,
        f"""SELECT {keys}, list(r ORDER BY i) AS m FROM (SELECT {keys}, i, list(s ORDER BY j) AS r FROM (
    SELECT {keys}, i, j, sum(z[i] * z[j]) AS s FROM {table}, (SELECT unnest(range(1, {size + 1})) AS i),
    (SELECT unnest(range(1, {size + 2})) AS j) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
        table,
    )


def lagged(value: str, lags: list[int], table: str, start: int, extra: str = "") -> str:
    items = ", ".join(f"lag({value}, {i}) OVER w" for i in lags)
    return f"""SELECT * FROM (SELECT *, [{items}, {value}] AS z FROM {table}
    WINDOW w AS (PARTITION BY machine_id{extra} ORDER BY step)) WHERE step >= {start}"""


def least_squares(table: str, last: int, prefix: str = "") -> None:
    """Add the AR walks over ``table`` for h = 1..last: ``{prefix}ar_walk`` and ``{prefix}seasonal_walk``."""
    p = prefix
    step(f"{p}naive_for", f"SELECT machine_id, arg_max(y, step) AS last, count(*) AS n FROM {table} GROUP BY 1", table)
    step(
        f"{p}changes",
        f"SELECT machine_id, step, y, y - lag(y) OVER (PARTITION BY machine_id ORDER BY step) AS w FROM {table}",
        table,
    )
    step(f"{p}ar_rows", lagged("w", [1, 2, 3, 4, 5], f"{p}changes", 6), f"{p}changes")
    normal_equations(f"{p}ar_sums", f"{p}ar_rows", 5)
    linear_solver(f"{p}ar", f"{p}ar_sums")
    step(
        f"{p}ar_state",
        f"""SELECT machine_id, list(w ORDER BY step DESC)[1:5] AS recent, arg_max(y, step) AS y FROM {p}changes
    GROUP BY 1 HAVING count(*) >= 20""",
        f"{p}changes",
    )
    step(
        f"{p}ar_walk",
        f"""SELECT machine_id, phi, 0 AS h, recent, y FROM {p}ar_state JOIN {p}ar_solved USING (machine_id)
    UNION ALL SELECT machine_id, phi, h + 1, list_prepend(list_dot_product(phi, recent), recent[1:4]),
    y + list_dot_product(phi, recent) FROM {p}ar_walk WHERE h < {last}""",
        f"{p}ar_state",
        f"{p}ar_solved",
    )
    step(
        f"{p}seasonal_changes",
        f"""SELECT *, y - lag(y, 1) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w AS w FROM {table}
    WINDOW w AS (PARTITION BY machine_id ORDER BY step)""",
        table,
    )
    step(f"{p}seasonal_rows", lagged("w", [1, 2, 3, 4, 5, 12], f"{p}seasonal_changes", 25), f"{p}seasonal_changes")
    normal_equations(f"{p}seasonal_sums", f"{p}seasonal_rows", 6)
    linear_solver(f"{p}seasonal", f"{p}seasonal_sums")
    step(
        f"{p}seasonal_state",
        f"""SELECT machine_id, list(w ORDER BY step DESC)[1:12] AS recent, list(y ORDER BY step DESC)[1:13] AS ys
    FROM {p}seasonal_changes GROUP BY 1 HAVING count(*) >= 20""",
        f"{p}seasonal_changes",
    )
    following = "list_dot_product(phi, list_append(recent[1:5], recent[12]))"
    step(
        f"{p}seasonal_walk",
        f"""SELECT machine_id, phi, 0 AS h, recent, ys FROM {p}seasonal_state JOIN {p}seasonal_solved USING (machine_id)
    UNION ALL SELECT machine_id, phi, h + 1, list_prepend({following}, recent[1:11]),
    list_prepend({following} + ys[1] + ys[12] - ys[13], ys[1:12]) FROM {p}seasonal_walk WHERE h < {last}""",
        f"{p}seasonal_state",
        f"{p}seasonal_solved",
    )


def pooled_regression(table: str, last: int, prefix: str = "") -> None:
    """Add ``{prefix}pooled_walk``: one regression over all machines of ``table``."""
    p = prefix
    step(
        f"{p}scaled_series",
        f"""SELECT machine_id, step, low, high, CASE WHEN high > low THEN (y - low) / (high - low) ELSE 0 END AS s FROM (
    SELECT *, min(y) OVER m AS low, max(y) OVER m AS high, count(*) OVER m AS n FROM {table}
    WINDOW m AS (PARTITION BY machine_id)) WHERE n >= 22""",
        table,
    )
    step(
        f"{p}pooled_rows",
        f"""SELECT 'all' AS pool, list_concat(x, [1.0, s]) AS z FROM (SELECT s, row_number() OVER m AS at_row,
    list(s) OVER (PARTITION BY machine_id ORDER BY step ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x
    FROM {p}scaled_series WINDOW m AS (PARTITION BY machine_id ORDER BY step)) WHERE at_row > 12""",
        f"{p}scaled_series",
    )
    normal_equations(f"{p}pooled_sums", f"{p}pooled_rows", 13, "pool")
    linear_solver(f"{p}pooled", f"{p}pooled_sums")
    step(
        f"{p}pooled_walk",
        f"""SELECT machine_id, low, high, phi[13] AS base, phi[1:12] AS w, 0 AS h, tail FROM (
    SELECT machine_id, any_value(low) AS low, any_value(high) AS high,
    list_reverse(list(s ORDER BY step DESC)[1:12]) AS tail FROM {p}scaled_series GROUP BY 1), {p}pooled_solved
    UNION ALL SELECT machine_id, low, high, base, w, h + 1, list_append(tail[2:12], base + list_dot_product(w, tail))
    FROM {p}pooled_walk WHERE h < {last}""",
        f"{p}scaled_series",
        f"{p}pooled_solved",
    )


least_squares("series", 6)
pooled_regression("series", 6)


def _forecast(strategy: str, walk: str, value: str, enough: int = 20) -> str:
    return f"""SELECT machine_id, '{strategy}' AS strategy, h, {r(f'least(1, greatest(0, {value}))', 'y_pred')}
    FROM {walk} WHERE h > 0 UNION ALL SELECT machine_id, '{strategy}', h, {rounded('last')}
    FROM naive_for, horizon WHERE n < {enough}"""


oracle("forecast_ar", _forecast("arima", "ar_walk", "y"), "ar_walk", "naive_for", "horizon")
oracle(
    "forecast_seasonal",
    _forecast("seasonal_arima", "seasonal_walk", "ys[1]"),
    "seasonal_walk",
    "naive_for",
    "horizon",
)
step(
    "degrees",
    """SELECT machine_id, step, 0 AS d, y AS w FROM series UNION ALL SELECT machine_id, step, 1, w FROM changes
    UNION ALL SELECT machine_id, step, 2, w - lag(w) OVER (PARTITION BY machine_id ORDER BY step) FROM changes""",
    "series",
    "changes",
)
step("degree_rows", lagged("w", [1, 2, 3, 4, 5], "degrees", 0, ", d").replace("step >= 0", "step >= 5 + d"), "degrees")
normal_equations("degree_sums", "degree_rows", 5, "machine_id, d")
step(
    "order_systems",
    """SELECT machine_id, d, p, list_transform(range(1, p + 1), lambda i: list_append(m[i][1:p], m[i][6])) AS m,
    list_transform(range(1, p + 1), lambda i: m[i][6]) AS b FROM degree_sums, (SELECT unnest(range(1, 6)) AS p)""",
    "degree_sums",
)
linear_solver("order", "order_systems")
step("order_totals", "SELECT machine_id, d, sum(w * w) AS total, count(*) AS n FROM degree_rows GROUP BY 1, 2", "degree_rows")
oracle(
    "ar_order_search",
    f"""SELECT machine_id, p::int AS p, d, {r('aic', 'aic', 6)} FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY aic, p, d) AS best FROM (
    SELECT machine_id, p, d, n * ln((total - list_dot_product(phi, b)) / n) + 2 * (p + 1) AS aic
    FROM order_solved JOIN order_totals USING (machine_id, d) WHERE n > p + 1 AND total > 0)) WHERE best = 1""",
    "order_solved",
    "order_totals",
)
# Orders with moving-average terms: a long autoregression, then its residuals as further inputs.
step("long_rows", lagged("w", [1, 2, 3, 4], "degrees", 0, ", d").replace("step >= 0", "step >= 4 + d"), "degrees")
normal_equations("long_sums", "long_rows", 4, "machine_id, d")
linear_solver("long", "long_sums")
step(
    "long_residuals",
    """SELECT machine_id, d, step, w, w - list_dot_product(phi, z[1:4]) AS e
    FROM long_rows JOIN long_solved USING (machine_id, d)""",
    "long_rows",
    "long_solved",
)
step(
    "arma_rows",
    """SELECT * FROM (SELECT machine_id, d, step, w, [b.w1, b.w2, lag(e, 1) OVER s, lag(e, 2) OVER s, w] AS z
    FROM long_residuals JOIN (SELECT machine_id, d, step, z[1] AS w1, z[2] AS w2 FROM long_rows) b
    USING (machine_id, d, step) WINDOW s AS (PARTITION BY machine_id, d ORDER BY step)) WHERE step >= 6 + d""",
    "long_residuals",
    "long_rows",
)
normal_equations("arma_sums", "arma_rows", 4, "machine_id, d")
step(
    "arma_systems",
    """SELECT machine_id, d, p, q, list_transform(places, lambda i: list_append(list_transform(places, lambda j: m[i][j]), m[i][5])) AS m,
    list_transform(places, lambda i: m[i][5]) AS b FROM (SELECT *, list_concat(range(1, p + 1), range(3, q + 3)) AS places
    FROM arma_sums, (SELECT unnest(range(0, 3)) AS p), (SELECT unnest(range(0, 3)) AS q) WHERE p + q > 0)""",
    "arma_sums",
)
linear_solver("arma", "arma_systems")
step("arma_totals", "SELECT machine_id, d, sum(w * w) AS total, count(*) AS n FROM arma_rows GROUP BY 1, 2", "arma_rows")
oracle(
    "arma_order_search",
    f"""SELECT machine_id, p::int AS p, d, q::int AS q, {r('aic', 'aic', 6)} FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY aic, p, d, q) AS best FROM (
    SELECT machine_id, p, d, q, n * ln((total - list_dot_product(phi, b)) / n) + 2 * (p + q + 1) AS aic
    FROM arma_solved JOIN arma_totals USING (machine_id, d) WHERE n > p + q + 1 AND total > 0)) WHERE best = 1""",
    "arma_solved",
    "arma_totals",
)

# One Gauss-Newton step of the seasonal model: shocks are sums over whole seasons back.
_PHI, _SPHI, _STHETA = (0.3, 0.1, -0.1, 0.05, 0.02), 0.2, 0.4
_OWN = " - ".join(["w", *[f"({c}::double) * lag(w, {i}) OVER s" for i, c in enumerate(_PHI, 1)]])
_OWN_BEFORE = " - ".join(["lag(w, 12) OVER s", *[f"({c}::double) * lag(w, {i + 12}) OVER s" for i, c in enumerate(_PHI, 1)]])
step(
    "season_inputs",
    f"""SELECT * FROM (SELECT machine_id, step, {_OWN} - {_SPHI}::double * ({_OWN_BEFORE}) AS u, -({_OWN_BEFORE}) AS v6,
    {', '.join(f'{_SPHI}::double * lag(w, {i + 12}) OVER s - lag(w, {i}) OVER s AS v{i}' for i in range(1, 6))}
    FROM seasonal_changes WINDOW s AS (PARTITION BY machine_id ORDER BY step)) WHERE step >= 30""",
    "seasonal_changes",
)
_BACK = f"pow(-{_STHETA}::double, (a.step - b.step) // 12)"
step(
    "season_shocks",
    f"""SELECT a.machine_id, a.step, sum({_BACK} * b.u) AS e,
    {', '.join(f'sum({_BACK} * b.v{i}) AS j{i}' for i in range(1, 7))}
    FROM season_inputs a JOIN season_inputs b ON a.machine_id = b.machine_id AND b.step <= a.step
    AND (a.step - b.step) % 12 = 0 GROUP BY ALL""",
    "season_inputs",
)
step(
    "season_rows",
    f"""SELECT a.machine_id, a.step, any_value(a.e) AS e, [any_value(a.j1), any_value(a.j2), any_value(a.j3), any_value(a.j4),
    any_value(a.j5), any_value(a.j6), coalesce(-sum(pow(-{_STHETA}::double, (a.step - 12 - b.step) // 12) * b.e), 0), any_value(a.e)] AS z
    FROM season_shocks a LEFT JOIN season_shocks b ON a.machine_id = b.machine_id AND b.step <= a.step - 12
    AND (a.step - b.step) % 12 = 0 GROUP BY ALL""",
    "season_shocks",
)
normal_equations("season_sums", "season_rows", 7)
linear_solver("season", "season_sums")
_START = [*_PHI, _SPHI, _STHETA]
oracle(
    "seasonal_ma_step",
    f"""SELECT machine_id, n, {r('squares', 'sum_squares', 6)},
    list_transform(m, lambda x: {rounded('x[8]', 6)}) AS slope,
    list_transform(range(1, 8), lambda i: {rounded(f'({_START}::double[])[i] - phi[i]', 6)}) AS params
    FROM season_solved JOIN season_sums USING (machine_id)
    JOIN (SELECT machine_id, count(*) AS n, sum(e * e) AS squares FROM season_rows GROUP BY 1) USING (machine_id) WHERE n > 7""",
    "season_solved",
    "season_sums",
    "season_rows",
)

# The exact likelihood of one lag on first differences, filtered step by step.
step(
    "one_lag",
    """SELECT machine_id, sum(w * before) / sum(before * before) AS phi, any_value(n) AS n FROM (SELECT machine_id, w,
    lag(w) OVER (PARTITION BY machine_id ORDER BY step) AS before, count(*) OVER (PARTITION BY machine_id) AS n FROM changes)
    GROUP BY 1 HAVING any_value(n) >= 20""",
    "changes",
)
step(
    "likelihood_walk",
    """SELECT machine_id, 0::bigint AS step, phi, 0.0::double AS state, 1 / (1 - phi * phi) AS spread, 0.0::double AS squares,
    0.0::double AS logs FROM one_lag WHERE abs(phi) < 1
    UNION ALL SELECT t.machine_id, c.step, t.phi, t.phi * t.state + t.phi * (c.w - t.state),
    t.phi * t.phi * t.spread + 1 - t.phi * t.phi * t.spread, t.squares + pow(c.w - t.state, 2) / t.spread, t.logs + ln(t.spread)
    FROM likelihood_walk t JOIN changes c ON c.machine_id = t.machine_id AND c.step = t.step + 1""",
    "one_lag",
    "changes",
)
step(
    "likelihoods",
    """SELECT machine_id, squares / step AS noise, -0.5 * (step * (ln(2 * pi() * squares / step) + 1) + logs) AS found
    FROM (SELECT *, max(step) OVER (PARTITION BY machine_id) AS last FROM likelihood_walk) WHERE step = last""",
    "likelihood_walk",
)
oracle(
    "ar1_likelihood",
    f"""SELECT machine_id, {r('found', 'log_likelihood', 6)}, {r('noise', 'noise', 6)}, {r('4 - 2 * found', 'aic', 6)}
    FROM one_lag LEFT JOIN likelihoods USING (machine_id)""",
    "one_lag",
    "likelihoods",
)
# A small recurrent network: its fixed weights, then state by state, then the pooled readout.
_INNER, _INTO, _SHIFT = (w.tolist() for w in Network(units=4, lags=2).weights())


def _state(state: str, value: str) -> str:
    """The state after a value."""
    return f"""list_transform(range(1, 5), lambda i: tanh(list_dot_product(({_INNER}::double[][])[i], {state})
    + {value} * ({_INTO}::double[])[i] + ({_SHIFT}::double[])[i]))"""


step(
    "net_series",
    """SELECT machine_id, at_step, n, low, span, CASE WHEN span > 0 THEN (y - low) / span ELSE 0 END AS x FROM (
    SELECT machine_id, y, row_number() OVER o AS at_step, count(*) OVER m AS n, min(y) OVER m AS low,
    max(y) OVER m - min(y) OVER m AS span FROM series
    WINDOW o AS (PARTITION BY machine_id ORDER BY step), m AS (PARTITION BY machine_id))""",
    "series",
)
step(
    "net_walk",
    f"""SELECT machine_id, 0::bigint AS at_step, 0.0::double AS x, 0.0::double AS before, [0.0, 0.0, 0.0, 0.0]::double[] AS state
    FROM net_series WHERE at_step = 1
    UNION ALL SELECT t.machine_id, s.at_step, s.x, t.x, {_state('t.state', 's.x')}
    FROM net_walk t JOIN net_series s ON s.machine_id = t.machine_id AND s.at_step = t.at_step + 1""",
    "net_series",
)
step(
    "net_rows",
    """SELECT 'all' AS pool, list_concat([1.0, w.x, w.before], w.state, [s.x]) AS z FROM net_walk w
    JOIN net_series s ON s.machine_id = w.machine_id AND s.at_step = w.at_step + 1 WHERE w.at_step >= 2 AND s.n >= 12""",
    "net_walk",
    "net_series",
)
normal_equations("net_sums", "net_rows", 7, "pool")
step(
    "net_ridge",
    """SELECT pool, list_transform(range(1, 8), lambda i: list_transform(range(1, 9), lambda j:
    m[i][j] + CASE WHEN i = j AND i > 1 THEN 1e-4 * m[1][1] ELSE 0 END)) AS m FROM net_sums""",
    "net_sums",
)
linear_solver("net", "net_ridge")
oracle(
    "recurrent_readout",
    f"""SELECT (i - 1)::int AS input, {r('phi[i]', 'weight', 6)} FROM net_solved, (SELECT unnest(range(1, 8)) AS i)""",
    "net_solved",
)
step(
    "net_ahead",
    f"""SELECT w.machine_id, 0 AS h, w.x, w.before, w.state, s.low, s.span, s.n FROM net_walk w
    JOIN net_series s ON s.machine_id = w.machine_id AND s.at_step = w.at_step AND s.at_step = s.n
    UNION ALL SELECT machine_id, h + 1, v, x, {_state('state', 'v')}, low, span, n FROM (
    SELECT *, list_dot_product(phi, list_concat([1.0, x, before], state)) AS v FROM net_ahead, net_solved WHERE h < 6)""",
    "net_walk",
    "net_series",
    "net_solved",
)
oracle(
    "forecast_recurrent",
    f"""SELECT machine_id, 'recurrent' AS strategy, h::int AS h,
    {r('CASE WHEN n >= 12 THEN least(1, greatest(0, low + span * x)) ELSE low + span * newest END', 'y_pred', 6)}
    FROM net_ahead JOIN (SELECT machine_id, x AS newest FROM net_ahead WHERE h = 0) USING (machine_id) WHERE h > 0""",
    "net_ahead",
)

# Noise named by seed, machine and step.
_UNIT = "(('0x' || substr(digest, {}, 13))::bigint + {}) / 4503599627370496.0::double"
step(
    "noise",
    f"""SELECT machine_id, h, 0.1 * spread * sqrt(-2 * ln({_UNIT.format(1, 1)})) * cos(2 * pi() * ({_UNIT.format(14, 0)})) AS noise
    FROM (SELECT machine_id, h, spread, md5('42:' || machine_id || ':' || h) AS digest
    FROM (SELECT machine_id, stddev_pop(y) AS spread FROM series GROUP BY 1), horizon)""",
    "series",
    "horizon",
)
step(
    "noisy",
    """SELECT machine_id, 0 AS h, tail, w FROM weighted WHERE h = 0
    UNION ALL SELECT t.machine_id, t.h + 1, list_append(tail[2:],
    least(1, greatest(0, list_dot_product(tail, w) / list_sum(w) + noise))), w
    FROM noisy t JOIN noise n ON n.machine_id = t.machine_id AND n.h = t.h + 1""",
    "weighted",
    "noise",
)
oracle(
    "forecast_weighted_noisy",
    f"""SELECT machine_id, 'weighted' AS strategy, h::int AS h, {r('tail[12]', 'y_pred')} FROM noisy WHERE h > 0
    UNION ALL SELECT machine_id, 'weighted', h, {rounded('least(1, greatest(0, last))')} FROM short, horizon""",
    "noisy",
    "short",
    "horizon",
)
oracle(
    "forecast_pooled",
    _forecast("lstm", "pooled_walk", "low + (high - low) * tail[12]", 22),
    "pooled_walk",
    "naive_for",
    "horizon",
)

# Routing: strategies out of simple labels (above or below average load and variability).


def routing(table: str, prefix: str = "") -> None:
    """Add ``{prefix}routes``: machine, workload type and strategy out of a table (machine_id, y)."""
    p, names = prefix, ("cpu_mean", "cpu_std", "cpu_cv")
    step(
        f"{p}described",
        f"""SELECT *, cpu_std / (cpu_mean + 1e-10) AS cpu_cv FROM (SELECT machine_id, avg(y) AS cpu_mean,
    stddev_samp(y) AS cpu_std FROM {table} GROUP BY 1)""",
        table,
    )
    step(
        f"{p}marked",
        "SELECT *, (cpu_mean > 0)::int + 2 * (cpu_cv > 0)::int AS cluster FROM (SELECT machine_id, "
        + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in names)
        + f" FROM {p}described)",
        f"{p}described",
    )
    step(
        f"{p}routes",
        f"""SELECT machine_id, cluster, workload_type, {_MODEL_NAME} AS strategy FROM {p}marked JOIN (
    SELECT cluster, {_TYPE} AS workload_type FROM (SELECT cluster, avg(cpu_mean) AS cpu_mean_mean,
    avg(cpu_cv) AS cpu_cv_mean FROM {p}marked GROUP BY 1)) USING (cluster)""",
        f"{p}marked",
    )


def routed_forecast(name: str, table: str, last: int, routes: str, prefix: str = "") -> None:
    """Add ``name`` (machine_id, strategy, h, y_pred): every machine by its own method."""
    p = prefix
    step(
        f"{p}bursty",
        f"SELECT machine_id, step, y FROM {table} JOIN {routes} USING (machine_id) WHERE strategy = 'lstm'",
        table,
        routes,
    )
    pooled_regression(f"{p}bursty", last, f"{p}bursty_")
    step(
        name,
        f"""SELECT machine_id, strategy, h, y_pred FROM {routes} JOIN (
    SELECT machine_id, 'arima' AS strategy, h, least(1, greatest(0, y)) AS y_pred FROM {p}ar_walk
    UNION ALL SELECT machine_id, 'seasonal_arima', h, least(1, greatest(0, ys[1])) FROM {p}seasonal_walk
    UNION ALL SELECT machine_id, 'lstm', h, least(1, greatest(0, low + (high - low) * tail[12])) FROM {p}bursty_pooled_walk
    UNION ALL SELECT machine_id, 'conservative', h, level FROM (SELECT machine_id, quantile_cont(y, 0.75) AS level
        FROM {table} GROUP BY 1), (SELECT unnest(range(1, {last + 1})) AS h)
    UNION ALL SELECT machine_id, unnest(['arima', 'seasonal_arima']), h, last FROM {p}naive_for,
        (SELECT unnest(range(1, {last + 1})) AS h) WHERE n < 20
    UNION ALL SELECT machine_id, 'lstm', h, last FROM {p}naive_for,
        (SELECT unnest(range(1, {last + 1})) AS h) WHERE n < 22)
    USING (machine_id, strategy) WHERE h > 0""",
        routes,
        table,
        f"{p}ar_walk",
        f"{p}seasonal_walk",
        f"{p}bursty_pooled_walk",
        f"{p}naive_for",
    )


routing("series")
routed_forecast("routed", "series", 6, "routes")
oracle("forecast_routed", f"SELECT machine_id, strategy, h::int AS h, {r('y_pred', 'y_pred')} FROM routed", "routed")
step(
    "cmp_split",
    """SELECT *, step + 1 - cut AS h FROM (SELECT *, n * 0.8::double AS part, floor(n * 0.8::double)::bigint AS cut FROM (
    SELECT *, count(*) OVER (PARTITION BY machine_id) AS n FROM series) WHERE n >= 50)""",
    "series",
)
step("cmp_train", "SELECT machine_id, step, y FROM cmp_split WHERE h <= 0", "cmp_split")
step("cmp_test", "SELECT machine_id, h, y FROM cmp_split WHERE h > 0", "cmp_split")
least_squares("cmp_train", LONGEST_TEST, "cmp_")
pooled_regression("cmp_train", LONGEST_TEST, "cmp_")
routed_forecast("cmp_routed", "cmp_train", LONGEST_TEST, "routes", "cmp_")
oracle(
    "comparison_routed",
    f"""SELECT machine_id, workload_type, strategy AS hybrid_strategy,
    {', '.join(r(f'sqrt(avg(pow(a.y - {v}, 2)))', f'{n}_rmse', 6) + ', ' + r(f'avg(abs((a.y - {v}) / (a.y + 1e-10))) * 100', f'{n}_mape', 6) for n, v in (('arima', 'arima'), ('lstm', 'lstm'), ('hybrid', 'y_pred')))}
    FROM cmp_test a
    JOIN (SELECT machine_id, h, least(1, greatest(0, y)) AS arima FROM cmp_ar_walk) USING (machine_id, h)
    JOIN (SELECT machine_id, h, least(1, greatest(0, low + (high - low) * tail[12])) AS lstm FROM cmp_pooled_walk)
    USING (machine_id, h) JOIN cmp_routed USING (machine_id, h) JOIN routes USING (machine_id, strategy) GROUP BY 1, 2, 3""",
    "cmp_test",
    "cmp_ar_walk",
    "cmp_pooled_walk",
    "cmp_routed",
    "routes",
)

# --- policies --------------------------------------------------------------------------------

_UP, _DOWN = "u > 0.75", "u < 0.40"
_ACTION = f"CASE WHEN {_UP} THEN 'scale_up' WHEN {_DOWN} THEN 'scale_down' ELSE 'keep' END"
_CONFIDENCE = f"least(CASE WHEN {_UP} OR {_DOWN} THEN abs(u - 0.5) / 0.5 ELSE 1 - abs(u - 0.5) / 0.5 END, 1)"


def _next(up: str = "0.75", down: str = "0.40") -> str:
    return f"""CASE WHEN u > {up} THEN least(cap * 1.25::double, 1.0::double)
    WHEN u < {down} THEN greatest(cap / 1.25::double, 0.1::double, p * 1.2::double) ELSE cap END"""


step(
    "decisions",
    f"""SELECT machine_id, cap AS current_capacity, p AS predicted_usage, {_ACTION} AS action,
    {_next()} AS recommended_capacity, {_CONFIDENCE} AS confidence FROM (
    SELECT machine_id, request_mean AS cap, cpu_mean AS p, cpu_mean / (request_mean + 1e-10) AS u FROM profiles)""",
    "profiles",
)
oracle(
    "scaling_decisions",
    f"SELECT machine_id, action, {rs('current_capacity predicted_usage recommended_capacity confidence')} FROM decisions",
    "decisions",
)
oracle("action_distribution", "SELECT action, count(*) AS n FROM decisions GROUP BY 1", "decisions")
step("static", "SELECT machine_id, step, y, max(y) OVER (PARTITION BY machine_id) * 1.2::double AS capacity FROM series", "series")
step("averaged", "SELECT machine_id, step, y, greatest(predicted * 1.2::double, 0.1::double) AS capacity FROM predicted", "predicted")
step("perfect", "SELECT machine_id, step, y, greatest(y * 1.1::double, 0.1::double) AS capacity FROM series", "series")


def _threshold(name: str, table: str, start: str, guard: str, cooldown: int) -> str:
    return f"""SELECT machine_id, -1::bigint AS step, {start} AS cap, 0 AS wait, NULL::double AS y FROM {table} GROUP BY 1
    UNION ALL SELECT machine_id, step,
    CASE WHEN wait > 0 THEN cap WHEN u > 0.8 THEN least(cap * 1.25::double, 1.0::double)
    WHEN u < 0.3 THEN greatest(cap / 1.25::double, {guard}0.1::double) ELSE cap END,
    CASE WHEN wait > 0 THEN wait - 1 WHEN u > 0.8 OR u < 0.3 THEN {cooldown} ELSE 0 END, y FROM (
    SELECT t.machine_id, s.step, t.cap, t.wait, s.y, s.y / (t.cap + 1e-10) AS u
    FROM {name} t JOIN {table} s ON s.machine_id = t.machine_id AND s.step = t.step + 1)"""


_MEDIAN, _FIRST = "quantile_cont(y, 0.5) * 1.5::double", "arg_min(y, step) * 1.5::double"
step("scaler", _threshold("scaler", "series", _MEDIAN, "y * 1.2::double, ", 3), "series")
step("simple_scaler", _threshold("simple_scaler", "series", _FIRST, "", 0), "series")
step("first_scaler", _threshold("first_scaler", "series", _FIRST, "y * 1.2::double, ", 3), "series")
step("cleaned_scaler", _threshold("cleaned_scaler", "cleaned_series", _MEDIAN, "y * 1.2::double, ", 3), "cleaned_series")
step("threshold", "SELECT machine_id, step, y, cap AS capacity FROM scaler WHERE step >= 0", "scaler")
step("threshold_plain", "SELECT machine_id, step, y, cap AS capacity FROM simple_scaler WHERE step >= 0", "simple_scaler")
step(
    "policy_walk",
    f"""SELECT machine_id, -1::bigint AS step, NULL::double AS before, arg_min(predicted, step) * 1.3::double AS cap,
    NULL::double AS p, NULL::double AS u, NULL::double AS y FROM predicted GROUP BY 1
    UNION ALL SELECT machine_id, step, cap, {_next()}, p, u, y FROM (
    SELECT t.machine_id, s.step, t.cap, s.predicted AS p, s.predicted / (t.cap + 1e-10) AS u, s.y
    FROM policy_walk t JOIN predicted s ON s.machine_id = t.machine_id AND s.step = t.step + 1)""",
    "predicted",
)
step(
    "policy",
    f"""SELECT machine_id, step, before AS current_capacity, p AS predicted, {_ACTION} AS action, cap AS capacity,
    {_CONFIDENCE} AS confidence, y FROM policy_walk WHERE step >= 0""",
    "policy_walk",
)
for _name, _table in (
    ("static_capacity", "static"),
    ("moving_average_capacity", "averaged"),
    ("oracle_capacity", "perfect"),
    ("threshold_capacity", "threshold"),
    ("threshold_simple", "threshold_plain"),
):
    oracle(_name, f"SELECT machine_id, step, {rs('capacity')} FROM {_table}", _table)
oracle(
    "stream_threshold",
    f"SELECT machine_id, step, {r('cap', 'capacity')} FROM first_scaler WHERE step >= 0",
    "first_scaler",
)
oracle(
    "policy_capacity",
    f"SELECT machine_id, step, action, {rs('current_capacity predicted capacity confidence')} FROM policy",
    "policy",
)
step("train_last", "SELECT machine_id, arg_max(y, step) AS last FROM train GROUP BY 1", "train")
step(
    "replay",
    f"""SELECT machine_id, 0 AS h, NULL::double AS p, NULL::double AS u, last * 1.3::double AS cap FROM train_last
    UNION ALL SELECT machine_id, h, p, u, {_next()} FROM (
    SELECT t.machine_id, w.h, w.y_pred AS p, w.y_pred / (t.cap + 1e-10) AS u, t.cap FROM replay t
    JOIN weighted_values w ON w.machine_id = t.machine_id AND w.h = t.h + 1)""",
    "train_last",
    "weighted_values",
)
oracle(
    "policy_replay",
    f"SELECT machine_id, h, {r('p', 'y_pred')}, {_ACTION} AS action, {r('cap', 'capacity')} FROM replay WHERE h > 0",
    "replay",
)
oracle(
    "policy_backtest",
    f"""SELECT machine_id, {r('sum(capacity)', 'total_cost', 6)},
    count(*) FILTER (y > capacity * 0.9::double) AS sla_violations,
    {r('avg((y > capacity * 0.9::double)::int) * 100', 'sla_violation_rate', 6)},
    {r('avg(capacity)', 'avg_capacity', 6)}, {r('avg(y) / avg(capacity)', 'avg_utilization', 6)} FROM policy GROUP BY 1""",
    "policy",
)


def _stack(**tables: str) -> str:
    return " UNION ALL ".join(
        f"SELECT machine_id, step, '{name}' AS strategy, capacity, y AS usage FROM {table}" for name, table in tables.items()
    )


step(
    "strategies",
    _stack(static="static", threshold="threshold_plain", proposed="policy", oracle="perfect"),
    "static",
    "threshold_plain",
    "policy",
    "perfect",
)
step(
    "baselines",
    _stack(static="static", threshold="threshold", moving_average="averaged"),
    "static",
    "threshold",
    "averaged",
)
oracle(
    "strategy_capacities",
    f"SELECT machine_id, step, strategy, {rs('capacity usage')} FROM strategies",
    "strategies",
)

# --- metrics ---------------------------------------------------------------------------------

_HOURS = "(5 / 60.0::double)"
_COST = f"sum(capacity) * {_HOURS} * 0.05::double"
_WASTE = f"sum(greatest(0, capacity - usage)) * {_HOURS} * 0.05::double"
_USE = "avg(usage / (capacity + 1e-10))"
_LATE = "usage > capacity * 0.95::double"
_RATE = f"avg(({_LATE})::int) * 100"


def _errors(a: str, p: str, digits: int = 6) -> str:
    return f"""{r(f'sqrt(avg(pow({a} - {p}, 2)))', 'rmse', digits)}, {r(f'avg(abs({a} - {p}))', 'mae', digits)},
    {r(f"coalesce(avg(abs(({a} - {p}) / {a})) FILTER ({a} <> 0) * 100, 'infinity'::double)", 'mape', digits)}"""


step(
    "one_step",
    """SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY machine_id ORDER BY step) AS before FROM series)
    WHERE before IS NOT NULL""",
    "series",
)
oracle(
    "prediction_metrics",
    f"""SELECT machine_id, {_errors('y', 'before')},
    {r('avg(abs((y - before) / (y + 1e-10))) * 100', 'mape_epsilon', 6)},
    {r('coalesce(avg(2 * abs(y - before) / (abs(y) + abs(before))) FILTER (abs(y) + abs(before) <> 0) * 100, 0)', 'smape', 6)}
    FROM one_step GROUP BY 1""",
    "one_step",
)
oracle(
    "cost_metrics",
    f"""SELECT machine_id, strategy, {r(_COST, 'total_cost', 6)},
    {r(f'{_COST} + sum(usage) * {_HOURS} * 0.01::double', 'total_cost_with_memory', 6)}, {r(_WASTE, 'wasted_cost', 6)},
    {r('sum(usage) / (sum(capacity) + 1e-10)', 'cost_efficiency', 6)} FROM baselines GROUP BY 1, 2""",
    "baselines",
)
oracle(
    "sla_metrics",
    f"""SELECT machine_id, strategy, count(*) FILTER ({_LATE}) AS sla_violation_count,
    {r(_RATE, 'sla_violation_rate', 6)}, {r(f'100 - {_RATE}', 'sla_compliance_rate', 6)} FROM baselines GROUP BY 1, 2""",
    "baselines",
)
oracle(
    "utilisation_metrics",
    f"""SELECT machine_id, strategy, {r(_USE, 'avg_utilization', 6)},
    {r('var_pop(usage / (capacity + 1e-10))', 'utilization_variance', 6)},
    {r('avg(capacity / (usage + 1e-10))', 'over_provision_ratio', 6)} FROM baselines GROUP BY 1, 2""",
    "baselines",
)
oracle(
    "utilisation_series",
    f"SELECT machine_id, step, strategy, {r('usage / (capacity + 1e-10)', 'utilization')} FROM baselines",
    "baselines",
)


def _everything(digits: int, reduction: str = "") -> str:
    return f"""{_errors('usage', 'predicted', digits)}, {r(_COST, 'total_cost', digits)},
    {r(_WASTE, 'wasted_cost', digits)}, {r(_USE, 'avg_utilization', digits)},
    {r('avg(capacity / (usage + 1e-10))', 'over_provision_ratio', digits)},
    count(*) FILTER ({_LATE}) AS sla_violation_count, {r(_RATE, 'sla_violation_rate', digits)}{reduction}"""


step("policy_use", "SELECT policy.*, policy.y AS usage, static.capacity AS flat FROM policy JOIN static USING (machine_id, step)", "policy", "static")
_SAVED = ", " + r("(sum(flat) - sum(capacity)) / sum(flat) * 100", "cost_reduction_pct", 6)
oracle("all_metrics", f"SELECT machine_id, {_everything(6, _SAVED)} FROM policy_use GROUP BY 1", "policy_use")
oracle(
    "results_table",
    f"""SELECT 'proposed' AS method, {_everything(6)} FROM policy_use
    UNION ALL SELECT 'moving_average', {_everything(6)} FROM (
    SELECT averaged.*, averaged.y AS usage, predicted.predicted FROM averaged JOIN predicted USING (machine_id, step))""",
    "policy_use",
    "averaged",
    "predicted",
)

# --- comparisons -----------------------------------------------------------------------------


def _breakdown(table: str, by: str = "") -> str:
    return f"""SELECT {by}strategy, {_COST} AS total_cost, {_COST} AS compute_cost, {_WASTE} AS wasted_cost,
    {_USE} AS utilization, count(*) FILTER ({_LATE}) AS sla_violations FROM {table} GROUP BY ALL"""


def _saving(name: str, by: str = "") -> str:
    base = f"max(total_cost) FILTER ({name} = 'static') OVER ({by})"
    return f"CASE WHEN {base} = 0 THEN 0 ELSE ({base} - total_cost) / {base} * 100 END AS cost_reduction_pct"


_MONEY = "total_cost compute_cost wasted_cost utilization cost_reduction_pct"
step("comparison", f"SELECT *, {_saving('strategy')} FROM ({_breakdown('strategies')})", "strategies")
oracle("compare_strategies", f"SELECT strategy, sla_violations, {rs(_MONEY, 6)} FROM comparison", "comparison")
oracle(
    "compare_strategies_by_machine",
    f"""SELECT machine_id, strategy, sla_violations, {rs(_MONEY, 6)} FROM (
    SELECT *, {_saving('strategy', 'PARTITION BY machine_id')} FROM ({_breakdown('strategies', 'machine_id, ')}))""",
    "strategies",
)
oracle(
    "cost_report",
    """SELECT strategy, concat_ws(chr(10), 'Strategy: ' || upper(strategy),
    printf('  Total Cost:        $%.4f', total_cost), printf('  Wasted Cost:       $%.4f', wasted_cost),
    printf('  Utilization:       %.1f%%', utilization * 100), printf('  SLA Violations:    %d', sla_violations),
    printf('  Cost Reduction:    %.1f%%', cost_reduction_pct)) AS report FROM comparison""",
    "comparison",
)
step(
    "methods",
    "SELECT * FROM baselines UNION ALL SELECT machine_id, step, 'proposed', capacity, y FROM policy",
    "baselines",
    "policy",
)
oracle(
    "compare_baselines",
    f"""SELECT method, sla_violations, {rs('total_cost utilization sla_violation_rate cost_reduction_pct', 6)} FROM (
    SELECT *, {_saving('method')} FROM (
    SELECT strategy AS method, sum(cost) AS total_cost,
    sum(CASE WHEN strategy = 'static' THEN flat ELSE used END * n) / sum(n) * 100 AS utilization,
    sum(late)::bigint AS sla_violations, sum(late) / sum(n) * 100 AS sla_violation_rate FROM (
    SELECT machine_id, strategy, {_COST} AS cost, {_USE} AS used, avg(usage) / max(capacity) AS flat,
    count(*) FILTER ({_LATE}) AS late, count(*) AS n FROM methods GROUP BY 1, 2) GROUP BY 1))""",
    "methods",
)
step("limits", "SELECT * FROM (VALUES (0.65::double, 0.40::double), (0.75, 0.40), (0.85, 0.40), (0.75, 0.30)) AS v(up, down)")
step(
    "sweep",
    f"""SELECT machine_id, up, down, -1::bigint AS step, arg_min(predicted, step) * 1.3::double AS cap, NULL::double AS y
    FROM predicted, limits GROUP BY 1, 2, 3
    UNION ALL SELECT machine_id, up, down, step, {_next('up', 'down')}, y FROM (
    SELECT t.machine_id, up, down, s.step, t.cap, s.predicted AS p, s.predicted / (t.cap + 1e-10) AS u, s.y
    FROM sweep t JOIN predicted s ON s.machine_id = t.machine_id AND s.step = t.step + 1)""",
    "predicted",
    "limits",
)
oracle(
    "threshold_sweep",
    f"""SELECT up, down, {r(_COST, 'total_cost', 6)},
    {r('(sum(flat) - sum(capacity)) / sum(flat) * 100', 'cost_reduction', 6)}, {r(_USE, 'utilization', 6)},
    {r(_RATE, 'sla_violations', 6)} FROM (SELECT sweep.up, sweep.down, sweep.cap AS capacity, sweep.y AS usage,
    static.capacity AS flat FROM sweep JOIN static USING (machine_id, step)) GROUP BY 1, 2""",
    "sweep",
    "static",
)
step(
    "cleaned_baselines",
    f"""SELECT machine_id, step, 'static' AS strategy, max(y) OVER (PARTITION BY machine_id) * 1.2::double AS capacity,
    y AS usage FROM cleaned_series
    UNION ALL SELECT machine_id, step, 'threshold', cap, y FROM cleaned_scaler WHERE step >= 0
    UNION ALL SELECT machine_id, step, 'moving_average', greatest(({_MOVING}) * 1.2::double, 0.1::double), y FROM cleaned_series""",
    "cleaned_series",
    "cleaned_scaler",
)
oracle(
    "cleaned_costs",
    f"""SELECT strategy, sla_violations, {rs(_MONEY, 6)} FROM (
    SELECT *, {_saving('strategy')} FROM ({_breakdown('cleaned_baselines')}))""",
    "cleaned_baselines",
)

# --- extras ----------------------------------------------------------------------------------

oracle(
    "autocorrelation",
    f"SELECT machine_id, {r('corr(y, before)', 'autocorrelation', 6)} FROM one_step GROUP BY 1",
    "one_step",
)
oracle(
    "peak_to_mean",
    f"SELECT machine_id, {r('max(y) / avg(y)', 'peak_to_mean')} FROM series GROUP BY 1",
    "series",
)
oracle(
    "buffered_capacity",
    f"""SELECT machine_id, {rs('sigma predicted allocated', 6)},
    CASE WHEN allocated > 1.0 THEN 'scale_up' WHEN 1.0 - allocated > 0.3 THEN 'scale_down' ELSE 'keep' END AS action,
    {r('CASE WHEN allocated > 1.0 OR 1.0 - allocated > 0.3 THEN allocated ELSE 1.0::double END', 'capacity', 6)} FROM (
    SELECT *, ceil((predicted + 2.33::double * sigma) / 0.25::double) * 0.25::double AS allocated FROM (
    SELECT machine_id, stddev_samp(y - before) AS sigma, arg_max(y, step) AS predicted FROM one_step GROUP BY 1))""",
    "one_step",
)
oracle(
    "penalised_cost",
    f"""SELECT machine_id, strategy,
    {r('sum(capacity * 0.05::double) + sum(greatest(0, capacity - usage) * 0.02::double)', 'penalised_cost', 6)}
    FROM baselines GROUP BY 1, 2""",
    "baselines",
)
oracle(
    "margin_capacity",
    f"SELECT machine_id, {r('cpu_mean * (1 + cpu_cv)', 'capacity')} FROM profiles",
    "profiles",
)

# --- the experiment on routed machines -------------------------------------------------------

step("cleaned_fine", _windowed("cleaned", 5), "cleaned")
step(
    "exp_series",
    """SELECT machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY time) - 1 AS step,
    average_usage_mean AS y FROM cleaned_fine""",
    "cleaned_fine",
)
step(
    "exp_split",
    """SELECT *, step + 1 - cut AS h FROM (SELECT *, floor(n * 0.8::double)::bigint AS cut FROM (
    SELECT *, count(*) OVER (PARTITION BY machine_id) AS n FROM exp_series) WHERE n >= 6)""",
    "exp_series",
)
step("exp_train", "SELECT machine_id, step, y FROM exp_split WHERE h <= 0", "exp_split")
step("exp_test", "SELECT machine_id, h - 1 AS step, h, y FROM exp_split WHERE h > 0", "exp_split")
routing("exp_series", "exp_")
least_squares("exp_train", LONGEST_TEST, "exp_")
routed_forecast("exp_routed", "exp_train", LONGEST_TEST, "exp_routes", "exp_")
step("exp_forecast", "SELECT machine_id, h, y, y_pred FROM exp_test JOIN exp_routed USING (machine_id, h)", "exp_test", "exp_routed")
step(
    "exp_replay",
    f"""SELECT machine_id, 0::bigint AS h, arg_max(y, step) * 1.3::double AS cap, NULL::double AS y FROM exp_train GROUP BY 1
    UNION ALL SELECT machine_id, h, {_next()}, y FROM (SELECT t.machine_id, f.h, f.y, f.y_pred AS p,
    f.y_pred / (t.cap + 1e-10) AS u, t.cap FROM exp_replay t JOIN exp_forecast f
    ON f.machine_id = t.machine_id AND f.h = t.h + 1)""",
    "exp_train",
    "exp_forecast",
)
step("exp_scaler", _threshold("exp_scaler", "exp_test", _MEDIAN, "y * 1.2::double, ", 3), "exp_test")
step(
    "exp_methods",
    f"""SELECT machine_id, 'static' AS strategy, max(y) OVER (PARTITION BY machine_id) * 1.2::double AS capacity, y AS usage
    FROM exp_test
    UNION ALL SELECT machine_id, 'threshold', cap, y FROM exp_scaler WHERE step >= 0
    UNION ALL SELECT machine_id, 'moving_average', greatest(({_MOVING}) * 1.2::double, 0.1::double), y FROM exp_test
    UNION ALL SELECT machine_id, 'proposed', cap, y FROM exp_replay WHERE h > 0""",
    "exp_test",
    "exp_scaler",
    "exp_replay",
)
oracle(
    "experiment_routed",
    f"""SELECT upper(strategy[1:1]) || strategy[2:] AS method, sla_violations,
    {rs('total_cost cost_reduction_pct utilization_pct sla_violation_rate rmse mae mape', 6)} FROM (
    SELECT *, {_saving('strategy')} FROM (SELECT strategy, sum(cost) AS total_cost,
    sum(CASE WHEN strategy = 'static' THEN flat ELSE used END * n) / sum(n) * 100 AS utilization_pct,
    sum(late)::bigint AS sla_violations, sum(late) / sum(n) * 100 AS sla_violation_rate FROM (
    SELECT machine_id, strategy, {_COST} AS cost, {_USE} AS used, avg(usage) / max(capacity) AS flat,
    count(*) FILTER ({_LATE}) AS late, count(*) AS n FROM exp_methods GROUP BY 1, 2) GROUP BY 1)),
    (SELECT sqrt(avg(pow(y - y_pred, 2))) AS rmse, avg(abs(y - y_pred)) AS mae,
    coalesce(avg(abs((y - y_pred) / y)) FILTER (y <> 0) * 100, 'infinity'::double) AS mape FROM exp_forecast)""",
    "exp_methods",
    "exp_forecast",
)

# The same for several numbers of clusters: the simple label folded to so many.
_NUMBERS = (2, 3, 4)
step(
    "sweep_marked",
    f"SELECT machine_id, cpu_mean, cpu_cv, cluster % k AS cluster, k FROM exp_marked, (SELECT unnest({list(_NUMBERS)}) AS k)",
    "exp_marked",
)
step(
    "sweep_routes",
    f"""SELECT k, machine_id, {_MODEL_NAME} AS strategy FROM sweep_marked JOIN (
    SELECT k, cluster, {_TYPE} AS workload_type FROM (SELECT k, cluster, avg(cpu_mean) AS cpu_mean_mean,
    avg(cpu_cv) AS cpu_cv_mean FROM sweep_marked GROUP BY 1, 2)) USING (k, cluster)""",
    "sweep_marked",
)
for _k in _NUMBERS:
    step(f"sweep{_k}_routes", f"SELECT machine_id, strategy FROM sweep_routes WHERE k = {_k}", "sweep_routes")
    for _name in ("ar_walk", "seasonal_walk", "naive_for"):
        step(f"sweep{_k}_{_name}", f"SELECT * FROM exp_{_name}", f"exp_{_name}")
    routed_forecast(f"sweep{_k}_routed", "exp_train", LONGEST_TEST, f"sweep{_k}_routes", f"sweep{_k}_")
step(
    "sweep_forecast",
    "SELECT k, machine_id, h, y, y_pred FROM exp_test JOIN ("
    + " UNION ALL ".join(f"SELECT {_k} AS k, * FROM sweep{_k}_routed" for _k in _NUMBERS)
    + ") USING (machine_id, h)",
    "exp_test",
    *(f"sweep{_k}_routed" for _k in _NUMBERS),
)
step(
    "sweep_replay",
    f"""SELECT k, machine_id, 0::bigint AS h, cap, NULL::double AS y FROM (SELECT machine_id,
    arg_max(y, step) * 1.3::double AS cap FROM exp_train GROUP BY 1), (SELECT unnest({list(_NUMBERS)}) AS k)
    UNION ALL SELECT k, machine_id, h, {_next()}, y FROM (SELECT t.k, t.machine_id, f.h, f.y, f.y_pred AS p,
    f.y_pred / (t.cap + 1e-10) AS u, t.cap FROM sweep_replay t JOIN sweep_forecast f
    ON f.k = t.k AND f.machine_id = t.machine_id AND f.h = t.h + 1)""",
    "exp_train",
    "sweep_forecast",
)
oracle(
    "cluster_sweep",
    f"""SELECT k::int AS n_clusters, {r('(static - sum(cost)) / static * 100', 'cost_reduction', 6)},
    {r('sum(used * n) / sum(n)', 'utilization', 6)}, {r('sum(late) / sum(n) * 100', 'sla_violations', 6)} FROM (
    SELECT k, machine_id, {_COST} AS cost, {_USE} AS used, count(*) FILTER ({_LATE}) AS late, count(*) AS n FROM (
    SELECT k, machine_id, cap AS capacity, y AS usage FROM sweep_replay WHERE h > 0) GROUP BY 1, 2), (
    SELECT {_COST} AS static FROM (SELECT max(y) OVER (PARTITION BY machine_id) * 1.2::double AS capacity FROM exp_test))
    GROUP BY k, static""",
    "sweep_replay",
    "exp_test",
)

# --- steps of k-means, labellings against each other -----------------------------------------

_OFF = " + ".join(f"pow(f.{c} - c.{c}, 2)" for c in FEATURES)
_MEANS = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
step("lloyd0", f"SELECT row_number() OVER (ORDER BY cluster) - 1 AS slot, {_MEANS} FROM quadrants GROUP BY cluster", "quadrants")
for _i in (1, 2, 3):
    step(
        f"lloyd_near{_i}",
        f"""SELECT * FROM (SELECT f.*, c.slot, {_OFF} AS off,
    row_number() OVER (PARTITION BY f.machine_id ORDER BY {_OFF}, c.slot) AS near
    FROM features f, lloyd{_i - 1} c) WHERE near = 1""",
        "features",
        f"lloyd{_i - 1}",
    )
    step(f"lloyd{_i}", f"SELECT slot, {_MEANS} FROM lloyd_near{_i} GROUP BY slot", f"lloyd_near{_i}")
oracle(
    "kmeans_steps",
    f"""SELECT slot AS cluster, n, {rs('cost ' + ' '.join(FEATURES), 6)} FROM lloyd2
    JOIN (SELECT slot, count(*) AS n FROM lloyd_near3 GROUP BY 1) USING (slot), (SELECT sum(off) AS cost FROM lloyd_near3)""",
    "lloyd2",
    "lloyd_near3",
)
_FOLDS = (2, 3)
step("folded", f"SELECT id, x, k, cluster % k AS cluster FROM emb, (SELECT unnest({list(_FOLDS)}) AS k)", "emb")
step(
    "folded_values",
    """SELECT k, cluster, pos, avg(v) AS v, count(*) AS n FROM (
    SELECT k, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM folded) GROUP BY 1, 2, 3""",
    "folded",
)
step("folded_centres", "SELECT k, cluster, list(v ORDER BY pos) AS centre FROM folded_values GROUP BY 1, 2", "folded_values")
step(
    "folded_spread",
    """SELECT k, inertia, (b / (clusters - 1)) / (inertia / (n - clusters)) AS calinski_harabasz FROM (
    SELECT k, sum(pow(list_distance(x, centre), 2)) AS inertia, count(*) AS n, count(DISTINCT cluster) AS clusters
    FROM folded JOIN folded_centres USING (k, cluster) GROUP BY 1) JOIN (
    SELECT k, sum(a.n * pow(a.v - m, 2)) AS b FROM folded_values a JOIN (
        SELECT pos, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM emb) GROUP BY 1)
    USING (pos) GROUP BY 1) USING (k)""",
    "folded",
    "folded_centres",
    "folded_values",
    "emb",
)
for _name, _total in (("k_sweep_fixed", "list_distance(a.x, b.x)"), ("k_sweep_squared", "pow(list_distance(a.x, b.x), 2)")):
    # a label takes part in all silhouettes of its own number of clusters only
    step(
        f"{_name}_means",
        f"""SELECT a.k, a.id, a.cluster AS own, b.cluster, sum({_total}) AS total, count(*) AS n
    FROM folded a JOIN folded b USING (k) GROUP BY 1, 2, 3, 4""",
        "folded",
    )
    _scores = _SILHOUETTE.format(table=f"{_name}_means").replace("SELECT own,", "SELECT k,", 1).replace("BY id,", "BY k, id,")
    step(f"{_name}_scores", f"SELECT k, avg(s) AS silhouette FROM ({_scores}) GROUP BY 1", f"{_name}_means")
    oracle(
        _name,
        f"SELECT k::int AS k, {rs('inertia silhouette calinski_harabasz', 6)} FROM folded_spread JOIN {_name}_scores USING (k)",
        "folded_spread",
        f"{_name}_scores",
    )
oracle(
    "best_k_swept",
    "SELECT k::int AS k FROM k_sweep_squared_scores ORDER BY silhouette DESC, k LIMIT 1",
    "k_sweep_squared_scores",
)

oracle(
    "read_report",
    """SELECT 'a' AS folder, 'read' AS status, count(*) FILTER (event_id % 13 <> 0) AS n_rows,
    count(*) FILTER (event_id % 13 = 0) AS n_without_time, 0::bigint AS n_bad FROM trace WHERE event_id % 3 = 0
    UNION ALL SELECT 'b', 'other header', 0, 0, 0""",
    "trace",
)

# --- quantiles per machine -------------------------------------------------------------------

_GAP = "(epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY machine_id ORDER BY time))) / 1000000.0::double"
oracle(
    "gap_quartiles",
    "SELECT machine_id, "
    + ", ".join(r(f"quantile_cont(gap, {p})", n, 4) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    + f" FROM (SELECT machine_id, {_GAP} AS gap FROM trace) WHERE gap IS NOT NULL GROUP BY 1",
    "trace",
)
oracle("conservative_levels", f"SELECT machine_id, {r('quantile_cont(y, 0.75)', 'level')} FROM series GROUP BY 1", "series")
oracle("autoscaler_starts", f"SELECT machine_id, {r('quantile_cont(y, 0.5) * 1.5', 'capacity')} FROM series GROUP BY 1", "series")

# --- the same results by the paths that large tables take ------------------------------------

for _name, _like in (
    ("fill_missing_hot", "fill_missing"),
    ("time_gaps_hot", "time_gaps"),
    ("cap_outliers_narrowed", "cap_outliers_iqr"),
    ("silhouette_blocks", "silhouette_exact"),
    ("dbscan_blocks", "dbscan_labels"),
    ("dbscan_halo", "dbscan_labels"),
    ("k_distance_blocks", "k_distances"),
    ("models_stored", "forecast_weighted"),
    ("results_written", "compare_strategies"),
):
    ORACLES[_name] = ORACLES[_like]
step("hours", "SELECT * REPLACE (date_trunc('hour', time)::timestamp AS time) FROM trace", "trace")
step("hours_filled", STEPS["filled"][1].replace("FROM trace", "FROM hours"), "hours")
oracle(
    "fill_missing_hours",
    f"SELECT machine_id, event_id, time, {rs('average_usage assigned_memory')} FROM hours_filled",
    "hours_filled",
)
oracle(
    "drop_critical_nulls",
    f"""SELECT machine_id, event_id, time, {rs('average_usage')} FROM trace
    WHERE event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 107 <> 0""",
    "trace",
)
oracle(
    "normalise_times",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', time)::timestamp END AS time,
    date_trunc('second', time)::timestamp AS start_time, NULL::timestamp AS end_time FROM trace""",
    "trace",
)
oracle("busiest_machine", "SELECT machine_id, count(*) AS n_rows FROM trace GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "trace")
oracle(
    "preview",
    f"SELECT machine_id, event_id, time, {rs('average_usage')} FROM trace ORDER BY event_id LIMIT 5",
    "trace",
)
oracle(
    "busiest_machines_windows",
    "SELECT machine_id, n_observations FROM profiles ORDER BY 2 DESC, 1 LIMIT 100",
    "profiles",
)


def _raw(time: str = "time", memory: str = "assigned_memory", where: str = "") -> str:
    return f"""SELECT machine_id, event_id AS instance_index, {time} AS time, {rs('average_usage maximum_usage')},
    {r('CASE WHEN event_id % 5 <> 0 THEN resource_request END', 'resource_request')}, {r(memory, 'assigned_memory')}
    FROM trace WHERE event_id % 13 <> 0{where}"""


oracle("read_csv", _raw(), "trace")
oracle("read_csv_units", _raw("CASE WHEN event_id % 3 = 0 THEN date_trunc('second', time)::timestamp ELSE time END"), "trace")
oracle("read_groups", _raw(memory="CASE WHEN event_id % 3 = 0 THEN assigned_memory END"), "trace")
oracle(
    "read_parquet",
    f"SELECT machine_id, event_id, time, {rs('average_usage')} FROM trace WHERE event_id % 13 <> 0",
    "trace",
)
oracle(
    "forecast_values_written",
    f"SELECT machine_id, h, {r('y', 'actual')}, {rs('y_pred')} FROM test JOIN weighted_values USING (machine_id, h)",
    "test",
    "weighted_values",
)
ORACLES["forecast_ranges_written"] = ORACLES["forecast_values_written"]
step(
    "step_errors",
    """SELECT machine_id, sqrt(avg(pow(y - before, 2))) AS rmse, avg(abs(y - before)) AS mae,
    coalesce(avg(abs((y - before) / y)) FILTER (y <> 0) * 100, 'infinity'::double) AS mape FROM one_step GROUP BY 1""",
    "one_step",
)
oracle(
    "metrics_written",
    f"""SELECT machine_id, {rs('rmse mae mape', 6)} FROM step_errors
    UNION ALL SELECT 'average', {r('avg(rmse)', 'rmse', 6)}, {r('avg(mae)', 'mae', 6)}, {r('avg(mape)', 'mape', 6)}
    FROM step_errors""",
    "step_errors",
)
oracle("density_sizes", "SELECT cluster, count(*) AS size FROM dbscan GROUP BY 1", "dbscan")
step(
    "noisy_stats",
    f"SELECT *, {_TYPE} AS workload_type FROM (SELECT cluster - 1 AS cluster, count(*) AS size, "
    "count(*) / (SELECT count(*) FROM quadrants)::double * 100 AS percentage, "
    + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in FEATURES)
    + " FROM quadrants GROUP BY 1) WHERE cluster <> -1",
    "quadrants",
)
oracle(
    "cluster_stats_noise",
    f"SELECT cluster, size, workload_type, {rs('percentage ' + _STAT_COLUMNS, 6)} FROM noisy_stats",
    "noisy_stats",
)
oracle(
    "strategy_noise",
    f"""SELECT machine_id, cluster, workload_type, {_REPORT_NAME} AS prediction_strategy, {_MODEL_NAME} AS strategy FROM (
    SELECT machine_id, q.cluster - 1 AS cluster,
    CASE WHEN q.cluster = 0 THEN 'volatile' ELSE coalesce(s.workload_type, 'periodic') END AS workload_type
    FROM quadrants q LEFT JOIN (SELECT * FROM noisy_stats WHERE cluster < 2) s ON s.cluster = q.cluster - 1)""",
    "quadrants",
    "noisy_stats",
)
oracle(
    "kmeans_consistency",
    "SELECT count(*) AS n, least(4, count(*)) AS clusters, 0::bigint AS misplaced FROM features",
    "features",
)
oracle(
    "pca_consistency",
    f"SELECT count(*) AS n, {r('0::double', 'covariance', 6)}, {r('0::double', 'share1_error', 6)}, "
    f"{r('0::double', 'share2_error', 6)}, true AS ordered FROM features",
    "features",
)
oracle(
    "best_k",
    "SELECT cluster AS k FROM emb GROUP BY 1 ORDER BY avg(x[1]) DESC, 1 LIMIT 1",
    "emb",
)
_CMP_MEAN = ", ".join(
    r(f"avg({n}_{m})", f"{n}_{m}", 6) for n in ("arima", "lstm", "hybrid") for m in ("rmse", "mape")
)
step(
    "cmp_errors",
    f"""SELECT machine_id,
    {', '.join(f'sqrt(avg(pow(a.y - {v}, 2))) AS {n}_rmse, avg(abs((a.y - {v}) / (a.y + 1e-10))) * 100 AS {n}_mape' for n, v in (('arima', 'arima'), ('lstm', 'lstm'), ('hybrid', 'y_pred')))}
    FROM cmp_test a
    JOIN (SELECT machine_id, h, least(1, greatest(0, y)) AS arima FROM cmp_ar_walk) USING (machine_id, h)
    JOIN (SELECT machine_id, h, least(1, greatest(0, low + (high - low) * tail[12])) AS lstm FROM cmp_pooled_walk)
    USING (machine_id, h) JOIN cmp_routed USING (machine_id, h) GROUP BY 1""",
    "cmp_test",
    "cmp_ar_walk",
    "cmp_pooled_walk",
    "cmp_routed",
)
oracle("comparison_routed_averages", f"SELECT {_CMP_MEAN} FROM cmp_errors", "cmp_errors")
step("train_size", "SELECT machine_id, count(*) AS n FROM train GROUP BY 1", "train")
step(
    "continued",
    f"""SELECT machine_id, 0 AS h, list(y ORDER BY step) AS tail, {_WEIGHTS} AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY step DESC) AS back FROM series)
    JOIN train_size USING (machine_id) WHERE back <= 12 AND n >= 12 GROUP BY 1
    UNION ALL SELECT machine_id, h + 1, list_append(tail[2:],
    least(1, greatest(0, list_dot_product(tail, w) / list_sum(w)))), w FROM continued WHERE h < 6""",
    "series",
    "train_size",
)
oracle(
    "continued_forecast",
    f"""SELECT machine_id, 'weighted' AS strategy, h, {r('tail[12]', 'y_pred')} FROM continued WHERE h > 0
    UNION ALL SELECT machine_id, 'weighted', h, {rounded('least(1, greatest(0, last))')} FROM (
    SELECT machine_id, arg_max(y, step) AS last FROM series JOIN train_size USING (machine_id) WHERE n < 12 GROUP BY 1),
    horizon""",
    "continued",
    "series",
    "train_size",
    "horizon",
)
