"""Queries over the event series: trends, quality, levels, bounds, risks, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from .catalog import BOUNDS_SQL, RUL_SQL, S_SQL, T, _bounds, _events, _items, _rul, add

#: Means of the first and last thirds, slope and spread of each series; then the labels.
TREND = "CASE WHEN n < 2 OR a IS NULL OR a = 0 THEN 'stable' WHEN z > 10 THEN 'increasing_strong' WHEN z > 2 THEN 'increasing_moderate' WHEN z > 0.5 THEN 'increasing_slight' WHEN z < -10 THEN 'decreasing_strong' WHEN z < -2 THEN 'decreasing_moderate' WHEN z < -0.5 THEN 'decreasing_slight' ELSE 'stable' END"
THIRDS = ", th0 AS (SELECT asset, sensor, any_value(n) AS n, avg(value) FILTER (i < greatest(1, n // 3)) AS a, avg(value) FILTER (i >= n - (n + 2) // 3) AS b, avg(value) AS m, stddev_pop(value) AS sd, coalesce(regr_slope(value, i), 0) AS slope FROM x GROUP BY 1, 2), th AS (SELECT *, CASE WHEN a <> 0 THEN (b - a) / a * 100 END AS z FROM th0) "
CHAR = (
    THIRDS
    + f""", c0 AS (SELECT *, {TREND} AS trend, CASE WHEN m <> 0 THEN sd / abs(m) ELSE 0 END AS cv, abs(slope) * n AS strength FROM th WHERE n >= 10),
ch AS (SELECT asset, sensor, n, trend, CASE WHEN trend <> 'stable' THEN CASE WHEN strength > 0.1 THEN 'degrading' ELSE 'stable' END WHEN cv > 0.1 THEN 'high_variance' ELSE 'stable' END AS label,
  CASE WHEN trend <> 'stable' THEN CASE WHEN strength > 1 THEN 'high' WHEN strength > 0.1 THEN 'moderate' ELSE 'low' END WHEN cv > 0.2 THEN 'high' WHEN cv > 0.1 THEN 'moderate' ELSE 'low' END AS severity,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction, round(slope, 6) AS slope, round(strength, 3) AS strength, round(cv, 3) AS cv FROM c0) """
)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return series.characterize(_events(s, d))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """The sensors that weigh more are purchases here."""
    return series.priorities(_labels(s, d), _rul(s, d), ("purchase",))


add("series_stats", lambda s, d: series.statistics(_events(s, d)), S_SQL + "SELECT asset, sensor, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS low, max(value) AS high FROM s GROUP BY 1, 2", False)
add("sensor_trend", lambda s, d: series.trends(_events(s, d)), S_SQL + THIRDS + f"SELECT asset, sensor, n, round(a, 6) AS first_mean, round(b, 6) AS last_mean, {TREND} AS trend FROM th", False)
add(
    "data_quality",
    lambda s, d: series.quality(_events(s, d)),
    S_SQL
    + """, w AS (SELECT asset, sensor, value, count(*) OVER g AS n, avg(value) OVER g AS m, stddev_pop(value) OVER g AS sd, (max(value) OVER g - min(value) OVER g) / 2 AS half FROM s WINDOW g AS (PARTITION BY asset, sensor)),
    q AS (SELECT asset, sensor, count(*) AS n, count(*) FILTER (n > 3 AND abs(value - m) > 3 * sd) AS outliers, min(value) = max(value) AS constant, count(*) FILTER (n > 1 AND abs(value - m) > half) AS outlier_count FROM w GROUP BY 1, 2)
    SELECT *, 100 - CASE WHEN outliers > 0 THEN 20 ELSE 0 END - CASE WHEN constant THEN 20 ELSE 0 END AS score FROM q""",
    False,
)
LEVEL_SQL = (
    S_SQL
    + """, g AS (SELECT asset, sensor, count(*) AS n, date_diff('microsecond', min(t), max(t)) / 1000000.0::DOUBLE AS span FROM s GROUP BY 1, 2),
    lv AS (SELECT * FROM (VALUES ('individual', 0, 0.0::DOUBLE), ('minute', 1, 60.0), ('hour', 2, 3600.0), ('day', 3, 86400.0), ('week', 4, 604800.0), ('month', 5, 2592000.0), ('quarter', 6, 7776000.0)) v(level, place, seconds)),
    k AS (SELECT *, CASE WHEN seconds = 0 THEN n WHEN span > 0 THEN greatest(1.0::DOUBLE, span / seconds) ELSE 1.0::DOUBLE END AS groups FROM g, lv),
    sc AS (SELECT *, n / groups AS per_group, CASE WHEN groups < 10 THEN (10 - groups) * -2 WHEN groups > 50 THEN (groups - 50) * -1.5::DOUBLE ELSE 100 - abs(groups - 30) END + least(50.0::DOUBLE, n / groups * 0.5::DOUBLE) AS score, groups BETWEEN 10 AND 50 AS fits FROM k) """
)
add("temporal_level_scores", lambda s, d: series.level_scores(_events(s, d)).select("asset", "sensor", "level", F.round("groups", 4).alias("groups"), F.round("per_group", 4).alias("per_group"), F.round("score", 4).alias("score"), "fits"), LEVEL_SQL + "SELECT asset, sensor, level, round(groups, 4) AS groups, round(per_group, 4) AS per_group, round(score, 4) AS score, fits FROM sc", False)
add("temporal_level_choice", lambda s, d: series.chosen_level(_events(s, d)), LEVEL_SQL + "SELECT asset, sensor, level, n, round(groups, 4) AS groups, round(per_group, 4) AS per_group, round(groups / n, 6) AS efficiency, fits FROM sc QUALIFY row_number() OVER (PARTITION BY asset, sensor ORDER BY score DESC, place) = 1", False)
add("sensor_bounds", lambda s, d: series.bounds_check(_events(s, d), _bounds(s)), S_SQL + BOUNDS_SQL + "SELECT asset, sensor, t, value, status, margin FROM bc", False)
add("sensor_characterization", _labels, S_SQL + CHAR + "SELECT * FROM ch", False)
add(
    "sensor_risk_summary",
    lambda s, d: series.sensor_risks(_labels(s, d)),
    S_SQL + CHAR + """, r AS (SELECT sensor, count(*) AS total, count(*) FILTER (label = 'degrading') AS degrading, count(*) FILTER (label = 'stable') AS stable, count(*) FILTER (label = 'high_variance') AS high_variance FROM ch GROUP BY 1)
    SELECT *, round(degrading * 100.0::DOUBLE / total, 1) AS share, CASE WHEN degrading * 100.0 / total > 20 THEN 'High Risk' WHEN degrading * 100.0 / total > 5 THEN 'Moderate Risk' ELSE 'Low Risk' END AS risk FROM r""",
    False,
)
DECIDED = (
    RUL_SQL
    + """, de0 AS (SELECT asset, sensor, label, severity, coalesce(rul, 100) AS rul FROM ch LEFT JOIN rl USING (asset)),
    de1 AS (SELECT *, CASE label WHEN 'degrading' THEN 3 WHEN 'high_variance' THEN 2 ELSE 0 END + CASE severity WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END + CASE WHEN rul <= 10 THEN 4 WHEN rul <= 30 THEN 2 WHEN rul <= 50 THEN 1 ELSE 0 END + CASE WHEN sensor = 'purchase' THEN 1 ELSE 0 END AS score FROM de0),
    de AS (SELECT *, CASE WHEN score >= 7 THEN 'immediate_action' WHEN score >= 4 THEN 'near_term_watch' ELSE 'normal_monitoring' END AS level,
      CASE WHEN score >= 7 THEN 'critical' WHEN score >= 4 THEN 'elevated' ELSE 'routine' END AS urgency, CASE WHEN score >= 7 THEN 'immediate_inspection_required' WHEN score >= 4 THEN 'schedule_maintenance_window' ELSE 'continue_monitoring' END AS action,
      CASE WHEN score >= 7 THEN '0-10_cycles' WHEN score >= 4 THEN '11-30_cycles' ELSE '>30_cycles' END AS time_frame FROM de1),
    fl AS (SELECT count(*) AS total, count(*) FILTER (level = 'immediate_action') AS immediate, count(*) FILTER (level = 'near_term_watch') AS near_term, count(*) FILTER (level = 'normal_monitoring') AS normal FROM de) """
)
add("risk_priority", _decisions, S_SQL + CHAR + DECIDED + "SELECT * FROM de", False)
add("fleet_summary", lambda s, d: series.fleet_risks(_decisions(s, d)), S_SQL + CHAR + DECIDED + "SELECT *, round(immediate * 100.0::DOUBLE / total, 1) AS immediate_share, round(near_term * 100.0::DOUBLE / total, 1) AS near_term_share FROM fl", False)
add(
    "fleet_report",
    lambda s, d: series.fleet_report(_labels(s, d), _decisions(s, d), _rul(s, d), series.bounds_summary(_events(s, d), _bounds(s))),
    S_SQL + CHAR + DECIDED + BOUNDS_SQL + """, lf AS (SELECT count(*) AS engines, count(*) FILTER (rul <= 20) AS critical, avg(rul) AS mean, min(rul) AS least, max(rul) AS most FROM rl),
    nm AS (SELECT string_agg('Engine ' || asset || ' (' || rul || ' cycles)', ', ' ORDER BY asset) AS five, string_agg(CASE WHEN k <= 3 THEN CAST(asset AS VARCHAR) END, ', ' ORDER BY asset) AS three FROM (SELECT *, row_number() OVER (ORDER BY asset) AS k FROM rl WHERE rul <= 20) WHERE k <= 5),
    tr AS (SELECT count(*) AS series, count(*) FILTER (label = 'degrading') AS degrading FROM ch),
    br AS (SELECT count(DISTINCT asset || '|' || sensor) FILTER (status <> 'within') AS broken FROM bc),
    ws AS (SELECT sensor AS worst, count(*) FILTER (label = 'degrading') * 100.0 / count(*) AS worst_share FROM ch GROUP BY 1 HAVING count(*) FILTER (label = 'degrading') * 100.0 / count(*) > 20 ORDER BY 2 DESC, 1 LIMIT 1),
    o AS (SELECT *, critical * 100.0 / engines AS cp, degrading * 100.0 / series AS dp, immediate * 100.0 / total AS ip, near_term * 100.0 / total AS np FROM lf, nm, tr, br, fl LEFT JOIN ws ON TRUE),
    ln AS (SELECT unnest([
      {'section': 'overview', 'place': 0, 'line': 'Fleet Status: ' || CASE WHEN cp > 15 THEN 'CRITICAL - Multiple engines require immediate attention' WHEN cp > 5 THEN 'ELEVATED RISK - Several engines showing degradation' ELSE 'NOMINAL - Fleet operating within normal parameters' END},
      {'section': 'overview', 'place': 1, 'line': 'Total Engines Analyzed: ' || engines}, {'section': 'overview', 'place': 2, 'line': 'Total Sensor Points: ' || series},
      {'section': 'overview', 'place': 3, 'line': 'Average Fleet RUL: ' || format('{:.1f}', mean) || ' cycles'}, {'section': 'overview', 'place': 4, 'line': 'RUL Range: ' || least || ' - ' || most || ' cycles'},
      {'section': 'overview', 'place': 5, 'line': 'Engines Requiring Immediate Attention: ' || critical || ' (' || format('{:.1f}', cp) || '%)'},
      {'section': 'findings', 'place': 6, 'line': CASE WHEN critical > 0 THEN 'IMMEDIATE ACTION REQUIRED: ' || critical || ' engines with critically low RUL' END},
      {'section': 'findings', 'place': 7, 'line': CASE WHEN critical > 0 THEN 'Critical engines: ' || five END}, {'section': 'findings', 'place': 8, 'line': CASE WHEN critical > 5 THEN 'Additional ' || (critical - 5) || ' engines require assessment' END},
      {'section': 'findings', 'place': 9, 'line': CASE WHEN dp > 10 THEN 'SENSOR DEGRADATION: ' || degrading || ' sensors (' || format('{:.1f}', dp) || '%) showing degradation trends' END},
      {'section': 'findings', 'place': 10, 'line': CASE WHEN broken > 0 THEN 'OPERATIONAL LIMITS EXCEEDED: ' || broken || ' sensor readings outside acceptable ranges' END},
      {'section': 'findings', 'place': 11, 'line': CASE WHEN critical = 0 AND dp <= 10 AND broken = 0 THEN 'No critical issues identified - fleet operating normally' END},
      {'section': 'risks', 'place': 12, 'line': 'Immediate Action Required: ' || immediate || ' sensors (' || format('{:.1f}', ip) || '%)'}, {'section': 'risks', 'place': 13, 'line': 'Near-term Monitoring: ' || near_term || ' sensors (' || format('{:.1f}', np) || '%)'},
      {'section': 'risks', 'place': 14, 'line': 'Normal Operations: ' || normal || ' sensors'}, {'section': 'risks', 'place': 15, 'line': 'FLEET RISK LEVEL: ' || CASE WHEN ip > 15 THEN 'HIGH' WHEN ip > 5 THEN 'MODERATE' ELSE 'LOW' END},
      {'section': 'recommendations', 'place': 16, 'line': CASE WHEN critical > 0 THEN 'IMMEDIATE: Schedule maintenance for engines ' || three END}, {'section': 'recommendations', 'place': 17, 'line': CASE WHEN critical > 3 THEN 'STRATEGIC: Develop replacement strategy for ' || critical || ' critical engines' END},
      {'section': 'recommendations', 'place': 18, 'line': 'HIGH PRIORITY: Investigate ' || worst || ' sensors (' || format('{:.1f}', worst_share) || '% degrading)'},
      {'section': 'recommendations', 'place': 19, 'line': CASE WHEN broken > 10 THEN 'CALIBRATION: Review sensor calibration procedures - ' || broken || ' bounds violations detected' END},
      {'section': 'recommendations', 'place': 20, 'line': CASE WHEN critical = 0 AND worst IS NULL AND broken <= 10 THEN 'ROUTINE: Continue standard maintenance protocols - no critical issues identified' END}]) AS x FROM o)
    SELECT x.section AS section, CAST(x.place AS INTEGER) AS place, x.line AS line FROM ln WHERE x.line IS NOT NULL""",
    False,
)
add("executive_metrics", lambda s, d: _rul(s, d).agg(F.count("*").alias("assets"), F.count_if(F.col("rul") <= 20).alias("critical"), F.count_if((F.col("rul") > 20) & (F.col("rul") <= 50)).alias("low"), F.count_if(F.col("rul") > 50).alias("high"), F.round(F.avg("rul"), 6).alias("mean"), F.min("rul").alias("least"), F.max("rul").alias("most")), "WITH z AS (SELECT 1)" + RUL_SQL + "SELECT count(*) AS assets, count(*) FILTER (rul <= 20) AS critical, count(*) FILTER (rul > 20 AND rul <= 50) AS low, count(*) FILTER (rul > 50) AS high, round(avg(rul), 6) AS mean, min(rul) AS least, max(rul) AS most FROM rl", False)
add("slope_rul_correlation", lambda s, d: series.slope_life_correlation(_labels(s, d), _rul(s, d)), S_SQL + CHAR + RUL_SQL + "SELECT sensor, count(*) AS assets, round(corr(slope, rul), 5) AS r, CASE WHEN abs(corr(slope, rul)) >= 0.4 THEN 'primary' WHEN abs(corr(slope, rul)) >= 0.2 THEN 'secondary' ELSE 'noise' END AS kind FROM ch JOIN rl USING (asset) GROUP BY 1 HAVING count(*) >= 3", False)
add("timeline", lambda s, d: series.timeline(_items(s, d)), "SELECT name, category, CAST(t AS TIMESTAMP) AS t, row_number() OVER (ORDER BY t, category, name) - 1 AS position FROM (SELECT 'order:' || o_orderkey AS name, 'object' AS category, o_orderdate AS t FROM orders UNION ALL SELECT 'event:' || event_id, 'event', ts FROM events)", False)


def _days(s: SparkSession, d: str) -> DataFrame:
    """Each user's span of each day, in minutes since 2024."""
    minute = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 60)
    x = T(s, d, "events").select(F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("asset"), minute.alias("minute"))
    return x.groupBy("asset").agg(F.min("minute").alias("created"), F.max("minute").alias("destroyed"))


DAYS = "WITH sp AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS asset, CAST(min(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 60)) AS BIGINT) AS created, CAST(max(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 60)) AS BIGINT) AS destroyed FROM events GROUP BY 1) "
add("lifespan_overlap", lambda s, d: series.overlaps(_days(s, d), 60), DAYS + 'SELECT x.asset AS a, y.asset AS b, greatest(x.created, y.created) AS start, least(x.destroyed, y.destroyed) AS "end", least(x.destroyed, y.destroyed) - greatest(x.created, y.created) AS duration FROM sp x JOIN sp y ON x.asset < y.asset AND greatest(x.created, y.created) < least(x.destroyed, y.destroyed)', False)
add(
    "lifespan_summary",
    lambda s, d: series.span_summary(_days(s, d)),
    DAYS + ", l AS (SELECT *, destroyed - created AS n, avg(destroyed - created) OVER () AS m FROM sp) SELECT count(*) AS total, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, min(created) AS first, max(destroyed) AS last, max(destroyed) - min(created) AS timespan, count(*) FILTER (n < m * 0.7::DOUBLE) AS short, count(*) FILTER (n >= m * 0.7::DOUBLE AND n <= m * 1.3::DOUBLE) AS medium, count(*) FILTER (n > m * 1.3::DOUBLE) AS long FROM l",
    False,
)


#: Sensors that each rule of the cascade knows, and one that none does.
KINDS = [("T2", "temperature_sensor", "T2", None, None), ("own", "speed_sensor", "x", 0.0, 5.0), ("a", "temperature_sensor", "T2", None, None), ("b", "flow_sensor", "Nf", None, None), ("c", "bleed_sensor", None, None, 3.0), ("d", "odd", None, None, None), ("farB", None, None, None, None)]


def _sensors(s: SparkSession, d: str) -> DataFrame:
    """A sensor for each user of the events, of a kind by number; one with a range of its own has that of its events."""
    at = (F.col("user_id") % len(KINDS)).cast("int") + 1
    of = lambda i, kind: F.element_at(F.array(*[F.lit(k[i]).cast(kind) for k in KINDS]), at)
    users = T(s, d, "events").filter("user_id IS NOT NULL").groupBy("user_id").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    own = of(0, "string") == "own"
    return users.select(of(0, "string").alias("sensor"), of(1, "string").alias("type"), of(2, "string").alias("sensor_type"), F.when(own, F.col("least")).otherwise(of(3, "double")).alias("low"), F.when(own, F.col("most")).otherwise(of(4, "double")).alias("high"))


add(
    "sensor_bounds_cascade",
    lambda s, d: series.bounds_of(_sensors(s, d)),
    """WITH us AS (SELECT user_id % 7 AS k, min(value) AS least, max(value) AS most FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
    SELECT sensor, CASE WHEN us.k = 1 THEN least ELSE low END AS low, CASE WHEN us.k = 1 THEN most ELSE high END AS high, unit, source FROM us
    JOIN (VALUES (0, 'T2', 515.0::DOUBLE, 525.0::DOUBLE, '°R', 'T2_specification'), (1, 'own', 0.0, 5.0, 'unknown', 'own_x'), (2, 'a', 60.0, 90.0, '°C', 'temperature_generic_bounds'), (3, 'b', 2300.0, 2500.0, 'rpm', 'default_bounds_NF'), (4, 'c', 0.0, 5.0, 'kg/s', 'default_bounds_BLEED'), (6, 'farB', 0.02, 0.05, 'ratio', 'FARB_specification')) v(k, sensor, low, high, unit, source) USING (k)""",
    False,
)


def _temporal(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as measurements by year, customers as objects by the years of their orders, documents' labels as validation
    results, events as timestamps of their users, and days of orders as text properties."""
    o, e, lab = T(s, d, "orders"), T(s, d, "events"), T(s, d, "labels")
    prop = lambda df, node, kind, name, text, number: df.select(node.alias("node_id"), F.lit(kind).alias("type"), F.lit(name).alias("prop"), text.cast("string").alias("s_val"), number.cast("double").alias("d_val"))
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    none = F.lit(None)
    span = o.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    p = prop(o, key("m", "o_orderkey"), "measurement", "timestamp", F.year("o_orderdate"), F.year("o_orderdate")).union(prop(span, key("obj", "o_custkey"), "object", "created", F.col("a"), F.col("a"))).union(prop(span, key("obj", "o_custkey"), "object", "destroyed", F.col("b"), F.col("b")))
    p = p.union(prop(lab, key("v", "doc_id"), "ValidationResult", "attributes.timestamp", F.lit(2001), F.lit(2001)))
    p = p.union(prop(o, key("m", "o_orderkey"), "measurement", "order_date", F.date_format("o_orderdate", "MM/dd/yyyy"), none)).union(prop(o, key("m", "o_orderkey"), "measurement", "attributes.note", F.concat(F.lit("seen "), F.date_format("o_orderdate", "yyyy/MM/dd")), none))
    n = e.select(key("t", "event_id").alias("node_id"), F.lit("Timestamp").alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("value")).union(e.select(key("u", "user_id"), F.lit("user"), F.col("user_id").cast("string")).distinct())
    return n, p, e.select(key("u", "user_id").alias("src"), key("t", "event_id").alias("dst"), F.lit("has_timestamp").alias("edge_type"))


add(
    "temporal_events",
    lambda s, d: series.temporal_events(*_temporal(s, d)),
    """WITH sp AS (SELECT o_custkey AS k, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1)
    SELECT 'm:' || o_orderkey AS name, 'measurement' AS category, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS t, 'measurement_timestamp' AS source FROM orders UNION ALL SELECT 'obj:' || k, 'object_creation', make_timestamp(a, 1, 1, 0, 0, 0), 'object_lifecycle' FROM sp
    UNION ALL SELECT 'obj:' || k, 'object_destruction', make_timestamp(b, 12, 31, 0, 0, 0), 'object_lifecycle' FROM sp UNION ALL SELECT 'v:' || doc_id, 'validation_event', TIMESTAMP '2001-06-15', 'validation_result' FROM labels
    UNION ALL SELECT 'u:' || user_id, 'user', date_trunc('second', ts), 'timestamp_node' FROM events UNION ALL SELECT 'm:' || o_orderkey, 'measurement', CAST(date_trunc('day', o_orderdate) AS TIMESTAMP), 'direct_property' FROM orders""",
    False,
)
