"""Sensor and event series: windows, chunks, trends, bounds, risk. A series is (asset, sensor, t, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import parse_time

KEY = ["asset", "sensor"]
#: Change of the mean, in percent, beyond which each label holds.
TREND_LABELS = ((10.0, "strong"), (2.0, "moderate"), (0.5, "slight"))
#: Calendar levels and their seconds.
LEVELS = (("individual", 0), ("minute", 60), ("hour", 3_600), ("day", 86_400), ("week", 604_800), ("month", 2_592_000), ("quarter", 7_776_000))
#: The range and unit of each sensor of the turbofan by name, of categories by type, and defaults.
SPECIFIED = {
    "T2": (515.0, 525.0, "°R"), "T24": (630.0, 650.0, "°R"), "P2": (14.0, 15.0, "psia"), "P15": (20.0, 23.0, "psia"), "P30": (550.0, 560.0, "psia"), "PS30": (45.0, 50.0, "psia"), "NF": (2300.0, 2500.0, "rpm"),
    "NC": (8000.0, 10000.0, "rpm"), "NRF": (2380.0, 2390.0, "rpm"), "NF_DMD": (2200.0, 2600.0, "rpm"), "EPR": (1.2, 1.8, "ratio"), "BPR": (5.0, 12.0, "ratio"), "PCNFR_DMD": (80.0, 105.0, "%"), "W31": (30.0, 50.0, "lbm/s"),
    "FARB": (0.02, 0.05, "ratio"), "HTBLEED": (350.0, 450.0, "°R"), "T30": (1580.0, 1605.0, "°R"), "T50": (1390.0, 1425.0, "°R"), "NRC": (8115.0, 8150.0, "rpm"), "W32": (23.0, 24.5, "lbm/s"), "PHI": (520.0, 525.5, "deg"),
}
CATEGORIES = {"temperature": (60.0, 90.0, "°C"), "pressure": (1.0, 10.0, "bar"), "speed": (0.0, 5000.0, "rpm")}
DEFAULTS = {
    "T2": (515.0, 525.0, "°R"), "P2": (14.0, 15.0, "psia"), "NF": (2300.0, 2500.0, "rpm"), "RATIO_SENSOR": (0.5, 2.0, "ratio"), "FLOW_SENSOR": (10.0, 100.0, "kg/s"), "BLEED_SENSOR": (0.0, 5.0, "kg/s"),
    "VIBRATION_SENSOR": (0.0, 10.0, "mm/s"), "TEMPERATURE": (60.0, 90.0, "°C"), "PRESSURE": (1.0, 10.0, "bar"), "SPEED": (0.0, 5000.0, "rpm"),
}
DEFAULT_OF = {"TEMPERATURE": "TEMPERATURE", "PRESSURE": "PRESSURE", "SPEED": "SPEED", "RATIO": "RATIO_SENSOR", "FLOW": "FLOW_SENSOR", "BLEED": "BLEED_SENSOR", "VIBRATION": "VIBRATION_SENSOR"}
#: Sensors that weigh more.
CRITICAL_SENSORS = ("T30", "T50", "P30")


def numbered(series: DataFrame) -> DataFrame:
    """With i (from 0) in order of time and n, per asset and sensor."""
    w = W.partitionBy(*KEY)
    return series.withColumn("i", F.row_number().over(w.orderBy("t", "value")) - 1).withColumn("n", F.count("*").over(w))


def chunks(series: DataFrame, target: int) -> DataFrame:
    """Runs of max(1, n // target) readings: their count, mean and range."""
    x = numbered(series).withColumn("chunk", F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / target))))
    return x.groupBy(*KEY, "chunk").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def trend_label(a: Column, b: Column) -> Column:
    """From the means of the first and the last third: the change in percent of the first; none of a zero base."""
    change = (b - a) / a * 100
    found = F.when(a.isNull() | (a == 0), "stable")
    for beyond, name in TREND_LABELS:
        found = found.when(change > beyond, f"increasing_{name}").when(change < -beyond, f"decreasing_{name}")
    return found.otherwise("stable")


def _thirds() -> tuple[Column, Column]:
    """Means of the first n // 3 and the last ceil(n / 3) values of numbered series; of two values, each one."""
    a = F.avg(F.when(F.col("i") < F.greatest(F.lit(1), F.floor(F.col("n") / 3)), F.col("value")))
    b = F.avg(F.when(F.col("i") >= F.col("n") - F.ceil(F.col("n") / 3), F.col("value")))
    return a, b


def trends(series: DataFrame) -> DataFrame:
    """Per series: the means of its first n // 3 and its last ceil(n / 3) values and the label they give."""
    a, b = _thirds()
    m = numbered(series).groupBy(*KEY).agg(F.first("n").alias("n"), a.alias("a"), b.alias("b"))
    return m.select(*KEY, "n", F.round("a", 6).alias("first_mean"), F.round("b", 6).alias("last_mean"), F.when(F.col("n") < 2, "stable").otherwise(trend_label(F.col("a"), F.col("b"))).alias("trend"))


def statistics(series: DataFrame) -> DataFrame:
    """Per series: count, mean, sample deviation (0 of one value), least and greatest."""
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return series.groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(std, 6).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


def quality(series: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Per series: issues (values beyond that many population deviations if there are more than three, all values equal),
    100 less 20 an issue, and the count of values farther from the mean than half the range. Means are summed in order of time, so
    that what lies on a limit doesn't depend on the order in which rows arrive."""
    w = W.partitionBy(*KEY).orderBy("t", "value").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = series.withColumn("n", F.count("*").over(w)).withColumn("m", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w))
    x = x.withColumn("half", (F.max("value").over(w) - F.min("value").over(w)) / 2)
    off = F.abs(F.col("value") - F.col("m"))
    far, wide = F.count_if((F.col("n") > 3) & (off > sigmas * F.col("sd"))), F.count_if((F.col("n") > 1) & (off > F.col("half")))
    g = x.groupBy(*KEY).agg(F.count("*").alias("n"), far.alias("outliers"), (F.min("value") == F.max("value")).alias("constant"), wide.alias("outlier_count"))
    return g.withColumn("score", 100 - 20 * ((F.col("outliers") > 0).cast("int") + F.col("constant").cast("int")))


def density_targets(assets: int, sensors: int, most_nodes: int = 2000, least: int = 5) -> tuple[int, int]:
    """(least, most) nodes of a series so that all series together have about most_nodes."""
    if not assets * sensors:
        return 10, 50
    each = max(least, most_nodes // (assets * sensors))
    return max(3, each // 2), each * 2


def level_scores(series: DataFrame, targets: tuple[int, int] = (10, 50)) -> DataFrame:
    """Per series and level of LEVELS: the groups that it would make by the time from the first to the last reading, the
    readings of each, a score (how near the targets' middle the groups are, less for those outside, more for readings a
    group) and whether the groups are within the targets."""
    low, high = (float(x) for x in targets)
    span = F.timestamp_diff("MICROSECOND", F.min("t"), F.max("t")) / 1e6
    g = series.groupBy(*KEY).agg(F.count("*").alias("n"), span.alias("span"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(i).alias("place"), F.lit(float(v)).alias("seconds")) for i, (k, v) in enumerate(LEVELS)])
    x = g.select(*KEY, "n", "span", F.explode(levels).alias("x")).select(*KEY, "n", "span", "x.*")
    groups = F.when(F.col("seconds") == 0, F.col("n").cast("double")).when(F.col("span") > 0, F.greatest(F.lit(1.0), F.col("span") / F.col("seconds"))).otherwise(1.0)
    x = x.withColumn("groups", groups).withColumn("per_group", F.col("n") / F.col("groups"))
    fit = F.when(F.col("groups") < low, (low - F.col("groups")) * -2).when(F.col("groups") > high, (F.col("groups") - high) * -1.5).otherwise(100 - F.abs(F.col("groups") - (low + high) / 2))
    return x.withColumn("score", fit + F.least(F.lit(50.0), F.col("per_group") * 0.5)).withColumn("fits", F.col("groups").between(low, high))


def chosen_level(series: DataFrame, targets: tuple[int, int] = (10, 50)) -> DataFrame:
    """Per series the level of the greatest score, the finest of equal ones, with what it makes of the readings."""
    best = level_scores(series, targets).groupBy(*KEY).agg(F.max_by(F.struct("level", "n", "groups", "per_group", "fits"), F.struct(F.col("score"), (-F.col("place")).alias("p"))).alias("b"))
    return best.select(*KEY, "b.level", F.col("b.n").alias("n"), F.round("b.groups", 4).alias("groups"), F.round("b.per_group", 4).alias("per_group"), F.round(F.col("b.groups") / F.col("b.n"), 6).alias("efficiency"), "b.fits")


def level_counts(series: DataFrame) -> DataFrame:
    """Buckets and readings a bucket at each calendar level."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.date_trunc(k, F.col("t")).alias("b")) for k in ("hour", "day", "week", "month", "quarter", "year")])
    g = series.select(F.explode(levels).alias("x")).groupBy("x.level").agg(F.count_distinct("x.b").alias("buckets"), F.count("*").alias("n"))
    return g.select("level", "buckets", F.round(F.col("n") / F.col("buckets"), 6).alias("per_bucket"))


def per_second(series: DataFrame) -> DataFrame:
    return series.groupBy(F.date_trunc("second", F.col("t")).alias("second")).agg(F.count("*").alias("n"))


def lines(series: DataFrame) -> DataFrame:
    """Least squares of value on elapsed seconds since the sensor's first reading."""
    t0 = series.groupBy("sensor").agg(F.min("t").alias("t0"))
    x = series.join(F.broadcast(t0), "sensor").withColumn("s", F.timestamp_diff("SECOND", F.col("t0"), F.col("t")).cast("double"))
    return x.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.regr_slope("value", "s"), 9).alias("slope"), F.round(F.regr_intercept("value", "s"), 5).alias("intercept"))


def bounds_of(sensors: DataFrame) -> DataFrame:
    """sensors(sensor, type, sensor_type, low, high; text and numbers, any null) -> (sensor, low, high, unit, source): its own
    range if it has both ends, else that of its name, of the category in its type, or a default by its sensor type or type.
    Sensors that no rule knows have no row."""
    spec = F.element_at(F.create_map(*[x for k, v in SPECIFIED.items() for x in (F.lit(k), _range(*v))]), F.upper("sensor"))
    kind, default = F.lower(F.coalesce("type", F.lit(""))), F.element_at(F.create_map(*[x for k, v in DEFAULTS.items() for x in (F.lit(k), _range(*v))]), F.upper(F.coalesce("sensor_type", F.lit(""))))
    none = F.lit(None).cast("struct<low:double,high:double,unit:string>")
    category, by_type, named, typed = none, none, F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in reversed(CATEGORIES.items()):
        category, named = F.when(F.contains(kind, F.lit(k)), _range(*v)).otherwise(category), F.when(F.contains(kind, F.lit(k)), F.lit(k)).otherwise(named)
    for k, key in reversed(DEFAULT_OF.items()):
        by_type, typed = F.when(F.contains(kind, F.lit(k.lower())), _range(*DEFAULTS[key])).otherwise(by_type), F.when(F.contains(kind, F.lit(k.lower())), F.lit(k)).otherwise(typed)
    own = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.struct("low", "high", F.lit("unknown").alias("unit")))
    found = F.coalesce(own, spec, category, default, by_type)
    source = F.when(own.isNotNull(), F.concat(F.lit("own_"), F.coalesce("sensor_type", "type", F.lit("unknown")))).when(spec.isNotNull(), F.concat(F.upper("sensor"), F.lit("_specification"))).when(category.isNotNull(), F.concat(named, F.lit("_generic_bounds"))).when(default.isNotNull(), F.concat(F.lit("default_bounds_"), F.upper("sensor_type"))).otherwise(F.concat(F.lit("default_bounds_"), typed))
    return sensors.select("sensor", found.alias("b"), source.alias("source")).filter("b IS NOT NULL").select("sensor", "b.low", "b.high", "b.unit", "source")


def _range(low: float, high: float, unit: str) -> Column:
    return F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(unit).alias("unit"))


def bounds_check(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds(sensor, low, high) -> each reading's status and how far it is from the nearest bound."""
    x = series.join(F.broadcast(bounds), "sensor")
    v = F.col("value")
    status = F.when(v < F.col("low"), "below").when(v > F.col("high"), "above").otherwise("within")
    margin = F.when(v < F.col("low"), F.col("low") - v).when(v > F.col("high"), v - F.col("high")).otherwise(F.least(v - F.col("low"), F.col("high") - v))
    return x.select(*KEY, "t", "value", status.alias("status"), F.bround(margin, 2).alias("margin"))


def bounds_summary(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per series the share outside and what it is called."""
    g = bounds_check(series, bounds).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "within").alias("violations"))
    pct = F.col("violations") * 100 / F.col("n")
    return g.withColumn("verdict", F.when(pct == 0, "all_within").when(pct < 10, "mostly_within").when(pct < 50, "some_violations").otherwise("many_violations"))


def characterize(series: DataFrame, least: int = 10) -> DataFrame:
    """Per series of at least that many readings: its trend label, slope on the reading's number, strength |slope| * n and
    population CV. One with a trend is degrading if its strength is above .1 (high above 1), else stable; one without has
    high variance if its CV is above .1 (high above .2)."""
    a, b = _thirds()
    x = numbered(series).filter(F.col("n") >= least)
    slope = F.regr_slope("value", F.col("i").cast("double"))
    g = x.groupBy(*KEY).agg(F.first("n").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.coalesce(slope, F.lit(0.0)).alias("slope"), a.alias("a"), b.alias("b"))
    g = g.withColumn("trend", trend_label(F.col("a"), F.col("b"))).withColumn("cv", F.when(F.col("m") != 0, F.col("sd") / F.abs("m")).otherwise(0.0)).withColumn("strength", F.abs("slope") * F.col("n"))
    moved, strength, cv = F.col("trend") != "stable", F.col("strength"), F.col("cv")
    label = F.when(moved, F.when(strength > 0.1, "degrading").otherwise("stable")).when(cv > 0.1, "high_variance").otherwise("stable")
    severity = F.when(moved, F.when(strength > 1, "high").when(strength > 0.1, "moderate").otherwise("low")).when(cv > 0.2, "high").when(cv > 0.1, "moderate").otherwise("low")
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return g.select(*KEY, "n", "trend", label.alias("label"), severity.alias("severity"), direction.alias("direction"), F.round("slope", 6).alias("slope"), F.round(strength, 3).alias("strength"), F.round(cv, 3).alias("cv"))


def sensor_risks(labels: DataFrame) -> DataFrame:
    """characterize() -> per sensor how many series have each label, and the risk that the share of degrading ones gives."""
    kinds = [F.count_if(F.col("label") == k).alias(k) for k in ("degrading", "stable", "high_variance")]
    g = labels.groupBy("sensor").agg(F.count("*").alias("total"), *kinds)
    share = F.col("degrading") * 100 / F.col("total")
    return g.withColumn("share", F.round(share, 1)).withColumn("risk", F.when(share > 20, "High Risk").when(share > 5, "Moderate Risk").otherwise("Low Risk"))


def priorities(labels: DataFrame, rul: DataFrame, critical: tuple[str, ...] = CRITICAL_SENSORS, life: int = 100) -> DataFrame:
    """characterize() and rul(asset, rul) -> per series a score: of its label, its severity, the remaining life (that many
    cycles if unknown) and whether the sensor is critical; and what to do how soon."""
    j = labels.join(rul, "asset", "left").withColumn("rul", F.coalesce("rul", F.lit(life)))
    score = F.when(F.col("label") == "degrading", 3).when(F.col("label") == "high_variance", 2).otherwise(0)
    score = score + F.when(F.col("severity") == "high", 3).when(F.col("severity") == "moderate", 2).otherwise(1)
    score = score + F.when(F.col("rul") <= 10, 4).when(F.col("rul") <= 30, 2).when(F.col("rul") <= 50, 1).otherwise(0) + F.col("sensor").isin(*critical).cast("int")
    level = F.when(F.col("score") >= 7, "immediate_action").when(F.col("score") >= 4, "near_term_watch").otherwise("normal_monitoring")
    # fixed values: what each level says
    told = {"immediate_action": ("critical", "immediate_inspection_required", "0-10_cycles"), "near_term_watch": ("elevated", "schedule_maintenance_window", "11-30_cycles"), "normal_monitoring": ("routine", "continue_monitoring", ">30_cycles")}
    named = [F.element_at(F.create_map(*[F.lit(x) for k, v in told.items() for x in (k, v[i])]), F.col("level")).alias(name) for i, name in enumerate(("urgency", "action", "time_frame"))]
    return j.withColumn("score", score).withColumn("level", level).select(*KEY, "label", "severity", "rul", "score", "level", *named)


def fleet_risks(decisions: DataFrame) -> DataFrame:
    """priorities() -> one row: series at each level and their shares in percent."""
    counts = [F.count_if(F.col("level") == k).alias(v) for k, v in (("immediate_action", "immediate"), ("near_term_watch", "near_term"), ("normal_monitoring", "normal"))]
    g = decisions.agg(F.count("*").alias("total"), *counts)
    share = lambda c: F.round(F.when(F.col("total") > 0, F.col(c) * 100 / F.col("total")).otherwise(0.0), 1)
    return g.withColumn("immediate_share", share("immediate")).withColumn("near_term_share", share("near_term"))


def fleet_report(labels: DataFrame, decisions: DataFrame, rul: DataFrame, checks: DataFrame) -> DataFrame:
    """The report on a fleet as lines (section, place, line): overview, findings, risks and recommendations.

    checks is bounds_summary(). Each part is an aggregate of one row; engines and sensors that are named are the first few
    by their number or share, so that nothing but these lines leaves the executors."""
    life = rul.agg(F.count("*").alias("engines"), F.count_if(F.col("rul") <= 20).alias("critical"), F.avg("rul").alias("mean"), F.min("rul").alias("least"), F.max("rul").alias("most"))
    first = rul.filter("rul <= 20").orderBy("asset").limit(5).agg(F.array_sort(F.collect_list(F.struct("asset", "rul"))).alias("named"))
    trend = labels.agg(F.count("*").alias("series"), F.count_if(F.col("label") == "degrading").alias("degrading"))
    broken = checks.agg(F.count_if(F.col("violations") > 0).alias("broken"))
    worst = sensor_risks(labels).withColumn("exact", F.col("degrading") * 100 / F.col("total")).filter("exact > 20").orderBy(F.desc("exact"), "sensor").limit(1)
    worst = worst.agg(F.first("sensor").alias("worst"), F.first("exact").alias("worst_share"))
    one = life.crossJoin(first).crossJoin(trend).crossJoin(broken).crossJoin(worst).crossJoin(fleet_risks(decisions))  # one row each
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100 / F.col(b)).otherwise(0.0)
    text = lambda c: F.col(c).cast("string")
    critical, falling = pct("critical", "engines"), pct("degrading", "series")
    status = F.when(critical > 15, "CRITICAL - Multiple engines require immediate attention").when(critical > 5, "ELEVATED RISK - Several engines showing degradation").otherwise("NOMINAL - Fleet operating within normal parameters")
    level = F.when(pct("immediate", "total") > 15, "HIGH").when(pct("immediate", "total") > 5, "MODERATE").otherwise("LOW")
    engines = F.array_join(F.transform("named", lambda x: F.concat(F.lit("Engine "), x["asset"].cast("string"), F.lit(" ("), x["rul"].cast("string"), F.lit(" cycles)"))), ", ")
    three = F.array_join(F.transform(F.slice("named", 1, 3), lambda x: x["asset"].cast("string")), ", ")
    d1 = lambda c: F.format_string("%.1f", c.cast("double"))
    # fixed values: the report's sentences and thresholds
    lines = [
        ("overview", F.concat(F.lit("Fleet Status: "), status)),
        ("overview", F.concat(F.lit("Total Engines Analyzed: "), text("engines"))),
        ("overview", F.concat(F.lit("Total Sensor Points: "), text("series"))),
        ("overview", F.concat(F.lit("Average Fleet RUL: "), d1(F.col("mean")), F.lit(" cycles"))),
        ("overview", F.concat(F.lit("RUL Range: "), text("least"), F.lit(" - "), text("most"), F.lit(" cycles"))),
        ("overview", F.concat(F.lit("Engines Requiring Immediate Attention: "), text("critical"), F.lit(" ("), d1(critical), F.lit("%)"))),
        ("findings", F.when(F.col("critical") > 0, F.concat(F.lit("IMMEDIATE ACTION REQUIRED: "), text("critical"), F.lit(" engines with critically low RUL")))),
        ("findings", F.when(F.col("critical") > 0, F.concat(F.lit("Critical engines: "), engines))),
        ("findings", F.when(F.col("critical") > 5, F.concat(F.lit("Additional "), (F.col("critical") - 5).cast("string"), F.lit(" engines require assessment")))),
        ("findings", F.when(falling > 10, F.concat(F.lit("SENSOR DEGRADATION: "), text("degrading"), F.lit(" sensors ("), d1(falling), F.lit("%) showing degradation trends")))),
        ("findings", F.when(F.col("broken") > 0, F.concat(F.lit("OPERATIONAL LIMITS EXCEEDED: "), text("broken"), F.lit(" sensor readings outside acceptable ranges")))),
        ("findings", F.when((F.col("critical") == 0) & (falling <= 10) & (F.col("broken") == 0), F.lit("No critical issues identified - fleet operating normally"))),
        ("risks", F.when(F.col("total") > 0, F.concat(F.lit("Immediate Action Required: "), text("immediate"), F.lit(" sensors ("), d1(pct("immediate", "total")), F.lit("%)")))),
        ("risks", F.when(F.col("total") > 0, F.concat(F.lit("Near-term Monitoring: "), text("near_term"), F.lit(" sensors ("), d1(pct("near_term", "total")), F.lit("%)")))),
        ("risks", F.when(F.col("total") > 0, F.concat(F.lit("Normal Operations: "), text("normal"), F.lit(" sensors")))),
        ("risks", F.when(F.col("total") > 0, F.concat(F.lit("FLEET RISK LEVEL: "), level))),
        ("recommendations", F.when(F.col("critical") > 0, F.concat(F.lit("IMMEDIATE: Schedule maintenance for engines "), three))),
        ("recommendations", F.when(F.col("critical") > 3, F.concat(F.lit("STRATEGIC: Develop replacement strategy for "), text("critical"), F.lit(" critical engines")))),
        ("recommendations", F.when(F.col("worst").isNotNull(), F.concat(F.lit("HIGH PRIORITY: Investigate "), F.col("worst"), F.lit(" sensors ("), d1(F.col("worst_share")), F.lit("% degrading)")))),
        ("recommendations", F.when(F.col("broken") > 10, F.concat(F.lit("CALIBRATION: Review sensor calibration procedures - "), text("broken"), F.lit(" bounds violations detected")))),
        ("recommendations", F.when((F.col("critical") == 0) & F.col("worst").isNull() & (F.col("broken") <= 10), F.lit("ROUTINE: Continue standard maintenance protocols - no critical issues identified"))),
    ]
    made = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(i).alias("place"), line.alias("line")) for i, (section, line) in enumerate(lines)])
    return one.select(F.explode(made).alias("x")).select("x.*").filter("line IS NOT NULL")


def slope_life_correlation(labels: DataFrame, rul: DataFrame, least: int = 3) -> DataFrame:
    """labels(asset, sensor, slope) -> per sensor the correlation of slopes with remaining life and what it is called."""
    g = labels.join(rul, "asset").groupBy("sensor").agg(F.count("*").alias("assets"), F.corr("slope", F.col("rul").cast("double")).alias("r")).filter(F.col("assets") >= least)
    a = F.abs("r")
    return g.select("sensor", "assets", F.round("r", 5).alias("r"), F.when(a >= 0.4, "primary").when(a >= 0.2, "secondary").otherwise("noise").alias("kind"))


def timeline(items: DataFrame) -> DataFrame:
    """items(name, category, t) -> with order. Counting the earlier ones per day first keeps the windows short: days are
    ranked among days, items within their day."""
    days = items.groupBy(F.to_date("t").alias("d")).agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = items.withColumn("d", F.to_date("t")).withColumn("k", F.row_number().over(W.partitionBy("d").orderBy("t", "category", "name")))
    return x.join(F.broadcast(before.select("d", "before")), "d").select("name", "category", "t", (F.col("before") + F.col("k") - 1).cast("long").alias("position"))


#: Names of properties that hold a time, and what a text with a time looks like.
TIMES = ("execution_time", "created", "last_updated", "modified", "timestamp", "date", "time", "datetime", "created_at", "updated_at", "executed_at")
LOOKS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}"


def temporal_events(nodes: DataFrame, props: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, category, t, source) of everything in a graph that has a time: measurements by the year of their timestamp
    (January 1), objects by the years that they were created (January 1) and destroyed (December 31), validation results
    (June 15), nodes that a has_timestamp edge leads from, by that timestamp's value, and text properties that are named for a
    time or look like one. Attributes one level down are properties named `attributes.` and the key."""
    year = lambda month, day: F.make_timestamp_ntz(F.col("d_val").cast("int"), F.lit(month), F.lit(day), F.lit(0), F.lit(0), F.lit(0))
    key = F.element_at(F.split(F.lower("prop"), r"\."), -1)
    number = props.filter("d_val IS NOT NULL AND d_val BETWEEN 1 AND 9999")
    rows = lambda df, category, t, source: df.select(F.col("node_id").alias("name"), F.lit(category).alias("category"), t.alias("t"), F.lit(source).alias("source"))
    found = rows(number.filter((F.col("type") == "measurement") & (F.col("prop") == "timestamp")), "measurement", year(1, 1), "measurement_timestamp")
    found = found.union(rows(number.filter((F.col("type") == "object") & (F.col("prop") == "created")), "object_creation", year(1, 1), "object_lifecycle"))
    found = found.union(rows(number.filter((F.col("type") == "object") & (F.col("prop") == "destroyed")), "object_destruction", year(12, 31), "object_lifecycle"))
    found = found.union(rows(number.filter((F.col("type") == "ValidationResult") & (key == "timestamp")), "validation_event", year(6, 15), "validation_result"))
    stamps = nodes.filter("type = 'Timestamp'").select(F.col("node_id").alias("dst"), parse_time(F.col("value")).alias("t"))
    linked = edges.filter("edge_type = 'has_timestamp'").select("src", "dst").join(stamps, "dst").join(nodes.select(F.col("node_id").alias("src"), "type"), "src")
    found = found.union(linked.select("src", "type", "t", F.lit("timestamp_node")))
    text = props.filter(F.col("d_val").isNull() & (key.isin(*TIMES) | F.contains(key, F.lit("time")) | F.contains(key, F.lit("date")) | ((F.length("s_val") >= 10) & F.col("s_val").rlike(LOOKS))))
    source = F.when(F.col("prop").startswith("attributes."), "attribute_property").otherwise("direct_property")
    return found.union(text.select("node_id", "type", parse_time(F.col("s_val")), source)).filter("t IS NOT NULL")


def overlaps(spans: DataFrame, width: int = 1) -> DataFrame:
    """spans(asset, created, destroyed) -> pairs of assets (a < b) with max(created) < min(destroyed), from when to when.

    Of two spans the later one to begin (of equal ones that of the greater asset) looks for the other in the bucket (of `width` years) in which it begins,
    so that every pair is made once, by an equality join, and spans are in several buckets on one side only. Pairs are as many as overlap: nothing
    bounds them but the input's square, if all are there at the same time. Buckets are dealt to a number of tasks of their own, as what is
    small by bytes is much work here; a task passes pairs on and holds none."""
    spark = spans.sparkSession
    x, tasks = spans.filter("created < destroyed"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    last = F.ceil(F.col("destroyed") / width) - 1  # a span that ends where a bucket begins has nothing in it
    begins = x.withColumn("bucket", F.floor(F.col("created") / width)).select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("asset", "created", "destroyed")])
    there = x.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("created") / width), last))).select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("asset", "created", "destroyed")])
    first = (F.col("created_a") < F.col("created_b")) | ((F.col("created_a") == F.col("created_b")) & (F.col("asset_a") < F.col("asset_b")))
    met = begins.repartition(tasks, "bucket").join(there.repartition(tasks, "bucket"), "bucket").filter(first & (F.col("created_b") < F.col("destroyed_a")))
    start, end = F.col("created_b"), F.least("destroyed_a", "destroyed_b")
    return met.select(F.least("asset_a", "asset_b").alias("a"), F.greatest("asset_a", "asset_b").alias("b"), start.alias("start"), end.alias("end"), (end - start).alias("duration"))


def span_summary(spans: DataFrame) -> DataFrame:
    """One row: assets, their mean, least and greatest lifespan, the time from the first to the last, and how many are short
    (below .7 of the mean), long (above 1.3) or between."""
    n = F.col("destroyed") - F.col("created")
    g = spans.agg(F.count("*").alias("total"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.min("created").alias("first"), F.max("destroyed").alias("last"))
    kinds = spans.crossJoin(F.broadcast(g.select("mean"))).agg(F.count_if(n < F.col("mean") * 0.7).alias("short"), F.count_if(n > F.col("mean") * 1.3).alias("long"))  # the mean is one row
    return g.crossJoin(F.broadcast(kinds)).select("total", F.round("mean", 6).alias("mean"), "least", "most", "first", "last", (F.col("last") - F.col("first")).alias("timespan"), "short", (F.col("total") - F.col("short") - F.col("long")).alias("medium"), "long")


def lifespans(objects: DataFrame) -> DataFrame:
    """objects(asset, created, destroyed) in years -> lifespan and its class."""
    n = F.col("destroyed") - F.col("created")
    return objects.select("asset", "created", "destroyed", n.alias("lifespan"), F.when(n <= 5, "short").when(n <= 15, "medium").otherwise("long").alias("class"))


def anachronisms(measures: DataFrame, objects: DataFrame) -> DataFrame:
    """measures(asset, t in years) against the objects' spans: a row per measurement with the reason if it can't be."""
    x = measures.join(objects, "asset")
    reason = F.when(F.col("t") < F.col("created"), "before creation").when(F.col("t") > F.col("destroyed"), "after destruction").otherwise("valid")
    return x.groupBy("asset", reason.alias("reason")).agg(F.count("*").alias("n"))
