"""Queries on propagated values: mixtures by hops, by belief and by spectra, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import propagation
from .catalog import GEO, HOP, ORACLES, SRC, E, N, P, _hops, _src, add, with_


def _geo(s: SparkSession, d: str) -> DataFrame:
    return N(s, d).filter("type IN ('customer', 'supplier', 'nation', 'region')")


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Customers' balances along customer, nation, region: customers are sources, suppliers isolated."""
    return propagation.assembled(_geo(s, d), _src(s, d), propagation.mixtures(_hops(s, d), _src(s, d)))


EMPTY = "CAST([] AS STRUCT(m DOUBLE, w DOUBLE, s DOUBLE)[])"


def fold_sql(records: str, most: int, near: str, shift: bool) -> str:
    """The fold of a list of one-element lists of structs m, d, w, s."""
    w, m = "(acc[p].w + r[1].w)", "((acc[p].w * acc[p].m + r[1].w * r[1].m) / (acc[p].w + r[1].w))"
    a, b = (f" + ({x} - {m}) ** 2" if shift else "" for x in ("acc[p].m", "r[1].m"))
    joined = f"{{'m': {m}, 'w': {w}, 's': sqrt((acc[p].w * (acc[p].s ** 2{a}) + r[1].w * (r[1].s ** 2{b})) / {w})}}".replace("acc[p]", "acc[PLACE]")
    new = "{'m': r[1].m, 'w': r[1].w, 's': r[1].s}"
    place = f"coalesce(list_position(list_transform(acc, lambda c: abs(c.m - r[1].m) < {near}), true), 0)"
    light = "list_position(list_transform(acc, lambda c: c.w), list_min(list_transform(acc, lambda c: c.w)))"
    put = lambda at, x: f"list_concat(list_concat(acc[1:{at} - 1], [{x}]), acc[{at} + 1:])"
    body = f"CASE WHEN {place} > 0 THEN {put(place, joined.replace('PLACE', place))} WHEN len(acc) < {most} THEN list_append(acc, {new}) WHEN list_min(list_transform(acc, lambda c: c.w)) < r[1].w THEN {put(light, new)} ELSE acc END"
    return f"list_reduce(list_prepend({EMPTY}, list_transform({records}, lambda z: [{{'m': z.m, 'w': z.w, 's': z.s}}])), lambda acc, r: {body})"


NORMAL = "list_transform({0}, lambda c: {{'m': c.m, 'w': c.w / list_sum(list_transform({0}, lambda q: q.w)), 's': c.s}})"
X = "round(greatest(0.001::DOUBLE, least(0.999::DOUBLE, (value - a + 0.1 * (b - a)) / ((b - a) * 1.2))), 9)"
MIXED = (
    SRC,
    HOP,
    f"sx AS (SELECT node_id, value, {X} AS x, a - 0.1 * (b - a) AS low, b + 0.1 * (b - a) AS high FROM so)",
    "rc AS (SELECT hp.node_id, round(sx.x, 4) AS m, distance AS d, sum(influence) AS w, 0.025::DOUBLE + 0.015::DOUBLE * distance AS s FROM hp JOIN sx ON sx.node_id = source GROUP BY 1, 2, 3)",
    "fo AS (SELECT node_id, " + fold_sql("list(struct_pack(m := m, w := w, s := s) ORDER BY m, d)", 5, "0.05::DOUBLE", True) + " AS f FROM rc GROUP BY node_id)",
    f"mx AS (SELECT n.node_id, CASE WHEN sx.node_id IS NOT NULL THEN 'source' WHEN fo.node_id IS NOT NULL THEN 'inferred' ELSE 'isolated' END AS kind, CASE WHEN sx.node_id IS NOT NULL THEN [{{'m': sx.x, 'w': 1.0::DOUBLE, 's': 0.02::DOUBLE}}] WHEN fo.node_id IS NOT NULL THEN {NORMAL.format('f')} ELSE {EMPTY} END AS c FROM n LEFT JOIN sx USING (node_id) LEFT JOIN fo USING (node_id) WHERE type IN ('customer', 'supplier', 'nation', 'region'))",
    "rg AS (SELECT min(low) AS low, max(high) AS high FROM sx)",
    "mv AS (SELECT node_id, kind, c, list_sum(list_transform(c, lambda q: q.w * q.m)) * (high - low) + low AS value FROM mx, rg)",
)
COMPONENTS = "SELECT node_id, kind, CAST(i - 1 AS INTEGER) AS place, round(c[i].w, 9) AS weight, round(c[i].m, 9) AS mean, round(c[i].s, 9) AS std FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM {0})"

add("propagate_values", lambda s, d: propagation.values_of(_mixed(s, d), _src(s, d)).withColumn("value", F.round("value", 2)), with_(*MIXED) + "SELECT node_id, kind, round(value, 2) AS value FROM mv")
add("propagate_mixtures", lambda s, d: propagation.components_of(_mixed(s, d)), with_(*MIXED) + COMPONENTS.format("mx"))
add("propagate_signals", lambda s, d: propagation.signals(_src(s, d), E(s, d, GEO), 2, 0.7, 2).withColumn("influence", F.round("influence", 4)), with_(*MIXED) + "SELECT round(x, 2) AS x, hp.node_id, distance, round(sum(influence), 4) AS influence FROM hp JOIN sx ON sx.node_id = source GROUP BY 1, 2, 3")
BINNED = (
    *MIXED[:3],
    "mo AS (SELECT CAST(least(floor(sx.x * 32), 31) AS INTEGER) AS bin, hp.node_id, distance, sum(influence) AS w, sum(influence * sx.x) AS wx, sum(influence * sx.x * sx.x) AS wxx FROM hp JOIN sx ON sx.node_id = source GROUP BY 1, 2, 3)",
    "mq AS (SELECT node_id, distance AS d, w, round(wx / w, 12) AS m, sqrt((0.025::DOUBLE + 0.015::DOUBLE * distance) ** 2 + greatest(wxx / w - (wx / w) * (wx / w), 0.0::DOUBLE)) AS s FROM mo)",
    "mf AS (SELECT node_id, " + fold_sql("list(struct_pack(m := m, w := w, s := s) ORDER BY m, d)", 5, "0.05::DOUBLE", True) + " AS f FROM mq GROUP BY node_id)",
    f"ml AS (SELECT node_id, {NORMAL.format('f')} AS c FROM mf)",
)
add(
    "propagate_moments",
    lambda s, d: propagation.moments(_src(s, d), E(s, d, GEO), 2, 0.7).select("bin", "node_id", "distance", *[F.round(c, 6).alias(c) for c in ("w", "wx", "wxx")]),
    with_(*BINNED[:4]) + "SELECT bin, node_id, distance, round(w, 6) AS w, round(wx, 6) AS wx, round(wxx, 6) AS wxx FROM mo",
)
add(
    "propagate_merged_mixtures",
    lambda s, d: propagation.merged_mixtures(propagation.moments(_src(s, d), E(s, d, GEO), 2, 0.7)).select("node_id", F.posexplode("c").alias("place", "q")).select("node_id", "place", *[F.round(f"q.{k}", 6).alias(n) for k, n in (("w", "weight"), ("m", "mean"), ("s", "std"))]),
    with_(*BINNED) + "SELECT node_id, CAST(i - 1 AS INTEGER) AS place, round(c[i].w, 6) AS weight, round(c[i].m, 6) AS mean, round(c[i].s, 6) AS std FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM ml)",
)
add("propagate_top_values", lambda s, d: propagation.top_values(propagation.values_of(_mixed(s, d), _src(s, d))).withColumn("value", F.round("value", 2)), with_(*MIXED) + "SELECT node_id, kind, round(value, 2) AS value FROM mv WHERE kind = 'inferred' ORDER BY mv.value DESC, node_id LIMIT 20")
add("propagate_page", lambda s, d: propagation.page(propagation.values_of(_mixed(s, d), _src(s, d)), 1, 50).select("node_id", "kind"), with_(*MIXED) + "SELECT node_id, kind FROM mx ORDER BY node_id LIMIT 50 OFFSET 50")
add(
    "gmm_range_filter",
    lambda s, d: propagation.in_range(_mixed(s, d), _src(s, d), 4000.0, 5000.0),
    with_(*MIXED) + "SELECT mx.node_id, kind FROM mx LEFT JOIN so USING (node_id), rg WHERE (kind = 'source' AND so.value BETWEEN 4000 AND 5000) OR (kind = 'inferred' AND len(list_filter(c, lambda q: (q.m + 2 * q.s) * (high - low) + low >= 4000 AND (q.m - 2 * q.s) * (high - low) + low <= 5000)) > 0)",
)
OVERLAP = "list_max(list_transform(x.c, lambda p: list_max(list_transform(y.c, lambda q: greatest(0.0::DOUBLE, 1 - abs(p.m - q.m) / (p.s + q.s)) * p.w * q.w))))"
SIMILAR = f"si AS (SELECT x.node_id AS a, y.node_id AS b, CASE WHEN 'isolated' IN (x.kind, y.kind) THEN 0.0::DOUBLE WHEN x.kind = 'source' AND y.kind = 'source' THEN greatest(0.0::DOUBLE, 1 - 2 * abs(x.c[1].m - y.c[1].m)) ELSE {OVERLAP} END AS similarity FROM mx x, mx y WHERE y.node_id LIKE 'region:%' OR y.node_id IN ('customer:1', 'customer:2'))"


def _similar(s: SparkSession, d: str) -> DataFrame:
    return propagation.similarities(_mixed(s, d), N(s, d).filter("type = 'region' OR node_id IN ('customer:1', 'customer:2')"))


add("gmm_similarity", lambda s, d: _similar(s, d).withColumn("similarity", F.round("similarity", 5)), with_(*MIXED, SIMILAR) + "SELECT a, b, round(similarity, 5) AS similarity FROM si")
add(
    "value_probability",
    lambda s, d: propagation.probability(_mixed(s, d), _src(s, d), 4500.0).withColumn("probability", F.round("probability", 5)),
    with_(*MIXED, "pq AS (SELECT node_id, kind, c, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (4500.0::DOUBLE - low) / (high - low))) AS v FROM mx, rg)")
    + "SELECT node_id, kind, round(CASE kind WHEN 'source' THEN greatest(0.0::DOUBLE, 1 - 10 * abs(v - c[1].m)) WHEN 'inferred' THEN least(1.0::DOUBLE, list_sum(list_transform(c, lambda q: q.w / q.s * exp(-0.5 * ((v - q.m) / q.s) ** 2))) / list_sum(list_transform(c, lambda q: q.w / q.s))) ELSE 0.05::DOUBLE END, 5) AS probability FROM pq",
)
add("influence_score", lambda s, d: propagation.influence_score(_mixed(s, d)).withColumn("score", F.round("score", 4)), with_(*MIXED) + "SELECT node_id, kind, round(10 * len(c) + CASE WHEN kind = 'isolated' THEN 0 ELSE 5 END + CASE WHEN len(c) > 1 THEN 20 * (list_max(list_transform(c, lambda q: q.m)) - list_min(list_transform(c, lambda q: q.m))) ELSE 0 END + CASE WHEN kind = 'inferred' THEN 15 ELSE 0 END, 4) AS score FROM mx")
add(
    "polar_layout",
    lambda s, d: (lambda p: p.filter("node_id NOT LIKE 'supplier%'").select("node_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("x", "y", "radius", "angle", "centrality")]))(propagation.polar_layout(_similar(s, d), propagation.values_of(_mixed(s, d), _src(s, d)))),
    with_(*MIXED, SIMILAR, "ce AS (SELECT a AS node_id, avg(similarity) AS centrality FROM si GROUP BY 1)", "po AS (SELECT node_id, centrality, 200 * (1 - centrality) AS radius, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 2 * pi() AS angle FROM ce JOIN mv USING (node_id))")
    + "SELECT node_id, round(radius * cos(angle), 3) + 0.0::DOUBLE AS x, round(radius * sin(angle), 3) + 0.0::DOUBLE AS y, round(radius, 3) AS radius, round(angle, 3) AS angle, round(centrality, 3) AS centrality FROM po WHERE node_id NOT LIKE 'supplier%'",
)
add("grid_layout", lambda s, d: propagation.grid_layout(N(s, d).filter("type IN ('nation', 'region')")), "SELECT node_id, k // side AS row, k % side AS \"column\", (k % side) * 50.0::DOUBLE AS x, (k // side) * 50.0::DOUBLE AS y FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS side FROM n WHERE type IN ('nation', 'region'))")
add(
    "density_curve",
    lambda s, d: propagation.density_curve(_mixed(s, d), "region:1", _src(s, d)).select(F.round("x", 4).alias("x"), "component", F.round("density", 8).alias("density")),
    with_(*MIXED, "ds AS (SELECT low + (high - low) * i / 299 AS x, k - 1 AS component, c[k].w * exp(-0.5 * ((low + (high - low) * i / 299 - (c[k].m * (high - low) + low)) / (c[k].s * (high - low))) ** 2) / (c[k].s * (high - low) * sqrt(2 * pi())) AS y FROM (SELECT *, unnest(generate_series(1, len(c))) AS k FROM mx, rg WHERE node_id = 'region:1'), range(0, 300) r(i))")
    + "SELECT round(x, 4) AS x, CAST(component AS INTEGER) AS component, round(y, 8) AS density FROM ds UNION ALL SELECT round(x, 4), -1, round(sum(y), 8) FROM ds GROUP BY ds.x",
)


def _believed(s: SparkSession, d: str) -> DataFrame:
    return propagation.believed(_geo(s, d), _src(s, d), propagation.belief_influences(_src(s, d), E(s, d, GEO)))


BELIEF = (
    "st(t, x1, x2, moved) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT t + 1, 0.1::DOUBLE * x1 + 0.9::DOUBLE * 0.85::DOUBLE, 0.1::DOUBLE * x2 + x1 * (0.9::DOUBLE * 0.85::DOUBLE), greatest(abs(0.1::DOUBLE * x1 + 0.9::DOUBLE * 0.85::DOUBLE - x1), abs(0.1::DOUBLE * x2 + x1 * (0.9::DOUBLE * 0.85::DOUBLE) - x2)) FROM st WHERE t < 15 AND moved >= 0.001)",
    *MIXED[:3],
    "bi AS (SELECT hp.node_id, round(sx.x, 4) AS m, round(CASE distance WHEN 1 THEN x1 ELSE x2 END, 2) AS i, sum(CASE distance WHEN 1 THEN x1 ELSE x2 END) AS w FROM hp JOIN sx ON sx.node_id = source, (SELECT * FROM st ORDER BY t DESC LIMIT 1) GROUP BY 1, 2, 3)",
    "bf AS (SELECT node_id, sum(w) AS evidence, "
    + fold_sql("list(struct_pack(m := m, w := w, s := 0.03::DOUBLE + 0.05::DOUBLE * (1 - i)) ORDER BY m, i)", 1 << 30, "0.08::DOUBLE", False)
    + " AS f FROM bi GROUP BY node_id)",
    "bh AS (SELECT node_id, evidence, list_transform(list_reverse_sort(list_transform(f, lambda q: {'w': q.w, 'm': q.m, 's': q.s}))[1:20], lambda q: {'m': q.m, 'w': q.w, 's': q.s}) AS f FROM bf)",
    f"bx AS (SELECT n.node_id, CASE WHEN sx.node_id IS NOT NULL THEN 'source' WHEN bh.node_id IS NOT NULL THEN 'inferred' ELSE 'isolated' END AS kind, CASE WHEN sx.node_id IS NOT NULL THEN [{{'m': sx.x, 'w': 1.0::DOUBLE, 's': 0.02::DOUBLE}}] WHEN bh.node_id IS NOT NULL THEN {NORMAL.format('f')} ELSE {EMPTY} END AS c, CASE WHEN sx.node_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(evidence, 0.0::DOUBLE) END AS evidence FROM n LEFT JOIN sx USING (node_id) LEFT JOIN bh USING (node_id) WHERE type IN ('customer', 'supplier', 'nation', 'region'))",
)
RECURSIVE = with_(*BELIEF)
add("belief_mixtures", lambda s, d: propagation.components_of(_believed(s, d)), RECURSIVE + COMPONENTS.format("bx"))
add("belief_evidence", lambda s, d: _believed(s, d).select("node_id", "kind", F.round("evidence", 3).alias("evidence")), RECURSIVE + "SELECT node_id, kind, round(evidence, 3) AS evidence FROM bx")


def _spectral(s: SparkSession, d: str, heat: bool) -> DataFrame:
    """On the whole graph: suppliers' balances."""
    n, src = N(s, d), propagation.sources(P(s, d), ["supplier"], "s_acctbal")
    c = propagation.components_of(propagation.assembled(n, src, propagation.spectral_mixtures(propagation.spectral_influences(n, E(s, d), src, heat=heat))))
    return c.select("node_id", "kind", "place", *[F.round(x, 5).alias(x) for x in ("weight", "mean", "std")])


def spectral_sql(heat: bool, order: int = propagation.ORDER, depth: int = 3, decay: float = 0.95, least: float = 0.01, boost: float = 1.3) -> str:
    """The polynomials' terms as a table each, their coefficients by the cosine sum."""
    n = 8 * (order + 1)
    v = "(top * (cos((j + 0.5::DOUBLE) * pi() / {n}) + 1) / 2)".format(n=n)
    f = f"exp(-{v} * d * 0.08::DOUBLE * 0.01::DOUBLE) * exp(-0.5::DOUBLE * ({v} / top) ** 2)" if heat else f"0.8::DOUBLE * exp(-0.5::DOUBLE * (({v} - top * 0.05::DOUBLE * d) / (top * 0.15::DOUBLE)) ** 2) + 0.2::DOUBLE"
    parts = [
        "so AS (SELECT node_id, d_val AS value, min(d_val) OVER () AS a, max(d_val) OVER () AS b FROM p WHERE prop = 's_acctbal')",
        f"sx AS MATERIALIZED (SELECT node_id, {X} AS x FROM so)",
        "ap AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst GROUP BY ALL)",
        "ids AS MATERIALIZED (SELECT node_id, row_number() OVER () AS i FROM n)",
        "aj AS MATERIALIZED (SELECT x.i, y.i AS j FROM (SELECT a, b FROM ap UNION ALL SELECT b, a FROM ap) JOIN ids x ON x.node_id = a JOIN ids y ON y.node_id = b)",
        "dg AS MATERIALIZED (SELECT i, count(*)::DOUBLE AS d FROM aj GROUP BY i)",
        "tp AS MATERIALIZED (SELECT max(x.d + y.d) AS top FROM aj JOIN dg x ON x.i = aj.i JOIN dg y ON y.i = aj.j)",
        f"cf AS MATERIALIZED (SELECT k, d, CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE 1 END * 2 / {n} * sum(({f}) * cos(k * (j + 0.5::DOUBLE) * pi() / {n})) AS c FROM tp, range(0, {order + 1}) a(k), range(1, {depth + 1}) b(d), range(0, {n}) c(j) GROUP BY k, d)",
        "t0 AS MATERIALIZED (SELECT i, round(x, 1) AS x, count(*)::DOUBLE AS v FROM sx JOIN ids USING (node_id) GROUP BY ALL)",
    ]
    for k in range(1, order + 1):
        one = f"SELECT t.i, x, ((2 / top) * coalesce(d, 0) - 1) * v AS v FROM t{k - 1} t LEFT JOIN dg USING (i), tp UNION ALL SELECT j, x, -(2 / top) * v FROM t{k - 1} JOIN aj USING (i), tp"
        whole = one if k == 1 else f"SELECT i, x, 2 * v AS v FROM ({one}) UNION ALL SELECT i, x, -v FROM t{k - 2}"
        parts.append(f"t{k} AS MATERIALIZED (SELECT i, x, sum(v) AS v FROM ({whole}) GROUP BY i, x)")
    terms = " UNION ALL ".join(f"SELECT {k} AS k, * FROM t{k}" for k in range(order + 1))
    z = "abs(y / length)" if heat else "greatest(y / length, 0)"
    low, high = (0.01, 0.02) if heat else (0.001, 0.015)
    w = "z * 0.5::DOUBLE" if heat else "z"
    parts += [
        f"ys AS MATERIALIZED (SELECT i, x, d, sum(c * v) AS y FROM ({terms}) JOIN cf USING (k) GROUP BY i, x, d)",
        "ln AS (SELECT x, d, sqrt(sum(y * y)) AS length FROM ys GROUP BY x, d)",
        f"zs AS (SELECT node_id, x, d, {z} * {decay}::DOUBLE ** d AS z FROM ys JOIN ln USING (x, d) JOIN ids USING (i) WHERE node_id NOT IN (SELECT node_id FROM sx))",
        f"fl AS (SELECT node_id, x AS m, d, CASE WHEN {w} < {least}::DOUBLE * 1.2::DOUBLE THEN {w} * {boost}::DOUBLE ELSE {w} END AS w, 0.025::DOUBLE + 0.015::DOUBLE * d AS s FROM zs WHERE z > (SELECT CASE WHEN count(*) < 500 THEN {low} ELSE {high} END FROM n))",
        # means that differ are .1 apart, farther than any that are folded into one: the fold is a sum by mean
        "fs AS (SELECT node_id, m, sum(w) AS w, sqrt(sum(w * s * s) / sum(w)) AS s FROM fl GROUP BY node_id, m)",
        "fp AS (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY m) - 1 AS place, w / sum(w) OVER (PARTITION BY node_id) AS w, m, s FROM fs)",
    ]
    return with_(*parts) + "SELECT node_id, 'source' AS kind, 0 AS place, 1.0::DOUBLE AS weight, round(x, 5) AS mean, 0.02::DOUBLE AS std FROM sx UNION ALL SELECT node_id, 'inferred', place::INTEGER, round(w, 5), round(m, 5), round(s, 5) FROM fp"


add("spectral_mixtures", lambda s, d: _spectral(s, d, False), spectral_sql(False))
add("heat_mixtures", lambda s, d: _spectral(s, d, True), spectral_sql(True))


def _shape(s: SparkSession, d: str) -> DataFrame:
    return propagation.shape(_geo(s, d), E(s, d, GEO))


def _tuning(s: SparkSession, d: str) -> DataFrame:
    p = propagation.tuning(_geo(s, d), E(s, d, GEO))
    return s.createDataFrame([(k, round(float(v), 6)) for k, v in p.items()], "parameter string, value double")


SHAPE = "up AS (SELECT src, dst FROM e WHERE edge_type = 'in_region')", "mem AS (SELECT dst AS r, src AS x FROM up UNION SELECT dst, dst FROM up UNION SELECT up.dst, e.src FROM e JOIN up ON e.dst = up.src WHERE e.edge_type = 'in_nation')", "sh AS (SELECT (SELECT count(*) FROM n WHERE type IN ('customer', 'supplier', 'nation', 'region')) AS n, (SELECT count(*) FROM e WHERE edge_type IN ('in_nation', 'in_region')) AS edges, 0.0::DOUBLE AS clustering, count(*) AS components, max(c) AS largest FROM (SELECT r, count(*) AS c FROM mem GROUP BY 1))"
add("graph_shape", _shape, with_(*SHAPE) + "SELECT * FROM sh")
add(
    "topology_tuning",
    _tuning,
    with_(*SHAPE, "de AS (SELECT *, edges / (CAST(n AS DOUBLE) * (n - 1)) AS z, largest / CAST(n AS DOUBLE) AS con FROM sh)", "di AS (SELECT *, CASE WHEN z > 0.1 THEN greatest(2, floor(log2(largest))) WHEN z > 0.01 THEN greatest(3, floor(ln(largest))) ELSE greatest(4, floor(sqrt(largest))) END AS dia, CASE WHEN z > 0.1 THEN 0.6 WHEN z > 0.01 THEN 0.7 ELSE 0.8 END AS sh, CASE WHEN z < 0.01 THEN 0 WHEN z < 0.05 THEN 1 ELSE 2 END AS band FROM de)",
          "pa AS (SELECT *, dia * sh::DOUBLE AS path FROM di)",
          """pr AS (SELECT z AS density, floor(least(10, greatest(3, floor(path * 1.5::DOUBLE) * CASE band WHEN 0 THEN 1.4 WHEN 1 THEN 1.2 ELSE greatest(0.6, 1 - z) END)) * 1.0) AS r0, CASE band WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.4 END AS damping,
          least(0.95, greatest(0.7, CASE WHEN band < 2 THEN 0.6 ELSE 0.5 END::DOUBLE ** (1 / path))) AS decay, least(5, greatest(2, least(dia + 1, floor(path * 1.5::DOUBLE)))) AS depth,
          floor(least(6, greatest(2, CASE WHEN band < 2 THEN 4 ELSE 3 END + 3 * (z + components / CAST(n AS DOUBLE))))) AS c0, CASE band WHEN 0 THEN 0.06 WHEN 1 THEN 0.08 ELSE 0.10 END AS m0,
          least(2.5, greatest(1.1, CASE band WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 + (1 - z * 10) ELSE 1.2 + (1 - z) * 0.5 END)) AS boost, least(0.05, greatest(0.002, CASE band WHEN 0 THEN 0.005 ELSE 0.01 * least(1.0, 100.0 / n) * greatest(0.5, z) END)) AS lw,
          least(20, greatest(5, CASE WHEN n < 50 THEN floor(n * 0.5) WHEN n < 200 THEN greatest(8, floor(path * 2)) ELSE greatest(6, floor(dia * 1.2::DOUBLE)) END)) AS e0, n, con FROM pa)""",
          "fi AS (SELECT *, CASE WHEN n > 2000 THEN floor(r0 * 0.8) ELSE r0 END AS rounds, CASE WHEN n > 2000 THEN floor(c0 * 0.8) ELSE c0 END AS c1, CASE WHEN n > 2000 THEN least(e0, 10) ELSE e0 END AS eigen FROM pr)")
    + """SELECT unnest(['density', 'rounds', 'damping', 'decay', 'depth', 'components', 'merge', 'boost', 'least_weight', 'eigenvectors']) AS parameter,
    round(unnest([density, rounds, damping, decay, depth, CASE WHEN con < 0.8 THEN least(c1 + 1, 6) ELSE c1 END, CASE WHEN con < 0.8 THEN greatest(m0 * 0.9, 0.05) ELSE m0 END, boost, lw, eigen]::DOUBLE[]), 6) AS value FROM fi""",
)
for _name in ("belief_mixtures", "belief_evidence"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)
