"""Queries of the calibration: paired hours, fit, baseline, held-out scores, diagnostics, chemistry check, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import chemistry, emissions, weather
from aerolake.functions.calendar import rounded
from aerolake.operators import calibration as cal
from aerolake.operators.series import chang_hanna
from aerolake.plans.emission_queries import TRAFFIC
from aerolake.plans.ledger import DAYTYPE_H, HOLIDAY_TABLE, LOCAL, SECTOR, SERIES, WEATHER, ledger
from aerolake.plans.ledger import weather as met
from aerolake.plans.queries import scheme_sql
from aerolake.sources.intermediate import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Rounds of ever finer grids in the SQL of the fit, until a step in ln(beta) is under 1e-6.
ZOOMS = 7


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


OTHERS = ("road.no2", "park.no2", "park.o3")
WIDE = ", ".join(f"max(v) FILTER (key = '{k}') AS {k.replace('.', '_')}" for k in ("road.nox", "park.nox", *OTHERS))
UTC = "CAST(year(t - INTERVAL 1 HOUR) * 100 + month(t - INTERVAL 1 HOUR) AS INTEGER)"
#: Paired hours with local columns, class and strength s, ending in ``hr``.
HOURS = f"""{SERIES}, {WEATHER}, {HOLIDAY_TABLE}, wd AS (SELECT t, {WIDE} FROM s GROUP BY 1),
ha AS (SELECT wd.*, u, direction, sw, cc, t2, road_nox - park_nox AS obs, {UTC.replace('t -', 'wd.t -')} AS month, {LOCAL.format('wd.t')} AS l FROM wd JOIN w ON wd.t = w.t WHERE road_nox IS NOT NULL AND park_nox IS NOT NULL AND u IS NOT NULL AND direction IS NOT NULL),
hm AS (SELECT month FROM ha GROUP BY 1 HAVING count(*) / (24 * day(last_day(make_date(month // 100, month % 100, 1)))) >= 0.75),
hr AS MATERIALIZED (SELECT *, {DAYTYPE_H.format('l')} AS daytype, CAST(hour(l) AS INTEGER) AS hour, CASE WHEN sw > 0 THEN substr(CASE WHEN sw >= 925 THEN 'AABCC' WHEN sw >= 675 THEN 'ABBCD' WHEN sw >= 175 THEN 'BCCDD' ELSE 'DDDDD' END,
CASE WHEN u < 2 THEN 1 WHEN u < 3 THEN 2 WHEN u < 5 THEN 3 WHEN u < 6 THEN 4 ELSE 5 END, 1) WHEN cc >= 95 THEN 'D' WHEN cc > 40 THEN CASE WHEN u < 1.9 THEN 'F' WHEN u < 3.4 THEN 'E' ELSE 'D' END ELSE CASE WHEN u < 3.4 THEN 'F' WHEN u < 5.5 THEN 'E' ELSE 'D' END END AS cls,
{TRAFFIC.format(l='l')} * 1e-5 * (2 + cos(radians(direction))) AS s FROM ha SEMI JOIN hm USING (month))"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cal.paired_hours(ledger(spark, sf_dir), met(spark, sf_dir), "road.nox", "park.nox", OTHERS)
    cls = weather.stability(F.col("u"), F.col("sw"), F.col("cc"))
    return materialise(out.withColumn("cls", cls).withColumn("s", emissions.traffic_factor(F.col("t")) * 1e-5 * (2 + F.cos(F.radians("direction")))), "paired-hours")


@query(f"WITH {HOURS} SELECT t, month, daytype, hour, cls, round(obs + 1e-9, 6) AS obs, round(s * 1e6 + 1e-9, 6) AS s FROM hr")
def calibration_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements joined with weather, paired, in months with enough capture."""
    return _hours(spark, sf_dir).select("t", "month", "daytype", "hour", "cls", rounded(F.col("obs")).alias("obs"), rounded(F.col("s") * 1e6).alias("s"))


LO, HI = cal.LN_BETA


def _fit_sql(rows: str) -> str:
    """CTEs ending in ``ft`` (fold, u0, beta, loss): the grid over ``rows`` (fold, s, u, obs), then finer grids."""
    out = f"fm AS MATERIALIZED (SELECT fold, ln(obs + 10) AS l, u0, 1e6::DOUBLE * s / sqrt(u * u + u0 * u0) AS m FROM {rows}, (SELECT round(0.5 + 0.05::DOUBLE * i, 2) AS u0 FROM range(51) r(i)) WHERE obs > -10), b0 AS (SELECT DISTINCT fold, u0, {LO!r}::DOUBLE AS lo, {HI!r}::DOUBLE AS hi FROM fm)"
    for turn in range(ZOOMS + 1):
        n = 40 if turn == 0 else 12  # later rounds: a sixth of what is left
        out += f""", t{turn} AS MATERIALIZED (SELECT fold, u0, lo, hi, i, exp(lo + (hi - lo) * i / {n}) AS b FROM b{turn}, range({n + 1}) r(i)),
j{turn} AS MATERIALIZED (SELECT fold, u0, i, sum((l - ln(b * m + 10)) * (l - ln(b * m + 10))) AS j FROM fm JOIN t{turn} USING (fold, u0) GROUP BY 1, 2, 3),
m{turn} AS MATERIALIZED (SELECT fold, u0, lo, hi, arg_min(i, j) AS i, min(j) AS j FROM j{turn} JOIN t{turn} USING (fold, u0, i) GROUP BY 1, 2, 3, 4), b{turn + 1} AS (SELECT fold, u0, lo + (hi - lo) * greatest(i - 1, 0) / {n} AS lo, lo + (hi - lo) * least(i + 1, {n}) / {n} AS hi FROM m{turn})"""
    last = f"m{ZOOMS}"
    return out + f", ft AS (SELECT fold, arg_min(u0, round(j, 9)) AS u0, arg_min(exp(lo + (hi - lo) * i / 12), round(j, 9)) AS beta, round(min(j), 9) AS loss FROM {last} GROUP BY 1)"


FOLDS = "tr AS (SELECT CASE WHEN month % 100 <= 6 THEN 'first' ELSE 'second' END AS fold, * FROM hr)"
ALL = "tr AS (SELECT 'all' AS fold, * FROM hr)"


@query(f"WITH {HOURS}, {ALL}, {_fit_sql('tr')} SELECT u0, round(beta + 1e-9, 4) AS beta, round(loss + 1e-9, 4) AS loss, (SELECT count(*) FROM hr) AS n, (SELECT CAST(count(*) FILTER (obs <= -10) AS BIGINT) FROM hr) AS n_dropped FROM ft")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cal.fit(_hours(spark, sf_dir))
    return out.select("u0", rounded(F.col("beta"), 4).alias("beta"), rounded(F.col("loss"), 4).alias("loss"), "n", "n_dropped")


BASE = f"""bx AS (SELECT *, obs * sqrt(u * u + 1.44) AS x, {SECTOR.format('direction')} AS sector FROM tr), bp AS (SELECT fold, daytype, hour, median(x) AS p FROM bx GROUP BY 1, 2, 3),
bq AS (SELECT fold, sector, median(x / p) AS q FROM bx JOIN bp USING (fold, daytype, hour) WHERE p > 0 GROUP BY 1, 2)"""
TEST = f"""te AS (SELECT CASE WHEN month % 100 <= 6 THEN 'second' ELSE 'first' END AS fold, {SECTOR.format('direction')} AS sector, * FROM hr),
pr AS (SELECT te.*, 1e6::DOUBLE * beta * s / sqrt(u * u + u0 * u0) AS mod, p * q / sqrt(u * u + 1.44) AS base FROM te JOIN ft USING (fold) LEFT JOIN bp USING (fold, daytype, hour) LEFT JOIN bq USING (fold, sector))"""
HELD = f"{HOURS}, {FOLDS}, {_fit_sql('tr')}, {BASE}, {TEST}"


@query(f"""WITH {HELD}, k AS (SELECT 'model' AS kind, obs AS o, mod AS p FROM pr UNION ALL SELECT 'baseline', obs, base FROM pr),
m AS (SELECT kind, count(*) AS n, avg(o) AS mo, avg(p) AS mp, avg((o - p) * (o - p)) AS mse, covar_pop(o, p) AS c, stddev_pop(o) AS so, stddev_pop(p) AS sp, avg(CASE WHEN greatest(p, 1) / greatest(o, 1) BETWEEN 0.5 AND 2 THEN 1.0::DOUBLE ELSE 0 END) AS fac2 FROM k WHERE p IS NOT NULL GROUP BY 1)
SELECT kind, n, round(2 * (mo - mp) / (mo + mp) + 1e-9, 5) AS fb, round(sqrt(mse) + 1e-9, 4) AS rmse, round(c / (so * sp) + 1e-9, 5) AS r, round(fac2 + 1e-9, 4) AS fac2 FROM m""")
def half_year_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and baseline on the half-years they were not fitted on."""
    out = cal.scores(cal.half_years(_hours(spark, sf_dir)))
    return out.select("kind", "n", rounded(F.col("fb"), 5).alias("fb"), rounded(F.col("rmse"), 4).alias("rmse"), rounded(F.col("r"), 5).alias("r"), rounded(F.col("fac2"), 4).alias("fac2"))


SPEED = "CASE " + " ".join(f"WHEN u >= {a} AND u < {b} THEN '{a:g}-{b:g}'" for a, b in cal.SPEED_BINS) + " END"


@query(f"""WITH {HELD}, g AS (SELECT 'sector' AS kind, CASE WHEN u > 1.5 THEN CAST(sector AS VARCHAR) END AS key, obs, mod FROM pr UNION ALL SELECT 'hour', CAST(hour AS VARCHAR), obs, mod FROM pr UNION ALL SELECT 'class', cls, obs, mod FROM pr
UNION ALL SELECT 'speed', {SPEED}, obs, mod FROM pr UNION ALL SELECT 'month', CAST(month AS VARCHAR), obs, mod FROM pr UNION ALL SELECT 'daytype', daytype, obs, mod FROM pr)
SELECT kind, key, count(*) AS n, round(CASE WHEN count(*) >= 30 AND sum(mod) > 0 THEN sum(obs) / sum(mod) END + 1e-9, 5) AS ratio FROM g WHERE key IS NOT NULL GROUP BY 1, 2""")
def held_out_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.diagnostics(cal.half_years(_hours(spark, sf_dir))).withColumn("ratio", rounded(F.col("ratio"), 5))


#: Left out month by month: ``jp`` holds each month's losses, ``jt`` their total, a fold is the total less its month; then a fine grid in common and the parabola through its lowest points.
STEP = (HI - LO) / 40
LOSS = "sum(power(l - ln(1e6::DOUBLE * exp({x}) * s / sqrt(u * u + u0 * u0) + 10), 2))"
LOMO = f"""fl AS MATERIALIZED (SELECT month, s, u, ln(obs + 10) AS l FROM hr WHERE obs > -10), u0s AS (SELECT round(0.5 + 0.05::DOUBLE * i, 2) AS u0 FROM range(51) r(i)), mo AS (SELECT DISTINCT month FROM hr),
jp AS MATERIALIZED (SELECT month, u0, i, {LOSS.format(x=f'({LO!r}::DOUBLE + {STEP!r}::DOUBLE * i)')} AS j FROM fl, u0s, range(41) r(i) GROUP BY 1, 2, 3),
jt AS (SELECT u0, i, sum(j) AS j FROM jp GROUP BY 1, 2),
jc AS (SELECT mo.month, jt.u0, arg_min(jt.i, jt.j - coalesce(jp.j, 0)) AS i FROM mo JOIN jt ON true LEFT JOIN jp ON jp.month = mo.month AND jp.u0 = jt.u0 AND jp.i = jt.i GROUP BY 1, 2),
jb AS MATERIALIZED (SELECT u0, min(greatest(i - 1, 0)) AS a, max(least(i + 1, 40)) AS b FROM jc GROUP BY 1),
ka AS (SELECT u0, a, unnest(range(0, (b - a) * 50 + 1)) AS k FROM jb),
kp AS MATERIALIZED (SELECT month, u0, k, {LOSS.format(x=f'({LO!r}::DOUBLE + {STEP!r}::DOUBLE * (a + k / 50.0::DOUBLE))')} AS j FROM fl, ka GROUP BY 1, 2, 3),
kt AS (SELECT u0, k, sum(j) AS j FROM kp GROUP BY 1, 2),
kf AS MATERIALIZED (SELECT mo.month, kt.u0, kt.k, kt.j - coalesce(kp.j, 0) AS j FROM mo JOIN kt ON true LEFT JOIN kp ON kp.month = mo.month AND kp.u0 = kt.u0 AND kp.k = kt.k),
km AS (SELECT month, u0, arg_min(k, j) AS k FROM kf GROUP BY 1, 2),
kv AS (SELECT m.month, m.u0, m.k, f.j AS j0, g.j AS jl, h.j AS jr FROM km m JOIN kf f USING (month, u0, k) LEFT JOIN kf g ON g.month = m.month AND g.u0 = m.u0 AND g.k = m.k - 1 LEFT JOIN kf h ON h.month = m.month AND h.u0 = m.u0 AND h.k = m.k + 1),
kb AS (SELECT month, u0, k + coalesce((jl - jr) / (2 * (jl - 2 * j0 + jr)), 0) AS k, j0 - coalesce(power(jl - jr, 2) / (8 * (jl - 2 * j0 + jr)), 0) AS j FROM kv),
lp AS (SELECT month AS fold, arg_min(u0, j) AS u0, arg_min(exp({LO!r}::DOUBLE + {STEP!r}::DOUBLE * (a + k / 50.0::DOUBLE)), j) AS beta FROM kb JOIN jb USING (u0) GROUP BY 1)"""


@query(f"WITH {HOURS}, {LOMO} SELECT fold AS month, u0, round(beta + 1e-9, 3) AS beta, (SELECT count(*) FROM hr WHERE month <> fold) AS n FROM lp")
def month_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of all months but one, for each month."""
    out = cal.fit_parts(_hours(spark, sf_dir), F.col("month"), leave_out=True)
    return out.select(F.col("part").alias("month"), "u0", rounded(F.col("beta"), 3).alias("beta"), "n")


OUT = f"""tr AS (SELECT mo.month AS fold, hr.obs, hr.u, hr.direction, hr.daytype, hr.hour FROM mo JOIN hr ON hr.month <> mo.month), {BASE},
te AS (SELECT month AS fold, {SECTOR.format('direction')} AS sector, * FROM hr),
pr AS (SELECT te.*, u0, 1e6::DOUBLE * beta * s / sqrt(u * u + u0 * u0) AS mod, p * q / sqrt(u * u + 1.44) AS base FROM te JOIN lp USING (fold) LEFT JOIN bp USING (fold, daytype, hour) LEFT JOIN bq USING (fold, sector))"""
MEANS = """k AS (SELECT 'model' AS kind, obs AS o, mod AS p FROM pr UNION ALL SELECT 'baseline', obs, base FROM pr),
m AS (SELECT kind, count(*) AS n, avg(o) AS mo, avg(p) AS mp, avg((o - p) * (o - p)) AS mse, avg(abs(o - p)) AS mae, covar_pop(o, p) AS c, stddev_pop(o) AS so, stddev_pop(p) AS sp, avg(CASE WHEN greatest(p, 1) / greatest(o, 1) BETWEEN 0.5 AND 2 THEN 1.0::DOUBLE ELSE 0 END) AS fac2,
avg(ln(greatest(o, 1)) - ln(greatest(p, 1))) AS l1, avg(power(ln(greatest(o, 1)) - ln(greatest(p, 1)), 2)) AS l2 FROM k WHERE p IS NOT NULL GROUP BY 1)"""


@query(f"WITH {HOURS}, {LOMO}, {OUT}, {MEANS} SELECT kind, n, round(2 * (mo - mp) / (mo + mp) + 1e-9, 4) AS fb, round(sqrt(mse) + 1e-9, 3) AS rmse, round(c / (so * sp) + 1e-9, 4) AS r, round(fac2 + 1e-9, 3) AS fac2 FROM m")
def month_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and baseline on months that they were not fitted on."""
    out = cal.scores(cal.months_left_out(_hours(spark, sf_dir)))
    return out.select("kind", "n", rounded(F.col("fb"), 4).alias("fb"), rounded(F.col("rmse"), 3).alias("rmse"), rounded(F.col("r"), 4).alias("r"), rounded(F.col("fac2"), 3).alias("fac2"))


@query(f"""WITH {HELD}, {MEANS}, v AS (SELECT kind, unnest(['fb', 'nmse', 'fac2', 'nad', 'r', 'mg', 'vg']) AS score, unnest([2 * (mo - mp) / (mo + mp), mse / (mo * mp), fac2, mae / (mo + mp), c / (so * sp), exp(l1), exp(l2)]) AS value FROM m)
SELECT a.kind, a.score, round(a.value + 1e-9, 4) AS value, CASE a.score WHEN 'fb' THEN abs(a.value) < 0.67 WHEN 'nmse' THEN a.value < 6 WHEN 'fac2' THEN a.value > 0.3 WHEN 'nad' THEN a.value < 0.5 END AS accepted,
CASE WHEN a.kind = 'model' THEN CASE WHEN a.score = 'r' THEN a.value > b.value WHEN a.score IN ('nmse', 'vg') THEN a.value < b.value END END AS better FROM v a LEFT JOIN v b ON b.kind = 'baseline' AND b.score = a.score""")
def calibration_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores against the urban criteria and the baseline."""
    out = cal.verdict(cal.scores(cal.half_years(_hours(spark, sf_dir))))
    return out.withColumn("value", rounded(F.col("value"), 4))


JK = "greatest(0, 1.05::DOUBLE * (1.47e-5::DOUBLE * greatest(0, coalesce(sw, 0)) - 4.84e-9::DOUBLE * power(greatest(0, coalesce(sw, 0)), 2)))"
KK = "3.0e-12::DOUBLE * exp(-1500 / (coalesce(t2, 15) + 273.15::DOUBLE)) * (7.2429e18::DOUBLE * 1013.25::DOUBLE / (coalesce(t2, 15) + 273.15::DOUBLE)) * 1e-9::DOUBLE"


@query(f"""WITH {HOURS}, ck AS (SELECT *, road_no2 AS o FROM hr WHERE road_no2 IS NOT NULL AND park_no2 IS NOT NULL AND park_o3 IS NOT NULL AND sw IS NOT NULL AND t2 IS NOT NULL), {scheme_sql('ck', 't, o', 'obs', 'park_no2', 'park_nox', 'park_o3', '60::DOUBLE', JK, KK)}
SELECT count(*) AS n, round(avg(o) + 1e-9, 5) AS mean_obs, round(avg(no2) + 1e-9, 5) AS mean_mod, round(sqrt(avg((o - no2) * (o - no2))) + 1e-9, 5) AS rmse, round(corr(o, no2) + 1e-9, 5) AS r,
round(sqrt(avg((o - no2) * (o - no2))) / (2 * sqrt(avg(0.0576::DOUBLE * (0.96::DOUBLE * o * o + 1600)))) + 1e-9, 5) AS mqi FROM sch""")
def chemistry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NO2 from measured NOx by the scheme alone, against measured NO2."""
    h = _hours(spark, sf_dir).dropna(subset=["road_no2", "park_no2", "park_o3", "sw", "t2"])
    made = chemistry.with_no2(h, "made", F.col("obs"), F.col("park_no2"), F.col("park_nox"), F.col("park_o3"), F.lit(60.0), chemistry.photolysis(F.col("sw")), chemistry.titration(F.col("t2")))
    rows = made.select(F.col("road_no2").alias("o"), F.col("made.no2").alias("p"))
    mqi = rows.agg(chemistry.quality_indicator(F.col("o"), F.col("p"), "no2").alias("mqi"), F.avg("o").alias("mo"), F.avg("p").alias("mp"))
    out = chang_hanna(rows, 1.0).join(F.broadcast(mqi), F.lit(True))  # one row each
    return out.select("n", rounded(F.col("mo"), 5).alias("mean_obs"), rounded(F.col("mp"), 5).alias("mean_mod"), rounded(F.col("rmse"), 5).alias("rmse"), rounded(F.col("r"), 5).alias("r"), rounded(F.col("mqi"), 5).alias("mqi"))


@query(f"""WITH {HELD.replace("base FROM te", "base, u0 FROM te")}, pt AS (SELECT *, CASE WHEN s > 0 THEN s * (10 + hour) / (sqrt(u * u + u0 * u0) * s) ELSE 60 END AS tau FROM pr WHERE road_no2 IS NOT NULL AND park_no2 IS NOT NULL AND park_nox IS NOT NULL AND park_o3 IS NOT NULL AND mod IS NOT NULL),
{scheme_sql('pt', 't, road_no2, road_nox', 'mod', 'park_no2', 'park_nox', 'park_o3', 'tau', JK, KK)}, k AS (SELECT 'no2' AS pollutant, road_no2 AS o, no2 AS p FROM sch UNION ALL SELECT 'nox', road_nox, nox FROM sch)
SELECT pollutant, count(*) AS n, round(2 * (avg(o) - avg(p)) / (avg(o) + avg(p)) + 1e-9, 4) AS fb, round(sqrt(avg((o - p) * (o - p))) + 1e-9, 3) AS rmse, round(corr(o, p) + 1e-9, 4) AS r,
CASE pollutant WHEN 'no2' THEN round(sqrt(avg((o - p) * (o - p))) / (2 * sqrt(avg(0.0576::DOUBLE * (0.96::DOUBLE * o * o + 1600)))) + 1e-9, 4) END AS mqi FROM k WHERE o IS NOT NULL AND p IS NOT NULL GROUP BY 1""")
def calibration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NO2 and NOx in full from held-out increments, the plume's age with the u0 of the fold that predicted the hour."""
    keys = {"no2": "road_no2", "nox": "road_nox", "bg_no2": "park_no2", "bg_nox": "park_nox", "bg_o3": "park_o3"}
    out = cal.totals(cal.half_years(_hours(spark, sf_dir)), F.col("s") * (10 + F.col("hour")), F.col("s"), keys)
    return out.select("pollutant", "n", rounded(F.col("fb"), 4).alias("fb"), rounded(F.col("rmse"), 3).alias("rmse"), rounded(F.col("r"), 4).alias("r"), rounded(F.col("mqi"), 4).alias("mqi"))


@query(f"WITH {HOURS}, q AS (SELECT unnest(['A', 'B']) AS grp, unnest([s * (hour % 5) / 10, s * (2 + cos(radians(direction))) / 9]) AS q, unnest([s, s * 2]) AS a FROM hr WHERE daytype = 'weekday' AND hour IN (7, 8, 15, 16, 17)) SELECT v.grp, round(coalesce(sum(q) / sum(a), any_value(usual)) + 1e-9, 6) AS share FROM (VALUES ('A', 0.21::DOUBLE), ('B', 0.37)) v(grp, usual) LEFT JOIN q ON q.grp = v.grp GROUP BY 1")
def congestion_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queueing share of two groups over weekday rush hours."""
    s = F.col("s")
    hours = _hours(spark, sf_dir).withColumns({"queue_A": s * (F.col("hour") % 5) / 10, "gamma_A": s, "queue_B": s * (2 + F.cos(F.radians("direction"))) / 9, "gamma_B": s * 2})
    return cal.congestion_share(hours).withColumn("share", rounded(F.col("share")))


TABLE = [(g, 22.5 * d, [(1 + (7 * d + 3 * k + c) % 5) / 10 for k in range(4)]) for c, g in enumerate(("AC", "D", "EF")) for d in range(16)]
TABLE_SQL = "lu(grp, direction, g) AS (VALUES " + ", ".join(f"('{g}', {d}::DOUBLE, [{', '.join(f'{x}::DOUBLE' for x in v)}])" for g, d, v in TABLE) + ")"
APART = "abs((d.direction - h.direction + 540) % 360 - 180)"


@query(f"""WITH {HOURS}, {TABLE_SQL}, lk AS (SELECT h.t, d.g, CASE WHEN h.u < 0.5 THEN 1 ELSE exp(-power({APART}, 2) / (2 * power(least(60, 22.5 * greatest(1, 2 / greatest(h.u, 1e-9))), 2))) END AS w
FROM hr h JOIN lu d ON d.grp = CASE WHEN cls IN ('A', 'B', 'C') THEN 'AC' WHEN cls IN ('E', 'F') THEN 'EF' ELSE 'D' END)
SELECT t, {', '.join(f'round(sum(w * g[{k + 1}]) / sum(w) + 1e-9, 6) AS g{k}' for k in range(4))} FROM lk GROUP BY 1""")
def table_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows of each hour's stability group, weighted over sixteen directions."""
    table = spark.createDataFrame(TABLE, "grp string, direction double, g array<double>")
    out = cal.smoothed(_hours(spark, sf_dir), table)
    return out.select("t", *(rounded(F.get("gamma", F.lit(k))).alias(f"g{k}") for k in range(4)))
