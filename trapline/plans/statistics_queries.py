"""Named queries for trends, daily activity and community statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions.names import species_label
from trapline.operators import activity as A
from trapline.operators import community as M
from trapline.operators import consensus as C
from trapline.operators import curves as D
from trapline.operators import filters as L
from trapline.operators import reports as R
from trapline.operators import scope as S
from trapline.operators import trends as T
from trapline.plans.registry import query
from trapline.plans.report_queries import ACTIVITY, DAYS_SQL, FIRST, LAST, STEPS_SQL, activity
from trapline.session import cut_lineage, shared_folder
from trapline.sources import tables as W

# The counts of the reports themselves.
ITERATIONS = 10_000
REPLICATES = 1_000


def scopes(s, facts):
    return S.all_scopes(facts, s.institutions, s.location_institutions)


SCOPES_SQL = """SELECT DISTINCT 'global' AS scope_type, '' AS scope_id, location_id FROM activity
    UNION ALL SELECT 'institution', CAST(institution_id AS STRING), location_id FROM location_institutions
        WHERE location_id IN (SELECT location_id FROM activity)
    UNION ALL SELECT DISTINCT 'ecoregion', i.ecoregion, li.location_id FROM location_institutions li JOIN institutions i ON i.id = li.institution_id
        WHERE li.location_id IN (SELECT location_id FROM activity)"""

KEY = "CAST('0x' || SUBSTR(MD5({text}), 1, 7) AS BIGINT)"


def _mix(source: str) -> str:
    """SQL of the draw steps over rows that carry k (key), i (iteration), d (place) and n (size): the draws of a group of one slice, as all
    groups of these tables are. ``tests/test_properties.py`` works groups of many slices out in plain Python."""
    steps = f"SELECT *, (k * 48271 + i * 69621 + d * 16807 + 1) % 2147483647 AS x FROM {source}"
    for a in (40692, 48271, 69621):
        steps = f"SELECT * REPLACE (((x * x) % 2147483647 + ({a} * x) % 2147483647 + d + i) % 2147483647 AS x) FROM ({steps})"
    return f"SELECT *, x % n AS pick FROM ({steps})"


TREND = {
    **ACTIVITY,
    "scopes": SCOPES_SQL,
    "yearly": """SELECT species_id, location_id, year, CAST(SUM(detection_count) AS BIGINT) AS det, CAST(SUM(trap_days) AS BIGINT) AS trap
        FROM activity GROUP BY 1, 2, 3""",
    "scoped": """SELECT y.species_id, s.scope_type, s.scope_id, y.location_id, y.year, y.det, y.trap,
        DENSE_RANK() OVER (PARTITION BY s.scope_type, s.scope_id ORDER BY y.location_id) - 1 AS site
        FROM yearly y JOIN scopes s ON s.location_id = y.location_id""",
    "places": f"""SELECT scope_type, scope_id, {KEY.format(text="scope_type || '|' || scope_id")} AS k,
        CAST(i.i AS BIGINT) AS i, CAST(d.d AS BIGINT) AS d, n FROM (SELECT scope_type, scope_id, MAX(site) + 1 AS n FROM scoped GROUP BY 1, 2) g
        CROSS JOIN (SELECT UNNEST(RANGE({ITERATIONS})) AS i) i CROSS JOIN LATERAL (SELECT UNNEST(RANGE(n)) AS d) d""",
    "drawn": _mix("places"),
    "resampled": """SELECT c.species_id, w.scope_type, w.scope_id, w.i AS iteration, c.year, CAST(SUM(c.det * w.m) AS BIGINT) AS detections,
        CAST(SUM(c.trap * w.m) AS BIGINT) AS trap_days FROM (SELECT scope_type, scope_id, i, pick, COUNT(*) AS m FROM drawn GROUP BY ALL) w
        JOIN scoped c ON c.scope_type = w.scope_type AND c.scope_id = w.scope_id AND c.site = w.pick GROUP BY 1, 2, 3, 4, 5""",
    "trends": """SELECT species_id, scope_type, scope_id, year, ROUND(AVG(detections * 100 / trap_days), 9) AS mean_dr_index,
        QUANTILE_CONT(detections * 100 / trap_days, 0.025) AS lower_ci, QUANTILE_CONT(detections * 100 / trap_days, 0.975) AS upper_ci
        FROM resampled WHERE trap_days > 0 GROUP BY 1, 2, 3, 4""",
}


def stored_activity(s):
    """The activity table, written once: trends, scopes and tests all read it."""
    path = W.fresh_folder(shared_folder(s.spark), "activity")
    W.replace_table(activity(s), path)
    return s.spark.read.parquet(path)


def _trends(s):
    facts = stored_activity(s)
    return T.yearly_trend(T.yearly_sums(facts), scopes(s, facts), ITERATIONS)


@query(
    "t1_yearly_trend",
    """SELECT species_id, scope_type, scope_id, year, ROUND(mean_dr_index, 6) AS mean_dr_index, ROUND(lower_ci, 6) AS lower_ci,
    ROUND(upper_ci, 6) AS upper_ci FROM trends""",
    **TREND,
)
def yearly_trend(s):
    rounded = [F.round(c, 6).alias(c) for c in ("mean_dr_index", "lower_ci", "upper_ci")]
    return _trends(s).select(*T.SCOPE, "year", *rounded)


@query("t2_scopes", "SELECT * FROM scopes", **TREND)
def all_scopes(s):
    return scopes(s, activity(s))


# A second series per species and scope, coarse enough to hold many equal values, so that the tie rules are exercised.
KENDALL = {
    "pairs": """SELECT a.species_id, a.scope_type, a.scope_id, (b.mean_dr_index - a.mean_dr_index) / (b.year - a.year) AS slope
        FROM series a JOIN series b ON b.species_id = a.species_id AND b.scope_type = a.scope_type AND b.scope_id = a.scope_id AND b.year > a.year""",
    "slopes": """SELECT species_id, scope_type, scope_id, COUNT(*) AS tot, COUNT(*) FILTER (WHERE slope > 0) AS up, COUNT(*) FILTER (WHERE slope < 0) AS down,
        COUNT(*) FILTER (WHERE slope = 0) AS tied, MEDIAN(slope) AS sen FROM pairs GROUP BY 1, 2, 3""",
    "weights": """SELECT species_id, scope_type, scope_id, SUM(t) AS n, SUM(t * (t - 1) * (2 * t + 5)) AS w FROM (
        SELECT species_id, scope_type, scope_id, mean_dr_index, COUNT(*) AS t FROM series GROUP BY 1, 2, 3, 4) g GROUP BY 1, 2, 3 HAVING SUM(t) >= 5""",
    "paths": """WITH RECURSIVE walk(n, c) AS (SELECT 1, 0 UNION ALL SELECT walk.n + 1, walk.c + s.j FROM walk, (SELECT UNNEST(RANGE(8)) AS j) s
        WHERE s.j <= walk.n AND walk.n < 8) SELECT n, c, COUNT(*) AS f FROM walk GROUP BY n, c""",
}
KENDALL_SQL = """SELECT w.species_id, w.scope_type, w.scope_id, CAST(w.n AS INT) AS n_years,
    CASE WHEN s.tied = s.tot THEN 0.0 ELSE ROUND((s.up - s.down) / SQRT(s.tot) / SQRT(s.tot - s.tied), 6) END AS mk_tau,
    CASE WHEN s.tied = s.tot THEN 0.0 ELSE ROUND(s.sen, 6) END AS sen_slope{p}
    FROM weights w JOIN slopes s ON s.species_id = w.species_id AND s.scope_type = w.scope_type AND s.scope_id = w.scope_id"""
# Exact without ties, else the normal approximation; erfc by the power series of erf, exact to 1e-11 for the short series here.
BOTH_P = """,
    ROUND(CASE WHEN s.tied = s.tot OR s.tied = 0 AND 4 * LEAST(s.down, s.tot - s.down) = w.n * (w.n - 1) THEN 1.0 WHEN s.tied = 0 THEN (SELECT 2 * SUM(f) FROM paths
        WHERE paths.n = w.n AND paths.c <= LEAST(s.down, s.tot - s.down)) / (SELECT SUM(f) FROM paths WHERE paths.n = w.n)
        ELSE 1 - 2 / SQRT(PI()) * LIST_SUM(LIST_TRANSFORM(RANGE(50), lambda k: POWER(-1::DOUBLE, k)
            * POWER(ABS(s.up - s.down) / SQRT((w.n * (w.n - 1) * (2 * w.n + 5) - w.w) / 18.0::DOUBLE) / SQRT(2.0::DOUBLE), 2 * k + 1) / GAMMA(k + 1.0::DOUBLE) / (2 * k + 1))) END, 6) AS mk_p"""


def _tested(trends):
    numbers = [F.round(c, 6).alias(c) for c in ("mk_tau", "sen_slope")]
    return T.trend_test(trends).select(*T.SCOPE, "n_years", *numbers, F.round("mk_p", 6).alias("mk_p"), "trend")


@query(
    "t3_trend_test",
    f"""SELECT *, CASE WHEN mk_p < 0.05 AND mk_tau > 0 THEN 'increasing' WHEN mk_p < 0.05 AND mk_tau < 0 THEN 'decreasing' ELSE 'no_trend' END AS trend
    FROM ({KENDALL_SQL.format(p=BOTH_P)}) t""",
    series="SELECT species_id, scope_type, scope_id, year, mean_dr_index FROM trends",
    **TREND,
    **KENDALL,
)
def trend_test(s):
    return _tested(_trends(s))


COARSE = "SELECT species_id, scope_type, scope_id, year, ROUND(mean_dr_index / 8) AS mean_dr_index FROM trends"


@query("t4_theil_sen_with_ties", KENDALL_SQL.format(p=BOTH_P), series=COARSE, **TREND, **KENDALL)
def theil_sen_with_ties(s):
    coarse = _trends(s).withColumn("mean_dr_index", F.round(F.col("mean_dr_index") / 8))
    return _tested(coarse).drop("trend")


# --- daily activity -------------------------------------------------------------------------------------------------------
def _verified(s):
    placed = S.at_valid_locations(L.started_between(s.observations, FIRST, LAST), s.locations)
    return C.verified_series(placed, s.identifications, s.photos).where("species_id IS NOT NULL")


def _times(s, species_only: bool = True):
    rows = _verified(s)
    return cut_lineage(D.detection_times(rows.where("species_id > 0") if species_only else rows))


def _effort(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return A.total_effort(A.photo_days(L.captured_between(s.photos, FIRST, LAST), placed))


HOURS = {
    "hours": f"""SELECT id, species_id, location_id, EPOCH_US(series_start_time - DATE_TRUNC('day', series_start_time)) / 3600000000 AS h
        FROM verified WHERE species_id IS NOT NULL AND location_id IN (SELECT id FROM lenient_locations)
        AND CAST(series_start_time AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
    "animal_hours": "SELECT * FROM hours WHERE species_id > 0",
    "effort": STEPS_SQL,
    "days": DAYS_SQL + " AND o.location_id IN (SELECT id FROM strict_locations)",
    "worked": "SELECT GREATEST(1, CAST(SUM(effort_days) AS BIGINT)) AS e FROM effort",
    "stats": """SELECT species_id, COUNT(*) AS total, SQRT((3 * (COUNT(*) * VAR_POP(h)) + 2 * 576.0 * COUNT(*)) / (3 * COUNT(*) - 1)) AS sd
        FROM animal_hours GROUP BY species_id HAVING COUNT(*) >= 2""",
    "merged": "SELECT species_id, h, COUNT(*) AS n FROM animal_hours GROUP BY species_id, h",
    "smooth": """SELECT m.species_id, CAST(g.i AS INT) AS i, SUM(m.n * EXP(-POWER((g.i * (24.0::DOUBLE / 127) - m.h - z.z) / (s.sd * 0.25), 2) / 2))
            / (ANY_VALUE(s.total) * ANY_VALUE(s.sd) * 0.25 * SQRT(2 * PI())) AS dens, ANY_VALUE(s.total) AS total
        FROM merged m JOIN stats s ON s.species_id = m.species_id CROSS JOIN (SELECT UNNEST([-24.0::DOUBLE, 0, 24]) AS z) z
        CROSS JOIN (SELECT UNNEST(RANGE(128)) AS i) g GROUP BY 1, 2""",
    "binned": """SELECT s.species_id, CAST(g.i AS INT) AS i, s.total, COUNT(a.id) AS n FROM stats s CROSS JOIN (SELECT UNNEST(RANGE(24)) AS i) g
        LEFT JOIN animal_hours a ON a.species_id = s.species_id AND FLOOR(a.h) = g.i GROUP BY 1, 2, 3""",
    "pct": "SELECT species_id, i, dens * 100 AS v FROM smooth",
    "shares": "SELECT species_id, i, v / SUM(v) OVER (PARTITION BY species_id) AS p FROM pct",
}


def _curve(df):
    return df.select("species_id", "i", F.round("hour", 6).alias("hour"), F.round("mean", 6).alias("mean"))


@query("t5_raw_curve_rai", "SELECT species_id, i, i::DOUBLE AS hour, ROUND(n * 100.0::DOUBLE / (SELECT e FROM worked), 6) AS mean FROM binned", **HOURS)
def raw_curve_rai(s):
    return _curve(D.activity_curve(_times(s), "rai", 0, _effort(s)))


@query("t5_raw_curve_percent", "SELECT species_id, i, i::DOUBLE AS hour, ROUND(n * 100.0::DOUBLE / total, 6) AS mean FROM binned", **HOURS)
def raw_curve_percent(s):
    return _curve(D.activity_curve(_times(s), "percent", 0))


@query(
    "t6_smooth_curve_rai",
    "SELECT species_id, i, ROUND(i * (24.0::DOUBLE / 127), 6) AS hour, ROUND(dens * total * 100 / (SELECT e FROM worked), 6) AS mean FROM smooth",
    **HOURS,
)
def smooth_curve_rai(s):
    return _curve(D.activity_curve(_times(s), "rai", 0.25, _effort(s)))


@query(
    "t6_smooth_curve_percent",
    "SELECT species_id, i, ROUND(i * (24.0::DOUBLE / 127), 6) AS hour, ROUND(dens * 100, 6) AS mean FROM smooth",
    **HOURS,
)
def smooth_curve_percent(s):
    return _curve(D.activity_curve(_times(s), "percent", 0.25))


BOOT = {
    **HOURS,
    "sites": "SELECT species_id, location_id, ROW_NUMBER() OVER (PARTITION BY species_id ORDER BY location_id) - 1 AS site FROM ("
    "SELECT DISTINCT species_id, location_id FROM animal_hours WHERE species_id IN (SELECT species_id FROM stats WHERE total >= 5)) t",
    "places": f"""SELECT species_id, {KEY.format(text="CAST(species_id AS STRING)")} AS k, CAST(i.i AS BIGINT) AS i, CAST(d.d AS BIGINT) AS d, n
        FROM (SELECT species_id, COUNT(*) AS n FROM sites GROUP BY 1) g CROSS JOIN (SELECT UNNEST(RANGE({REPLICATES})) AS i) i
        CROSS JOIN LATERAL (SELECT UNNEST(RANGE(n)) AS d) d""",
    "drawn": _mix("places"),
    "boot": """SELECT w.species_id, w.i AS r, a.h, SUM(w.m) AS n FROM (SELECT species_id, i, pick, COUNT(*) AS m FROM drawn GROUP BY ALL) w
        JOIN sites s ON s.species_id = w.species_id AND s.site = w.pick
        JOIN animal_hours a ON a.species_id = s.species_id AND a.location_id = s.location_id GROUP BY 1, 2, 3""",
    "boot_mean": "SELECT species_id, r, SUM(n) AS pts, SUM(n * h) / SUM(n) AS mu FROM boot GROUP BY 1, 2 HAVING SUM(n) >= 2",
    "raw_reps": """SELECT m.species_id, m.r, CAST(g.i AS INT) AS i, m.pts, COALESCE(SUM(b.n), 0) * 100.0::DOUBLE / m.pts AS v FROM boot_mean m
        CROSS JOIN (SELECT UNNEST(RANGE(24)) AS i) g LEFT JOIN boot b ON b.species_id = m.species_id AND b.r = m.r AND FLOOR(b.h) = g.i GROUP BY 1, 2, 3, m.pts""",
}
BAND_SQL = """SELECT species_id, i, ROUND({hour}, 6) AS hour, ROUND(AVG({v}), 6) AS mean, ROUND(QUANTILE_CONT({v}, 0.025), 6) AS ci_lower,
    ROUND(QUANTILE_CONT({v}, 0.975), 6) AS ci_upper FROM {source} GROUP BY species_id, i"""


def _band(df):
    return df.select("species_id", "i", *[F.round(c, 6).alias(c) for c in ("hour", "mean", "ci_lower", "ci_upper")])


@query("t7_curve_band_smooth")  # the SQL would take kernels of every drawn time; tests/test_rules.py works them out in numpy
def curve_band_smooth(s):
    return _band(D.curve_band(D.resampled_curves(_times(s), 0.25, REPLICATES)))


@query("t7_curve_band_raw", BAND_SQL.format(hour="i::DOUBLE", v="v * pts / (SELECT e FROM worked)", source="raw_reps"), **BOOT)
def curve_band_raw(s):
    return _band(D.curve_band(D.resampled_curves(_times(s), 0, REPLICATES), "rai", _effort(s)))


@query(
    "t8_overlap_of_two",
    """SELECT ROUND(SUM(LEAST(a.p, b.p)), 6) AS overlap FROM shares a JOIN shares b ON b.i = a.i WHERE a.species_id = 1 AND b.species_id = 2""",
    **HOURS,
)
def overlap_of_two(s):
    curves = D.activity_curve(_times(s), "percent", 0.25)
    return D.overlap(curves.where("species_id = 1"), curves.where("species_id = 2")).select(F.round("overlap", 6).alias("overlap"))


def _matrix(df):
    return df.select("species_a", "species_b", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])


@query(
    "t9_overlap_matrix",
    """SELECT a.species_id AS species_a, b.species_id AS species_b, CASE WHEN a.species_id = b.species_id THEN 1.0 ELSE ROUND(SUM(LEAST(a.p, b.p)), 6) END AS mean,
    CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM shares a JOIN shares b ON b.i = a.i GROUP BY 1, 2""",
    **HOURS,
)
def overlap_matrix(s):
    return _matrix(D.overlap_matrix(D.activity_curve(_times(s), "percent", 0.25)))


@query("t9_overlap_band")
def overlap_band(s):
    return _matrix(D.overlap_band(D.resampled_curves(_times(s), 0.25, REPLICATES)))


def _report(df):
    return df.select("mode", "species_id", "i", *[F.round(c, 6).alias(c) for c in ("mean", "ci_lower", "ci_upper")])


@query(
    "t10_activity_report",
    """SELECT 'rai' AS mode, species_id, i, ROUND(dens * total * 100 / (SELECT e FROM worked), 6) AS mean, CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper FROM smooth
    UNION ALL SELECT 'percent' AS mode, species_id, i, ROUND(dens * 100, 6) AS mean, NULL AS ci_lower, NULL AS ci_upper FROM smooth""",
    **HOURS,
)
def activity_report(s):
    return _report(D.activity_report(_times(s), _effort(s), 0.25))


SCOPED_HOURS = {
    **HOURS,
    "scoped_sites": "SELECT location_id FROM location_institutions WHERE institution_id = 1",
    "hours": HOURS["hours"].replace("SELECT id,", "SELECT id, CAST(series_start_time AS DATE) AS day,", 1),
    "animal_hours": """SELECT * FROM hours WHERE species_id IN (1, 2, 3, 5) AND location_id IN (SELECT location_id FROM scoped_sites)
        AND NOT EXISTS (SELECT 1 FROM deployments d WHERE d.location_id = hours.location_id AND hours.day BETWEEN d.start_date AND d.end_date
            AND (d.qc_stolen = TRUE OR d.qc_sd_issue = TRUE))""",
    "days": HOURS["days"] + " AND o.location_id IN (SELECT location_id FROM scoped_sites)",
}


@query(
    "t10_site_report",
    """SELECT 'rai' AS section, species_id AS species_a, CAST(NULL AS BIGINT) AS species_b, i, ROUND(dens * total * 100 / (SELECT e FROM worked), 6) AS value FROM smooth
    UNION ALL SELECT 'percent', species_id, NULL, i, ROUND(dens * 100, 6) FROM smooth
    UNION ALL SELECT 'overlap', a.species_id, b.species_id, NULL, CASE WHEN a.species_id = b.species_id THEN 1.0 ELSE ROUND(SUM(LEAST(a.p, b.p)), 6) END
        FROM shares a JOIN shares b ON b.i = a.i GROUP BY a.species_id, b.species_id
    UNION ALL SELECT 'effort', NULL, NULL, NULL, CAST(e AS DOUBLE) FROM worked""",
    **SCOPED_HOURS,
)
def site_report(s):
    sites = S.scope_locations("institution:1", s.locations, s.institutions, s.location_institutions)
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    days = A.photo_days(L.captured_between(s.photos, FIRST, LAST), placed)
    report = D.site_report(_verified(s), days, (1, 2, 3, 5), sites, s.deployments, ("qc_stolen", "qc_sd_issue"), 0.25)
    unknown, no_place = F.lit(None).cast("bigint").alias("species_b"), F.lit(None).cast("int").alias("i")
    curves = report.curves.select(F.col("mode").alias("section"), F.col("species_id").alias("species_a"), unknown, "i", F.round("mean", 6).alias("value"))
    overlaps = report.overlap.select(F.lit("overlap").alias("section"), "species_a", "species_b", no_place, F.round("mean", 6).alias("value"))
    effort = report.effort.select(F.lit("effort").alias("section"), unknown.alias("species_a"), unknown, no_place, F.col("effort_days").cast("double").alias("value"))
    return curves.unionByName(overlaps).unionByName(effort)


@query("t10_activity_report_band")
def activity_report_band(s):
    return _report(D.activity_report(_times(s), _effort(s), 0.25, REPLICATES))


@query("t11_detection_hours", "SELECT species_id, location_id, ROUND(h, 9) AS decimal_hour FROM hours", **HOURS)
def detection_hours(s):
    return D.detection_hours(_verified(s)).select("species_id", "location_id", F.round("decimal_hour", 9).alias("decimal_hour"))


@query(
    "s6_curve_table",
    "SELECT CASE WHEN i = 0 OR i = 127 THEN CAST(CAST(ROUND(i * 24 / 127) AS INT) AS STRING) ELSE PRINTF('%.2f', i * (24.0::DOUBLE / 127)) END AS \"Hour\", "
    + ", ".join(
        f"PRINTF('%.4f', MAX(CASE WHEN species_id = {k} THEN dens * total * 100 / (SELECT e FROM worked) END)) AS \"{n} (Mean)\", "
        f"'' AS \"{n} (Lower CI)\", '' AS \"{n} (Upper CI)\""
        for k, n in (
            (1, "UA 3"), (2, "UA 4"), (3, "Genus1 species5"), (4, "UA 6"), (5, "UA 7"), (6, "UA 8"), (7, "UA 9"),
            (8, "Genus2 species10"), (9, "UA 11"),
        )
    )
    + " FROM smooth GROUP BY i",
    **HOURS,
)
def curve_table(s):
    return D.curve_wide(D.activity_curve(_times(s), "rai", 0.25, _effort(s)), s.species, species_label("uk"))


# --- communities ------------------------------------------------------------------------------------------------------------
def _regions(s):
    left = S.scope_locations("institution:1", s.locations, s.institutions, s.location_institutions)
    right = S.scope_locations("ecoregion:lowland", s.locations, s.institutions, s.location_institutions)
    inside = L.in_biotopes(
        left.select(F.lit("left").alias("region"), F.col("id").alias("location_id")).unionByName(
            right.select(F.lit("right").alias("region"), F.col("id").alias("location_id"))
        ),
        s.location_biotopes,
        [0, 1, 2, 3],
    )
    return inside


REGIONS = {
    **ACTIVITY,
    "regions": """SELECT * FROM (SELECT 'left' AS region, location_id FROM location_institutions WHERE institution_id = 1
        UNION SELECT 'right' AS region, li.location_id FROM location_institutions li JOIN institutions i ON i.id = li.institution_id WHERE i.ecoregion = 'lowland') r
        WHERE location_id IN (SELECT location_id FROM location_biotopes WHERE biotope_id IN (0, 1, 2, 3))""",
    "inside": """SELECT a.*, r.region FROM activity a JOIN regions r ON r.location_id = a.location_id
        WHERE a.year * 100 + a.month BETWEEN 199602 AND 200008""",
    "totals": """SELECT region, CAST(SUM(td) AS BIGINT) AS trap_days, COUNT(DISTINCT location_id) AS active_locations, CAST(SUM(seen) AS BIGINT) AS total_detections
        FROM (SELECT region, location_id, year, month, MAX(trap_days) AS td, SUM(detection_count) AS seen FROM inside GROUP BY 1, 2, 3, 4) t GROUP BY region""",
    "rai": """SELECT i.region, i.species_id, CAST(SUM(i.detection_count) AS BIGINT) AS detections, CAST(SUM(i.detection_count) AS BIGINT) / ANY_VALUE(t.trap_days) * 100 AS rai
        FROM inside i JOIN totals t ON t.region = i.region GROUP BY 1, 2""",
    "present": f"""SELECT DISTINCT r.region, i.species_id FROM identifications i JOIN photos p ON p.id = i.photo_id JOIN observations o ON o.id = p.observation_id
        JOIN regions r ON r.location_id = o.location_id WHERE o.status IN ('completed', 'archived') AND o.location_id IN (SELECT id FROM strict_locations)
        AND i.species_id > 0 AND p.captured_at >= DATE '{FIRST}' AND p.captured_at < DATE '{LAST}' + INTERVAL 1 DAY""",
    "sides": """SELECT species_id, BOOL_OR(region = 'left') AS l, BOOL_OR(region = 'right') AS r FROM present GROUP BY 1""",
    "paired": """SELECT species_id, SUM(CASE WHEN region = 'left' THEN detections ELSE 0 END)::DOUBLE AS a, SUM(CASE WHEN region = 'right' THEN detections ELSE 0 END)::DOUBLE AS b,
        SUM(CASE WHEN region = 'left' THEN rai ELSE 0 END) AS ra, SUM(CASE WHEN region = 'right' THEN rai ELSE 0 END) AS rb FROM rai GROUP BY 1""",
}

def _region_rows(s):
    return M.region_activity(stored_activity(s), _regions(s), FIRST, LAST)


def _present(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return M.region_species(s.identifications, s.photos, placed, _regions(s), FIRST, LAST)


def _presence(s):
    return M.presence(_present(s), "left", "right")


@query("t12_region_rai", "SELECT region, species_id, detections, ROUND(rai, 9) AS rai FROM rai", **REGIONS)
def region_rai(s):
    return M.region_rai(_region_rows(s)).select("region", "species_id", "detections", F.round("rai", 9).alias("rai"))


DIVERSITY_SQL = """SELECT region, ROUND_EVEN(-SUM(CASE WHEN p > 0 THEN p * LN(p) END), 3) AS shannon, ROUND_EVEN(1 - SUM(p * p), 3) AS simpson,
    ROUND_EVEN(-SUM(CASE WHEN p > 0 THEN p * LN(p) END) / LN(COUNT(*)), 3) AS pielou FROM (SELECT region, rai / SUM(rai) OVER (PARTITION BY region) AS p FROM rai) t
    GROUP BY region"""


@query("t13_diversity", DIVERSITY_SQL, **REGIONS)
def diversity(s):
    return M.diversity(M.region_rai(_region_rows(s)))


PRESENCE_SQL = """SELECT COUNT(*) FILTER (WHERE l AND r) AS shared_count, COUNT(*) FILTER (WHERE l AND NOT r) AS left_only_count,
    COUNT(*) FILTER (WHERE r AND NOT l) AS right_only_count, ROUND_EVEN(COUNT(*) FILTER (WHERE l AND r) / COUNT(*), 3) AS jaccard,
    ROUND_EVEN(2 * COUNT(*) FILTER (WHERE l AND r) / (COUNT(*) FILTER (WHERE l) + COUNT(*) FILTER (WHERE r)), 3) AS sorensen FROM sides"""


@query("t14_presence_similarity", PRESENCE_SQL, **REGIONS)
def presence_similarity(s):
    return M.presence_similarity(_presence(s))


NAMES_SQL = """SELECT CASE WHEN l AND r THEN 'shared' WHEN l THEN 'left' ELSE 'right' END AS side, COALESCE(s.common_name_en, s.scientific_name) AS name
    FROM sides JOIN species s ON s.id = sides.species_id"""


@query("t14_presence_names", NAMES_SQL, **REGIONS)
def presence_names(s):
    return M.presence_names(_presence(s), s.species, species_label("en"))


ABUNDANCE_SQL = """SELECT ROUND_EVEN(1 - 2 * SUM(LEAST(a, b)) / SUM(a + b), 3) AS bray_curtis,
    ROUND_EVEN(2 * SUM(a * b) / ((SUM(a * a) / (SUM(a) * SUM(a)) + SUM(b * b) / (SUM(b) * SUM(b))) * SUM(a) * SUM(b)), 3) AS morisita_horn FROM paired"""


@query("t15_abundance_similarity", ABUNDANCE_SQL, **REGIONS)
def abundance_similarity(s):
    return M.abundance_similarity(M.paired_counts(M.region_rai(_region_rows(s)), "left", "right"))


@query(
    "t16_region_totals",
    "SELECT * FROM totals",
    **REGIONS,
)
def region_totals(s):
    return M.region_totals(_region_rows(s))


@query(
    "t16_top_species_by_rai",
    """SELECT species_id, CAST(a AS BIGINT) AS left_count, CAST(b AS BIGINT) AS right_count, ROUND_EVEN(ra, 3) AS left_rai, ROUND_EVEN(rb, 3) AS right_rai
    FROM paired ORDER BY ra + rb DESC, species_id LIMIT 30""",
    **REGIONS,
)
def top_species_by_rai(s):
    return M.top_by_rai(M.paired_counts(M.region_rai(_region_rows(s)), "left", "right"))


def _metrics(section: str, source: str, metrics: tuple[str, ...], side: str = "CAST(NULL AS VARCHAR)", item: str = "CAST(NULL AS VARCHAR)") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {side} AS side, {item} AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics
    )


@query(
    "t16_region_report",
    " UNION ALL ".join(
        [
            _metrics("region", "region_rows", M.INDICES, "region", "CASE region WHEN 'left' THEN 'Institution 1' ELSE 'Lowland' END"),
            _metrics("similarity", "presences", ("shared_count", "left_only_count", "right_only_count", "jaccard", "sorensen")),
            _metrics("similarity", "abundances", ("bray_curtis", "morisita_horn")),
            _metrics("species", "top_species", ("left_count", "right_count", "left_rai", "right_rai"), item="name"),
            "SELECT 'names', side, name, NULL, NULL FROM side_names",
        ]
    ),
    indices=DIVERSITY_SQL,
    presences=PRESENCE_SQL,
    abundances=ABUNDANCE_SQL,
    side_names=NAMES_SQL,
    region_rows="""SELECT t.*, n.species_count, d.shannon, d.simpson, d.pielou FROM totals t JOIN indices d ON d.region = t.region
        JOIN (SELECT region, COUNT(*) AS species_count FROM present GROUP BY region) n ON n.region = t.region""",
    top_species="""SELECT COALESCE(s.common_name_en, s.scientific_name) AS name, a AS left_count, b AS right_count, ROUND_EVEN(ra, 3) AS left_rai, ROUND_EVEN(rb, 3) AS right_rai
        FROM paired p JOIN species s ON s.id = p.species_id ORDER BY ra + rb DESC, p.species_id LIMIT 30""",
    **REGIONS,
)
def region_report(s):
    return M.compare_regions(_region_rows(s), _present(s), s.species, species_label("en"), {"left": "Institution 1", "right": "Lowland"})


@query(
    "a17_trend_lookup",
    """SELECT year, ROUND(mean_dr_index, 6) AS mean_dr_index FROM trends WHERE species_id = 2 AND scope_type = 'institution' AND scope_id = '1'
    AND year BETWEEN 1996 AND 2000""",
    **TREND,
)
def trend_lookup(s):
    found = R.trend_lookup(_trends(s), 2, 1996, 2000, "institution", "1")
    return found.select("year", F.round("mean_dr_index", 6).alias("mean_dr_index"))
