"""Named queries for the occurrence export, one per mode and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import occurrences as X
from trapline.operators.filters import TaxonFilter
from trapline.plans.registry import query

FIRST, LAST = "1995-06-01", "2000-12-31"
FLAGS = ("qc_stolen", "qc_sd_issue", "qc_local_datetime_issue")


def tables(s):
    return X.OccurrenceTables(
        observations=s.observations,
        photos=s.photos,
        identifications=s.identifications,
        species=s.species,
        locations=s.locations,
        location_institutions=s.location_institutions,
        deployments=s.deployments,
        users=s.users,
        ai_predictions=s.ai_predictions,
        ai_models=s.ai_models,
        ai_model_levels=s.ai_model_levels,
    )


def _sql(flags: bool = False, institutions: str | None = None, taxon: str = "s.id > 0") -> dict[str, str]:
    """Named queries of the export, written as the plain relational definition."""
    common = f"""l.is_valid IS NOT FALSE AND CAST(o.series_start_time AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND {taxon}"""
    if institutions:
        common += f" AND EXISTS (SELECT 1 FROM location_institutions li WHERE li.location_id = l.id AND li.institution_id IN ({institutions}))"
    if flags:
        common += """ AND NOT EXISTS (SELECT 1 FROM deployments d WHERE d.location_id = o.location_id
            AND CAST(o.series_start_time AS DATE) BETWEEN d.start_date AND d.end_date
            AND (d.qc_stolen OR d.qc_sd_issue OR d.qc_local_datetime_issue <> ''))"""
    head = """o.id AS observation_id, s.id AS species_id, o.location_id, s.scientific_name, s.kingdom, s.phylum, s.class_name, s.order_rank, s.family, s.genus,
        s.establishment_means, o.series_start_time, l.name AS location_name, l.latitude, l.longitude, l.state_province"""
    join = "JOIN locations l ON l.id = o.location_id JOIN species s ON s.id"
    return {
        "names": """SELECT p.observation_id, i.species_id, STRING_AGG(DISTINCT CAST(i.user_id AS STRING), '|' ORDER BY CAST(i.user_id AS STRING)) AS voter_ids,
            STRING_AGG(DISTINCT COALESCE(u.full_name, 'User #' || CAST(i.user_id AS STRING)), ' | '
                ORDER BY COALESCE(u.full_name, 'User #' || CAST(i.user_id AS STRING))) AS identified_by
            FROM identifications i JOIN photos p ON p.id = i.photo_id LEFT JOIN users u ON u.id = i.user_id GROUP BY 1, 2""",
        "agreed": f"""SELECT {head}, r.max_quantity, n.voter_ids, n.identified_by, 'human_consensus' AS row_kind, CAST(NULL AS DOUBLE) AS ai_confidence,
            CAST(NULL AS STRING) AS ai_model_name FROM observations o JOIN ranked r ON r.observation_id = o.id AND r.rn = 1 {join} = r.species_id
            JOIN names n ON n.observation_id = o.id AND n.species_id = r.species_id WHERE o.status IN ('completed', 'archived') AND {common}""",
        "disputed": f"""SELECT {head}, v.max_quantity, n.voter_ids, n.identified_by, 'human_conflict' AS row_kind, CAST(NULL AS DOUBLE) AS ai_confidence,
            CAST(NULL AS STRING) AS ai_model_name FROM observations o JOIN votes v ON v.observation_id = o.id {join} = v.species_id
            JOIN names n ON n.observation_id = o.id AND n.species_id = v.species_id WHERE o.status = 'pending' AND {common}""",
        "picked": """SELECT a.observation_id, a.prediction_species_id, a.prediction_score, COALESCE(a.animal_count, 1) AS n,
            m.name || ' ' || m.version || COALESCE(' (' || v.code || ')', '') AS model_name, ROW_NUMBER() OVER (PARTITION BY a.observation_id
                ORDER BY COALESCE(v.accuracy_rank, 0) DESC, a.prediction_score DESC NULLS LAST, a.id) AS k
            FROM ai_predictions a JOIN ai_models m ON m.id = a.model_id LEFT JOIN ai_model_levels v ON v.id = m.level_id
            WHERE a.prediction_species_id IS NOT NULL""",
        "guessed": f"""SELECT {head}, g.n AS max_quantity, CAST(NULL AS STRING) AS voter_ids, CAST(NULL AS STRING) AS identified_by, 'ai' AS row_kind,
            g.prediction_score AS ai_confidence, g.model_name AS ai_model_name FROM observations o JOIN picked g ON g.observation_id = o.id AND g.k = 1
            {join} = g.prediction_species_id WHERE NOT EXISTS (SELECT 1 FROM identifications i JOIN photos p ON p.id = i.photo_id
                WHERE p.observation_id = o.id) AND {common}""",
    }


KEYS = "observation_id, species_id, row_kind, scientific_name, location_name, series_start_time, max_quantity, voter_ids, ai_confidence, ai_model_name"


def _keys(records):
    ids = F.array_join(F.transform("voters", lambda v: v["id"]), "|")
    return records.select(
        "observation_id", "species_id", "row_kind", "scientific_name", "location_name", "series_start_time", "max_quantity",
        ids.alias("voter_ids"), "ai_confidence", "ai_model_name",
    )


@query("x1_consensus_records", f"SELECT {KEYS} FROM agreed", **_sql())
def consensus_records(s):
    return _keys(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST)))


@query("x1_consensus_records_filtered", f"SELECT {KEYS} FROM agreed", **_sql(True, "1, 3", "s.id > 0 AND s.class_name = 'Mammalia'"))
def consensus_records_filtered(s):
    spec = X.OccurrenceSpec(
        FIRST,
        LAST,
        mode="no such mode",
        qc_flags=FLAGS,
        institutions=(1, 2, 3),
        allowed_institutions=(1, 3, 4),
        taxon=TaxonFilter(class_name="Mammalia"),
    )
    return _keys(X.occurrences(tables(s), spec))


@query("x2_conflict_records", f"SELECT {KEYS} FROM disputed", **_sql())
def conflict_records(s):
    return _keys(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST, mode="human_any")).where("row_kind = 'human_conflict'"))


@query("x3_ai_records", f"SELECT {KEYS} FROM guessed", **_sql())
def ai_records(s):
    return _keys(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST, mode="human_ai")).where("row_kind = 'ai'"))


@query(
    "x4_human_any_records",
    f"SELECT {KEYS} FROM agreed UNION ALL SELECT {KEYS} FROM disputed",
    **_sql(flags=True),
)
def human_any_records(s):
    return _keys(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST, mode="human_any", qc_flags=FLAGS)))


@query(
    "x4_human_ai_records",
    f"SELECT {KEYS} FROM agreed UNION ALL SELECT {KEYS} FROM disputed UNION ALL SELECT {KEYS} FROM guessed",
    **_sql(taxon="TRUE"),
)
def human_ai_records(s):
    spec = X.OccurrenceSpec(FIRST, LAST, mode="human_ai", taxon=TaxonFilter(species_only=False))
    return _keys(X.occurrences(tables(s), spec))


BEST = "ORDER BY max_quantity DESC NULLS FIRST, series_start_time, observation_id"


@query(
    "x5_best_of_day",
    f"""SELECT {KEYS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scientific_name, location_name, CAST(series_start_time AS DATE) {BEST}) AS k
    FROM agreed) t WHERE k = 1""",
    **_sql(),
)
def best_of_day(s):
    return _keys(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST, aggregation="location_day")))


@query(
    "x6_independent_events",
    f"""SELECT {KEYS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scientific_name, location_name, event_id {BEST}) AS k FROM (
        SELECT *, SUM(opens) OVER (PARTITION BY scientific_name, location_name ORDER BY series_start_time, observation_id ROWS UNBOUNDED PRECEDING) AS event_id
        FROM (SELECT *, CASE WHEN series_start_time - LAG(series_start_time) OVER (PARTITION BY scientific_name, location_name
                ORDER BY series_start_time, observation_id) <= INTERVAL '60' MINUTE THEN 0 ELSE 1 END AS opens FROM agreed) a) b) c WHERE k = 1""",
    **_sql(),
)
def independent_events(s):
    spec = X.OccurrenceSpec(FIRST, LAST, aggregation="location_timewindow", minutes="9999")
    return _keys(X.occurrences(tables(s), spec))


@query("x7_no_grouping_with_conflicts", f"SELECT {KEYS} FROM agreed UNION ALL SELECT {KEYS} FROM disputed", **_sql())
def no_grouping_with_conflicts(s):
    return _keys(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST, mode="human_any", aggregation="location_day")))


@query("x8_total_count", "SELECT COUNT(*) AS total_count FROM agreed", **_sql(flags=True))
def total_count(s):
    return X.total_count(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST, qc_flags=FLAGS)))


@query("x8_preview", f"SELECT {KEYS} FROM agreed ORDER BY series_start_time, observation_id, species_id LIMIT 10", **_sql())
def preview(s):
    return _keys(X.preview(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST)), 10))


SHAPE_SQL = f"""SELECT 'URN:survey:CT:observation:' || CAST(observation_id AS STRING)
        || CASE WHEN row_kind = 'human_conflict' THEN ':taxon:' || CAST(species_id AS STRING) ELSE '' END AS "occurrenceID",
    observation_id AS "observationID", 'MachineObservation' AS "basisOfRecord",
    CASE row_kind WHEN 'ai' THEN '{X.PREDICTED}' WHEN 'human_conflict' THEN '{X.DISPUTED}' ELSE '{X.VERIFIED}' END AS "identificationVerificationStatus",
    CASE row_kind WHEN 'ai' THEN ai_model_name ELSE identified_by END AS "identifiedBy",
    CASE WHEN row_kind = 'ai' THEN CAST(ROUND_EVEN(ai_confidence, 3) AS STRING) ELSE '' END AS "identificationConfidence",
    CASE row_kind WHEN 'ai' THEN 'Automatic detection by ' || ai_model_name || ', confidence: ' || CAST(ROUND_EVEN(ai_confidence, 2) AS STRING)
        WHEN 'human_conflict' THEN '{X.DISPUTED_REMARK}' ELSE '{X.VERIFIED_REMARK}' END AS "identificationRemarks",
    'CT' AS "institutionCode", scientific_name AS "scientificName", kingdom, phylum, class_name AS "class", order_rank AS "order", family, genus,
    CASE WHEN POSITION(' ' IN scientific_name) > 0 THEN SUBSTR(scientific_name, POSITION(' ' IN scientific_name) + 1) END AS "specificEpithet",
    establishment_means AS "establishmentMeans", 'present' AS "occurrenceStatus", STRFTIME(series_start_time, '%Y-%m-%d') AS "eventDate",
    max_quantity AS "individualCount", STRFTIME(series_start_time, '%H:%M:%S') AS "eventTime", 'UA' AS "countryCode",
    state_province AS "stateProvince", location_name AS "locality", CAST(latitude AS DOUBLE) AS "decimalLatitude",
    CAST(longitude AS DOUBLE) AS "decimalLongitude", 'WGS84' AS "geodeticDatum", 20 AS "coordinateUncertaintyInMeters",
    'GPS (smartphone)' AS "georeferenceSources", 'Automated camera trap' AS "recordedBy"
    FROM (SELECT * FROM agreed UNION ALL SELECT * FROM disputed UNION ALL SELECT * FROM guessed) t"""


@query("x9_shaped_records", SHAPE_SQL, **_sql(taxon="TRUE"))
def shaped_records(s):
    spec = X.OccurrenceSpec(FIRST, LAST, mode="human_ai", taxon=TaxonFilter(species_only=False))
    return X.shape(X.occurrences(tables(s), spec))
