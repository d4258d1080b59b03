"""Named queries for sources, row scopes and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.functions.names import prediction_label, species_label
from trapline.functions.pairing import with_every
from trapline.operators import filters as L
from trapline.operators import scope as S
from trapline.operators.scope import Viewer
from trapline.plans.registry import query

MEMBER = Viewer(institution_ids=(1, 3))


@query("f1_valid_strict", "SELECT id, name FROM locations WHERE is_valid IS TRUE")
def valid_strict(s):
    return S.valid_locations(s.locations, strict=True).select("id", "name")


@query("f1_valid_lenient", "SELECT id, name FROM locations WHERE is_valid IS NOT FALSE")
def valid_lenient(s):
    return S.valid_locations(s.locations).select("id", "name")


MEMBER_SITES = """SELECT id FROM locations WHERE visibility_level = 0
    OR id IN (SELECT location_id FROM location_institutions WHERE institution_id IN (1, 3))"""


@query(
    "f2_accessible_series",
    """SELECT 'admin' AS viewer, id FROM observations WHERE location_id IN (SELECT id FROM locations)
    UNION ALL SELECT 'member' AS viewer, id FROM observations WHERE location_id IN (SELECT id FROM member_sites)
    UNION ALL SELECT 'visitor' AS viewer, id FROM observations WHERE location_id IN (SELECT id FROM locations WHERE visibility_level = 0)""",
    member_sites=MEMBER_SITES,
)
def accessible_series(s):
    seen = None
    for name, viewer in (("admin", Viewer(admin=True)), ("member", MEMBER), ("visitor", Viewer())):
        part = S.accessible(s.observations, s.locations, s.location_institutions, viewer).select(
            F.lit(name).alias("viewer"), "id"
        )
        seen = part if seen is None else seen.unionByName(part)
    return seen


@query(
    "f3_selected_institutions",
    """SELECT 'text' AS given, id FROM observations
    WHERE location_id IN (SELECT location_id FROM location_institutions WHERE institution_id IN (2, 4))
    UNION ALL SELECT 'nothing' AS given, id FROM observations""",
)
def selected_institutions(s):
    listed = S.in_institutions(s.observations, s.location_institutions, "2, 4,x").select(F.lit("text").alias("given"), "id")
    everything = S.in_institutions(s.observations, s.location_institutions, []).select(F.lit("nothing").alias("given"), "id")
    return listed.unionByName(everything)


@query(
    "f4_resolved_scopes",
    """SELECT 'ecoregion:lowland' AS scope, id FROM locations WHERE id IN (SELECT li.location_id FROM location_institutions li
        JOIN institutions i ON i.id = li.institution_id WHERE i.ecoregion = 'lowland')
    UNION ALL SELECT 'institution:3' AS scope, id FROM locations WHERE id IN (SELECT location_id FROM location_institutions WHERE institution_id = 3)
    UNION ALL SELECT 'default kept' AS scope, id FROM locations WHERE id IN (SELECT li.location_id FROM location_institutions li
        JOIN institutions i ON i.id = li.institution_id WHERE i.ecoregion = 'mountain')
    UNION ALL SELECT 'default dropped' AS scope, id FROM locations
    UNION ALL SELECT 'unknown ecoregion' AS scope, id FROM locations WHERE FALSE""",
)
def resolved_scopes(s):
    cases = (
        ("ecoregion:lowland", "ecoregion:lowland", ""),
        ("institution:3", "institution:3", ""),
        ("default kept", "", "ecoregion:mountain"),
        ("default dropped", "", "ecoregion:none"),
        ("unknown ecoregion", "ecoregion:none", ""),
    )
    result = None
    for name, scope, default in cases:
        sites = S.scope_locations(scope, s.locations, s.institutions, s.location_institutions, default)
        part = sites.select(F.lit(name).alias("scope"), "id")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "f5_viewable_photos",
    """SELECT p.id FROM photos p LEFT JOIN observations o ON o.id = p.observation_id LEFT JOIN upload_batches b ON b.id = p.upload_batch_id
    WHERE COALESCE(o.location_id, b.location_id) IN (SELECT id FROM member_sites)""",
    member_sites=MEMBER_SITES,
)
def viewable_photos(s):
    loose = s.photos  # every photo of the survey has a series; the raw stream below has none
    return S.viewable_photos(loose, s.observations, s.upload_batches, s.locations, s.location_institutions, MEMBER).select("id")


@query(
    "f5_viewable_raw_photos",
    """SELECT r.id FROM raw_photos r JOIN upload_batches b ON b.id = r.upload_batch_id
    WHERE b.location_id IN (SELECT id FROM locations WHERE visibility_level = 0)""",
)
def viewable_raw_photos(s):
    loose = s.raw_photos.withColumn("observation_id", F.lit(None).cast("bigint"))
    return S.viewable_photos(
        loose, s.observations, s.upload_batches, s.locations, s.location_institutions, Viewer(signed_in=False)
    ).select("id")


@query(
    "f6_qc_exclusion",
    """SELECT o.id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM deployments d WHERE d.location_id = o.location_id
        AND CAST(o.series_start_time AS DATE) BETWEEN d.start_date AND d.end_date
        AND (d.qc_stolen = TRUE OR d.qc_sd_issue = TRUE OR (d.qc_local_datetime_issue IS NOT NULL AND d.qc_local_datetime_issue <> '')))""",
)
def qc_exclusion(s):
    flags = ["qc_stolen", "qc_sd_issue", "qc_local_datetime_issue", "not_a_flag"]
    return L.qc_exclude(s.observations, s.deployments, flags).select("id")


@query(
    "f7_started_between",
    "SELECT id FROM observations WHERE CAST(series_start_time AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1999-08-15'",
)
def started_between(s):
    return L.started_between(s.observations, "1996-02-01", "1999-08-15").select("id")


@query(
    "f8_captured_between",
    "SELECT id FROM photos WHERE captured_at BETWEEN DATE '1996-02-01' AND DATE '1999-08-15'",
)
def captured_between(s):
    return L.captured_between(s.photos, "1996-02-01", "1999-08-15").select("id")


@query(
    "f9_half_open_ranges",
    """SELECT 'photo' AS kind, id FROM photos WHERE captured_at >= DATE '1996-02-01' AND captured_at < DATE '1999-08-16'
    UNION ALL SELECT 'series' AS kind, id FROM observations WHERE series_start_time BETWEEN DATE '1996-02-01' AND DATE '1999-08-16'""",
)
def half_open_ranges(s):
    shot = L.captured_through(s.photos, "1996-02-01", "1999-08-15").select(F.lit("photo").alias("kind"), "id")
    begun = L.started_through(s.observations, "1996-02-01", "1999-08-15").select(F.lit("series").alias("kind"), "id")
    return shot.unionByName(begun)


@query(
    "f10_taxon_filter",
    """SELECT 'ids' AS given, id FROM species WHERE id IN (1, 4)
    UNION ALL SELECT 'genus' AS given, id FROM species WHERE id > 0 AND genus = 'Genus1'
    UNION ALL SELECT 'family' AS given, id FROM species WHERE id > 0 AND family = 'Family2'
    UNION ALL SELECT 'order' AS given, id FROM species WHERE id > 0 AND order_rank = 'Order3'
    UNION ALL SELECT 'class' AS given, id FROM species WHERE id > 0 AND class_name = 'Aves'
    UNION ALL SELECT 'all' AS given, id FROM species""",
)
def taxon_filter(s):
    cases = {
        "ids": L.TaxonFilter(species_ids=(1, 4, -1), genus="Genus1"),
        "genus": L.TaxonFilter(genus="Genus1", family="Family2"),
        "family": L.TaxonFilter(family="Family2"),
        "order": L.TaxonFilter(order="Order3", class_name="Mammalia"),
        "class": L.TaxonFilter(class_name="Aves"),
        "all": L.TaxonFilter(species_only=False),
    }
    result = None
    for name, taxon in cases.items():
        part = L.taxon_filter(s.species, taxon).select(F.lit(name).alias("given"), "id")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "f11_biotope_filter",
    "SELECT id FROM observations WHERE location_id IN (SELECT location_id FROM location_biotopes WHERE biotope_id IN (1, 3))",
)
def biotope_filter(s):
    return L.in_biotopes(s.observations, s.location_biotopes, [1, 3]).select("id")


@query(
    "f12_display_names",
    """SELECT id, COALESCE(NULLIF(common_name_ua, ''), scientific_name) AS uk,
        CASE WHEN common_name_en IS NULL THEN scientific_name WHEN id > 0 THEN common_name_en || ' (' || scientific_name || ')'
            ELSE common_name_en END AS en_latin,
        CASE WHEN id > 0 THEN COALESCE(common_name_en, common_name_ua, scientific_name) || ' (' || scientific_name || ')'
            ELSE COALESCE(common_name_en, common_name_ua, scientific_name) END AS en_prediction
    FROM species""",
)
def display_names(s):
    return s.species.select(
        "id",
        species_label("uk").alias("uk"),
        species_label("en", latin=True).alias("en_latin"),
        prediction_label("en").alias("en_prediction"),
    )


CAMERA_TEXT = """SELECT event_id AS id, CAST(user_id % 5 AS STRING) AS upload_batch_id,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'no clock' WHEN event_id % 17 = 0 THEN '2009:12:31 23:59:59'
         WHEN event_id % 19 = 0 THEN '2031:01:01 00:00:00' ELSE REPLACE(SUBSTR(CAST(ts AS STRING), 1, 19), '-', ':') END AS taken_text,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 AS STRING) WHEN event_id % 3 = 1 THEN 'x7' END AS subsecond_text
    FROM {events}"""
CAMERA_TEXT_SQL = CAMERA_TEXT.replace("{", "").replace("}", "")


@query(
    "f13_clean_capture_time",
    """SELECT id, upload_batch_id, CASE WHEN exact >= TIMESTAMP '2010-01-01' AND exact <= TIMESTAMP '2030-01-02' THEN exact
        ELSE TIMESTAMP '1900-01-01' + INTERVAL '1' SECOND * n END AS captured_at
    FROM (SELECT id, upload_batch_id, CAST(ROW_NUMBER() OVER (PARTITION BY upload_batch_id ORDER BY id) AS INT) AS n,
        TRY_STRPTIME(taken_text, '%Y:%m:%d %H:%M:%S') + INTERVAL '1' MICROSECOND * CAST(
            CASE WHEN REGEXP_FULL_MATCH(subsecond_text, '[0-9]+') THEN CAST(RPAD(subsecond_text, 6, '0') AS BIGINT) ELSE 0 END AS INT) AS exact
        FROM camera_text) t""",
    camera_text=CAMERA_TEXT_SQL,
)
def clean_capture_time(s):
    raw = s.spark.sql(CAMERA_TEXT, events=s.events)
    return L.clean_capture_time(raw, now="2030-01-01").select("id", "upload_batch_id", "captured_at")


FILE_NAMES = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.png' WHEN 3 THEN '.jpg'
    WHEN 4 THEN 'noending' ELSE 'd.tar.jpg' END AS original_filename FROM {events}"""


@query(
    "f14_allowed_extensions",
    "SELECT id, original_filename FROM file_names WHERE id % 6 IN (0, 1, 5)",
    file_names=FILE_NAMES.replace("{", "").replace("}", ""),
)
def allowed_extensions(s):
    return L.allowed_extension(s.spark.sql(FILE_NAMES, events=s.events))


@query(
    "f15_taxonomy_options",
    """SELECT DISTINCT 'class' AS level, class_name AS value, CAST(NULL AS BIGINT) AS species_id FROM species WHERE id > 0 AND class_name IS NOT NULL
    UNION ALL SELECT DISTINCT 'order' AS level, order_rank AS value, NULL AS species_id FROM species WHERE id > 0 AND order_rank IS NOT NULL AND class_name = 'Aves'
    UNION ALL SELECT DISTINCT 'family' AS level, family AS value, NULL AS species_id FROM species WHERE id > 0 AND family IS NOT NULL AND class_name = 'Aves'
    UNION ALL SELECT DISTINCT 'genus' AS level, genus AS value, NULL AS species_id FROM species WHERE id > 0 AND genus IS NOT NULL AND class_name = 'Aves'
    UNION ALL SELECT 'species' AS level, COALESCE(common_name_ua || ' (' || scientific_name || ')', scientific_name) AS value, id AS species_id
        FROM species WHERE id > 0 AND class_name = 'Aves'""",
)
def taxonomy_options(s):
    return L.taxonomy_options(s.species, L.TaxonFilter(class_name="Aves"))


@query(
    "f16_review_filters",
    """SELECT 'user' AS kind, id, username AS name FROM users WHERE id IN (SELECT user_id FROM identifications)
    UNION ALL SELECT 'species' AS kind, id, COALESCE(common_name_ua || ' (' || scientific_name || ')', scientific_name) AS name
        FROM species WHERE id IN (SELECT species_id FROM identifications)""",
)
def review_filters(s):
    return L.review_filters(s.identifications, s.users, s.species)


@query(
    "f17_three_valued_logic",
    """SELECT id, qc_stolen OR qc_sd_issue OR qc_battery_issue AS any_issue, qc_stolen AND qc_sd_issue AS both_issues FROM deployments""",
)
def three_valued_logic(s):
    return s.deployments.select(
        "id",
        L.any_of(F.col("qc_stolen"), F.col("qc_sd_issue"), F.col("qc_battery_issue")).alias("any_issue"),
        L.both(F.col("qc_stolen"), F.col("qc_sd_issue")).alias("both_issues"),
    )


@query(
    "f18_location_register",
    """SELECT l.id, l.name, CAST(l.latitude AS DOUBLE) AS latitude, CAST(l.longitude AS DOUBLE) AS longitude,
        (SELECT STRING_AGG(CAST(institution_id AS STRING), ',' ORDER BY institution_id) FROM location_institutions WHERE location_id = l.id) AS institution_ids,
        COALESCE((SELECT STRING_AGG(CAST(biotope_id AS STRING), ',' ORDER BY biotope_id) FROM location_biotopes WHERE location_id = l.id), '') AS biotope_ids,
        COALESCE(l.is_valid, FALSE) AS is_valid, COALESCE(l.invalid_note, '') AS invalid_note
    FROM locations l WHERE l.id IN (SELECT location_id FROM location_institutions WHERE institution_id IN (1, 3))""",
)
def location_register(s):
    register = L.location_register(s.locations, s.location_institutions, s.location_biotopes, MEMBER)
    for lists in ("institution_ids", "biotope_ids"):
        register = register.withColumn(lists, F.array_join(F.col(lists).cast("array<string>"), ","))
    return register


NEW_SITES = """SELECT c_custkey AS new_id, 44 + (c_custkey % 40) * 0.25 + (c_custkey % 3) * 0.000004 AS latitude,
    22 + (c_custkey % 40) * 0.5 AS longitude FROM {customer}"""


@query(
    "f19_duplicate_sites",
    """SELECT n.new_id, l.id AS existing_id FROM new_sites n LEFT JOIN locations l
    ON ROUND(CAST(n.latitude AS DECIMAL(20,10)), 5) = l.latitude AND ROUND(CAST(n.longitude AS DECIMAL(20,10)), 5) = l.longitude""",
    new_sites=NEW_SITES.replace("{", "").replace("}", ""),
)
def duplicate_sites(s):
    return L.duplicate_sites(s.spark.sql(NEW_SITES, customer=s.customer), s.locations).select("new_id", "existing_id")


@query(
    "f20_series_positions",
    """SELECT id, observation_id, ROW_NUMBER() OVER w - 1 AS photo_index, LAG(id) OVER w AS previous_id, LEAD(id) OVER w AS next_id
    FROM photos WINDOW w AS (PARTITION BY observation_id ORDER BY captured_at, id)""",
)
def series_positions(s):
    return L.series_positions(s.photos)


RAW_VISITS = """SELECT o_orderkey AS visit_id, CAST(o_custkey % 25 AS STRING) AS location_id,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE SUBSTR(CAST(o_orderdate AS STRING), 1, 10) END AS visit_datetime,
    CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey % 5 + 1 AS STRING) END AS visit_purpose_id,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 3 + 1 AS STRING) END AS battery_type_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' END AS is_camera_operational,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 900 AS STRING) END AS photos_on_card,
    CASE WHEN o_orderkey % 6 = 0 THEN '  ' ELSE ' note ' END AS comments FROM {orders}"""


@query(
    "f21_clean_visits",
    """SELECT CAST(location_id AS INT) AS location_id, CAST(visit_datetime AS TIMESTAMP) AS visit_datetime,
        CAST(visit_purpose_id AS INT) AS visit_purpose_id, TRY_CAST(NULLIF(battery_type_id, '') AS INT) AS battery_type_id,
        CASE is_camera_operational WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS is_camera_operational,
        TRY_CAST(NULLIF(photos_on_card, '') AS INT) AS photos_on_card, NULLIF(TRIM(comments), '') AS comments
    FROM raw_visits WHERE visit_datetime IS NOT NULL AND visit_purpose_id <> ''""",
    raw_visits=RAW_VISITS.replace("{", "").replace("}", ""),
)
def clean_visits(s):
    return L.clean_visits(s.spark.sql(RAW_VISITS, orders=s.orders))


@query(
    "f22_deployment_register",
    """SELECT 'full' AS viewer, id, location_id, study_year FROM deployments WHERE location_id IS NULL OR location_id IN (SELECT id FROM locations)
    UNION ALL SELECT 'member' AS viewer, id, location_id, study_year FROM deployments
    WHERE location_id IN (SELECT location_id FROM location_institutions WHERE institution_id IN (1, 3))""",
)
def deployment_register(s):
    columns = ["id", "location_id", "study_year"]
    full = L.deployment_register(s.deployments, s.locations, s.location_institutions, Viewer(), full_access=True)
    own = L.deployment_register(s.deployments, s.locations, s.location_institutions, MEMBER)
    return full.select(F.lit("full").alias("viewer"), *columns).unionByName(own.select(F.lit("member").alias("viewer"), *columns))


@query("f22_study_years", "SELECT DISTINCT study_year FROM deployments WHERE study_year <> 0")
def study_years(s):
    full = L.deployment_register(s.deployments, s.locations, s.location_institutions, Viewer(admin=True))
    return L.study_years(full)


@query(
    "j7_every_species_at_every_site",
    "SELECT l.id AS location_id, s.id AS species_id FROM locations l CROSS JOIN species s",
)
def every_species_at_every_site(s):
    sites = s.locations.select(F.col("id").alias("location_id"))
    return with_every(sites, s.species.select(F.col("id").alias("species_id")))
