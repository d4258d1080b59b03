"""Deployment sheets: CSV or Parquet exports of several workbook sheets with differing headers."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.sources.starschema import QC_BOOLEAN_FLAGS

# Known headers and the register column each fills.
ALIASES = {
    "study_year": "study_year",
    "study_season": "study_season",
    "study_design": "study_design",
    "deployment_id": "name",
    "camera_id": "camera_id",
    "camera_model": "camera_model",
    "serial_number": "serial_number",
    "start_date": "start_date",
    "start_time": "start_time",
    "end_date": "end_date",
    "end_time": "end_time",
    "n_days_working": "n_days_working",
    "n_photos": "n_photos",
    "latitude": "latitude",
    "longitude": "longitude",
    **{flag: flag for flag in QC_BOOLEAN_FLAGS},
    "qc_camera_stolen": "qc_stolen",
    "qc_camera_firmware_issue": "qc_firmware_issue",
    "qc_camera_settings_issue": "qc_settings_issue",
    "qc_camera_battery_depleted": "qc_battery_issue",
    "qc_sd_ damaged": "qc_sd_issue",
    "qc_sd_damaged": "qc_sd_issue",
    "qc_camera_sd_damaged": "qc_sd_issue",
    "qc_no_data_uploaded": "qc_no_data_uploaded_by_pa",
    "qc_no_gps_coordinate": "qc_no_gps_coordinates",
    "qc_no_data_captured": "qc_no_species_captured",
    "qc_placement_is_incorrect": "qc_placement_incorrect",
    "qc_placement_is_poor": "qc_poor_placement",
    "qc_placement_at_feeding_location": "qc_feeding_location",
    "qc_installation_is_incorrect": "qc_installation_incorrect",
    "qc_distance_reference_photos_are_missed": "qc_distance_reference_photos_missed",
    "qc_local_datetime_photos_missed": "qc_datetime_photos_missed",
    "qc_local_datetime_photos_are_missed": "qc_datetime_photos_missed",
    "used_brf": "qc_used_brf",
    "used_basic_reporting_form": "qc_used_brf",
    "qc_local_datetime_issue": "qc_local_datetime_issue",
    "qc_set_local_time_issue": "qc_local_datetime_issue",
    "qc_comment": "qc_comment",
    "comment": "qc_comment",
    "problem_comment": "qc_comment",
}
# Headers with the opposite meaning, where "yes" says that all is well.
INVERTED = {
    "camera_functioning": "qc_non_functional",
    "qc_functional": "qc_non_functional",
    "qc_camera_functioning": "qc_non_functional",
    "data_usable": "qc_data_not_usable",
    "qc_data_usable": "qc_data_not_usable",
    "set_local_time": "qc_local_datetime_not_set",
    "qc_set_local_time": "qc_local_datetime_not_set",
}
# Headers that are known and not imported.
IGNORED = ("study_area_id", "study_area_name_en", "region_name_en")
PARK_HEADER = "study_area_name_en"
# Words for yes and no.
YES = ("1", "1.0", "true", "yes", "y", "x", "так", "+", "так.")
NO = ("0", "0.0", "false", "no", "n", "ні", "-", "none")

INTEGERS = ("study_year", "n_days_working", "n_photos")
DATES = ("start_date", "end_date")
TIMES = ("start_time", "end_time")
TEXTS = ("study_season", "study_design", "camera_model", "serial_number", "qc_local_datetime_issue")
FIELDS = (
    "name", "camera_id", "latitude", "longitude", *INTEGERS, *DATES, *TIMES, *TEXTS, "qc_comment", *QC_BOOLEAN_FLAGS,
)
NAME_LENGTH, TEXT_LENGTH, CAMERA_LENGTH = 200, 100, 10


def normal_header(header: str) -> str:
    return " ".join(str(header).strip().lower().split())


def unmapped_headers(sheet: DataFrame) -> list[str]:
    """Headers of a sheet that no rule knows."""
    known = {*ALIASES, *INVERTED, *IGNORED, "sheet", "row_no"}
    return [c for c in sheet.columns if normal_header(c) not in known]


def read_sheets(spark: SparkSession, paths: Mapping[str, str], order: Mapping[str, int] | None = None) -> DataFrame:
    """One CSV per sheet (name to path) as one table of text columns, with the sheet's place and the row's place in it."""
    parts = []
    for place, (name, path) in enumerate(paths.items()):
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
        numbered = rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("sheet", F.lit(name))
        parts.append(parse_sheet(numbered).withColumn("sheet_no", F.lit((order or {}).get(name, place))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _blank(raw: Column) -> Column:
    """Text without surrounding blanks; empty text and hard spaces count as missing."""
    text = F.trim(F.regexp_replace(raw.cast("string"), " ", " "))
    return F.nullif(text, F.lit(""))


def _yes_no(raw: Column, inverted: bool) -> Column:
    word = F.lower(_blank(raw))
    value = F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    return ~value if inverted else value


def _whole(raw: Column) -> Column:
    return F.regexp_replace(_blank(raw), ",", "").try_cast("double").try_cast("int")


def _year(raw: Column) -> Column:
    """First run of four digits, so a campaign over two years counts for its first."""
    return F.nullif(F.regexp_extract(_blank(raw), r"\d{4}", 0), F.lit("")).try_cast("int")


def _date(raw: Column) -> Column:
    return F.coalesce(F.try_to_date(_blank(raw), "yyyy-MM-dd"), _blank(raw).try_cast("timestamp_ntz").cast("date"))


def _time(raw: Column) -> Column:
    """Time of day as HH:mm:ss."""
    text = _blank(raw)
    spelled = F.when(text.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.concat(F.lit("2000-01-01 "), text))
    return F.date_format(spelled.try_cast("timestamp_ntz"), "HH:mm:ss")


def _camera(raw: Column) -> Column:
    """Camera number: a trailing ``.0`` is dropped, short numbers are padded to four digits, ten characters are kept."""
    text = F.regexp_replace(_blank(raw), r"^(\d+)\.0$", "$1")
    padded = F.when(text.rlike(r"^\d{1,3}$"), F.lpad(text, 4, "0")).otherwise(text)
    return F.substring(padded, 1, CAMERA_LENGTH)


def _converted(field: str, raw: Column, inverted: bool) -> Column:
    if field in QC_BOOLEAN_FLAGS:
        return _yes_no(raw, inverted)
    if field == "study_year":
        return _year(raw)
    if field in INTEGERS:
        return _whole(raw)
    if field in DATES:
        return _date(raw)
    if field in TIMES:
        return _time(raw)
    if field == "camera_id":
        return _camera(raw)
    if field in ("qc_comment", "qc_local_datetime_issue"):
        return _blank(raw)
    return F.substring(_blank(raw), 1, NAME_LENGTH if field == "name" else TEXT_LENGTH)


def _empty(field: str) -> Column:
    kinds = {**dict.fromkeys(QC_BOOLEAN_FLAGS, "boolean"), **dict.fromkeys(INTEGERS, "int"), **dict.fromkeys(DATES, "date")}
    return F.lit(None).cast(kinds.get(field, "string"))


def parse_sheet(sheet: DataFrame) -> DataFrame:
    """Register columns of one sheet of text columns (plus ``sheet`` and ``row_no``), the park name, and a warning for every
    value that is present but unreadable. Of several headers for one column the last readable one counts; comments add up."""
    found: dict[str, list[tuple[Column, bool]]] = {}
    park = F.lit(None).cast("string")
    for header in sheet.columns:
        key, raw = normal_header(header), F.col(f"`{header}`")
        if key in INVERTED:
            found.setdefault(INVERTED[key], []).append((raw, True))
        elif key in ALIASES:
            found.setdefault(ALIASES[key], []).append((raw, False))
        elif key == PARK_HEADER:
            park = _blank(raw)
    columns, warnings = [], []
    for field in FIELDS:
        sources = found.get(field, [])
        if not sources:
            columns.append(_empty(field).alias(field))
            continue
        values = [_converted(field, raw, inverted) for raw, inverted in sources]
        if field == "qc_comment":
            columns.append(F.nullif(F.concat_ws("; ", *values), F.lit("")).alias(field))
            continue
        columns.append(F.coalesce(*reversed(values)).alias(field))
        if field not in ("latitude", "longitude"):
            warnings += [
                F.when(_blank(raw).isNotNull() & value.isNull(), F.struct(F.lit(field).alias("field"), raw.cast("string").alias("raw_value")))
                for (raw, _), value in zip(sources, values)
            ]
    listed = F.filter(F.array(*warnings), lambda w: w.isNotNull()) if warnings else F.array()
    return sheet.select("sheet", "row_no", park.alias("park"), *columns, listed.alias("warnings"))


def sheet_warnings(rows: DataFrame) -> DataFrame:
    """(sheet, row_no, field, raw_value) of every unreadable value."""
    return rows.select("sheet", "row_no", F.explode("warnings").alias("w")).select("sheet", "row_no", "w.field", "w.raw_value")
