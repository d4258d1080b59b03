"""Display names of species in the interface language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_name(lang: str) -> Column:
    """Common name in the interface language, without any fallback."""
    columns = {"uk": "common_name_ua", "en": "common_name_en"}
    return F.nullif(F.col(columns[lang]), F.lit("")) if lang in columns else F.lit(None).cast("string")


def species_label(lang: str, latin: bool = False) -> Column:
    """Common name, else the Latin one. ``latin`` appends the Latin name, except for special categories (id < 0)."""
    common = common_name(lang)
    shown = F.when((F.col("id") > 0) & common.isNotNull(), F.concat(common, F.lit(" ("), F.col("scientific_name"), F.lit(")")))
    return F.coalesce(shown, common, F.col("scientific_name")) if latin else F.coalesce(common, F.col("scientific_name"))


def prediction_label(lang: str) -> Column:
    """Name used in prediction lists: either common name before the Latin one, Latin in brackets for real species."""
    first, second = ("common_name_en", "common_name_ua") if lang == "en" else ("common_name_ua", "common_name_en")
    name = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.col("scientific_name"))
    bracketed = F.concat(name, F.lit(" ("), F.col("scientific_name"), F.lit(")"))
    return F.when((F.col("id") > 0) & F.col("scientific_name").isNotNull(), bracketed).otherwise(name)


def user_label(username: str = "username", user_id: str = "user_id") -> Column:
    return F.coalesce(F.col(username), F.concat(F.lit("User "), F.col(user_id).cast("string")))


def bracketed_label(lang: str) -> Column:
    """Common name with the Latin name in brackets, else the Latin name."""
    common = common_name(lang)
    return F.coalesce(F.concat(common, F.lit(" ("), F.col("scientific_name"), F.lit(")")), F.col("scientific_name"))


def plural_form(number: Column, one: str, few: str, many: str) -> Column:
    """Noun form beside a number in languages with three forms (1, 21 / 2-4, 22-24 / the rest with 11-19)."""
    tens, ones = F.abs(number) % 100, F.abs(number) % 10
    return F.when(tens.between(11, 19), many).when(ones == 1, one).when(ones.between(2, 4), few).otherwise(many)
