"""Registry of the named queries: how to run each over a data folder, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trapline.session import apply_adaptive, set_where_unset
from trapline.sources.starschema import Survey, checking_sql


@dataclass(frozen=True)
class NamedQuery:
    name: str
    run: Callable[[Survey], DataFrame]
    sql: str | None


REGISTRY: dict[str, NamedQuery] = {}


def query(name: str, sql: str | None = None, **named: str):
    """Register a function from Survey to DataFrame. ``named`` adds extra named queries to the checking SQL."""

    def keep(run: Callable[[Survey], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = NamedQuery(name, run, checking_sql(sql, **{**SHARED_SQL, **named}) if sql else None)
        return run

    return keep


def runner(entry: NamedQuery) -> Callable[[SparkSession, str], DataFrame]:
    def start(spark: SparkSession, folder: str) -> DataFrame:
        apply_adaptive(spark)
        set_where_unset(spark, {"spark.sql.session.timeZone": "UTC"})  # survey times are wall-clock times without a zone
        return entry.run(Survey(spark, folder))

    return start


# Named queries many checks share.
SHARED_SQL = {
    "votes": """SELECT p.observation_id, i.species_id, COUNT(DISTINCT i.user_id) AS vote_count, MAX(i.quantity) AS max_quantity
        FROM identifications i JOIN photos p ON p.id = i.photo_id GROUP BY p.observation_id, i.species_id""",
    "ranked": """SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id
        ORDER BY vote_count DESC, max_quantity DESC NULLS FIRST, species_id ASC NULLS LAST) AS rn FROM votes""",
    "verified": """SELECT o.*, r.species_id, r.vote_count, r.max_quantity FROM observations o
        JOIN ranked r ON r.observation_id = o.id WHERE r.rn = 1 AND o.status IN ('completed', 'archived')""",
    "lenient_locations": "SELECT * FROM locations WHERE is_valid IS NOT FALSE",
    "strict_locations": "SELECT * FROM locations WHERE is_valid IS TRUE",
}
