"""Named queries over facts that are stored by series: the same rows as from the votes, without an exchange of them."""

from __future__ import annotations

from dataclasses import replace

from trapline.operators import consensus as C
from trapline.operators import filters as L
from trapline.operators import occurrences as X
from trapline.operators import reports as R
from trapline.operators import scope as S
from trapline.plans.consensus_queries import QUORUM_SQL
from trapline.plans.occurrence_queries import FIRST, KEYS, LAST, _keys, _sql, tables
from trapline.plans.registry import query
from trapline.plans.report_queries import FIRST as SHOWN_FIRST
from trapline.plans.report_queries import LAST as SHOWN_LAST
from trapline.plans.report_queries import TOP_SQL
from trapline.session import shared_folder
from trapline.sources.layout import SeriesFacts, store_facts
from trapline.sources.tables import fresh_folder


def facts(s) -> SeriesFacts:
    return store_facts(s.observations, s.identifications, s.photos, fresh_folder(shared_folder(s.spark), "facts"))


@query("j1_stored_consensus", "SELECT observation_id, species_id, vote_count, max_quantity, CAST(rn AS INT) AS rn FROM ranked")
def stored_consensus(s):
    return C.consensus(facts(s).ballots, None)


@query("j1_stored_quorum", QUORUM_SQL)
def stored_quorum(s):
    held = facts(s)
    return C.quorum(held.observations, held.ballots, None)


@query("j1_stored_top_species", TOP_SQL)
def stored_top_species(s):
    held = facts(s)
    placed = S.at_valid_locations(L.started_between(held.observations, SHOWN_FIRST, SHOWN_LAST), s.locations)
    return R.top_species(C.verified_series(placed, held.ballots, None), s.species)


@query("j1_stored_occurrences", f"SELECT {KEYS} FROM agreed", **_sql())
def stored_occurrences(s):
    held = facts(s)
    stored = replace(tables(s), observations=held.observations, identifications=held.ballots, photos=None)
    return _keys(X.occurrences(stored, X.OccurrenceSpec(FIRST, LAST)))
