"""All core queries by name, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from sparkloka.operators import instants
from sparkloka.plans import corpus_queries, entity_queries, label_queries, place_queries, score_queries, source_queries, stream_queries, text_queries  # noqa: F401
from sparkloka.plans.registry import QUERIES, SQL, Query
from sparkloka.runtime import table


def _tables(s, d):
    return table(s, d, "social_bootstrap"), table(s, d, "city_zones"), table(s, d, "scrape_sites")


def queries() -> dict[str, Query]:
    return {
        **QUERIES,
        "p4_found": lambda s, d: instants.found(*_tables(s, d)),
        "p4_instants": lambda s, d: instants.post_instants(*_tables(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
