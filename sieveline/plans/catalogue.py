"""All queries of the contact-data engine, with their oracle SQL."""

from sieveline.plans import computed_queries, entity_queries, landed_queries, lookup_queries, record_queries, state_queries, text_queries

QUERIES = text_queries.QUERIES | entity_queries.QUERIES | record_queries.QUERIES | landed_queries.QUERIES | state_queries.QUERIES | lookup_queries.QUERIES | computed_queries.QUERIES
ORACLES = text_queries.ORACLES | entity_queries.ORACLES | record_queries.ORACLES | landed_queries.ORACLES | state_queries.ORACLES | lookup_queries.ORACLES | computed_queries.ORACLES
