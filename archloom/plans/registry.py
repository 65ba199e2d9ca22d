"""All queries of the graph engine by name, with the SQL that checks them."""

from archloom.plans import more_queries, oracles, queries

QUERIES = queries.QUERIES | more_queries.QUERIES
ORACLES = oracles.ORACLES | more_queries.ORACLES
