"""All queries of the core and the SQL that must give the same rows."""

from loamgraph.plans import core_problems, graph_queries

QUERIES = {**graph_queries.QUERIES, **core_problems.QUERIES}
SQL = {**graph_queries.SQL, **core_problems.SQL}
