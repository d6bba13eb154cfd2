"""All named queries on series."""

from strandline.plans import queries, studies

QUERIES = queries.QUERIES | studies.QUERIES
ORACLE = queries.ORACLE | studies.ORACLE
