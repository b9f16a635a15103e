"""All queries of the engine by name, and the SQL that gives the same rows."""

from folio.plans import analytics, answers, crawling, indexed, overview, records, retrieval, streams, upkeep  # noqa: F401  (they register their queries)
from folio.plans.register import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_rrf_pages"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
