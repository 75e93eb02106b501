"""Independent SQL oracle (DuckDB dialect) for the Spark queries.

Every text starts from the same adapter over ``events`` + ``nation`` that
``attrition.sources.events.events_from_tables`` implements in Spark. Shared
steps are named CTEs; ``build(name)`` returns ``WITH <needed CTEs> <final
SELECT>``.
"""

from oracle import features_sql, model_sql, users_sql  # noqa: F401  (register more queries)
from oracle.sql import build, oracle_queries

__all__ = ["build", "oracle_queries"]
