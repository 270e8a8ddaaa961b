"""All registered queries of the library and the SQL each is compared with."""

from __future__ import annotations

from quillon.plans import agent, curation, evaluation, fixtures, maintenance, parsing, retrieval, texts
from quillon.plans.registry import EXAMPLE_SQL, EXAMPLES, QUERIES, SQL

FLAGSHIP = "hybrid_search"
FAMILIES = (agent, retrieval, maintenance, evaluation, curation, parsing, texts, fixtures)

#: Names of the queries that only exist as worked examples, over rows of their own.
INLINE = [name for name in EXAMPLES if name not in QUERIES]
for _name in INLINE:
    QUERIES[_name] = EXAMPLES[_name]
    SQL[_name] = EXAMPLE_SQL[_name]

__all__ = ["EXAMPLES", "EXAMPLE_SQL", "FAMILIES", "FLAGSHIP", "INLINE", "QUERIES", "SQL"]
