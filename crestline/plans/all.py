"""Everything that is registered; importing the modules registers their queries."""

from . import checks, imaging, points, preparation, sources, tracing  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

# the simplest SQL first: where comparisons share one allowance of time, the long traces come last
QUERIES = dict(sorted(QUERIES.items(), key=lambda q: len(ORACLE_SQL.get(q[0], ""))))
