"""All queries of the library's own operators by name, and the SQL that states the same result."""

from __future__ import annotations

from lumenreel.plans import media, payloads, scenes, store, streams, texts, work  # noqa: F401  they register their queries
from lumenreel.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
