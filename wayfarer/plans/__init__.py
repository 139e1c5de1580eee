"""Registered queries over the supplied tables, and the same in SQL."""

from . import views as _views  # noqa: F401 (registers its queries)
from .journeys import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
