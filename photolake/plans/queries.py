"""All registered queries of the photo library and their SQL."""

from . import file_queries, geo_queries, library_queries, planning_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
