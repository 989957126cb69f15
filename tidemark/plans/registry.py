"""The queries of the library, by name."""

from . import connectors, exchanges, execution, logs, measures, procedures, reports, routing  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

FLAGSHIP = routing.classify_geo
