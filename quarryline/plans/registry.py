"""All named queries of the library and their SQL."""

from __future__ import annotations

from . import catalog, formats, logs

QUERIES = catalog.QUERIES | formats.QUERIES | logs.QUERIES
ORACLES = catalog.ORACLES | formats.ORACLES | logs.ORACLES
