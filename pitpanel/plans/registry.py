"""Names, queries and SQL of everything outside the training-data subpackage."""

from __future__ import annotations

from . import readings, studies

QUERIES: dict = dict(studies.QUERIES) | readings.QUERIES
ORACLES: dict = dict(studies.ORACLES) | readings.ORACLES
