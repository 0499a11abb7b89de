"""Registered queries over the test tables, each with DuckDB SQL where SQL can express it."""

from . import assembly, charts, cohort, entities, files, icu, models, notes, published, skewed

_PARTS = (icu, cohort, notes, charts, assembly, skewed, models, published, entities, files)
QUERIES = {name: f for part in _PARTS for name, f in part.R.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.R.sql.items()}
