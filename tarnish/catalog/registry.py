"""All registered queries in one place."""

from __future__ import annotations

from tarnish.catalog import analysis, composites, degradation, files, leftovers, preparation, quality, scenarios, scoring

MODULES = [degradation, composites, analysis, scoring, preparation, quality, scenarios, leftovers, files]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
