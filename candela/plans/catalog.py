"""All queries of the market-bar library and their DuckDB SQL."""

from __future__ import annotations

from candela.plans import catalog_asof, catalog_bars, catalog_direction, catalog_eval, catalog_scoring, catalog_stream, catalog_structure

PARTS = (catalog_bars, catalog_structure, catalog_scoring, catalog_eval, catalog_direction, catalog_asof, catalog_stream)
QUERIES = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE = {k: q for part in PARTS for k, q in part.ORACLE.items()}
