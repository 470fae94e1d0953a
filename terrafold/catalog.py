"""All queries of the engine's own operators, with the SQL each must equal."""

from __future__ import annotations

from .plans import event_queries, point_queries, raster_queries, scene_queries, source_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (point_queries, event_queries, raster_queries, scene_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
