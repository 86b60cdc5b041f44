"""All queries of the library."""

from __future__ import annotations

from . import brushes, channels, documents, editing, exports, geometry, images, imports, lifecycle, raster, workspace

MODULES = (raster, channels, documents, geometry, exports, editing, brushes, images, imports, lifecycle, workspace)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
