"""All named queries: importing this module fills the registry."""

from __future__ import annotations

from .plans import imports, locations, maps, routes, scalars, spatial, tracks  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
