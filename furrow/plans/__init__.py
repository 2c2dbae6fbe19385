"""Every query of the engine, by family; importing a module registers its queries."""

from furrow.plans import did_plans, forest_plans, panel_plans, quality_plans, raster_plans, season_plans, spatial_plans  # noqa: F401
from furrow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
