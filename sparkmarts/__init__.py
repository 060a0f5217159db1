"""sparkmarts: product-analytics marts on Spark's DataFrame API.

Raw operational tables are normalised to a column contract, typed defensively into staging
views and aggregated into six marts; report aggregates and data-quality checks run on top.

    from sparkmarts import Warehouse, build_marts, dashboard, marts
"""

from sparkmarts.operators.reports import dashboard
from sparkmarts.plans.pipeline import build_marts, marts, stage
from sparkmarts.sources.normalize import normalize
from sparkmarts.sources.warehouse import CatalogWarehouse, Warehouse

__version__ = "0.1.0"

__all__ = ["CatalogWarehouse", "Warehouse", "build_marts", "dashboard", "marts", "normalize",
           "stage"]
