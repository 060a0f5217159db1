"""Event classification expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmarts.contracts import FUNNEL_STAGES, PRODUCT_STAGE


def funnel_stage(
    event_name: Column,
    stages: Mapping[str, Sequence[str]] = FUNNEL_STAGES,
    default: str = PRODUCT_STAGE,
) -> Column:
    """Funnel stage of an event name: the first stage listing it, else ``default``.

    Compiles to one CASE expression; a NULL name falls through to ``default``.
    """
    expr = None
    for stage, names in stages.items():
        test = event_name.isin(list(names))
        expr = F.when(test, F.lit(stage)) if expr is None else expr.when(test, F.lit(stage))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))
