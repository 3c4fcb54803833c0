"""Layer projections: masks, maps derived from the change raster, fills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Change classes that make up each derived 1/0 map.
DERIVED_MAPS = {
    "hrp_deforestation": (6, 7, 8),
    "t1_forest": (5, 6, 7, 8),
    "t1_non_forest": (1, 2, 3, 4),
    "t1t2_deforestation": (6, 7),
    "t2_forest": (5, 8),
    "t2_non_forest": (1, 2, 3, 4, 6, 7),
    "t2t3_deforestation": (8,),
    "t3_forest": (5,),
    "t3_non_forest": (1, 2, 3, 4, 6, 7, 8),
}


def derived_map(name: str, change: str | Column = "fcbm") -> Column:
    """One of ``DERIVED_MAPS`` as 1/0, NULL where the change class is NULL."""
    value = F.col(change) if isinstance(change, str) else change
    return value.isin(*DERIVED_MAPS[name]).cast("int")


def combined_mask(area_value: int = 1, aoi: str = "aoi", excl: str = "excl") -> Column:
    """1 inside the area and not excluded, else 0; a NULL exclusion is included."""
    inside = F.coalesce(F.col(aoi) == area_value, F.lit(False))
    excluded = F.coalesce(F.col(excl) == 1, F.lit(False))
    return F.when(inside & ~excluded, 1).otherwise(0)


def area_mask(area_value: int = 1, aoi: str = "aoi") -> Column:
    """1 where the area layer has ``area_value``, else 0 (no exclusions)."""
    return F.when(F.col(aoi) == area_value, 1).otherwise(0)


def mask_to_area(value: str, mask: str = "mask") -> Column:
    """``value`` where the mask is 1, else NULL."""
    return F.when(F.col(mask) == 1, F.col(value))


def apply_mask(
    value: str,
    mask: str,
    fill: str | float = "auto",
    value_nodata: float | None = None,
    mask_declares_nodata: bool = True,
) -> Column:
    """Keep ``value`` where the mask is valid, else ``fill``.

    ``"auto"`` and ``"nodata"`` fill with the layer's own NoData: NULL when it
    declares one, 0 when it does not.  A mask that declares no NoData is
    invalid where it is 0.
    """
    valid = F.col(mask).isNotNull() if mask_declares_nodata else F.coalesce(F.col(mask) != 0, F.lit(False))
    if fill in ("auto", "nodata"):
        outside = F.lit(0) if value_nodata is None else F.lit(None)
    else:
        outside = F.lit(fill)
    return F.when(valid, F.col(value)).otherwise(outside)


def keep_where_valid(value: str | Column, template: str) -> Column:
    """``value`` only where the template layer has data."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(F.col(template).isNotNull(), column)


def review_map(forest: str, loss_cal: str, loss_cnf: str) -> Column:
    """Forest 1, loss in the first period 2, loss in the second period 3.

    Where the second period is NULL the forest value stays.
    """
    f, first, second = F.col(forest), F.col(loss_cal), F.col(loss_cnf)
    return (
        F.when(second == 1, 3)
        .when((second == 0) & (first == 1), 2)
        .when((second == 0) & (first == 0) & (f == 1), 1)
        .otherwise(f)
    )
