"""Column functions over boxes ``x1, y1, x2, y2``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "", suffix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))


def centre(b: tuple[Column, ...] | None = None) -> tuple[Column, Column]:
    x1, y1, x2, y2 = b or box()
    return (x1 + x2) / 2, (y1 + y2) / 2


def area(b: tuple[Column, ...] | None = None) -> Column:
    x1, y1, x2, y2 = b or box()
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...], plus: float | None = None) -> Column:
    """Intersection over union; null if any side is missing. A union of at most 1e-6 gives 0, or with ``plus`` that is added to it."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    missing = F.lit(False)
    for c in (*a, *b):  # greatest and least skip nulls
        missing = missing | c.isNull()
    value = w * h / (union + F.lit(plus)) if plus is not None else F.when(union <= 1e-6, 0.0).otherwise(w * h / union)
    return F.when(missing, F.lit(None).cast("double")).otherwise(value)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
