"""3 x 3 homographies as ``array<double>`` of nine numbers, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The image point in pitch coordinates; null without a homography or at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.when(w != 0, w)
    return (h[0] * x + h[1] * y + h[2]) / ok, (h[3] * x + h[4] * y + h[5]) / ok


def inverse(h: Column) -> Column:
    """The inverse up to its scale, normalised to a last element of 1; null if singular."""
    a, b, c, d, e, f, g, k, i = (h[n] for n in range(9))
    det = a * (e * i - f * k) - b * (d * i - f * g) + c * (d * k - e * g)
    adjugate = F.array(e * i - f * k, c * k - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d)
    return F.when(F.abs(det) > 1e-300, normalise(F.transform(adjugate, lambda x: x / det)))


def normalise(h: Column) -> Column:
    """Scaled to a last element of 1 where that is not tiny."""
    return F.when(F.abs(h[8]) > 1e-12, F.transform(h, lambda x: x / h[8])).otherwise(h)


def blend(a: Column, b: Column, t: Column) -> Column:
    """(1 - t) a + t b of two normalised homographies, normalised; the other one if one is missing."""
    mixed = normalise(F.zip_with(normalise(a), normalise(b), lambda x, y: (1 - t) * x + t * y))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(mixed)


def weak_axis_spread(x: str, y: str) -> Column:
    """Aggregate: square root of the smaller eigenvalue of the points' sample covariance; 0 under three points."""
    sxx, syy, sxy = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    half = (sxx + syy) / 2
    root = F.sqrt(F.greatest((sxx - syy) * (sxx - syy) / 4 + sxy * sxy, F.lit(0.0)))
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) < 3, 0.0).otherwise(F.sqrt(F.greatest(half - root, F.lit(0.0))))


def appearance_distance(a: Column, b: Column) -> Column:
    """Half the Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)) / 2
