"""Numeric jobs: homography fits, spline filling, small assignments. Numpy inside tasks, grouped and shuffled by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import centre
from ..params import BALL, DEFAULTS, Params

KEY = ["match_id", "frame"]


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest one-to-one assignment (shortest augmenting paths with potentials)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # column m is the virtual start
    for row in range(n):
        owner[m] = row
        at, least, came, used = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            used[at] = True
            k = owner[at]
            slack = c[k] - u[k] - v[:m]
            better = ~used[:m] & (slack < least)
            least[better], came[better] = slack[better], at
            free = np.where(used[:m], np.inf, least)
            nxt = int(np.argmin(free))
            delta = free[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used[:m]] -= delta
            at = nxt
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[m] = -1
    cols = np.flatnonzero(owner[:m] >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    rows, cols = rows[order], cols[order]
    return (cols, rows) if flipped else (rows, cols)


def assign_frames(pairs: DataFrame) -> DataFrame:
    """Of (match_id, frame, gt_id, pred_id, iou) pairs the one-to-one choice with the most IoU in each frame."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p = np.unique(pdf["gt_id"]), np.unique(pdf["pred_id"])
        best = np.zeros((len(g), len(p)))
        best[np.searchsorted(g, pdf["gt_id"]), np.searchsorted(p, pdf["pred_id"])] = pdf["iou"]
        rows, cols = assign(-best)
        keep = best[rows, cols] > 0
        rows, cols = rows[keep], cols[keep]
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "frame": pdf["frame"].iloc[0], "gt_id": g[rows], "pred_id": p[cols], "iou": best[rows, cols]})

    return pairs.select(*KEY, "gt_id", "pred_id", "iou").groupBy(*KEY).applyInPandas(solve, pairs.select(*KEY, "gt_id", "pred_id", "iou").schema)


def dlt(image: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """Homographies (k, 3, 3) of k sets of n point pairs (k, n, 2), least squares after centring and scaling both sides."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(1, keepdims=True)
        size = np.sqrt(((p - mean) ** 2).sum(2)).mean(1)
        s = np.sqrt(2) / np.where(size > 0, size, 1)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2] = -s[:, None] * mean[:, 0]
        t[:, 2, 2] = 1
        return (p - mean) * s[:, None, None], t

    (a, ta), (b, tb) = scaled(image), scaled(pitch)
    one, nil = np.ones(a.shape[:2]), np.zeros(a.shape[:2])
    x, y, u, w = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    top = np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], -1)
    low = np.stack([nil, nil, nil, x, y, one, -w * x, -w * y, -w], -1)
    system = np.concatenate([top, low], 1)
    h = np.linalg.svd(system)[2][:, -1].reshape(-1, 3, 3)
    return np.linalg.inv(tb) @ h @ ta


def _unit(h: np.ndarray) -> np.ndarray:
    last = h[..., 2:3, 2:3]
    return np.where(np.abs(last) > 1e-12, h / np.where(last == 0, 1, last), h)


def fit_homography(keypoints: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(match_id, frame, h, ok, degenerate, n_points) of every frame with keypoints (x, y -> x_cm, y_cm).

    Under four points: no fit, not degenerate. Too little spread across the weaker axis, or a condition number above 1e8:
    degenerate. Frames are gathered by Spark and solved in stacks of equal point counts, not one call a frame.
    """
    sets = keypoints.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "x", "y", "x_cm", "y_cm"))).alias("p"))
    flat = sets.select(*KEY, *[F.expr(f"transform(p, q -> cast(q.{c} as double))").alias(c) for c in ("x", "y", "x_cm", "y_cm")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["x"].map(len).to_numpy()
            h = np.full((len(pdf), 3, 3), np.nan)
            bad = np.zeros(len(pdf), bool)
            for size in np.unique(n[n >= 4]):
                at = np.flatnonzero(n == size)
                a, b = (np.stack([np.stack(pdf[c].iloc[at].to_list()) for c in cs], -1) for cs in (("x", "y"), ("x_cm", "y_cm")))
                centred = a - a.mean(1, keepdims=True)
                cov = np.einsum("kni,knj->kij", centred, centred) / (size - 1)
                spread = np.sqrt(np.maximum(np.linalg.eigvalsh(cov)[:, 0], 0))
                thin = spread < p.min_spread_px
                found = np.full((len(at), 3, 3), np.nan)
                if (~thin).any():
                    found[~thin] = dlt(a[~thin], b[~thin])
                    cond = np.linalg.cond(found[~thin])
                    thin[np.flatnonzero(~thin)[~(cond <= p.max_condition)]] = True
                found[thin] = np.nan
                h[at], bad[at] = _unit(found), thin
            ok = np.isfinite(h).all((1, 2))
            yield pd.DataFrame({"match_id": pdf["match_id"], "frame": pdf["frame"], "h": [x.ravel() if o else None for x, o in zip(h, ok)], "ok": ok, "degenerate": bad, "n_points": n})

    return flat.mapInPandas(run, "match_id bigint, frame bigint, h array<double>, ok boolean, degenerate boolean, n_points int")


def solve_anchor(image: np.ndarray, pitch: np.ndarray, threshold: float = DEFAULTS.anchor_threshold_cm) -> np.ndarray | None:
    """Four pairs exactly; more of them robustly: the four whose fit has most pairs within the threshold (then the least
    error) choose the pairs of a final fit. None under four pairs, for unequal counts or non-finite results."""
    image, pitch = np.asarray(image, float).reshape(-1, 2), np.asarray(pitch, float).reshape(-1, 2)
    if len(image) < 4 or len(image) != len(pitch) or not (np.isfinite(image).all() and np.isfinite(pitch).all()):
        return None
    with np.errstate(all="ignore"):
        if len(image) > 4:
            picks = np.array(list(combinations(range(len(image)), 4)))
            tries = dlt(image[picks], pitch[picks])
            q = np.concatenate([image, np.ones((len(image), 1))], 1) @ np.swapaxes(tries, 1, 2)
            error = np.sqrt(((q[..., :2] / q[..., 2:] - pitch) ** 2).sum(2))
            error = np.where(np.isfinite(error), error, np.inf)
            inside = error <= threshold
            best = np.lexsort((np.where(inside, error, 0).sum(1), -inside.sum(1)))[0]
            if inside[best].sum() < 4:
                return None
            image, pitch = image[inside[best]], pitch[inside[best]]
        h = _unit(dlt(image[None], pitch[None])[0])
        if not np.isfinite(h).all() or np.linalg.cond(h) > 1e14:
            return None
        q = np.concatenate([image, np.ones((len(image), 1))], 1) @ h.T
        return h if np.isfinite(q[:, :2] / q[:, 2:]).all() else None


#: Numbers in the stacked equations of anchors that are solved at a time.
STACK = 2_000_000


def solve_anchors(image: np.ndarray, pitch: np.ndarray, threshold: float = DEFAULTS.anchor_threshold_cm) -> list[np.ndarray | None]:
    """``solve_anchor`` of k anchors of n pairs each, (k, n, 2).

    Where one four's fit has all pairs within the threshold no four can have more, so all pairs choose the final fit and the
    other fours need no try. A few widely spread fours are tried in stacks; anchors that none of them settles take every four.
    """
    out: list[np.ndarray | None] = [None] * len(image)
    n = image.shape[1]
    if n < 4:
        return out
    whole = np.isfinite(image).all((1, 2)) & np.isfinite(pitch).all((1, 2))
    todo = np.flatnonzero(whole)
    ones = np.ones((len(image), n, 1))
    with np.errstate(all="ignore"):
        settled = [todo] if n == 4 else []
        for turn in range(3 if n > 4 else 0):
            if not len(todo):
                break
            four = spread_four(image[todo], turn)
            at = np.arange(len(todo))[:, None]
            sure = np.zeros(len(todo), bool)
            # three of the four near one line have no fit of their own
            firm = np.flatnonzero(firm_four(image[todo][at, four]) & firm_four(pitch[todo][at, four]))
            tries = four_fit(*(x[todo[firm][:, None], four[firm]] for x in (image, pitch)))
            q = np.concatenate([image[todo[firm]], ones[todo[firm]]], 2) @ np.swapaxes(tries, 1, 2)
            error = np.sqrt(((q[..., :2] / q[..., 2:] - pitch[todo[firm]]) ** 2).sum(2))
            sure[firm] = (error <= threshold).all(1)  # not so for nan
            settled.append(todo[sure])
            todo = todo[~sure]
        for at in settled:
            if not len(at):
                continue
            h = _unit(dlt(image[at], pitch[at]))
            q = np.concatenate([image[at], ones[at]], 2) @ np.swapaxes(h, 1, 2)
            good = np.isfinite(h).all((1, 2)) & np.isfinite(q[..., :2] / q[..., 2:]).all((1, 2))
            good[good] = ~(np.linalg.cond(h[good]) > 1e14)
            for k, x, g in zip(at, h, good):
                out[k] = x if g else None
    if n > 4:
        for k in todo:
            out[k] = solve_anchor(image[k], pitch[k], threshold)
    return out


def spread_four(points: np.ndarray, turn: int) -> np.ndarray:
    """Places (k, 4) of four points each that lie far out in four directions, another cross of directions a ``turn``."""
    angle = turn * np.pi / 6 + 0.3
    u, v = np.array([np.cos(angle), np.sin(angle)]), np.array([-np.sin(angle), np.cos(angle)])
    a, b = points @ u, points @ v
    return np.stack([a.argmin(1), a.argmax(1), b.argmin(1), b.argmax(1)], 1)


def firm_four(points: np.ndarray) -> np.ndarray:
    """Whether no three of four points (k, 4, 2) are near one line (or one point)."""
    size = ((points - points.mean(1, keepdims=True)) ** 2).sum((1, 2))
    ok = size > 0
    for i, j, k in combinations(range(4), 3):
        d, e = points[:, j] - points[:, i], points[:, k] - points[:, i]
        ok &= np.abs(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) > 1e-3 * size
    return ok


def four_fit(image: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """Homographies (k, 3, 3) of four firm pairs (k, 4, 2): both fours are seen from the same frame of reference."""

    def frame(p: np.ndarray) -> np.ndarray:
        h = np.concatenate([p, np.ones((len(p), 4, 1))], 2).swapaxes(1, 2)
        return h[..., :3] * np.linalg.solve(h[..., :3], h[..., 3:]).swapaxes(1, 2)

    return frame(pitch) @ np.linalg.inv(frame(image))


def fit_anchor(anchors: DataFrame, threshold: float = DEFAULTS.anchor_threshold_cm) -> DataFrame:
    """Anchors (match_id, frame, image_pts, pitch_pts arrays of struct<x, y>) with ``h`` (null where there is no fit)."""
    flat = anchors.select(*KEY, *[F.expr(f"transform({c}, q -> cast(q.{a} as double))").alias(f"{c}_{a}") for c in ("image_pts", "pitch_pts") for a in "xy"])
    names = ["image_pts_x", "image_pts_y", "pitch_pts_x", "pitch_pts_y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[np.ndarray | None] = [None] * len(pdf)
            size = pdf[names].map(lambda v: -1 if v is None else len(v)).to_numpy().reshape(len(pdf), 4)
            alike = (size == size[:, :1]).all(1) & (size[:, 0] >= 4)
            for n in np.unique(size[alike, 0]):
                at = np.flatnonzero(alike & (size[:, 0] == n))
                step = max(1, STACK // (18 * int(n)))
                for k in (at[i : i + step] for i in range(0, len(at), step)):
                    a, b = (np.stack([np.stack(pdf[c].iloc[k].to_list()).astype(float) for c in cs], -1) for cs in (names[:2], names[2:]))
                    for i, h in zip(k, solve_anchors(a, b, threshold)):
                        out[i] = None if h is None else h.ravel()
            yield pd.DataFrame({"match_id": pdf["match_id"], "frame": pdf["frame"], "h": out})

    return flat.mapInPandas(run, "match_id bigint, frame bigint, h array<double>")


def not_a_knot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives (times a half) at the knots of the cubic spline whose third derivative is continuous at the
    second and the last but one knot; four knots or more. One elimination over a tridiagonal system."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    low, mid, up, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 3 * np.diff(d)
    # the end conditions give the first and last value by their two neighbours; put into the rows next to them
    r0, r1 = h[0] / h[1], h[-1] / h[-2]
    mid[0] += low[0] * (1 + r0)
    up[0] -= low[0] * r0
    mid[-1] += up[-1] * (1 + r1)
    low[-1] -= up[-1] * r1
    c = np.zeros(n)
    for k in range(1, n - 2):
        f = low[k] / mid[k - 1]
        mid[k] -= f * up[k - 1]
        rhs[k] -= f * rhs[k - 1]
    c[n - 2] = rhs[-1] / mid[-1]
    for k in range(n - 4, -1, -1):
        c[k + 1] = (rhs[k] - up[k] * c[k + 2]) / mid[k]
    c[0] = (1 + r0) * c[1] - r0 * c[2]
    c[-1] = (1 + r1) * c[-2] - r1 * c[-3]
    return c


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline through the anchors, straight lines under four of them."""
    if len(x) < 4:
        return np.interp(at, x, y)
    c, h = not_a_knot(x, y), np.diff(x)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    b = np.diff(y)[k] / h[k] - h[k] * (2 * c[k] + c[k + 1]) / 3
    t = at - x[k]
    return y[k] + t * (b + t * (c[k] + t * (c[k + 1] - c[k]) / (3 * h[k])))


#: Anchors of a piece of a match, and anchors beyond either end that are solved with it.
SPLINE_PIECE, SPLINE_MARGIN = 4096, 64


def spline_pieces(anchors: DataFrame, piece: int = SPLINE_PIECE, margin: int = SPLINE_MARGIN) -> DataFrame:
    """Anchors (match_id, frame, ..) as ``nth``, their number in the match from 0, and each ``part`` that needs them: their
    own, nth / piece, and the next one within ``margin`` anchors. Numbers come from counts of spans of frames, so no task
    sorts a match."""
    spans = anchors.withColumn("_span", F.floor(F.col("frame") / piece))
    before = Window.partitionBy("match_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = spans.groupBy("match_id", "_span").agg(F.count("*").alias("_n")).select("match_id", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("a.match_id").eqNullSafe(F.col("c.match_id")) & F.col("a._span").eqNullSafe(F.col("c._span"))
    place = Window.partitionBy("match_id", "_span").orderBy("frame")
    numbered = spans.alias("a").join(counts.alias("c"), on).select("a.*", "_before").withColumn("nth", F.col("_before") + F.row_number().over(place) - 1)
    part = lambda x: F.floor(x / piece).cast("int")
    parts = F.sequence(F.greatest(part(F.col("nth") - margin), F.lit(0)), part(F.col("nth") + margin))
    return numbered.withColumn("part", F.explode(parts)).drop("_span", "_before")


def spline_fill(tracks: DataFrame, overrides: DataFrame, p: Params = DEFAULTS, piece: int = SPLINE_PIECE) -> DataFrame:
    """(match_id, frame, cx, cy) inside gaps of 2 to 30 frames between real or manual ball positions (manual wins).

    The curve of a match depends on all of its anchors, but what is ``k`` anchors away counts at most 2 ** -k of its own
    size: each row of the spline's equations has a diagonal twice the sum of the others. So a match is solved in pieces of
    ``piece`` anchors with 64 more on either side (2 ** -64 is below a double's precision), each in a task of its own.
    """
    cx, cy = centre()
    real = tracks.filter((F.col("class_id") == BALL) & (F.col("ball_interpolated") == 0)).groupBy(*KEY).agg(F.max_by(F.struct(cx.alias("cx"), cy.alias("cy")), F.struct("conf", -F.col("x1"))).alias("p"))
    real = real.select(*KEY, F.col("p.cx").alias("cx"), F.col("p.cy").alias("cy"), F.lit(0).alias("rank"))
    manual = overrides.groupBy(*KEY).agg(F.max("cx").alias("cx"), F.max("cy").alias("cy")).withColumn("rank", F.lit(1))
    anchors = real.unionByName(manual).groupBy(*KEY).agg(F.max_by(F.struct("cx", "cy"), "rank").alias("p")).select(*KEY, "p.cx", "p.cy")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        f = pdf["frame"].to_numpy(float)
        own = (pdf["nth"] // piece == pdf["part"]).to_numpy()
        holes = [np.arange(a + 1, b) for a, b, o in zip(f[:-1], f[1:], own) if o and 1 < b - a <= p.spline_max_gap]
        at = np.concatenate(holes) if holes else np.zeros(0)
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "frame": at.astype(np.int64), "cx": spline_values(f, pdf["cx"].to_numpy(float), at), "cy": spline_values(f, pdf["cy"].to_numpy(float), at)})

    return spline_pieces(anchors, piece).groupBy("match_id", "part").applyInPandas(run, "match_id bigint, frame bigint, cx double, cy double")


def two_means(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two centroids, seeded by the farthest row from the mean and the row farthest from that."""
    first = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    c = np.stack([first, x[np.argmax(((x - first) ** 2).sum(1))]])
    for _ in range(rounds):
        side = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[side == k].mean(0) if (side == k).any() else c[k] for k in (0, 1)])
        if np.allclose(new, c):
            break
        c = new
    return c


def team_clusters(features: DataFrame, key: str = "match_id", row: str = "row_id", frame: str = "frame", stride: int = 60, most_frames: int = 24, feature: str = "feature") -> DataFrame:
    """(key, row, team): two-means fitted on sampled frames of each match (at most ``most_frames``, a feature of the
    fit), then a team for every row; -1 for rows without a feature. The prediction is JVM-side, row by row."""
    steps = features.filter((F.col(frame) % stride == 0) & F.col(feature).isNotNull())
    picked = steps.select(key, frame).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(frame))).filter(F.col("_k") <= most_frames).drop("_k")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = two_means(np.stack(pdf[feature].to_list()).astype(float))
        c = c[np.lexsort(c.T[::-1])]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "c0": [c[0]], "c1": [c[1]]})

    kind = features.schema[key].dataType.simpleString()
    models = steps.join(picked, [key, frame]).select(key, feature).groupBy(key).applyInPandas(fit, f"{key} {kind}, c0 array<double>, c1 array<double>")
    d = lambda c: F.aggregate(F.zip_with(feature, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    team = F.when(F.col(feature).isNull() | F.col("c0").isNull(), -1).when(d("c0") <= d("c1"), 0).otherwise(1)
    return features.join(models, key, "left").select(key, row, team.alias("team"))
