"""Array helpers for negative-binomial fits of many features at once.

Every function takes features as rows and samples as columns; Spark decides which features share a task.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the published method.
MIN_MU = 0.5
MIN_DISP = 1e-8
MAX_DISP = 10.0
FIT_DISP = 1e-6            # dispersions below this are left out of trend and prior
START_PSEUDO = 0.1         # added to normalised counts before the starting logarithms
RIDGE = 1e-6 / math.log(2.0) ** 2
OUTLIER_SDS = 2.0
COOK_MIN_DISP = 0.04
COOK_PROB = 0.99
MIN_REPLICATES = 3
MANY_REPLICATES = 7        # arms of this size get outliers replaced
REPLACE_TRIM = 0.2
BOUND = 30.0 * math.log(2.0)   # largest coefficient of a refit
GRID = 20
# Trimmed squared errors per arm: (largest arm size, trimmed share of each end, scale).
TRIM = ((3, 1 / 3, 2.04), (23, 1 / 4, 1.86), (math.inf, 1 / 8, 1.51))


def lgamma_digamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log gamma and its derivative for positive arguments: shift up, then the asymptotic series."""
    x = np.array(x, dtype=float)
    shift_log, shift_inv = np.zeros_like(x), np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        z = np.where(low, x, 1.0)
        shift_log += np.log(z)
        shift_inv += np.where(low, 1.0 / z, 0.0)
        x = np.where(low, x + 1, x)
    i = 1.0 / x
    i2 = i * i
    lg = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i * (
        1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    dg = np.log(x) - 0.5 * i - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    return lg - shift_log, dg - shift_inv


def trigamma(x: float) -> float:
    total = 0.0
    while x < 20:
        total += 1.0 / (x * x)
        x += 1.0
    i2 = 1.0 / (x * x)
    return total + 1.0 / x + i2 / 2 + i2 / x * (1 / 6 - i2 * (1 / 30 - i2 / 42))


def arm_means(y: np.ndarray, arm: np.ndarray) -> np.ndarray:
    """Mean of each arm, put back on its samples."""
    out = np.empty_like(y, dtype=float)
    for a in (0, 1):
        out[:, arm == a] = y[:, arm == a].mean(axis=1, keepdims=True)
    return out


def start_dispersion(norm: np.ndarray, sf: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """Smaller of a residual-based and a moment-based dispersion, kept inside the allowed range."""
    n = norm.shape[1]
    m1 = np.maximum(fitted, 1.0)
    rough = np.maximum((((norm - m1) ** 2 - m1) / m1**2).sum(axis=1) / (n - 2), 0.0)
    mean = norm.mean(axis=1)
    moments = (norm.var(axis=1, ddof=1) - (1.0 / sf).mean() * mean) / mean**2
    return np.clip(np.minimum(rough, moments), MIN_DISP, max(MAX_DISP, n))


def _profile(x, y, mu, arm, centre=None, var=None, slope_only=False):
    """Cox-Reid adjusted profile log likelihood of log dispersion ``x`` (one per feature), and its slope."""
    alpha = np.exp(x)[:, None]
    r = 1.0 / alpha
    lg_y, dg_y = lgamma_digamma(y + r)
    lg_r, dg_r = lgamma_digamma(r)
    am = alpha * mu
    log1 = np.log1p(am)
    slope = (-r * (dg_y - dg_r) + r * log1 - (r + y) * am / (1 + am) + y).sum(axis=1)
    w = mu / (1 + am)
    value = None if slope_only else (lg_y - lg_r - (r + y) * log1 + y * x[:, None]).sum(axis=1)
    for a in (0, 1):
        s = w[:, arm == a].sum(axis=1)
        slope += 0.5 * alpha[:, 0] * (w[:, arm == a] ** 2).sum(axis=1) / s
        if value is not None:
            value -= 0.5 * np.log(s)
    if centre is not None:
        slope -= (x - centre) / var
        if value is not None:
            value -= (x - centre) ** 2 / (2 * var)
    return value, slope


def grid_peak(y, mu, arm, top: float, centre=None, var=None, points: int = GRID) -> np.ndarray:
    """Highest point of the profile on a coarse grid over the allowed range, then on a fine one around it (log scale)."""
    low, high = math.log(MIN_DISP), math.log(top)
    gap = (high - low) / (points - 1)
    tries = np.broadcast_to(np.linspace(low, high, points)[:, None], (points, len(y)))
    for _ in range(2):
        values = np.stack([_profile(x.copy(), y, mu, arm, centre, var)[0] for x in tries])
        best = tries[values.argmax(axis=0), np.arange(len(y))]
        tries = np.clip(best + np.linspace(-gap, gap, points)[:, None], low, high)
    return best


def climb(start: np.ndarray, y, mu, arm, top: float, centre=None, var=None, max_iter: int = 100) -> np.ndarray:
    """Local maximum of the profile uphill from ``start`` (log scale), by damped Newton steps.

    A climb that has not settled after ``max_iter`` steps is replaced by the peak of a grid. Without a prior, a start from which next to
    nothing is gained is returned as it is.
    """
    low, high = math.log(MIN_DISP), math.log(top)
    x = np.clip(start, low, high)
    value, _ = _profile(x, y, mu, arm, centre, var)
    first = value.copy()
    live = np.ones(len(x), dtype=bool)
    eps = 1e-4
    for _ in range(max_iter):
        at = np.flatnonzero(live)
        if not len(at):
            break
        c = None if centre is None else centre[at]
        args = (y[at], mu[at], arm)
        _, g = _profile(x[at], *args, c, var, slope_only=True)
        _, g_hi = _profile(x[at] + eps, *args, c, var, slope_only=True)
        _, g_lo = _profile(x[at] - eps, *args, c, var, slope_only=True)
        bend = (g_hi - g_lo) / (2 * eps)
        step = np.where(bend < 0, -g / np.where(bend < 0, bend, -1.0), np.sign(g))
        step = np.clip(step, -1.0, 1.0)
        moved = np.zeros(len(at), dtype=bool)
        gain = np.zeros(len(at))
        for _ in range(30):
            try_x = np.clip(x[at] + step, low, high)
            new, _ = _profile(try_x, *args, c, var)
            better = ~moved & (new > value[at])
            gain[better] = (new - value[at])[better]
            x[at[better]], value[at[better]] = try_x[better], new[better]
            moved |= better
            if moved.all() or (np.abs(step[~moved]) < 1e-9).all():
                break
            step = np.where(moved, 0.0, step / 2)
        live[at[~moved | (gain < 1e-10)]] = False
    if live.any():
        c = None if centre is None else centre[live]
        x[live] = grid_peak(y[live], mu[live], arm, top, c, var)
        value[live], _ = _profile(x[live], y[live], mu[live], arm, c, var)
    if centre is not None:
        return x
    gained = value > first + np.abs(first) * 1e-6
    return np.where(gained, x, np.clip(start, low, high))


def gene_wise(y: np.ndarray, sf: np.ndarray, arm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised mean and gene-wise dispersion."""
    norm = y / sf
    fitted = arm_means(norm, arm)
    start = start_dispersion(norm, sf, fitted)
    top = max(MAX_DISP, y.shape[1])
    mu = np.maximum(fitted * sf, MIN_MU)
    disp = start.copy()
    free = start > MIN_DISP
    if free.any():
        disp[free] = np.exp(climb(np.log(start[free]), y[free], mu[free], arm, top))
    return norm.mean(axis=1), np.clip(disp, MIN_DISP, top)


def final_dispersion(y, sf, arm, gene, trend, prior_var, resid_var) -> np.ndarray:
    """Dispersion drawn towards the trend's value; a feature far above the trend keeps its own."""
    fitted = arm_means(y / sf, arm)
    mu = np.maximum(fitted * sf, MIN_MU)
    top = max(MAX_DISP, y.shape[1])
    start = np.log(np.where(gene > 0.1 * trend, gene, trend))
    drawn = np.clip(np.exp(climb(start, y, mu, arm, top, np.log(trend), prior_var)), MIN_DISP, top)
    outlier = np.log(gene) > np.log(trend) + OUTLIER_SDS * math.sqrt(resid_var)
    return np.where(outlier, gene, drawn)


def refit(y, sf, on, a, b0, b1, ridge: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounded maximum of the penalised likelihood by damped Newton steps, for features that weighted least squares leave unsettled.

    The likelihood is concave in both coefficients. Returns them and whether the score is zero (but for coefficients at a bound).
    """
    r = 1.0 / a

    def value(u, v):
        mu = sf * np.exp(u[:, None] + v[:, None] * on)
        return (y * np.log(np.maximum(a * mu, 1e-300)) - (y + r) * np.log1p(a * mu)).sum(axis=1) - (RIDGE * u * u + ridge * v * v) / 2

    u, v = (np.clip(b, -BOUND, BOUND) for b in (b0, b1))
    now, done = value(u, v), np.zeros(len(y), dtype=bool)
    for _ in range(rounds):
        mu = sf * np.exp(u[:, None] + v[:, None] * on)
        pull = (y - mu) / (1 + a * mu)
        bend = mu * (1 + a * y) / (1 + a * mu) ** 2
        g0, g1 = pull.sum(axis=1) - RIDGE * u, (pull * on).sum(axis=1) - ridge * v
        h0, h1 = bend.sum(axis=1) + RIDGE, (bend * on).sum(axis=1)
        h2 = h1 + ridge
        at_bound = lambda b, g: (np.abs(b) >= BOUND) & (np.sign(g) == np.sign(b))
        done = (np.abs(np.where(at_bound(u, g0), 0, g0)) < 1e-7) & (np.abs(np.where(at_bound(v, g1), 0, g1)) < 1e-7)
        if done.all():
            break
        det = h0 * h2 - h1 * h1
        d0, d1 = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
        length = np.ones(len(y))
        moved = done.copy()
        for _ in range(50):
            tu, tv = np.clip(u + length * d0, -BOUND, BOUND), np.clip(v + length * d1, -BOUND, BOUND)
            new = value(tu, tv)
            better = ~moved & (new >= now)
            u, v, now = np.where(better, tu, u), np.where(better, tv, v), np.where(better, new, now)
            moved |= better
            if moved.all():
                break
            length = np.where(moved, length, length / 2)
    return u, v, done


def wald_fit(y, sf, arm, disp, max_iter: int = 100, ridge: float = RIDGE):
    """Two-coefficient negative-binomial fit per feature; ``ridge`` is the inverse of the second coefficient's prior variance.

    Features that weighted least squares leave unsettled are fitted again by ``refit``. Returns the coefficients and the standard error of the
    second (natural log scale), whether the fit settled, the leverage-based influence inputs ``mu`` and ``hat``.
    """
    on = arm.astype(float)
    base = np.log(y / sf + START_PSEUDO)
    b0 = base[:, arm == 0].mean(axis=1)
    b1 = base[:, arm == 1].mean(axis=1) - b0
    a = disp[:, None]
    settled = np.zeros(len(y), dtype=bool)
    last = np.zeros(len(y))
    r = 1.0 / a
    lg_const = lgamma_digamma(y + r)[0] - lgamma_digamma(r)[0]
    for it in range(max_iter):
        mu = np.maximum(sf * np.exp(b0[:, None] + b1[:, None] * on), MIN_MU)
        w = mu / (1 + a * mu)
        z = np.log(mu / sf) + (y - mu) / mu
        s0, s1 = w.sum(axis=1) + RIDGE, (w * on).sum(axis=1)
        d = s1 + ridge
        t0, t1 = (w * z).sum(axis=1), (w * z * on).sum(axis=1)
        det = s0 * d - s1 * s1
        n0, n1 = (d * t0 - s1 * t1) / det, (s0 * t1 - s1 * t0) / det
        b0, b1 = np.where(settled, b0, n0), np.where(settled, b1, n1)
        mu = np.maximum(sf * np.exp(b0[:, None] + b1[:, None] * on), MIN_MU)
        dev = -2 * (lg_const + y * np.log(a * mu) - (y + r) * np.log1p(a * mu)).sum(axis=1)
        if it:
            settled |= np.abs(dev - last) / (np.abs(dev) + 0.1) < 1e-8
        last = dev
        if settled.all():
            break
    if (left := ~settled).any():
        b0[left], b1[left], settled[left] = refit(y[left], sf, on, a[left], base[left][:, arm == 0].mean(axis=1), base[left][:, arm == 1].mean(axis=1) - base[left][:, arm == 0].mean(axis=1), ridge)
        mu[left] = np.maximum(sf * np.exp(b0[left, None] + b1[left, None] * on), MIN_MU)
    w = mu / (1 + a * mu)
    s0, s1 = w.sum(axis=1), (w * on).sum(axis=1)
    det = (s0 + RIDGE) * (s1 + ridge) - s1 * s1
    i00, i01, i11 = (s1 + ridge) / det, -s1 / det, (s0 + RIDGE) / det
    # Row of the inverse for the second coefficient, around the information matrix.
    se = np.sqrt(i01 * (i01 * s0 + i11 * s1) + i11 * (i01 * s1 + i11 * s1))
    hat = w * np.where(arm == 1, (i00 + 2 * i01 + i11)[:, None], i00[:, None])
    return b0, b1, se, settled, mu, hat


def _trimmed_mean(v: np.ndarray, share: float) -> np.ndarray:
    n = v.shape[1]
    cut = int(math.floor(n * share))
    return np.sort(v, axis=1)[:, cut:n - cut].mean(axis=1)


def cook_distances(y, sf, arm, mu, hat) -> np.ndarray:
    """Cook's distance of each count; minus infinity in arms without enough replicates."""
    sizes = {a: int((arm == a).sum()) for a in (0, 1)}
    usable = np.array([sizes[int(a)] >= MIN_REPLICATES for a in arm])
    if not usable.any() or len(arm) <= 2:
        return np.full(y.shape, -np.inf)
    norm = y / sf
    variance = np.zeros(len(y))
    for a, size in sizes.items():
        if size >= MIN_REPLICATES:
            share, scale = next((s, c) for top, s, c in TRIM if size <= top)
            own = norm[:, arm == a]
            err = (own - _trimmed_mean(own, share)[:, None]) ** 2
            variance = np.maximum(variance, scale * _trimmed_mean(err, share))
    mean = norm.mean(axis=1)
    robust = np.maximum((variance - (1 / sf).mean() * mean) / mean**2, COOK_MIN_DISP)
    spread = mu + robust[:, None] * mu * mu
    return np.where(usable, (y - mu) ** 2 / spread * hat / (1 - hat) ** 2 / 2, -np.inf)


def cook_flags(y, sf, arm, mu, hat, limit: float, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest Cook's distance over samples in arms with enough replicates (but those to ``skip``), and the outlier flag.

    A feature is not flagged when three or more samples have a larger count than the suspect one.
    """
    cook = cook_distances(y, sf, arm, mu, hat)
    if skip is not None:
        cook[:, skip] = -np.inf
    worst = cook.argmax(axis=1)
    top = cook[np.arange(len(y)), worst]
    suspect = y[np.arange(len(y)), worst]
    known = np.isfinite(top)
    return np.where(known, top, np.nan), known & (top > limit) & ((y > suspect[:, None]).sum(axis=1) < 3)


def many_replicates(arm: np.ndarray) -> np.ndarray:
    """Samples whose arm is large enough for outliers to be replaced."""
    return np.isin(arm, [a for a in (0, 1) if (arm == a).sum() >= MANY_REPLICATES])


def without_outliers(y, sf, arm, cook: np.ndarray, limit: float) -> np.ndarray:
    """Counts in large arms whose distance exceeds the limit, replaced by the feature's trimmed mean at the sample's depth."""
    norm = y / sf
    middle = np.floor(_trimmed_mean(norm, REPLACE_TRIM)[:, None] * sf)
    return np.where((cook > limit) & many_replicates(arm), middle, y)


def local_curve(x: np.ndarray, moments: np.ndarray, pulls: np.ndarray, counts: np.ndarray, knots: np.ndarray, share: float = 0.7) -> np.ndarray:
    """Locally quadratic regression at ``knots`` from binned sums, weighted by a tricube of the distance.

    A bin stands at ``x`` with ``counts`` points; ``moments[:, j]`` is the sum of w (x_i - x)^j for j up to 4, ``pulls[:, j]`` of w y_i (x_i - x)^j for j up to 2.
    The window of a knot reaches the nearest ``share`` of all points.
    """
    out = np.empty(len(knots))
    for k, t in enumerate(knots):
        gap = np.abs(x - t)
        near = np.argsort(gap, kind="stable")
        reach = gap[near[min(np.searchsorted(np.cumsum(counts[near]), share * counts.sum()), len(x) - 1)]]
        kernel = np.clip(1 - (gap / max(reach * 1.0001, 1e-12)) ** 3, 0, None) ** 3
        shift = x - t  # powers about the knot from powers about the bin
        m = [sum(math.comb(j, i) * shift ** (j - i) * moments[:, i] for i in range(j + 1)) @ kernel for j in range(5)]
        p = [sum(math.comb(j, i) * shift ** (j - i) * pulls[:, i] for i in range(j + 1)) @ kernel for j in range(3)]
        for degree in (2, 1, 0):  # fewer terms where the points do not tell them apart
            a = np.array([[m[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            unit = np.sqrt(np.maximum(np.diag(a), 1e-300))
            if degree == 0 or np.linalg.cond(a / np.outer(unit, unit)) < 1e10:
                out[k] = np.linalg.solve(a / np.outer(unit, unit), np.array(p[:degree + 1]) / unit)[0] / unit[0]
                break
    return out


def smooth(x: np.ndarray, y: np.ndarray, share: float = 0.2, rounds: int = 3) -> np.ndarray:
    """Robust locally weighted straight-line smoother (Cleveland 1979)."""
    n = len(x)
    k = max(2, min(n, int(share * n + 1e-7)))
    weight = np.ones(n)
    fit = np.zeros(n)
    for it in range(rounds + 1):
        for i in range(n):
            gap = np.abs(x - x[i])
            h = np.sort(gap)[k - 1]
            near = np.where(gap <= 0.999 * h, np.where(gap > 0.001 * h, (1 - (gap / h) ** 3) ** 3, 1.0), 0.0) * weight
            total = near.sum()
            if total <= 0:
                fit[i] = y[i]
                continue
            near = near / total
            mid = (near * x).sum()
            spread = (near * (x - mid) ** 2).sum()
            fit[i] = (near * y).sum()
            if math.sqrt(spread) > 0.001 * (x[-1] - x[0]):
                fit[i] += (x[i] - mid) * (near * (x - mid) * y).sum() / spread
        rest = np.abs(y - fit)
        scale = 6 * np.median(rest)
        if it == rounds or scale < 1e-7 * rest.mean() or scale <= 1e-12 * np.abs(y).max():
            break
        ratio = rest / scale
        weight = np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, (1 - ratio**2) ** 2, 0.0))
    return fit
