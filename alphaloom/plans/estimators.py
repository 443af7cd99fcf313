"""Alpha and foreground estimation of one image as NumPy, for a grouped Python stage."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np

from alphaloom.plans.kernels import (
    Sparse,
    boxfilter,
    cf_laplacian,
    cg,
    held,
    ichol,
    jacobi,
    knn_laplacian,
    lbdm_laplacian,
    lkm_operator,
    rw_laplacian,
    uniform_laplacian,
    vcycle,
)

LAPLACIANS: dict[str, Callable[..., Sparse]] = {"cf": cf_laplacian, "knn": knn_laplacian, "lbdm": lbdm_laplacian, "rw": rw_laplacian, "uniform": uniform_laplacian}
LAPLACIAN_OPERATORS: dict[str, Callable] = {"lkm": lkm_operator}
PRECONDITIONERS: dict[str, Callable] = {"jacobi": jacobi, "ichol": ichol, "none": lambda A: None}  # noqa: N803


def trimap_split(trimap: np.ndarray, bg_threshold=0.1, fg_threshold=0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat masks: foreground, background, known, unknown; both thresholds belong to the known side. Absent pixels (NaN) are neither."""
    t = np.asarray(trimap).ravel()
    if np.nanmin(t) < 0 or np.nanmax(t) > 1:
        warnings.warn(f"trimap values should be in [0, 1] but reach from {t.min()} to {t.max()}", stacklevel=2)
    fg, bg = t >= fg_threshold, t <= bg_threshold
    if not bg.any():
        raise ValueError("the trimap has no background")
    if not fg.any():
        raise ValueError("the trimap has no foreground")
    known = fg | bg
    return fg, bg, known, ~known & ~np.isnan(t)


def sanity_check_image(image: np.ndarray) -> None:
    if image.ndim != 3 or image.shape[2] != 3:
        warnings.warn(f"expected an RGB image but its shape is {image.shape}", stacklevel=2)
    if np.nanmin(image) < 0 or np.nanmax(image) > 1:
        warnings.warn(f"image values should be in [0, 1] but reach from {image.min()} to {image.max()}", stacklevel=2)
    if image.dtype not in (np.float32, np.float64):
        warnings.warn(f"expected a floating-point image, not {image.dtype}", stacklevel=2)


def make_linear_system(L: Sparse, trimap: np.ndarray, lambda_value=100.0) -> tuple[Sparse, np.ndarray]:  # noqa: N803
    fg, _, known, _ = trimap_split(trimap)
    return L + Sparse.diagonal(lambda_value * known), lambda_value * fg.astype(np.float64)


def within(image: np.ndarray, diag: np.ndarray) -> np.ndarray:
    """Which pixels have an equation: those that are there, but for any that no window holds."""
    return held(image) & (diag != 0)


def _factory(preconditioner, default: str, shape: tuple[int, int], inside: np.ndarray | None = None) -> Callable:
    """A function of the matrix. inside: the pixels of the image that the matrix is about; the V-cycle, which works on whole images, sees the others as decoupled."""
    chosen = default if preconditioner is None else preconditioner
    if chosen != "vcycle":
        return PRECONDITIONERS[chosen] if isinstance(chosen, str) else chosen
    if inside is None:
        return lambda A: vcycle(A, shape)  # noqa: N803

    def whole(A: Sparse) -> Callable:  # noqa: N803
        at, n = np.flatnonzero(inside), len(inside)
        rest = np.flatnonzero(~inside)
        cycle = vcycle(Sparse(np.concatenate((at[A.i], rest)), np.concatenate((at[A.j], rest)), np.concatenate((A.v, np.full(len(rest), A.diag().mean()))), (n, n)), shape)

        def apply(r: np.ndarray) -> np.ndarray:
            full = np.zeros(n)
            full[at] = r
            return cycle(full)[at]

        return apply

    return whole


def estimate_alpha_cf(image, trimap, preconditioner=None, laplacian_kwargs=None, cg_kwargs=None) -> np.ndarray:
    """Closed form: known pixels are eliminated, and keep the trimap's own values."""
    sanity_check_image(image)
    fg, _, known, unknown = trimap_split(trimap)
    L = cf_laplacian(image, is_known=known, **(laplacian_kwargs or {}))  # noqa: N806
    alpha = np.array(trimap, np.float64).ravel()
    lone = unknown & (L.diag() == 0)  # no window holds them, so nothing binds them
    alpha[lone], unknown = 1.0, unknown & ~lone
    inner = L.block(unknown, unknown)
    if unknown.any():
        b = -L.block(unknown, known).dot(fg[known].astype(np.float64))
        alpha[unknown] = cg(inner, b, M=_factory(preconditioner, "ichol", trimap.shape, unknown)(inner), **(cg_kwargs or {}))
    return np.clip(alpha, 0, 1).reshape(trimap.shape)


def _soft(name: str, default: str) -> Callable[..., np.ndarray]:
    def estimate(image, trimap, preconditioner=None, laplacian_kwargs=None, cg_kwargs=None) -> np.ndarray:
        sanity_check_image(image)
        A, b = make_linear_system(LAPLACIANS[name](image, **(laplacian_kwargs or {})), trimap)  # noqa: N806
        inside = within(image, A.diag())
        if not inside.all():
            A, b = A.block(inside, inside), b[inside]  # noqa: N806
        x = np.full(trimap.size, np.nan)
        x[inside] = cg(A, b, M=_factory(preconditioner, default, trimap.shape, None if inside.all() else inside)(A), **(cg_kwargs or {}))
        return np.clip(x, 0, 1).reshape(trimap.shape)

    estimate.__name__ = f"estimate_alpha_{name}"
    return estimate


estimate_alpha_lbdm = _soft("lbdm", "ichol")
estimate_alpha_knn = _soft("knn", "jacobi")
estimate_alpha_rw = _soft("rw", "jacobi")


def estimate_alpha_lkm(image, trimap, laplacian_kwargs=None, cg_kwargs=None) -> np.ndarray:
    sanity_check_image(image)
    product, diag = lkm_operator(image, **(laplacian_kwargs or {}))
    fg, _, known, _ = trimap_split(trimap)
    c = 100.0 * known
    inside = within(image, diag + c)
    inverse = inside / np.where(inside, diag + c, 1.0)
    x = cg(lambda p: np.where(inside, product(p) + c * p, 0.0), 100.0 * fg, M=lambda r: r * inverse, **(cg_kwargs or {}))
    return np.where(inside, np.clip(x, 0, 1), np.nan).reshape(trimap.shape)


# --- shared matting --------------------------------------------------------------------------------------------------------------------------------------------


def compositing_alpha(colour: np.ndarray, F: np.ndarray, B: np.ndarray) -> np.ndarray:  # noqa: N803
    d = F - B
    return np.clip(((colour - B) * d).sum(axis=-1) / ((d * d).sum(axis=-1) + 1e-5), 0, 1)


def compositing_error(colour: np.ndarray, F: np.ndarray, B: np.ndarray) -> np.ndarray:  # noqa: N803
    a = compositing_alpha(colour, F, B)[..., None]
    d = a * F + (1 - a) * B - colour
    return (d * d).sum(axis=-1)


def _offsets(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def _shifted(a: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """a at (y + dy, x + dx), and where that is inside."""
    h, w = a.shape[:2]
    y, x = np.arange(h) + dy, np.arange(w) + dx
    inside = ((y >= 0) & (y < h))[:, None] & ((x >= 0) & (x < w))[None]
    return a[np.clip(y, 0, h - 1)][:, np.clip(x, 0, w - 1)], inside


def expand_trimap(trimap: np.ndarray, image: np.ndarray, radius: int, threshold: float) -> np.ndarray:
    """Unknown pixels take the value of the nearest known one within radius whose colour is within threshold; ties: the first by row and column."""
    known = (trimap == 0) | (trimap == 1)
    out, closest = trimap.copy(), np.full(trimap.shape, np.inf)
    for dy, dx in _offsets(radius):
        far = np.hypot(dy, dx)
        if far > radius:
            continue
        value, inside = _shifted(trimap, dy, dx)
        colour, _ = _shifted(image, dy, dx)
        ok = inside & ((value == 0) | (value == 1)) & (np.sqrt(((image - colour) ** 2).sum(axis=2)) <= threshold) & ~known & (far < closest)
        out[ok], closest[ok] = value[ok], far
    return out


def gradient_energy(image: np.ndarray, px, py, sx, sy) -> np.ndarray:
    """The colour change summed along the way from p to s in at most 10 steps. Both coordinates advance by the step of x, as published results have it."""
    h, w = image.shape[:2]
    dx, dy = (sx - px).astype(np.float64), (sy - py).astype(np.float64)
    d = np.hypot(dx, dy)
    steps = np.clip(np.ceil(d).astype(int), 1, 10)
    step_x, step_y = dx / steps, dy / steps
    total = np.zeros(len(px))
    for i in range(11):
        on = (i <= steps) & (d > 0)
        qx, qy = np.trunc(px + i * step_x).astype(int), np.trunc(py + i * step_x).astype(int)
        cx, cy = (lambda v: np.clip(v, 0, w - 1)), (lambda v: np.clip(v, 0, h - 1))
        gx = 0.5 * (image[cy(qy), cx(qx + 1)] - image[cy(qy), cx(qx - 1)])
        gy = 0.5 * (image[cy(qy + 1), cx(qx)] - image[cy(qy - 1), cx(qx)])
        v = step_x[:, None] * gx + step_y[:, None] * gy
        length = np.sqrt((v * v).sum(axis=1))
        total += np.where(on & ~np.isnan(length), length, 0)  # steps beside an absent pixel have no gradient
    return total


def sample_gathering(image, trimap, F0, B0, angles=4, weights=(3, 2, 1, 4), np_radius=1):  # noqa: N803
    """(F, B, alpha): for each unknown pixel the best pair of the first foreground and background pixels on rays."""
    h, w = trimap.shape
    F, B, alpha = (np.broadcast_to(F0, image.shape).copy(), np.broadcast_to(B0, image.shape).copy(), trimap.copy())  # noqa: N806
    B[trimap == 0], F[trimap == 1] = image[trimap == 0], image[trimap == 1]
    py, px = np.nonzero((trimap != 0) & (trimap != 1) & ~np.isnan(trimap))
    n = len(py)
    if not n:
        return F, B, alpha
    number = ((px % 8) + (py % 8) * 8) * 99991 % 64
    start = 2 * np.pi / 64 * number
    sample = {1: np.full((angles, n, 2), -1), 0: np.full((angles, n, 2), -1)}  # (x, y) of the first hit
    for a in range(angles):
        c, s = np.cos(2 * np.pi / angles * a + start), np.sin(2 * np.pi / angles * a + start)
        alive = np.ones(n, bool)
        for step in range(2 * max(w, h)):
            x, y = np.trunc(px + step * c).astype(int), np.trunc(py + step * s).astype(int)
            alive &= (x >= 0) & (y >= 0) & (x < w) & (y < h)
            if not alive.any():
                break
            t = trimap[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
            for value, got in sample.items():
                hit = alive & (t == value) & (got[a, :, 0] < 0)
                got[a, hit, 0], got[a, hit, 1] = x[hit], y[hit]
    colours, used, energy = {}, {}, {}
    for value, got in sample.items():
        none = (got[:, :, 0] < 0).all(axis=0)
        got[0, none, 0], got[0, none, 1] = px[none], py[none]
        used[value] = got[:, :, 0] >= 0
        colours[value] = image[np.maximum(got[:, :, 1], 0), np.maximum(got[:, :, 0], 0)].copy()
        colours[value][0, none] = F0 if value == 1 else B0
        e = np.stack([np.where(used[value][a], gradient_energy(image, px, py, got[a, :, 0], got[a, :, 1]), np.inf) for a in range(angles)])
        energy[value] = e.min(axis=0)
    likely = energy[0] / (energy[1] + energy[0] + 1e-5)
    colour, least = image[py, px], np.full(n, np.inf)
    e_n, e_a, e_f, e_b = weights
    for i in range(angles):
        for j in range(angles):
            f, b = colours[1][i], colours[0][j]
            a = compositing_alpha(colour, f, b)
            error = np.zeros(n)
            for dy, dx in _offsets(np_radius):
                error += np.nan_to_num(compositing_error(image[np.clip(py + dy, 0, h - 1), np.clip(px + dx, 0, w - 1)], f, b))
            df, db = (np.hypot(px - s[k, :, 0], py - s[k, :, 1]) for s, k in ((sample[1], i), (sample[0], j)))
            cost = error**e_n * (likely + (1 - 2 * likely) * a) ** e_a * df**e_f * db**e_b
            better = used[1][i] & used[0][j] & (cost < least)
            least[better] = cost[better]
            alpha[py[better], px[better]] = a[better]
            F[py[better], px[better]], B[py[better], px[better]] = f[better], b[better]
    return F, B, alpha


def sample_refinement(F, B, image, trimap, radius=5):  # noqa: N803
    """(F, B, alpha): the mean of the three neighbouring pairs that explain a pixel best; three is the divisor even where there are fewer."""
    unknown = (trimap != 0) & (trimap != 1)
    h, w = trimap.shape
    costs, f, b = np.full((3, h, w), np.inf), np.zeros((3, h, w, 3)), np.zeros((3, h, w, 3))
    rows = np.arange(h)[:, None], np.arange(w)[None]
    for dy, dx in _offsets(radius):
        fq, inside = _shifted(F, dy, dx)
        bq, _ = _shifted(B, dy, dx)
        cost = compositing_error(image, fq, bq)
        worst = costs.argmax(axis=0)
        ok = inside & (cost < costs[worst, *rows])
        y, x = np.nonzero(ok)
        k = worst[ok]
        costs[k, y, x], f[k, y, x], b[k, y, x] = cost[ok], fq[ok], bq[ok]
    F2, B2, alpha = F.copy(), B.copy(), trimap.copy()  # noqa: N806
    F2[unknown], B2[unknown] = f.sum(axis=0)[unknown] / 3, b.sum(axis=0)[unknown] / 3
    alpha[unknown] = compositing_alpha(image, F2, B2)[unknown]
    return F2, B2, alpha


def local_smoothing(F, B, alpha, image, trimap, radius1=5, radius2=5, radius3=5, sigma1=None, sigma2=0.1, sigma3=None):  # noqa: N803
    """(alpha, F, B). sigma3 follows radius1 by default, as published results have it."""
    sigma1 = (2 * radius1 + 1) ** 2 / (9 * np.pi) if sigma1 is None else sigma1
    sigma3 = (2 * radius1 + 1) ** 2 / (9 * np.pi) if sigma3 is None else sigma3
    known = (trimap == 0) | (trimap == 1)
    f, b = np.zeros_like(F), np.zeros_like(B)
    sum_f, sum_b = np.zeros(trimap.shape), np.zeros(trimap.shape)
    for dy, dx in _offsets(radius1):
        aq, inside = _shifted(alpha, dy, dx)
        weight = np.exp(-(dx * dx + dy * dy) / sigma1) * (np.abs(alpha - aq) if dx or dy else 1.0)
        wf, wb = (np.where(inside, np.maximum(weight * v, 1e-5), 0) for v in (aq, 1 - aq))
        sum_f, sum_b = sum_f + wf, sum_b + wb
        f, b = f + wf[..., None] * _shifted(F, dy, dx)[0], b + wb[..., None] * _shifted(B, dy, dx)[0]
    F2, B2 = (np.where(known[..., None], old, new / s[..., None]) for old, new, s in ((F, f, sum_f), (B, b, sum_b)))  # noqa: N806
    first = compositing_alpha(image, F2, B2)
    mass = np.where(known, 0, alpha * (1 - alpha))
    apart = np.sqrt(((F2 - B2) ** 2).sum(axis=2))
    total, weights = np.zeros(trimap.shape), np.zeros(trimap.shape)
    for dy, dx in _offsets(radius2):
        m, inside = _shifted(mass, dy, dx)
        m = np.where(inside, m, 0)
        weights, total = weights + m, total + m * _shifted(apart, dy, dx)[0]
    mean = total / (weights + 1e-5) + 1e-5
    sure = np.minimum(1, apart / mean) * np.exp(-np.sqrt(compositing_error(image, F2, B2)) / sigma2)
    low, weights = np.zeros(trimap.shape), np.zeros(trimap.shape)
    for dy, dx in _offsets(radius3):
        aq, inside = _shifted(alpha, dy, dx)
        m = np.where(inside, np.exp(-(dx * dx + dy * dy) / sigma3) + _shifted(known, dy, dx)[0], 0)
        low, weights = low + m * aq, weights + m
    out = sure * first + (1 - sure) * low / weights
    return np.where(known, trimap, out), F2, B2


def estimate_alpha_sm(
    image, trimap, return_foreground_background=False, trimap_expansion_radius=10, trimap_expansion_threshold=0.02, sample_gathering_angles=4, sample_gathering_weights=(3, 2, 1, 4),
    sample_gathering_Np_radius=1, sample_refinement_radius=5, local_smoothing_radius1=5, local_smoothing_radius2=5, local_smoothing_radius3=5, local_smoothing_sigma_sq1=None,
    local_smoothing_sigma_sq2=0.1, local_smoothing_sigma_sq3=None,
):  # fmt: skip  # noqa: N803
    image, trimap = np.asarray(image, np.float32).astype(np.float64), np.asarray(trimap, np.float32).astype(np.float64)
    grown = trimap
    if trimap_expansion_radius > 0 and trimap_expansion_threshold > 0:
        grown = expand_trimap(trimap, image, trimap_expansion_radius, float(np.float32(trimap_expansion_threshold)))
    F0, B0 = image[grown == 1].mean(axis=0), image[grown == 0].mean(axis=0)  # noqa: N806
    F, B, _ = sample_gathering(image, grown, F0, B0, sample_gathering_angles, sample_gathering_weights, sample_gathering_Np_radius)  # noqa: N806
    here = held(image).reshape(trimap.shape)
    own = np.ix_(here.any(axis=1), here.any(axis=0))  # what follows leaves out what is not there, at any border
    F, B, image, grown = F[own], B[own], image[own], grown[own]  # noqa: N806
    F, B, alpha = sample_refinement(F, B, image, grown, sample_refinement_radius)  # noqa: N806
    alpha, F, B = local_smoothing(F, B, alpha, image, grown, local_smoothing_radius1, local_smoothing_radius2, local_smoothing_radius3, local_smoothing_sigma_sq1, local_smoothing_sigma_sq2, local_smoothing_sigma_sq3)  # noqa: N806
    out = [np.full((*here.shape, *a.shape[2:]), np.nan) for a in (alpha, F, B)]
    for whole, part in zip(out, (alpha, F, B), strict=True):
        whole[own] = part
    return tuple(out) if return_foreground_background else out[0]


ALPHA: dict[str, Callable[..., np.ndarray]] = {"cf": estimate_alpha_cf, "lkm": estimate_alpha_lkm, "knn": estimate_alpha_knn, "lbdm": estimate_alpha_lbdm, "rw": estimate_alpha_rw, "sm": estimate_alpha_sm}
estimate_alpha = estimate_alpha_cf


# --- foreground ------------------------------------------------------------------------------------------------------------------------------------------------


def resize_nearest(a: np.ndarray, h: int, w: int) -> np.ndarray:
    y = np.minimum(np.arange(h) * a.shape[0] // h, a.shape[0] - 1)
    x = np.minimum(np.arange(w) * a.shape[1] // w, a.shape[1] - 1)
    return a[y][:, x]


def pyramid(h: int, w: int) -> list[tuple[int, int]]:
    """Heights and widths from one pixel to the whole image."""
    n = int(np.ceil(np.log2(max(w, h))))
    if n == 0:
        raise ValueError("an image of one pixel has no pyramid")
    return [(round(h ** (i / n)), round(w ** (i / n))) for i in range(n + 1)]


def estimate_foreground_cf(image, alpha, regularization=1e-5, rtol=1e-5, neighbors=((-1, 0), (1, 0), (0, -1), (0, 1)), return_background=False, foreground_guess=None, background_guess=None, ichol_kwargs=None, cg_kwargs=None):
    h, w, d = image.shape
    if alpha.shape != (h, w):
        raise ValueError("image and alpha differ in size")
    n, a = h * w, np.asarray(alpha, np.float64).ravel()
    y, x = (v.ravel() for v in np.mgrid[:h, :w])
    i = y * w + x
    smooth = None
    for dx, dy in neighbors:
        j = np.clip(y + dy, 0, h - 1) * w + np.clip(x + dx, 0, w - 1)
        weight = regularization + np.abs(a[i] - a[j])
        one = Sparse(np.concatenate((i, i, j, j)), np.concatenate((i, j, i, j)), np.concatenate((weight, -weight, -weight, weight)), (n, n))
        smooth = one if smooth is None else smooth + one
    s, k = smooth, np.arange(n)
    rows, cols = np.concatenate((s.i, s.i + n, k, k, k + n, k + n)), np.concatenate((s.j, s.j + n, k, k + n, k, k + n))
    A = Sparse(rows, cols, np.concatenate((s.v, s.v, a * a, a * (1 - a), a * (1 - a), (1 - a) ** 2)), (2 * n, 2 * n))  # noqa: N806
    pairs = np.arange(2 * n).reshape(2, n).T.ravel()  # a pixel's two unknowns side by side: the entries lie near the diagonal, and the factor is banded
    place = np.argsort(pairs)
    factor = ichol(Sparse(place[A.i], place[A.j], A.v, A.shape), **(ichol_kwargs or {}))
    M = lambda r: factor(r[pairs])[place]  # noqa: E731, N806
    F, B = (np.array(image if g is None else g, np.float64) for g in (foreground_guess, background_guess))  # noqa: N806
    for c in range(d):
        v = np.asarray(image[:, :, c], np.float64).ravel()
        got = cg(A, np.concatenate((a * v, (1 - a) * v)), x0=np.concatenate((F[:, :, c].ravel(), B[:, :, c].ravel())), M=M, rtol=rtol, **(cg_kwargs or {}))
        F[:, :, c], B[:, :, c] = got[:n].reshape(h, w), got[n:].reshape(h, w)
    F, B = np.clip(F, 0, 1), np.clip(B, 0, 1)  # noqa: N806
    return (F, B) if return_background else F


def _solve_pairs(colour, a, F4, B4, da):  # noqa: N803
    """The two by two systems of pixels: colour (k, c), a (k), neighbours' colours (4, k, c) and weights (4, k)."""
    a1, s = 1 - a, da.sum(axis=0)
    a00, a01, a11 = a * a + s, a * a1, a1 * a1 + s
    b0 = a[:, None] * colour + (da[..., None] * F4).sum(axis=0)
    b1 = a1[:, None] * colour + (da[..., None] * B4).sum(axis=0)
    det = (a00 * a11 - a01 * a01)[:, None]
    F = (a11[:, None] * b0 - a01[:, None] * b1) / det  # noqa: N806
    B = (a00[:, None] * b1 - a01[:, None] * b0) / det  # noqa: N806
    return np.clip(F, 0, 1), np.clip(B, 0, 1)


def _around(h: int, w: int, y: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))]


def _solvable(a: np.ndarray, around: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places that are there with all four neighbours; the others keep what the coarser level gave them."""
    return ~np.isnan(a[y, x]) & ~np.isnan(np.stack([a[v] for v in around])).any(axis=0)


def estimate_foreground_ml(image, alpha, regularization=1e-5, n_small_iterations=10, n_big_iterations=2, small_size=32, return_background=False, gradient_weight=1.0):
    """Multi-level, each level by Gauss-Seidel in raster order: a pixel depends on its left and upper neighbours' new values, so anti-diagonals are done one after the other."""
    image, alpha = np.asarray(image, np.float64), np.asarray(alpha, np.float64)
    h0, w0, d = image.shape
    mean = lambda m: image[m].sum(axis=0) / (m.sum() + 1e-5)
    F, B = mean(alpha > 0.9).reshape(1, 1, d), mean(alpha < 0.1).reshape(1, 1, d)  # noqa: N806
    for h, w in pyramid(h0, w0):
        colour, a = resize_nearest(image, h, w), resize_nearest(alpha, h, w)
        F, B = resize_nearest(F, h, w).copy(), resize_nearest(B, h, w).copy()  # noqa: N806
        yy, xx = np.mgrid[:h, :w]
        order = np.argsort((yy + xx).ravel(), kind="stable")
        gaps = np.isnan(a).any()
        cuts = np.searchsorted((yy + xx).ravel()[order], np.arange(h + w))
        for _ in range(n_small_iterations if w <= small_size and h <= small_size else n_big_iterations):
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                y, x = order[p:q] // w, order[p:q] % w
                if gaps:
                    ok = _solvable(a, _around(h, w, y, x), y, x)
                    y, x = y[ok], x[ok]
                around = _around(h, w, y, x)
                da = np.stack([regularization + gradient_weight * np.abs(a[y, x] - a[v]) for v in around])
                F[y, x], B[y, x] = _solve_pairs(colour[y, x], a[y, x], np.stack([F[v] for v in around]), np.stack([B[v] for v in around]), da)
    return (F, B) if return_background else F


def estimate_foreground_ml_jacobi(image, alpha, regularization=1e-5, n_small_iterations=10, n_big_iterations=2, small_size=32, return_background=False):
    """Multi-level by Jacobi iterations, from the first pixel's colour. A level hands on the iterate before its last, as the double-buffered variants do."""
    image, alpha = np.asarray(image, np.float64), np.asarray(alpha, np.float64)
    h0, w0, _ = image.shape
    F = B = image[:1, :1]  # noqa: N806
    for h, w in pyramid(h0, w0):
        colour, a = resize_nearest(image, h, w), resize_nearest(alpha, h, w)
        F, B = resize_nearest(F, h, w), resize_nearest(B, h, w)  # noqa: N806
        y, x = (v.ravel() for v in np.mgrid[:h, :w])
        around = _around(h, w, y, x)
        da = np.stack([regularization + np.abs(a[y, x] - a[v]) for v in around])
        ok = _solvable(a, around, y, x).reshape(h, w, 1)
        for _ in range((n_small_iterations if min(w, h) <= small_size else n_big_iterations) - 1):
            f, b = _solve_pairs(colour[y, x], a[y, x], np.stack([F[v] for v in around]), np.stack([B[v] for v in around]), da)
            F, B = np.where(ok, f.reshape(h, w, -1), F), np.where(ok, b.reshape(h, w, -1), B)  # noqa: N806
    return (F, B) if return_background else F


FOREGROUND: dict[str, Callable[..., np.ndarray]] = {"ml": estimate_foreground_ml, "cf": estimate_foreground_cf, "jacobi": estimate_foreground_ml_jacobi}
estimate_foreground = estimate_foreground_ml

__all__ = ["ALPHA", "FOREGROUND", "LAPLACIANS", "LAPLACIAN_OPERATORS", "PRECONDITIONERS", "boxfilter", "vcycle", "estimate_alpha", "estimate_foreground"]
