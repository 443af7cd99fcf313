"""The numeric kernels against brute force and invariants."""

import warnings

import numpy as np
import pytest

from alphaloom.functions.vectors import Timer, div_round_up, isiterable
from alphaloom.plans import estimators as E
from alphaloom.plans import kernels as K


def picture(h=12, w=15, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    soft = np.clip((x - w * 0.35) / (w * 0.3), 0, 1)
    fg, bg = np.array([0.9, 0.2, 0.1]), np.array([0.1, 0.3, 0.8])
    image = soft[..., None] * fg + (1 - soft)[..., None] * bg + rng.normal(0, 0.01, (h, w, 3))
    trimap = np.where(x < w * 0.25, 0.0, np.where(x > w * 0.75, 1.0, 0.5))
    return np.clip(image, 0, 1), trimap, soft


def spd(n, rng):
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.2)
    return a + a.T + n * np.eye(n)


def sparse(a):
    i, j = np.nonzero(a)
    return K.Sparse(i, j, a[i, j], a.shape)


@pytest.mark.parametrize("mode", ["valid", "same", "full"])
@pytest.mark.parametrize("radius", [1, 2, 4])
def test_boxfilter(mode, radius):
    rng = np.random.default_rng(1)
    for m in range(2 * radius + 1, 2 * radius + 6):
        for n in (2 * radius + 1, 2 * radius + 4):
            src = rng.random((m, n))
            pad = {"valid": 0, "same": radius, "full": 2 * radius}[mode]
            p = np.pad(src, pad)
            win = np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1,) * 2)
            assert np.abs(K.boxfilter(src, radius, mode) - win.sum(axis=(2, 3))).max() < 1e-10
    with pytest.raises(ValueError):
        K.boxfilter(np.zeros((2 * radius, 9)), radius)


@pytest.mark.parametrize("n", [1, 5, 10])
@pytest.mark.parametrize("start", [False, True])
@pytest.mark.parametrize("again", [False, True])
def test_cg(n, start, again):
    rng = np.random.default_rng(0)
    a = rng.random((n, n))
    a = a + a.T + n * np.eye(n)
    b, x0 = rng.random(n), rng.random(n) if start else None
    for m in (None, np.diag(1 / np.diag(a)), lambda r: r / np.diag(a)):
        count = K.CounterCallback()
        x = K.cg(a, b, x0=x0, M=m, rtol=0, atol=1e-12, callback=count, reorthogonalize=again)
        assert np.linalg.norm(a @ x - b) < 1e-10
        assert 0 < count.n < 20


def test_cg_gives_up():
    with pytest.raises(ValueError):
        K.cg(np.eye(3) * [1, 2, 3], np.ones(3), rtol=0, atol=0, maxiter=2)


def test_ichol_without_dropping_is_exact():
    for seed in range(5):
        a = spd(50, np.random.default_rng(seed))
        b = np.random.default_rng(seed).random(50)
        f = K.ichol(sparse(a), discard_threshold=0.0)
        assert np.linalg.norm(a @ f(b) - b) < 1e-10
        assert np.abs(f.L.dense() @ f.L.dense().T - a).max() < 1e-10


def test_ichol_shifts_and_limits():
    a = sparse(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.isfinite(K.ichol(a)(np.ones(2))).all()
    with pytest.raises(ValueError):
        K.ichol(a, shifts=[0.0])
    with pytest.raises(ValueError):
        K.ichol(sparse(spd(20, np.random.default_rng(0))), max_nnz=5)
    with pytest.raises(ValueError):
        K.ichol(np.eye(3))


def test_sparse_algebra():
    rng = np.random.default_rng(3)
    a, b = rng.random((6, 8)) * (rng.random((6, 8)) < 0.4), rng.random((8, 5)) * (rng.random((8, 5)) < 0.4)
    A, B = sparse(a), sparse(b)
    assert np.allclose(A.matmul(B).dense(), a @ b)
    assert np.allclose(A.T.dense(), a.T)
    rows, cols = rng.random(6) < 0.5, rng.random(8) < 0.5
    assert np.allclose(A.block(rows, cols).dense(), a[rows][:, cols])
    assert np.allclose((A + A.scaled(2)).dense(), 3 * a)
    assert np.allclose(A.dot(np.arange(8)), a @ np.arange(8))


def test_laplacian_rows_sum_to_zero():
    image, _, _ = picture()
    for name, f in E.LAPLACIANS.items():
        assert np.abs(f(image).row_sum()).max() < 1e-6, name


def test_matrix_free_equals_closed_form():
    image, trimap, _ = picture()
    for r in (1, 2):
        L = K.cf_laplacian(image, radius=r)
        product, diag = K.lkm_operator(image, radius=r)
        p = np.random.default_rng(0).random(L.shape[0])
        assert np.abs(product(p) - L.dot(p)).max() < 1e-7
        assert np.abs(diag - L.diag()).max() < 1e-7


def test_vcycle_and_the_others_as_preconditioners():
    image, trimap, _ = picture(16, 16)
    A, b = E.make_linear_system(K.cf_laplacian(image), trimap)
    want = np.linalg.solve(A.dense(), b)
    counts = {}
    for name, m in (("none", None), ("jacobi", K.jacobi(A)), ("ichol", K.ichol(A)), ("vcycle", K.vcycle(A, (16, 16)))):
        count = K.CounterCallback()
        x = K.cg(A, b, M=m, callback=count, rtol=1e-9)
        counts[name] = count.n
        assert np.abs(x - want).max() < 1e-5
    assert counts["ichol"] < counts["jacobi"] <= counts["none"]


@pytest.mark.parametrize("name", sorted(E.ALPHA))
def test_alpha_is_near_the_truth(name):
    image, trimap, truth = picture()
    options = {"laplacian_kwargs": {"radius": 1}} if name == "lkm" else {"laplacian_kwargs": {"n_neighbors": [8, 4]}} if name == "knn" else {}
    alpha = E.ALPHA[name](image, trimap, **options)
    assert alpha.shape == trimap.shape and alpha.min() >= 0 and alpha.max() <= 1
    assert np.abs(alpha - truth).mean() < (0.2 if name in ("rw", "knn") else 0.06)


def test_knn_is_exact():
    rng = np.random.default_rng(0)
    x, q = rng.random((300, 5)), rng.random((70, 5))
    d, i = K.knn(x, q, 7)
    full = np.sqrt(((q[:, None] - x) ** 2).sum(axis=2))
    assert (i == np.argsort(full, axis=1, kind="stable")[:, :7]).all()
    assert np.allclose(d, np.sort(full, axis=1)[:, :7])
    with pytest.raises(ValueError):
        K.knn(x[:3], q, 7)


def test_foreground_composes_the_image_again():
    image, _, alpha = picture()
    for name, f in E.FOREGROUND.items():
        fg, bg = f(image, alpha, return_background=True)
        again = alpha[..., None] * fg + (1 - alpha)[..., None] * bg
        assert np.abs(again - image).mean() < 0.05, name


def test_gauss_seidel_by_diagonals_equals_raster_order():
    image, _, alpha = picture(7, 9)
    fast = E.estimate_foreground_ml(image, alpha, n_small_iterations=3)
    h0, w0, _ = image.shape
    F = image[alpha > 0.9].sum(axis=0).reshape(1, 1, 3) / ((alpha > 0.9).sum() + 1e-5)
    B = image[alpha < 0.1].sum(axis=0).reshape(1, 1, 3) / ((alpha < 0.1).sum() + 1e-5)
    for h, w in E.pyramid(h0, w0):
        c, a = E.resize_nearest(image, h, w), E.resize_nearest(alpha, h, w)
        F, B = E.resize_nearest(F, h, w).copy(), E.resize_nearest(B, h, w).copy()
        for _ in range(3):
            for y in range(h):
                for x in range(w):
                    m = np.array([[a[y, x] ** 2, a[y, x] * (1 - a[y, x])], [a[y, x] * (1 - a[y, x]), (1 - a[y, x]) ** 2]])
                    rhs = np.stack([a[y, x] * c[y, x], (1 - a[y, x]) * c[y, x]])
                    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                        q = min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)
                        d = 1e-5 + abs(a[y, x] - a[q])
                        m = m + d * np.eye(2)
                        rhs = rhs + d * np.stack([F[q], B[q]])
                    F[y, x], B[y, x] = np.clip(np.linalg.solve(m, rhs), 0, 1)
    assert np.abs(fast - F).max() < 1e-9
    with pytest.raises(ValueError):
        E.pyramid(1, 1)


def test_trimap_errors_and_warnings():
    with pytest.raises(ValueError):
        E.trimap_split(np.ones((3, 3)))
    with pytest.raises(ValueError):
        E.trimap_split(np.zeros((3, 3)))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        E.trimap_split(np.array([-1.0, 2.0]))
        E.sanity_check_image(np.full((2, 2), 7))
    assert len(said) == 4


def test_helpers():
    assert div_round_up(7, 3) == 3 and div_round_up(6, 3) == 2
    assert isiterable([]) and not isiterable(3)
    assert Timer().stop() >= 0


def test_cg_counts_updates():
    count = K.CounterCallback()
    assert np.allclose(K.cg(np.eye(4), np.ones(4), maxiter=1, callback=count), 1) and count.n == 1
    assert np.allclose(K.cg(np.eye(4), np.ones(4), x0=np.ones(4), atol=1e-9, callback=count), 1) and count.n == 1  # there before the first step
    seen = []
    K.cg(np.diag([1.0, 2.0, 3.0]), np.ones(3), callback=lambda A, x, b, nb, r, nr: seen.append(nr))
    assert len(seen) == 3 and seen[-1] < 1e-7 * np.sqrt(3)


@pytest.mark.parametrize("options", [{}, {"diag_keep_discarded": False}, {"discard_threshold": 1e-2}, {"relative_discard_threshold": 1e-2}])
def test_banded_factor_equals_the_general_one(monkeypatch, options):
    image, trimap, _ = picture(9, 11)
    A, _ = E.make_linear_system(K.cf_laplacian(image), trimap)
    banded = K.ichol(A, **options).L.dense()
    monkeypatch.setattr(K, "RING", 0)
    assert np.allclose(banded, K.ichol(A, **options).L.dense(), atol=1e-12)


def test_relative_threshold_goes_by_unshifted_columns():
    a = np.array([[1.0, 0.5, 0.2], [0.5, 0.1, 0.3], [0.2, 0.3, 1.0]])
    got = K.ichol(sparse(a), discard_threshold=0, shifts=[0.0, 1.0], relative_discard_threshold=0.15).L.dense()
    assert got[2, 0] == 0 and got[1, 0] != 0  # 0.2 of 1.7; with the shift's 2.7 the 0.5 would still stay, the 0.2 would not either way


@pytest.mark.parametrize("leaf", [1, 8, 40])
def test_tree_with_ties_and_copies(leaf):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (400, 3)).astype(float)
    full = ((x[:, None] - x) ** 2).sum(axis=2)
    d, i = K.KDTree(x, leaf).query(x, 9)
    assert (i == np.argsort(full, axis=1, kind="stable")[:, :9]).all() and np.allclose(d**2, np.sort(full, axis=1)[:, :9])
    tree = K.KDTree(x, leaf)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(400)) and max(map(len, tree.leaves)) <= 2 * leaf
    assert all((tree.low[k] <= x[own]).all() and (x[own] <= tree.high[k]).all() for k, own in enumerate(tree.leaves))


def test_vcycle_by_name():
    image, trimap, _ = picture(20, 18)
    for name in ("cf", "lbdm"):
        want = E.ALPHA[name](image, trimap, cg_kwargs={"rtol": 1e-10})
        assert np.abs(E.ALPHA[name](image, trimap, preconditioner="vcycle", cg_kwargs={"rtol": 1e-10}) - want).max() < 1e-5


def test_preconditioners_save_iterations():
    """The published bounds are of an image that is not at hand; the order of the methods is the same."""
    image, trimap, _ = picture(48, 48)
    A, b = E.make_linear_system(K.cf_laplacian(image), trimap)
    counts = []
    for m in (None, K.jacobi(A), K.vcycle(A, (48, 48)), K.ichol(A)):
        count = K.CounterCallback()
        x = K.cg(A, b, M=m, atol=1e-6, rtol=0, callback=count)
        assert np.linalg.norm(A.dot(x) - b) <= 1e-6
        counts.append(count.n)
    assert counts == sorted(counts, reverse=True) and counts[-1] <= 4, counts
