"""A fit of one cloud as a sequence of sums over its points.

``steps`` is a generator: it yields a request, gets the request's sums over all points of the cloud and goes on. Sums of parts of a
cloud add up, so the same steps run in one task on a small cloud (``run_whole``) and over the parts of a large one, whose sums Spark
adds; there the told answers are kept, and ``replay`` repeats the cheap steps between them.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence

import numpy as np

# Fixed values of the fitting procedure.
MINIMUM_POINTS = {"plane": 3, "sphere": 4, "cylinder": 6, "quadric": 6, "quartic": 15}
CANDIDATES = 120
#: Shift and width of the digits of a residual's bits, from the top; the sign is always 0.
DIGITS = ((51, 12), (39, 12), (27, 12), (15, 12), (3, 12), (0, 3))
#: The same for a single model, whose counters are few.
LONG_DIGITS = ((47, 16), (31, 16), (15, 16), (0, 15))
DEGENERATE_EIGENVALUE = 1e-12
TRIM_ROUNDS = 3
TRIM_FACTOR = 3.0
TRIM_FLOOR = 1e-8
REFINE_STEPS = 25
REFINE_DAMPING = 1e-8
REFINE_STOP = 1e-9
RANK_TOLERANCE = 1e-13
#: Squared distance from the origin of sums to the centroid, in spreads, above which the sums are taken again about the centroid.
FAR_ORIGIN = 1e4
#: Numbers that the residuals of several candidates fill at a time, and points whose terms are formed at a time.
BLOCK_NUMBERS = 1 << 18
BLOCK_POINTS = 1 << 13
#: Places of a symmetric matrix that are summed.
TRIANGLES = {n: np.triu_indices(n) for n in (3, 4, 5, 6, 15)}
STATS = ("me", "rmse", "max_abs", "axis_min", "axis_max", "n")


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Solution of a symmetric system; None where the matrix is rank deficient."""
    size = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    scaled = matrix / np.outer(size, size)
    if not np.isfinite(scaled).all() or np.linalg.eigvalsh(scaled)[0] < RANK_TOLERANCE:
        return None
    return np.linalg.solve(scaled, right / size) / size


def orient(v: np.ndarray) -> np.ndarray:
    """Directions, flipped so that their largest component is not negative."""
    largest = np.take_along_axis(v, np.abs(v).argmax(axis=-1)[..., None], axis=-1)
    return np.where(largest < 0, -v, v)


def orthogonal(v: np.ndarray) -> np.ndarray:
    if abs(v[0]) > 1e-12 * abs(v[2]) or abs(v[1]) > 1e-12 * abs(v[2]):
        return np.array([-v[1], v[0], 0.0]) / np.sqrt(v[0] * v[0] + v[1] * v[1])
    return np.array([0.0, -v[2], v[1]]) / np.sqrt(v[1] * v[1] + v[2] * v[2])


def cross(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    """Of two single vectors; ``np.cross`` takes ten times as long for them."""
    (ax, ay, az), (bx, by, bz) = map(float, a), map(float, b)
    return np.array([ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx])


def frame(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    axis = [0.0, 0.0, 0.0]
    axis[int(np.argmin(np.abs(d)))] = 1.0
    u = cross(d, axis)
    u /= np.sqrt(u @ u)
    return u, cross(d, u)


def gauss_newton(matrix, right, s, kind: str):
    """One Gauss-Newton step from summed normal equations; ``matrix`` is NULL at the start."""
    c, d, r = np.array(s[:3]), np.array(s[3:6]), s[6]
    state = "open"
    if matrix is not None and len(matrix):
        n = len(right)
        a = np.zeros((n, n))
        a[TRIANGLES[n]] = matrix
        a = a + np.triu(a, 1).T + REFINE_DAMPING * np.eye(n)
        step = np.linalg.solve(a, np.asarray(right, float)) if np.isfinite(a).all() else np.full(n, np.nan)
        size = np.linalg.norm(step)
        if not np.isfinite(step).all() or size < REFINE_STOP or size > 2 * max(1.0, r):
            state = "done"
        elif kind == "sphere":
            c = c + step[:3]
        else:
            u, v = frame(d)
            c = c + u * step[0] + v * step[1]
            d = d + u * step[2] + v * step[3]
            d = d / np.linalg.norm(d)
        if state == "open":
            r = r + step[-1]
            if r <= 0 or not np.isfinite(c).all():
                state = "failed"
    u, v = frame(d) if kind == "cylinder" else (d, d)
    return (*(dict(zip("xyz", x)) for x in (c, d, u, v)), r, state)


# -- sums over points ----------------------------------------------------------------


def monomials(u: np.ndarray, v: np.ndarray, degree: int) -> np.ndarray:
    """As ``models.surface_terms``: by total degree, then by rising power of ``u``."""
    pu, pv = [np.ones_like(u)], [np.ones_like(v)]
    for _ in range(degree):
        pu.append(pu[-1] * u)
        pv.append(pv[-1] * v)
    return np.stack([pu[i] * pv[total - i] for total in range(degree + 1) for i in range(total + 1)]).T


def height(u: np.ndarray, v: np.ndarray, coefficients: np.ndarray, degree: int) -> np.ndarray:
    """The polynomial of ``monomials``, by nested products."""
    places = [(i, total - i) for total in range(degree + 1) for i in range(total + 1)]
    at, out = dict(zip(places, coefficients)), np.zeros_like(u)
    for j in range(degree, -1, -1):
        row = np.full_like(u, at[degree - j, j])
        for i in range(degree - j - 1, -1, -1):
            row *= u
            row += at[i, j]
        out *= v
        out += row
    return out


def residuals(pts: np.ndarray, m: dict) -> np.ndarray:
    """Signed distances to a model, as ``models.residual``."""
    delta, kind = pts - m["center"], m["kind"]
    if kind == "sphere":
        return np.sqrt(np.einsum("ni,ni->n", delta, delta)) - m["rho"]
    along = delta @ m["direction"]
    if kind == "plane":
        return along
    if kind == "cylinder":
        radial = delta - along[:, None] * m["direction"]
        return np.sqrt(np.einsum("ni,ni->n", radial, radial)) - m["rho"]
    u, v = delta @ m["basis_u"] / m["surface_scale"], delta @ m["basis_v"] / m["surface_scale"]
    return along - height(u, v, m["coefficients"], 2 if kind == "quadric" else 4)


def candidate_residuals(pts: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Absolute residuals, a row per shape (centre, normal, radius; a radius below zero marks a plane)."""
    delta = pts[None] - shapes[:, None, :3]
    flat = shapes[:, 6] < 0
    if flat.all():
        return np.abs(np.einsum("knj,kj->kn", delta, shapes[:, 3:6]))
    return np.abs(np.sqrt(np.einsum("knj,knj->kn", delta, delta)) - shapes[:, 6:])


def _equations(terms: np.ndarray, value: np.ndarray) -> np.ndarray:
    matrix = terms.T @ terms
    return np.concatenate([matrix[TRIANGLES[len(matrix)]], terms.T @ value])


def _system(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((n, n))
    a[TRIANGLES[n]] = sums[:-n]
    return a + np.triu(a, 1).T, sums[-n:]


def _sum_block(ask: tuple, pts: np.ndarray) -> np.ndarray:
    what, select = ask[0], ask[1]
    if select is not None:
        pts = pts[np.abs(residuals(pts, select[0])) <= select[1]]
    if what == "moments":
        d = pts - ask[2]
        products = d.T @ d
        return np.concatenate([[len(d)], d.sum(axis=0), products[TRIANGLES[3]]])
    if what == "ball":
        d = pts - ask[2]
        return _equations(np.column_stack([2 * d, np.ones(len(d))]), (d * d).sum(axis=1))
    if what == "circles":
        d, out = pts - ask[2], []
        for u, v in ask[3]:
            p, q = d @ u, d @ v
            out.append(_equations(np.column_stack([2 * p, 2 * q, np.ones(len(d))]), p * p + q * q))
        return np.concatenate(out)
    if what == "gaps":
        d = pts - ask[2]
        gaps = [np.sqrt((d @ u - p0) ** 2 + (d @ v - q0) ** 2) - r for u, v, p0, q0, r in ask[3]]
        return np.array([(g * g).sum() for g in gaps])
    if what == "surface":
        m = ask[2]
        d = pts - m["center"]
        terms = monomials(d @ m["basis_u"] / m["surface_scale"], d @ m["basis_v"] / m["surface_scale"], ask[3])
        return _equations(terms, d @ m["direction"])
    if what == "gauss":
        _, _, c, d, r, kind = ask
        delta = pts - c
        t = delta @ d if kind == "cylinder" else np.zeros(len(pts))
        radial = delta - t[:, None] * d if kind == "cylinder" else delta
        size = np.sqrt(np.einsum("ni,ni->n", radial, radial))
        held = size >= 1e-12
        normal, t, size = radial[held] / size[held, None], t[held], size[held]
        if kind == "sphere":
            terms = np.column_stack([-normal, -np.ones(len(size))])
        else:
            nu, nv = (normal @ x for x in frame(d))
            terms = np.column_stack([-nu, -nv, -t * nu, -t * nv, -np.ones(len(size))])
        return np.concatenate([[held.sum()], _equations(terms, r - size)])
    if what == "digits":
        _, _, shapes, leads, shift, width = ask[:6]
        out = np.zeros((len(shapes), 1 << width))
        for n, s in enumerate(shapes):
            e = np.abs(residuals(pts, s)) if isinstance(s, dict) else candidate_residuals(pts, s[None])[0]
            bits = np.ascontiguousarray(e).view(np.int64)
            if leads is not None:
                bits = bits[bits >> shift + width == leads[n]]
            out[n] = np.bincount(bits >> shift & (1 << width) - 1, minlength=1 << width)
        return out.ravel()
    raise ValueError(what)


def measure(ask: tuple, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and largest values over points; those of parts are added and compared."""
    if ask[0] == "stats":
        m = ask[2]
        e, t = residuals(pts, m), (pts - m["center"]) @ m["direction"]
        return np.array([len(e), e.sum(), (e * e).sum()]), np.array([np.abs(e).max(), -t.min(), t.max()])
    blocks = range(0, max(len(pts), 1), BLOCK_POINTS)
    return sum(_sum_block(ask, pts[i:i + BLOCK_POINTS]) for i in blocks), np.zeros(0)


def close(ask: tuple, sums: np.ndarray) -> np.ndarray:
    """What is kept of the sums: of digit counts, each shape's digit and rank inside it."""
    if ask[0] != "digits":
        return sums
    ranks, counts = np.asarray(ask[6]), sums.reshape(len(ask[2]), -1)
    upto = counts.cumsum(axis=1)
    digit = (upto <= ranks[:, None]).sum(axis=1)
    return np.stack([digit, ranks - (upto - counts)[np.arange(len(ranks)), digit]])




# -- steps -----------------------------------------------------------------------------

Steps = Generator[tuple, np.ndarray, object]


def _median(shapes: Sequence, n: int, whole: bool, digits: Sequence = DIGITS) -> Steps:
    """``(index, value)`` of the smallest upper median of absolute residuals, the earlier one in a tie.

    Medians of parts are found digit by digit; after each digit only shapes stay open whose median has the smallest one so far."""
    if whole:
        values = yield ("medians", None, shapes)
        return int(np.argmin(values)), float(np.min(values))
    left, leads, ranks = np.arange(len(shapes)), None, np.full(len(shapes), n // 2)
    for shift, width in digits:
        digit, ranks = yield ("digits", None, [shapes[i] for i in left], leads, shift, width, ranks)
        digit = digit.astype(np.int64)
        leads = digit if leads is None else (leads << width) + digit
        least = leads == leads.min()
        left, leads, ranks = left[least], leads[least], ranks[least]
        if len(left) == 1 and len(shapes) > 1:
            return int(left[0]), None
    return int(left[0]), float(leads[:1].astype(np.int64).view(np.float64)[0])


def _axes(origin: np.ndarray, select: tuple | None, known: np.ndarray | None = None) -> Steps:
    """Centroid, rising eigenvalues of the covariance and oriented axes; ``known`` are the sums about ``origin``, if taken before."""
    for _ in range(2):
        s = (yield ("moments", select, origin)) if known is None else known
        known = None
        shift = s[1:4] / s[0]
        cov = np.zeros((3, 3))
        cov[TRIANGLES[3]] = s[4:] / s[0]
        cov = cov + np.triu(cov, 1).T - np.outer(shift, shift)
        origin = origin + shift
        if shift @ shift <= FAR_ORIGIN * np.trace(cov):
            break
    values, vectors = np.linalg.eigh(np.where(np.isfinite(cov), cov, 0.0))
    return origin, values, orient(vectors.T)


def least_squares(kind: str, origin: np.ndarray, select: tuple | None, known: np.ndarray | None = None) -> Steps:
    center, values, axes = yield from _axes(origin, select, known)
    m = {"kind": kind, "center": center, "failure": "degenerate" if values[1] <= DEGENERATE_EIGENVALUE else None}
    if kind == "plane":
        return m | {"direction": axes[0], "offset": -axes[0] @ center}
    if kind == "sphere":
        s = solve(*_system((yield ("ball", select, center)), 4))
        m |= {"direction": np.array([0.0, 0.0, 1.0]), "center": center + s[:3] if s is not None else None}
        squared = s[:3] @ s[:3] + s[3] if s is not None else np.nan
        m["failure"] = m["failure"] or ("rank" if s is None else None if squared > 0 else "radius")
        return m | {"radius": float(np.sqrt(squared)) if squared > 0 else None}
    if kind == "cylinder":
        return (yield from _cylinder(m, axes, select))
    m |= {"direction": axes[0], "basis_u": orthogonal(axes[0]), "surface_scale": float(np.sqrt(max(values.sum(), 0.0)))}
    m |= {"basis_v": cross(axes[0], m["basis_u"]), "offset": -axes[0] @ center}
    degree, n = (2, 6) if kind == "quadric" else (4, 15)
    if m["surface_scale"] > 0:
        m["coefficients"] = solve(*_system((yield ("surface", select, m, degree)), n))
    return m | {"failure": m["failure"] or ("rank" if m.get("coefficients") is None else None)}


def _cylinder(m: dict, axes: np.ndarray, select: tuple | None) -> Steps:
    """Each principal axis is tried as the cylinder axis with a circle fit; the candidate of least squared error wins, the
    earlier one in a tie."""
    origin, frames = m["center"], [(u, cross(d, u)) for d in axes for u in (orthogonal(d),)]
    sums, tries = (yield ("circles", select, origin, frames)), []
    for (u, v), d, part in zip(frames, axes, sums.reshape(3, -1)):
        s = solve(*_system(part, 3))
        if s is not None and (squared := s[0] * s[0] + s[1] * s[1] + s[2]) > 0:
            tries.append((u, v, s[0], s[1], np.sqrt(squared), d))
    if not tries:
        return m | {"center": None, "failure": m["failure"] or "rank"}
    scores = yield ("gaps", select, origin, [t[:5] for t in tries])
    u, v, p, q, r, d = tries[int(np.argmin(scores))]
    return m | {"center": origin + p * u + q * v, "direction": orient(d), "radius": float(r)}


def subset_shapes(points: np.ndarray, kind: str) -> np.ndarray:
    """Shapes through minimal subsets (an array of subsets by points by coordinates) that determine one."""
    center = points.mean(axis=1)
    d = points - center[:, None]
    values, vectors = np.linalg.eigh(np.einsum("kni,knj->kij", d, d) / points.shape[1])
    held = values[:, 1] > DEGENERATE_EIGENVALUE
    if kind == "plane":
        return np.column_stack([center, orient(vectors[:, :, 0]), np.full(len(d), -1.0)])[held]
    terms = np.concatenate([2 * d, np.ones((*d.shape[:2], 1))], axis=2)
    matrix, right = np.einsum("kni,knj->kij", terms, terms)[held], np.einsum("kni,kn->ki", terms, (d * d).sum(axis=2))[held]
    size = np.sqrt(np.maximum(np.einsum("kii->ki", matrix), 1e-300))
    scaled = matrix / (size[:, :, None] * size[:, None])
    sound = np.isfinite(scaled).all(axis=(1, 2))
    sound[sound] = np.linalg.eigvalsh(scaled[sound])[:, 0] >= RANK_TOLERANCE
    s = np.linalg.solve(scaled[sound], (right / size)[sound][..., None])[..., 0] / size[sound]
    squared, up = (s[:, :3] ** 2).sum(axis=1) + s[:, 3], np.tile([0.0, 0.0, 1.0], (len(s), 1))
    return np.column_stack([center[held][sound] + s[:, :3], up, np.sqrt(squared)])[squared > 0]


def _robust_start(m: dict, n: int, subsets: np.ndarray, whole: bool) -> Steps:
    """Replace the all-points model by the best of it and the random minimal subsets. Its failure stays."""
    shapes = subset_shapes(subsets, m["kind"]) if len(subsets) else np.zeros((0, 7))
    if m["failure"] is None:
        shapes = np.vstack([[*m["center"], *m["direction"], -1.0 if m["kind"] == "plane" else m["radius"]], shapes])
    if not len(shapes):
        return m
    best, _ = yield from _median(shapes, n, whole)
    m = m | {"center": shapes[best, :3], "direction": shapes[best, 3:6]}
    if m["kind"] == "sphere":
        return m | {"radius": float(shapes[best, 6])}
    return m | {"offset": -m["direction"] @ m["center"]}


def refine(m: dict, select: tuple | None) -> Steps:
    """At most ``REFINE_STEPS`` Gauss-Newton steps on the geometric distance."""
    if m["kind"] not in ("sphere", "cylinder") or m["failure"]:
        return m
    at, state, n = [*m["center"], *m["direction"], m["radius"]], "open", 4 if m["kind"] == "sphere" else 5
    for _ in range(REFINE_STEPS):
        sums = yield ("gauss", select, np.array(at[:3]), np.array(at[3:6]), at[6], m["kind"])
        if not sums[0]:
            break
        c, d, _, _, r, state = gauss_newton(sums[1:-n], sums[-n:], at, m["kind"])
        at = [*c.values(), *d.values(), r]
        if state != "open":
            break
    return m | {"center": np.array(at[:3]), "direction": orient(np.array(at[3:6])), "radius": float(at[6]),
                "failure": "not_converged" if state == "failed" else None}


def _trim(m: dict, n: int, whole: bool) -> Steps:
    """Up to three rounds of refitting on the points near the current model. It ends when too few points are near, or after
    one refinement when all of them are."""
    for _ in range(TRIM_ROUNDS):
        if m["failure"]:
            break
        model = m | {"rho": m.get("radius")}
        _, median = yield from _median([model], n, whole, LONG_DIGITS)
        select = (model, max(TRIM_FLOOR, TRIM_FACTOR * median))
        known = yield ("moments", select, m["center"])
        near = int(known[0])
        if near < MINIMUM_POINTS[m["kind"]]:
            break
        if near == n:
            return (yield from refine(m, None))
        m = yield from refine((yield from least_squares(m["kind"], m["center"], select, known)), select)
    return m


def steps(kind: str, n: int, origin: np.ndarray, subsets: np.ndarray, diameter: float, whole: bool) -> Steps:
    """All steps of a fit: solve, robust start or refinement, trimmed refits, statistics. ``n`` points, ``origin`` somewhere near."""
    m = yield from least_squares(kind, origin, None)
    if kind in ("plane", "sphere"):
        m = yield from _robust_start(m, n, subsets, whole)
    else:
        m = yield from refine(m, None)
    m = yield from _trim(m, n, whole)
    m["standard_diameter"] = diameter
    if not m["failure"]:
        rho = diameter / 2 if diameter > 0 else m.get("radius")
        s = yield ("stats", None, m | {"rho": rho})
        m |= dict(zip(STATS, (s[1] / s[0], np.sqrt(s[2] / s[0]), s[3], -s[4], s[5], int(s[0]))))
    return m


def _medians(pts: np.ndarray, shapes: Sequence) -> np.ndarray:
    at, out = len(pts) // 2, []
    if isinstance(shapes[0], dict):
        return np.array([np.partition(np.abs(residuals(pts, s)), at)[at] for s in shapes])
    size = max(1, BLOCK_NUMBERS // len(pts))
    for i in range(0, len(shapes), size):
        out.append(np.partition(candidate_residuals(pts, shapes[i:i + size]), at, axis=1)[:, at])
    return np.concatenate(out)


def run_whole(fit: Steps, pts: np.ndarray) -> dict:
    """All steps on the points of one cloud."""
    try:
        ask = next(fit)
        while True:
            ask = fit.send(_medians(pts, ask[2]) if ask[0] == "medians" else np.concatenate(measure(ask, pts)))
    except StopIteration as end:
        return end.value


def replay(fit: Steps, told: Sequence[np.ndarray]) -> tuple[tuple | None, dict | None]:
    """The request after the told answers, or the model."""
    try:
        ask = next(fit)
        for answer in told:
            ask = fit.send(answer)
        return ask, None
    except StopIteration as end:
        return None, end.value
