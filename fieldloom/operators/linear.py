"""Linear operators on lattice fields and iterative solvers.

An operator is a projection over fields gathered at displaced sites: one shuffle an
application, in which all the solver's other vectors ride along at no displacement.  A
solver is a driver loop over scalars: each iteration gathers once, reduces in one or two
aggregations, and ends in a reliable checkpoint every ``CUT_EVERY`` iterations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions.tensors import Tensor, column
from fieldloom.plans.lattice import Lattice

CUT_EVERY = 2
Wanted = list[tuple[str, tuple[int, ...]]]


@dataclass(frozen=True)
class Operator:
    """wanted(source) lists the displaced fields; apply(gathered, names, source) is the result's expression."""

    wanted: Callable[[str], Wanted]
    apply: Callable[[Lattice, dict, str], Tensor]

    def __call__(self, lat: Lattice, source: str, out: str) -> Lattice:
        got, names = lat.gather(self.wanted(source))
        keep = dict.fromkeys([*lat.shapes, out])
        return got.put(**{out: self.apply(got, names, source)}).keep(*keep)


def unit(d: int, mu: int, by: int = 1) -> tuple[int, ...]:
    return tuple(by * int(k == mu) for k in range(d))


def hops(d: int) -> list[tuple[int, ...]]:
    return [unit(d, mu, s) for mu in range(d) for s in (1, -1)]


def laplacian(d: int, mass2: float = 0.0, sign: float = 1.0) -> Operator:
    """sign (sum of neighbours - 2 d f) + mass2 f."""

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        total = lat.t(f).scale(-2.0 * d * sign + mass2)
        for h in hops(d):
            total = total + lat.t(names[(f, h)]).scale(sign)
        return total

    return Operator(lambda f: [(f, h) for h in hops(d)], apply)


def massive(d: int, mass2: float) -> Operator:
    """-Laplacian + mass2: hermitian and positive."""
    return laplacian(d, mass2, -1.0)


def covariant_laplacian(d: int, links: Sequence[str], mass2: float = 0.0) -> Operator:
    """mass2 f + sum over mu of 2 f - U f(x + mu) - U† f(x - mu)."""

    def wanted(f: str) -> Wanted:
        return [(f, h) for h in hops(d)] + [(links[mu], unit(d, mu, -1)) for mu in range(d)]

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        total = lat.t(f).scale(2.0 * d + mass2)
        for mu in range(d):
            total = total - lat.t(links[mu]) * lat.t(names[(f, unit(d, mu))])
            total = total - lat.t(names[(links[mu], unit(d, mu, -1))]).adj() * lat.t(names[(f, unit(d, mu, -1))])
        return total

    return Operator(wanted, apply)


def smear(lat: Lattice, f: str, width: float, n: int) -> Lattice:
    """Gaussian smearing (1 + width^2 / (4 n) Laplacian)^n."""
    step = laplacian(len(lat.grid.dims))
    for k in range(n):
        lat = step(lat, f, "__l")
        lat = lat.put(**{f: lat.t(f) + lat.t("__l").scale(width * width / (4.0 * n))}).keep(*[s for s in lat.shapes if s != "__l"])
        if k % CUT_EVERY == CUT_EVERY - 1:
            lat = lat.cut()
    return lat


def dots(lat: Lattice, pairs: Sequence[tuple[str, str]]) -> list[complex]:
    """Several inner products in one aggregation, as driver numbers."""
    inner = [lat.t(a).inner(lat.t(b)) for a, b in pairs]
    row = lat.df.agg(*[F.sum(column(x)).alias(f"{p}{k}") for k, c in enumerate(inner) for p, x in (("re", c.re), ("im", c.im))]).first()
    return [complex(row[f"re{k}"] or 0.0, row[f"im{k}"] or 0.0) for k in range(len(inner))]


def combine(lat: Lattice, **sums: dict[str, complex]) -> Lattice:
    """New fields as linear combinations of old ones."""

    def total(parts: dict[str, complex]) -> Tensor:
        out = None
        for n, a in parts.items():
            term = lat.t(n) if a == 1 else lat.t(n) * complex(a)
            out = term if out is None else out + term
        return out

    return lat.put(**{n: total(p) for n, p in sums.items()})


@dataclass
class Solution:
    """A lattice that holds the solution field, the squared residual norms, their goal and the iterations used.

    A solver that stops at its largest number of iterations says so: ``converged`` is false.
    """

    lattice: Lattice
    residuals: list[float]
    goal: float = float("inf")

    @property
    def converged(self) -> bool:
        return self.residuals[-1] <= self.goal

    @property
    def iterations(self) -> int:
        return len(self.residuals) - 1


def conjugate_gradient(a: Operator, lat: Lattice, b: str, x: str = "x", tol: float = 1e-8, most: int = 1000) -> Solution:
    """Solves A x = b for a hermitian positive A from x = 0; a zero source has a zero solution."""
    own = list(lat.shapes)
    lat = combine(lat, **{x: {b: 0.0}, "__r": {b: 1.0}, "__p": {b: 1.0}}).cut()
    rr = dots(lat, [("__r", "__r")])[0].real
    goal, history = tol * tol * rr, [rr]
    while history[-1] > goal and len(history) <= most:
        lat = a(lat, "__p", "__q").cut()
        # One aggregation an iteration: the new residual's norm follows from products of the old one.
        # The old norm is summed afresh: carried on, its first rounding would outgrow a fast-shrinking residual.
        norm, pq, rq, qq = dots(lat, [("__r", "__r"), ("__p", "__q"), ("__r", "__q"), ("__q", "__q")])
        rr = norm.real
        alpha = rr / pq.real
        new = max(rr - 2 * alpha * rq.real + alpha * alpha * qq.real, 0.0)
        lat = combine(lat, **{x: {x: 1.0, "__p": alpha}, "__r": {"__r": 1.0, "__q": -alpha}, "__p": {"__r": 1.0, "__q": -alpha, "__p": new / rr}})
        rr = new
        history.append(rr)
    return Solution(lat.keep(*dict.fromkeys([*own, x])).cut(), history, goal)


def multishift(a: Operator, lat: Lattice, b: str, shifts: Sequence[float], tol: float = 1e-8, most: int = 1000) -> Solution:
    """Solves (A + s) x_k = b for all shifts from one Krylov space; fields x0, x1, ..."""
    own, k = list(lat.shapes), len(shifts)
    names = [f"x{i}_s" for i in range(k)]
    lat = combine(lat, **{n: {b: 0.0} for n in names}, **{f"__p{i}": {b: 1.0} for i in range(k)}, __r={b: 1.0}, __p={b: 1.0}).cut()
    rr = dots(lat, [("__r", "__r")])[0].real
    history, goal = [rr], tol * tol * rr
    alpha_old, beta_old, z, z_old = 1.0, 0.0, [1.0] * k, [1.0] * k
    while history[-1] > goal and len(history) <= most:
        lat = a(lat, "__p", "__q").cut()
        alpha = rr / dots(lat, [("__p", "__q")])[0].real
        z_new = [zo * zz * alpha_old / (alpha * beta_old * (zo - zz) + zo * alpha_old * (1 + alpha * s)) for s, zz, zo in zip(shifts, z, z_old, strict=True)]
        lat = combine(lat, __r={"__r": 1.0, "__q": -alpha}, **{names[i]: {names[i]: 1.0, f"__p{i}": alpha * z_new[i] / z[i]} for i in range(k)})
        new = dots(lat, [("__r", "__r")])[0].real
        beta = new / rr
        lat = combine(lat, __p={"__r": 1.0, "__p": beta}, **{f"__p{i}": {"__r": z_new[i], f"__p{i}": beta * (z_new[i] / z[i]) ** 2} for i in range(k)})
        z_old, z, alpha_old, beta_old, rr = z, z_new, alpha, beta, new
        history.append(rr)
    return Solution(lat.keep(*own, *names).cut(), history, goal)


def conjugate_residual(a: Operator, lat: Lattice, b: str, x: str = "x", tol: float = 1e-8, most: int = 1000) -> Solution:
    """Solves A x = b for a hermitian A, indefinite ones too."""
    own = list(lat.shapes)
    lat = a(combine(lat, **{x: {b: 0.0}, "__r": {b: 1.0}, "__p": {b: 1.0}}), "__r", "__ar")
    lat = combine(lat, __ap={"__ar": 1.0}).cut()
    rar, rr = (z.real for z in dots(lat, [("__r", "__ar"), ("__r", "__r")]))
    history, goal = [rr], tol * tol * rr
    while history[-1] > goal and len(history) <= most:
        alpha = rar / dots(lat, [("__ap", "__ap")])[0].real
        lat = combine(lat, **{x: {x: 1.0, "__p": alpha}, "__r": {"__r": 1.0, "__ap": -alpha}})
        lat = a(lat, "__r", "__ar").cut()
        new, rr = (z.real for z in dots(lat, [("__r", "__ar"), ("__r", "__r")]))
        lat = combine(lat, __p={"__r": 1.0, "__p": new / rar}, __ap={"__ar": 1.0, "__ap": new / rar})
        rar = new
        history.append(rr)
    return Solution(lat.keep(*dict.fromkeys([*own, x])).cut(), history, goal)


def minimal_residual(a: Operator, lat: Lattice, b: str, x: str = "x", tol: float = 1e-8, most: int = 1000, relax: float = 1.0) -> Solution:
    """Steps along the residual that minimise it; any A with a positive hermitian part."""
    own = list(lat.shapes)
    lat = combine(lat, **{x: {b: 0.0}, "__r": {b: 1.0}}).cut()
    history = [dots(lat, [("__r", "__r")])[0].real]
    goal = tol * tol * history[0]
    while history[-1] > goal and len(history) <= most:
        lat = a(lat, "__r", "__q").cut()
        qr, qq = dots(lat, [("__q", "__r"), ("__q", "__q")])
        w = relax * qr / qq.real
        lat = combine(lat, **{x: {x: 1.0, "__r": w}, "__r": {"__r": 1.0, "__q": -w}})
        history.append(dots(lat, [("__r", "__r")])[0].real)
    return Solution(lat.keep(*dict.fromkeys([*own, x])).cut(), history, goal)


def bicgstab(a: Operator, lat: Lattice, b: str, x: str = "x", tol: float = 1e-8, most: int = 1000) -> Solution:
    """Solves A x = b for a general A."""
    own = list(lat.shapes)
    lat = combine(lat, **{x: {b: 0.0}, "__r": {b: 1.0}, "__h": {b: 1.0}, "__p": {b: 1.0}}).cut()
    rho = dots(lat, [("__h", "__r")])[0]
    history = [rho.real]
    goal = tol * tol * history[0]
    while history[-1] > goal and len(history) <= most:
        lat = a(lat, "__p", "__v").cut()
        alpha = rho / dots(lat, [("__h", "__v")])[0]
        lat = combine(lat, __s={"__r": 1.0, "__v": -alpha})
        lat = a(lat, "__s", "__t").cut()
        ts, tt = dots(lat, [("__t", "__s"), ("__t", "__t")])
        w = ts / tt.real if tt.real else 0.0
        lat = combine(lat, **{x: {x: 1.0, "__p": alpha, "__s": w}, "__r": {"__s": 1.0, "__t": -w}})
        new, rr = dots(lat, [("__h", "__r"), ("__r", "__r")])
        history.append(rr.real)
        if not w or not rho:
            break
        beta = new / rho * alpha / w
        lat = combine(lat, __p={"__r": 1.0, "__p": beta, "__v": -beta * w})
        rho = new
    return Solution(lat.keep(*dict.fromkeys([*own, x])).cut(), history, goal)


def gcr(a: Operator, lat: Lattice, b: str, x: str = "x", tol: float = 1e-8, most: int = 200, restart: int = 8, prepare: Callable[[Lattice, str, str], Lattice] | None = None) -> Solution:
    """Generalised conjugate residual with restarts; ``prepare`` applies a flexible preconditioner."""
    own = list(lat.shapes)
    lat = combine(lat, **{x: {b: 0.0}, "__r": {b: 1.0}}).cut()
    history = [dots(lat, [("__r", "__r")])[0].real]
    goal, k, norms = tol * tol * history[0], 0, []
    while history[-1] > goal and len(history) <= most:
        lat = prepare(lat, "__r", f"__p{k}") if prepare else combine(lat, **{f"__p{k}": {"__r": 1.0}})
        lat = a(lat, f"__p{k}", f"__q{k}").cut()
        c = dots(lat, [(f"__q{j}", f"__q{k}") for j in range(k)]) if k else []
        off = [z / n for z, n in zip(c, norms, strict=True)]
        lat = combine(lat, **{f"__{v}{k}": {f"__{v}{k}": 1.0} | {f"__{v}{j}": -off[j] for j in range(k)} for v in "pq"})
        qr, qq = dots(lat, [(f"__q{k}", "__r"), (f"__q{k}", f"__q{k}")])
        norms.append(qq.real)
        w = qr / qq.real
        lat = combine(lat, **{x: {x: 1.0, f"__p{k}": w}, "__r": {"__r": 1.0, f"__q{k}": -w}})
        history.append(dots(lat, [("__r", "__r")])[0].real)
        k += 1
        if k == restart:
            k, norms = 0, []
            lat = lat.keep(*own, *({x} - set(own)), "__r").cut()
    return Solution(lat.keep(*dict.fromkeys([*own, x])).cut(), history, goal)


def arnoldi(a: Operator, lat: Lattice, b: str, steps: int) -> tuple[Lattice, np.ndarray, float]:
    """Orthonormal fields __v0.. of the Krylov space of b, the Hessenberg matrix and |b|."""
    norm = dots(lat, [(b, b)])[0].real ** 0.5
    lat = combine(lat, __v0={b: 1.0 / norm})
    h = np.zeros((steps + 1, steps), dtype=complex)
    for k in range(steps):
        lat = a(lat, f"__v{k}", "__w").cut()
        for _ in range(2):  # twice is enough to stay orthogonal
            c = dots(lat, [(f"__v{j}", "__w") for j in range(k + 1)])
            h[: k + 1, k] += c
            lat = combine(lat, __w={"__w": 1.0} | {f"__v{j}": -c[j] for j in range(k + 1)})
        h[k + 1, k] = dots(lat, [("__w", "__w")])[0].real ** 0.5
        if abs(h[k + 1, k]) < 1e-14 * norm:
            return lat, h[: k + 1, : k + 1], norm
        lat = combine(lat, **{f"__v{k + 1}": {"__w": 1.0 / h[k + 1, k]}}).cut()
    return lat, h, norm


def gmres(a: Operator, lat: Lattice, b: str, x: str = "x", steps: int = 10, tol: float = 1e-8, most: int = 50) -> Solution:
    """GMRES restarted after ``steps``, for any A; the residuals listed are true ones, one a cycle.

    The small least-squares problem of a cycle is solved on the driver.
    """
    own = list(lat.shapes)
    lat = combine(lat, **{x: {b: 0.0}, "__r": {b: 1.0}}).cut()
    history = [dots(lat, [("__r", "__r")])[0].real]
    goal = tol * tol * history[0]
    while history[-1] > goal and len(history) <= most:
        lat, h, norm = arnoldi(a, lat, "__r", steps)
        e = np.zeros(h.shape[0], dtype=complex)
        e[0] = norm
        y = np.linalg.lstsq(h, e, rcond=None)[0]
        lat = combine(lat, **{x: {x: 1.0} | {f"__v{k}": y[k] for k in range(h.shape[1])}}).keep(*dict.fromkeys([*own, x]))
        lat = combine(a(lat, x, "__ax"), __r={b: 1.0, "__ax": -1.0}).keep(*dict.fromkeys([*own, x]), "__r").cut()
        history.append(dots(lat, [("__r", "__r")])[0].real)
    return Solution(lat.keep(*dict.fromkeys([*own, x])), history, goal)


def lanczos(a: Operator, lat: Lattice, b: str, steps: int, vectors: int = 0) -> tuple[np.ndarray, Lattice]:
    """Ritz values of a hermitian A, ascending, and the lowest vectors as fields e0, e1, ..."""
    own = list(lat.shapes)
    lat, h, _ = arnoldi(a, lat, b, steps)
    n = h.shape[1]
    values, small = np.linalg.eigh((h[:n, :n] + h[:n, :n].conj().T) / 2)
    lat = combine(lat, **{f"e{i}": {f"__v{k}": small[k, i] for k in range(n)} for i in range(vectors)}) if vectors else lat
    return values, lat.keep(*own, *[f"e{i}" for i in range(vectors)]).cut()


def power_method(a: Operator, lat: Lattice, b: str, steps: int) -> float:
    """Rayleigh quotient after a number of normalised applications."""
    lat = combine(lat, __v={b: 1.0})
    value = 0.0
    for k in range(steps):
        lat = a(lat, "__v", "__w").cut()
        vw, vv, ww = dots(lat, [("__v", "__w"), ("__v", "__v"), ("__w", "__w")])
        value = vw.real / vv.real
        lat = combine(lat, __v={"__w": 1.0 / ww.real**0.5})
    return value


def chebyshev(a: Operator, lat: Lattice, f: str, coefficients: Sequence[float], low: float, high: float, out: str = "cheb") -> Lattice:
    """sum_k c_k T_k(y(A)) f with c_0 halved and y mapping [low, high] to [-1, 1], by the three-term recurrence."""
    own = list(lat.shapes)
    scale, shift = 2.0 / (high - low), -(high + low) / (high - low)
    lat = a(combine(lat, __t0={f: 1.0}), f, "__a")
    lat = combine(lat, __t1={"__a": scale, f: shift}, **{out: {f: 0.5 * coefficients[0] + coefficients[1] * shift, "__a": coefficients[1] * scale}}).cut()
    for k in range(2, len(coefficients)):
        lat = a(lat, "__t1", "__a")
        lat = combine(lat, __t2={"__a": 2 * scale, "__t1": 2 * shift, "__t0": -1.0})
        lat = combine(lat, __t0={"__t1": 1.0}, __t1={"__t2": 1.0}, **{out: {out: 1.0, "__t2": coefficients[k]}}).cut()
    return lat.keep(*dict.fromkeys([*own, out]))


def chebyshev_coefficients(function: Callable[[float], float], low: float, high: float, order: int) -> list[float]:
    """Coefficients of a function on [low, high] by the sums over Chebyshev nodes."""
    nodes = np.cos(np.pi * (np.arange(order) + 0.5) / order)
    values = np.array([function(0.5 * (x * (high - low) + high + low)) for x in nodes])
    return [float(2.0 / order * (values * np.cos(k * np.pi * (np.arange(order) + 0.5) / order)).sum()) for k in range(order)]


def deflated_guess(lat: Lattice, b: str, vectors: Sequence[str], values: Sequence[float], out: str = "guess") -> Lattice:
    """sum_k v_k <v_k, b> / value_k."""
    c = dots(lat, [(v, b) for v in vectors])
    return combine(lat, **{out: {v: z / w for v, z, w in zip(vectors, c, values, strict=True)}})


def schur_even_odd(diagonal: float, hop: Operator) -> Operator:
    """The even-odd Schur complement D - H D^-1 H of (D + H) on one parity, for a constant D and a hop H that flips parity."""
    inner = hop

    class _Schur(Operator):
        def __call__(self, lat: Lattice, source: str, out: str) -> Lattice:
            got = inner(inner(lat, source, "__h1"), "__h1", "__h2")
            keep = dict.fromkeys([*lat.shapes, out])
            return combine(got, **{out: {source: diagonal, "__h2": -1.0 / diagonal}}).keep(*keep)

    return _Schur(hop.wanted, hop.apply)


def multi_rhs_cg(a: Operator, lat: Lattice, bs: Sequence[str], tol: float = 1e-8, most: int = 1000) -> Solution:
    """Conjugate gradients for several sources at once: one shuffle an iteration for all; fields x0, x1, ...

    The residuals reported are the largest relative ones.
    """
    own, n = list(lat.shapes), range(len(bs))
    lat = combine(lat, **{f"x{k}_b": {bs[k]: 0.0} for k in n}, **{f"__r{k}": {bs[k]: 1.0} for k in n}, **{f"__p{k}": {bs[k]: 1.0} for k in n}).cut()
    first = rr = [z.real for z in dots(lat, [(f"__r{k}", f"__r{k}") for k in n])]
    history = [1.0]
    while history[-1] > tol * tol and len(history) <= most:
        state = list(lat.shapes)
        got, names = lat.gather([w for k in n for w in a.wanted(f"__p{k}")])
        lat = got.put(**{f"__q{k}": a.apply(got, names, f"__p{k}") for k in n}).keep(*dict.fromkeys([*state, *[f"__q{k}" for k in n]])).cut()
        pq = [z.real for z in dots(lat, [(f"__p{k}", f"__q{k}") for k in n])]
        alpha = [x / y if y else 0.0 for x, y in zip(rr, pq, strict=True)]
        lat = combine(lat, **{f"x{k}_b": {f"x{k}_b": 1.0, f"__p{k}": alpha[k]} for k in n}, **{f"__r{k}": {f"__r{k}": 1.0, f"__q{k}": -alpha[k]} for k in n})
        new = [z.real for z in dots(lat, [(f"__r{k}", f"__r{k}") for k in n])]
        lat = combine(lat, **{f"__p{k}": {f"__r{k}": 1.0, f"__p{k}": new[k] / rr[k] if rr[k] else 0.0} for k in n})
        rr = new
        history.append(max(x / y if y else 0.0 for x, y in zip(rr, first, strict=True)))
    return Solution(lat.keep(*own, *[f"x{k}_b" for k in n]).cut(), history, tol * tol)
