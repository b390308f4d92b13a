"""Operators and solvers on packed blocks: spin is projected and links are applied before the shuffle.

A site's neighbour ahead sends its half spinor, (1 - gamma) psi with half the components;
the neighbour behind sends U† (1 + gamma) psi, so that no link ever moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from fieldloom.functions.spin import GAMMA5, projector
from fieldloom.operators.linear import hops, unit
from fieldloom.plans.blocks import Arrays, Blocks, Shape, Site, Stencil

Apply = Callable[[Blocks, str, str], Blocks]


def dagger(x: np.ndarray) -> np.ndarray:
    return np.conj(np.swapaxes(x, -1, -2))


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """<x, y> of each block."""
    return (np.conj(x) * y).sum(axis=tuple(range(1, np.ndim(x))))


def laplacian(d: int, source: str, out: str, shape: Shape, mass2: float = 0.0) -> Stencil:
    """(2 d + mass2) f less the sum of neighbours."""

    def after(x: Arrays, seen, site: Site) -> Arrays:
        return {out: (2.0 * d + mass2) * x[source] - sum(seen["f", h] for h in hops(d))}

    return Stencil((source,), {"f": shape}, tuple(("f", h) for h in hops(d)), lambda x, site: {"f": x[source]}, after, {out: shape})


def covariant_laplacian(d: int, links: Sequence[str], source: str, out: str, shape: Shape, mass2: float = 0.0) -> Stencil:
    """mass2 f + sum over mu of 2 f - U f(x + mu) - U† f(x - mu), on color vectors or matrices."""

    def before(x: Arrays, site: Site) -> Arrays:
        return {"f": x[source]} | {f"b{mu}": times(dagger(x[u]), x[source]) for mu, u in enumerate(links)}

    def after(x: Arrays, seen, site: Site) -> Arrays:
        total = (2.0 * d + mass2) * x[source]
        for mu, u in enumerate(links):
            total = total - times(x[u], seen["f", unit(d, mu)]) - seen[f"b{mu}", unit(d, mu, -1)]
        return {out: total}

    wanted = tuple(w for mu in range(d) for w in (("f", unit(d, mu)), (f"b{mu}", unit(d, mu, -1))))
    return Stencil((source, *links), {"f": shape} | {f"b{mu}": shape for mu in range(d)}, wanted, before, after, {out: shape})


def times(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of matrices at each site; that of single numbers needs no loop over sites."""
    return u * x if u.shape[-2:] == (1, 1) else u @ x


def halves(mu: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """1 + sign gamma_mu as reconstruction (4 x 2) times projection (2 x 4)."""
    p = projector(mu, sign)
    return p @ np.linalg.pinv(p[:2]), p[:2]


def wilson_hop(d: int, links: Sequence[str], source: str, out: str, colors: int, dag: bool = False, parity: int | None = None, then: Callable[[Arrays, np.ndarray, Site], np.ndarray] | None = None, reads: Sequence[str] = ()) -> Stencil:
    """The sum over mu of (1 - g) U f(x + mu) + (1 + g) U† f(x - mu); with a parity, of a source that lives there alone.

    ``then`` may finish the result where it is, with the fields named in reads.
    """
    signs = (1, -1) if dag else (-1, 1)
    to = None if parity is None else 1 - parity
    half, full = Shape((2, colors), parity), Shape((4, colors), to)

    def before(x: Arrays, site: Site) -> Arrays:
        psi, own = x[source], site.sites(parity)
        fore = {f"f{mu}": halves(mu, signs[0])[1] @ psi for mu in range(d)}
        return fore | {f"b{mu}": halves(mu, signs[1])[1] @ (psi @ np.conj(x[links[mu]][:, own])) for mu in range(d)}

    def after(x: Arrays, seen, site: Site) -> Arrays:
        own, total = site.sites(to), 0.0
        for mu in range(d):
            u = np.swapaxes(x[links[mu]][:, own], -1, -2)
            total = total + halves(mu, signs[0])[0] @ (seen[f"f{mu}", unit(d, mu)] @ u) + halves(mu, signs[1])[0] @ seen[f"b{mu}", unit(d, mu, -1)]
        return {out: total if then is None else then(x, total, site)}

    wanted = tuple(w for mu in range(d) for w in ((f"f{mu}", unit(d, mu)), (f"b{mu}", unit(d, mu, -1))))
    return Stencil(tuple(dict.fromkeys([source, *links, *reads])), {f"{k}{mu}": half for k in "fb" for mu in range(d)}, wanted, before, after, {out: full})


def wilson(d: int, links: Sequence[str], source: str, out: str, colors: int, mass: float, dag: bool = False, twist: float = 0.0) -> Stencil:
    """(mass + d) f - hop / 2 + i twist gamma5 f."""

    def then(x: Arrays, hop: np.ndarray, site: Site) -> np.ndarray:
        local = (mass + d) * x[source] - 0.5 * hop
        return local + (-1j if dag else 1j) * twist * (GAMMA5 @ x[source]) if twist else local

    return wilson_hop(d, links, source, out, colors, dag, None, then, (source,))


def fused(s: Stencil, update: Callable[[Arrays], Arrays], fields: dict[str, Shape], numbers: Callable[[Arrays], dict[str, np.ndarray]], reads: Sequence[str] = (), own: bool = True, idle: Sequence[str] = ()) -> Stencil:
    """A stencil on fields that are brought up to date first; both and the numbers of a block are results.

    The update sees the fields, those named in reads, and with ``own`` the stencil's results as they were.
    Fields that are ``idle`` have no part in what is sent: there the update may not find them.
    """
    reads = tuple(dict.fromkeys([*fields, *s.reads, *reads, *(s.results if own else ())]))

    def after(x: Arrays, seen, site: Site) -> Arrays:
        x = x | update(x)
        got = {n: x[n] for n in fields} | s.after(x, seen, site)
        return got | numbers(x | got)

    names = numbers({n: np.zeros((0, *sh.dims)) for n, sh in (fields | s.results).items()})
    return Stencil(reads, s.labels, s.wanted, lambda x, site: s.before(x | update(x), site), after, fields | s.results | dict.fromkeys(names, Shape()), tuple(n for n in reads if n not in idle))


def conjugate_gradient(a: Callable[[str, str], Stencil], b: Blocks, source: str, fixed: Blocks | None = None, x: str = "x", tol: float = 1e-8, most: int = 1000) -> tuple[Blocks, list[float], bool]:
    """Solves A x = source for a hermitian positive A, given as a stencil from one field to another.

    An iteration writes one table and drops the last: vectors are brought up to date in the
    pass that sends surfaces and applies A, and the products of a block are columns of the result.
    Only x, r, p and q are written; fields that A reads and that stay lie in ``fixed`` and
    meet the vectors without a shuffle.  Returns the solution, the squared residual norms
    and whether the last is below the goal.
    """
    shape = b.shapes[source]
    names = ("#rr", "#pq", "#rq", "#qq")
    fields = {n: shape for n in (x, "r", "p")}
    numbers = lambda v: {"#rr": inner(v["r"], v["r"]).real, "#pq": inner(v["p"], v["q"]).real, "#rq": inner(v["r"], v["q"]).real, "#qq": inner(v["q"], v["q"]).real}
    start = b.keep(source).local(lambda v, site: {x: 0 * v[source], "r": v[source], "p": v[source], "q": 0 * v[source]}, (source,), fields | {"q": shape}).keep(x, "r", "p", "q")
    alpha, beta, history, goal = 0.0, 0.0, [], 0.0
    state = start.cut()
    for _ in range(most + 1):

        def update(v: Arrays, alpha=alpha, beta=beta) -> Arrays:
            r = v["r"] - alpha * v["q"]
            moved = {x: v[x] + alpha * v["p"]} if x in v else {}
            return moved | {"r": r, "p": r + beta * v["p"] if alpha else v["p"]}

        here = state.join(fixed) if fixed is not None else state
        old, state = state, here.stencil(fused(a("p", "q"), update, fields, numbers, idle=(x,))).keep(x, "r", "p", "q", *names).cut()
        rr, pq, rq, qq = state.sums(*names)
        history.append(rr)
        goal = goal or tol * tol * rr
        if rr <= goal or pq == 0.0:
            break
        alpha = rr / pq
        beta = max(rr - 2 * alpha * rq + alpha * alpha * qq, 0.0) / rr
        old.drop()
    return state.keep(x), history, history[-1] <= goal
