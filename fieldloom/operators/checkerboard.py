"""Even-odd operators whose diagonal is a matrix at each site, on half-volume fields of blocks.

M = D + H, where D acts on the components of a site and H leads from one parity to the
other.  Vectors live on one parity: they take half the storage, and only their half of
the surfaces moves.  D and its inverses are fields ``d0``, ``d1``, ``i0``, ``i1`` of the even
and odd sites, inverted once site by site.  With a D that changes from site to site the
Schur complements differ as operators:

* ``mooee``: D_e - H_eo D_o^-1 H_oe
* ``one``: 1 - D_e^-1 H_eo D_o^-1 H_oe
* ``two``: 1 - H_eo D_o^-1 H_oe D_e^-1
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from fieldloom.functions.spin import GAMMA
from fieldloom.operators.halo import dagger, inner, wilson_hop
from fieldloom.plans.blocks import Arrays, Blocks, Shape, Site

KINDS = ("mooee", "one", "two")


def at_sites(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix of each site on its spinor, whose components run over spins and then colors."""
    return (m @ x.reshape(*x.shape[:2], -1, 1)).reshape(x.shape)


def clover_term(d: int, colors: int, mass: float, csw: float, field_strengths: Sequence[str]) -> Callable[[Arrays, Site], np.ndarray]:
    """mass + d less csw / 2 sum over mu < nu of sigma F, as a matrix on the components of each site."""

    def term(x: Arrays, site: Site) -> np.ndarray:
        n = 4 * colors
        f = next(iter(x.values()))
        out = np.zeros((*f.shape[:2], n, n), complex) + (mass + d) * np.eye(n)
        for (mu, nu), name in zip(combinations(range(d), 2), field_strengths, strict=True):
            sigma = (GAMMA[mu] @ GAMMA[nu] - GAMMA[nu] @ GAMMA[mu]) / 2
            out -= csw / 2.0 * np.einsum("st,nxab->nxsatb", sigma, x[name]).reshape(out.shape)
        return out

    return term


def site_matrices(b: Blocks, term: Callable[[Arrays, Site], np.ndarray], reads: Sequence[str], size: int) -> Blocks:
    """The diagonal on even and odd sites with its inverses, beside the fields."""

    def make(x: Arrays, site: Site) -> Arrays:
        full = term({n: x[n] for n in reads}, site)
        parts = {f"d{p}": full[:, site.sites(p)] for p in (0, 1)}
        return parts | {f"i{p}": np.linalg.inv(parts[f"d{p}"]) for p in (0, 1)}

    return b.local(make, reads, {f"{k}{p}": Shape((size, size), p) for k in "di" for p in (0, 1)})


def split(b: Blocks, name: str, even: str, odd: str) -> Blocks:
    """A field as two half-volume fields."""
    dims = b.shapes[name].dims
    return b.local(lambda x, site: {even: x[name][:, site.sites(0)], odd: x[name][:, site.sites(1)]}, (name,), {even: Shape(dims, 0), odd: Shape(dims, 1)})


def merge(b: Blocks, even: str, odd: str, name: str) -> Blocks:
    dims = b.shapes[even].dims

    def whole(x: Arrays, site: Site) -> Arrays:
        out = np.zeros((len(site.keys), site.geometry.sites, *dims), complex)
        out[:, site.sites(0)], out[:, site.sites(1)] = x[even], x[odd]
        return {name: out}

    return b.local(whole, (even, odd), {name: Shape(dims)})


@dataclass(frozen=True)
class EvenOddWilson:
    """The Wilson hop with a site matrix as diagonal; ``fixed`` holds links, matrices and inverses by block."""

    d: int
    links: tuple[str, ...]
    colors: int
    fixed: Blocks

    def hop(self, vectors: Blocks, source: str, out: str, parity: int, dag: bool, then: Callable[[Arrays, np.ndarray], np.ndarray], reads: Sequence[str] = ()) -> Blocks:
        """-1/2 of the hop from a parity to the other, finished by ``then``; the result alone, in a table of its own."""
        own = [n for n in reads if n in vectors.shapes]
        here = vectors.keep(*dict.fromkeys([source, *own])).join(self.fixed.keep(*self.links, *[n for n in reads if n not in own]))
        s = wilson_hop(self.d, self.links, source, out, self.colors, dag, parity, lambda x, h, site: then(x, -0.5 * h), tuple(reads))
        return here.stencil(s).keep(out).cut()

    def schur(self, kind: str, dag: bool = False) -> Callable[[Blocks, str, str], Blocks]:
        """A complement on the even sites, or its adjoint, as a function of (vectors, source, out) that makes a table of out.

        The adjoint of ``one`` has the form of ``two`` with all factors adjoint, and the other way round.
        """
        if kind not in KINDS:
            raise ValueError(f"no Schur operator {kind}")
        adj = dagger if dag else (lambda m: m)
        form = {"one": "two", "two": "one"}.get(kind, kind) if dag else kind

        def apply(v: Blocks, source: str, out: str) -> Blocks:
            first = v.keep(source)
            if form == "two":
                first = first.join(self.fixed.keep("i0")).local(lambda x, site: {"_s": at_sites(adj(x["i0"]), x[source])}, ("i0", source), {"_s": Shape((4, self.colors), 0)}).keep("_s").cut()
            odd = self.hop(first, "_s" if form == "two" else source, "_o", 0, dag, lambda x, h: at_sites(adj(x["i1"]), h), ("i1",))
            finish = {
                "mooee": lambda x, h: at_sites(adj(x["d0"]), x[source]) - h,
                "one": lambda x, h: x[source] - at_sites(adj(x["i0"]), h),
                "two": lambda x, h: x[source] - h,
            }[form]
            got = self.hop(odd.join(v.keep(source)), "_o", out, 1, dag, finish, (source, *{"mooee": ("d0",), "one": ("i0",)}.get(form, ())))
            odd.drop()
            if form == "two":
                first.drop()
            return got

        return apply


def numbers(b: Blocks, /, **pairs: tuple[str, str]) -> dict[str, complex]:
    """Several inner products of fields in one pass and one row."""
    reads = tuple(dict.fromkeys(n for p in pairs.values() for n in p))

    def make(x: Arrays, site: Site) -> Arrays:
        z = {k: inner(x[a], x[c]) for k, (a, c) in pairs.items()}
        return {f"#{k}{part}": v for k, w in z.items() for part, v in (("r", w.real), ("i", w.imag))}

    got = b.local(make, reads, {f"#{k}{p}": Shape() for k in pairs for p in "ri"})
    s = got.sums(*[f"#{k}{p}" for k in pairs for p in "ri"])
    return {k: complex(s[2 * j], s[2 * j + 1]) for j, k in enumerate(pairs)}


def update(b: Blocks, /, **sums: dict[str, complex]) -> Blocks:
    """New fields as linear combinations of the old ones, in a table that replaces theirs."""
    shape = {n: b.shapes[next(iter(p))] for n, p in sums.items()}
    reads = tuple(dict.fromkeys(m for p in sums.values() for m in p))
    return b.local(lambda x, site: {n: sum(a * x[m] for m, a in p.items()) for n, p in sums.items()}, reads, shape)


@dataclass
class Solved:
    """The vectors with the solution, the squared residual norms and their goal."""

    blocks: Blocks
    residuals: list[float]
    goal: float

    @property
    def converged(self) -> bool:
        return self.residuals[-1] <= self.goal

    @property
    def iterations(self) -> int:
        return len(self.residuals) - 1


def normal_cg(a: Callable, a_dagger: Callable, b: Blocks, source: str, x: str = "x", tol: float = 1e-8, most: int = 500) -> Solved:
    """Solves A x = source through A† A x = A† source; the residuals are those of the normal equations."""
    v = update(a_dagger(b, source, "r"), **{x: {"r": 0.0}, "r": {"r": 1.0}, "p": {"r": 1.0}}).cut()
    rr = numbers(v, rr=("r", "r"))["rr"].real
    history, goal = [rr], tol * tol * rr
    while history[-1] > goal and len(history) <= most:
        ap = a(v, "p", "ap")
        q = a_dagger(ap, "ap", "q")
        all_ = v.join(ap).join(q)
        n = numbers(all_, rr=("r", "r"), pq=("ap", "ap"), rq=("r", "q"), qq=("q", "q"))
        rr = n["rr"].real
        alpha = rr / n["pq"].real
        new = max(rr - 2 * alpha * n["rq"].real + alpha * alpha * n["qq"].real, 0.0)
        old, v = v, update(all_, **{x: {x: 1.0, "p": alpha}, "r": {"r": 1.0, "q": -alpha}, "p": {"r": 1.0, "q": -alpha, "p": new / rr}}).keep(x, "r", "p").cut()
        for gone in (old, ap, q):
            gone.drop()
        history.append(new)
    return Solved(v.keep(x), history, goal)


def bicgstab(a: Callable, b: Blocks, source: str, x: str = "x", tol: float = 1e-8, most: int = 500) -> Solved:
    """Solves A x = source for any A; stops with what it has where a product vanishes."""
    v = update(b.keep(source), **{x: {source: 0.0}, "r": {source: 1.0}, "p": {source: 1.0}, "r0": {source: 1.0}}).keep(x, "r", "p", "r0").cut()
    rr = numbers(v, rr=("r", "r"))["rr"].real
    rho, history, goal = complex(rr), [rr], tol * tol * rr
    while history[-1] > goal and len(history) <= most:
        ap = a(v, "p", "ap")
        both = v.join(ap)
        alpha = rho / numbers(both, z=("r0", "ap"))["z"]
        s = update(both, s={"r": 1.0, "ap": -alpha}).cut()
        t = a(s, "s", "t")
        all_ = s.join(t)
        n = numbers(all_, ts=("t", "s"), tt=("t", "t"), ss=("s", "s"), r0s=("r0", "s"), r0t=("r0", "t"))
        w = n["ts"] / n["tt"].real if n["tt"].real else 0.0
        new = n["r0s"] - w * n["r0t"]
        beta = new / rho * (alpha / w) if w and rho else 0.0
        rr = max(n["ss"].real - abs(w) ** 2 * n["tt"].real, 0.0)
        old, v = v, update(all_, **{x: {x: 1.0, "p": alpha, "s": w}, "r": {"s": 1.0, "t": -w}, "p": {"s": 1.0, "t": -w, "p": beta, "ap": -beta * w}}).keep(x, "r", "p", "r0").cut()
        for gone in (old, ap, s, t):
            gone.drop()
        rho = new
        history.append(rr)
        if not w or not rho:
            break
    return Solved(v.keep(x), history, goal)


def red_black_solve(m: EvenOddWilson, b: Blocks, source: str, kind: str = "mooee", solver: str = "normal_cg", tol: float = 1e-8) -> Solved:
    """Solves M x = source on the whole lattice: the odd sites are eliminated, the even ones solved for, the odd ones put back.

    Returns blocks with the field x.  ``normal_cg`` takes the adjoint complement as well,
    ``bicgstab`` the complement alone.
    """
    v = split(b.keep(source), source, "be", "bo").keep("be", "bo").cut()
    # s = b_e - H_eo D_o^-1 b_o
    t = v.join(m.fixed.keep("i1")).local(lambda x, site: {"_t": at_sites(x["i1"], x["bo"])}, ("i1", "bo"), {"_t": Shape((4, m.colors), 1)}).keep("be", "bo", "_t").cut()
    prepare = {"mooee": lambda x, h: x["be"] - h, "one": lambda x, h: at_sites(x["i0"], x["be"] - h), "two": lambda x, h: x["be"] - h}[kind]
    s = m.hop(t, "_t", "s", 1, False, prepare, ("be", *(("i0",) if kind == "one" else ())))
    t.drop()
    a = m.schur(kind)
    got = normal_cg(a, m.schur(kind, True), s, "s", "xe", tol) if solver == "normal_cg" else bicgstab(a, s, "s", "xe", tol)
    xe = got.blocks
    if kind == "two":
        xe = xe.join(m.fixed.keep("i0")).local(lambda x, site: {"xe": at_sites(x["i0"], x["xe"])}, ("i0", "xe"), {"xe": Shape((4, m.colors), 0)}).keep("xe").cut()
    # x_o = D_o^-1 (b_o - H_oe x_e)
    back = m.hop(xe.join(v.keep("bo")), "xe", "xo", 0, False, lambda x, h: at_sites(x["i1"], x["bo"] - h), ("i1", "bo"))
    return Solved(merge(back.join(xe.keep("xe")), "xe", "xo", "x").keep("x").cut(), got.residuals, got.goal)
