"""Fermion matrices: Wilson, twisted mass, domain wall and staggered, as one stencil each.

A spinor is a field of 4 x Nc components and a link of Nc x Nc.  An application gathers
the spinor at the eight neighbours and the links behind in one shuffle; spin projection,
color product and sum are columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import combinations

from pyspark.sql import functions as F

from fieldloom.functions.spin import GAMMA, GAMMA5, projector, times
from fieldloom.functions.tensors import C, Tensor
from fieldloom.operators.linear import Operator, combine, hops, unit
from fieldloom.plans.lattice import Lattice


def _wanted(d: int, links: Sequence[str], n: int):
    return lambda f: [(f, h[:n] + (0,) * (d - n)) for h in hops(d) if any(h[:n])] + [(links[mu], unit(d, mu, -1)) for mu in range(n)]


def _hop(lat: Lattice, names: dict, f: str, d: int, links: Sequence[str], n: int, dagger: bool) -> Tensor:
    """sum over mu of (1 - g) U f(x + mu) + (1 + g) U† f(x - mu); dagger flips the signs of g."""
    total = None
    for mu in range(n):
        ahead = lat.t(names[(f, unit(d, mu))])
        behind = lat.t(names[(f, unit(d, mu, -1))])
        u, v = lat.t(links[mu]), lat.t(names[(links[mu], unit(d, mu, -1))]).adj()
        # Colors are the columns of the spinor: U psi is psi times U transposed.
        fore = times(projector(mu, 1 if dagger else -1), ahead * u.transpose())
        aft = times(projector(mu, -1 if dagger else 1), behind * v.transpose())
        total = fore + aft if total is None else total + fore + aft
    return total


def wilson_hop(d: int, links: Sequence[str], n: int | None = None, dagger: bool = False) -> Operator:
    n = d if n is None else n
    return Operator(_wanted(d, links, n), lambda lat, names, f: _hop(lat, names, f, d, links, n, dagger))


def wilson(d: int, links: Sequence[str], mass: float, dagger: bool = False, twist: float = 0.0) -> Operator:
    """(mass + d) f - hop / 2, with i twist gamma5 f for twisted mass."""

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        out = lat.t(f).scale(mass + d) - _hop(lat, names, f, d, links, d, dagger).scale(0.5)
        if twist:
            out = out + times(GAMMA5, lat.t(f)) * complex(0, -twist if dagger else twist)
        return out

    return Operator(_wanted(d, links, d), apply)


def normal(m: Operator, m_dagger: Operator) -> Operator:
    """M† M."""

    class _Normal(Operator):
        def __call__(self, lat: Lattice, source: str, out: str) -> Lattice:
            keep = dict.fromkeys([*lat.shapes, out])
            return m_dagger(m(lat, source, "__m"), "__m", out).keep(*keep)

    return _Normal(m.wanted, m.apply)


def domain_wall(links: Sequence[str], m5: float, mass: float, ls: int, dagger: bool = False) -> Operator:
    """Domain-wall matrix on a five-dimensional lattice whose last dimension is s (ls sites).

    (4 - m5 + 1) f - hop / 2 - P- f(s + 1) - P+ f(s - 1), with -mass at the two walls.
    """
    d, n = 5, 4

    def wanted(f: str):
        return _wanted(d, links, n)(f) + [(f, unit(d, 4)), (f, unit(d, 4, -1))]

    def wall(t: Tensor, at: int) -> Tensor:
        hit = F.col("x4") == at
        return t.map(lambda c: C(F.when(hit, -mass * c.re).otherwise(c.re), F.when(hit, -mass * c.im).otherwise(c.im)))

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        up, down = wall(lat.t(names[(f, unit(d, 4))]), ls - 1), wall(lat.t(names[(f, unit(d, 4, -1))]), 0)
        minus, plus = projector(4, -1) / 2, projector(4, 1) / 2
        if dagger:
            minus, plus = plus, minus
        out = lat.t(f).scale(5.0 - m5) - _hop(lat, names, f, d, links, n, dagger).scale(0.5)
        return out - times(minus, up) - times(plus, down)

    return Operator(wanted, apply)


def staggered(d: int, links: Sequence[str], mass: float, dagger: bool = False) -> Operator:
    """mass f + sum over mu of eta_mu (U f(x + mu) - U† f(x - mu)) / 2; eta flips with the parity of lower coordinates."""

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        out = lat.t(f).scale(mass)
        for mu in range(d):
            lower = sum((F.col(f"x{k}") for k in range(mu)), F.lit(0))
            eta = F.when(F.pmod(lower, F.lit(2)) == 0, 0.5).otherwise(-0.5)
            step = lat.t(links[mu]) * lat.t(names[(f, unit(d, mu))]) - lat.t(names[(links[mu], unit(d, mu, -1))]).adj() * lat.t(names[(f, unit(d, mu, -1))])
            out = out + step.scale(-eta if dagger else eta)
        return out

    return Operator(lambda f: [(f, h) for h in hops(d)] + [(links[mu], unit(d, mu, -1)) for mu in range(d)], apply)


def gamma5(lat: Lattice, f: str, out: str) -> Lattice:
    return lat.put(**{out: times(GAMMA5, lat.t(f))})


def axpby_slices(lat: Lattice, f: str, a: float, b: float, s: int, s2: int, out: str, project: int = 0) -> Lattice:
    """On slice s of the last dimension: a f(s) + b P f(s2), P being 1 or a chiral projector; other slices stay as they are."""
    last = len(lat.grid.dims) - 1
    other = Lattice(lat.df.filter(F.col(f"x{last}") == s2).withColumn(f"x{last}", F.lit(s)), lat.grid, lat.shapes).keep(f).rename(f, "__o")
    at = replace(lat, df=lat.df.filter(F.col(f"x{last}") == s)).join(other)
    p = at.t("__o") if not project else times(projector(4, project) / 2, at.t("__o"))
    at = at.put(**{out: at.t(f).scale(a) + p.scale(b)})
    rest = combine(replace(lat, df=lat.df.filter(F.col(f"x{last}") != s)), **{out: {f: 1.0}})
    keep = [*lat.shapes, out]
    return replace(rest.keep(*keep), df=rest.keep(*keep).df.drop("__slab").unionByName(at.keep(*keep).df.drop("__slab")))


def clover_wilson(d: int, links: Sequence[str], mass: float, csw: float, dagger: bool = False) -> Operator:
    """The Wilson matrix less csw / 2 sum over mu < nu of sigma F, with sigma half the commutator of gammas.

    The lattice must hold the field strengths f01, f02, ... that ``gauge.clover`` makes;
    they are local, so that the term adds nothing to the shuffle.
    """
    base = wilson(d, links, mass, dagger)

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        out = base.apply(lat, names, f)
        for mu, nu in combinations(range(d), 2):
            sigma = (GAMMA[mu] @ GAMMA[nu] - GAMMA[nu] @ GAMMA[mu]) / 2
            out = out - times(sigma, lat.t(f) * lat.t(f"f{mu}{nu}").transpose()).scale(csw / 2.0)
        return out

    return Operator(base.wanted, apply)


def moebius(links: Sequence[str], m5: float, mass: float, ls: int, b: float, c: float) -> Operator:
    """(b D + 1) f + (c D - 1) h with h = P- f(s + 1) + P+ f(s - 1), D the Wilson matrix at -m5 and -mass at the walls."""
    d, n = 5, 4
    walls = domain_wall(links, m5, mass, ls)

    class _Moebius(Operator):
        def __call__(self, lat: Lattice, source: str, out: str) -> Lattice:
            keep = dict.fromkeys([*lat.shapes, out])
            up, down = unit(d, 4), unit(d, 4, -1)
            got, names = lat.gather([(source, up), (source, down)])

            def wall(t: Tensor, at: int) -> Tensor:
                hit = F.col("x4") == at
                return t.map(lambda z: C(F.when(hit, -mass * z.re).otherwise(z.re), F.when(hit, -mass * z.im).otherwise(z.im)))

            h = times(projector(4, -1) / 2, wall(got.t(names[(source, up)]), ls - 1)) + times(projector(4, 1) / 2, wall(got.t(names[(source, down)]), 0))
            got = got.put(__h=h).keep(*lat.shapes, "__h")
            got = combine(got, __x={source: b, "__h": c})
            got, names = got.gather(_wanted(d, links, n)("__x"))
            dx = got.t("__x").scale(4.0 - m5) - _hop(got, names, "__x", d, links, n, False).scale(0.5)
            return got.put(**{out: dx + got.t(source) - got.t("__h")}).keep(*keep)

    return _Moebius(walls.wanted, walls.apply)


def improved_staggered(d: int, links: Sequence[str], long_links: Sequence[str], mass: float, c1: float, c2: float, dagger: bool = False) -> Operator:
    """mass f + sum over mu of eta_mu (c1 (U f(x + mu) - U† f(x - mu)) + c2 (W f(x + 3 mu) - W† f(x - 3 mu))) / 2.

    U are fat links and W the three-link products, both given as fields.
    """

    def wanted(f: str):
        out = [(f, unit(d, mu, s)) for mu in range(d) for s in (1, -1, 3, -3)]
        return out + [(links[mu], unit(d, mu, -1)) for mu in range(d)] + [(long_links[mu], unit(d, mu, -3)) for mu in range(d)]

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        out = lat.t(f).scale(mass)
        for mu in range(d):
            lower = sum((F.col(f"x{k}") for k in range(mu)), F.lit(0))
            eta = F.when(F.pmod(lower, F.lit(2)) == 0, 0.5).otherwise(-0.5)
            step = None
            for c, n, u in ((c1, 1, links[mu]), (c2, 3, long_links[mu])):
                part = lat.t(u) * lat.t(names[(f, unit(d, mu, n))]) - lat.t(names[(u, unit(d, mu, -n))]).adj() * lat.t(names[(f, unit(d, mu, -n))])
                step = part.scale(c) if step is None else step + part.scale(c)
            out = out + step.scale(-eta if dagger else eta)
        return out

    return Operator(wanted, apply)


def gamma5_hermitian(m: Operator) -> Operator:
    """gamma5 M: hermitian where M is gamma5-hermitian."""
    return Operator(m.wanted, lambda lat, names, f: times(GAMMA5, m.apply(lat, names, f)))
