"""Even-odd (red-black) Schur complements and solves for operators D + H, D local and H flipping parity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor
from fieldloom.operators.linear import Operator, Solution, combine, conjugate_gradient, dots
from fieldloom.plans.lattice import Lattice


def on_parity(lat: Lattice, name: str, parity: int, out: str) -> Lattice:
    """The field on one parity, zero on the other."""
    here = lat.grid.parity() == parity
    return lat.put(**{out: lat.t(name).map(lambda c: C(F.when(here, c.re).otherwise(0.0), F.when(here, c.im).otherwise(0.0)))})


def _check(lat: Lattice) -> None:
    if any(n % 2 for n in lat.grid.dims):
        raise ValueError("a hop flips parity only where all extents are even")


class Schur(Operator):
    """The complement on a parity of D + H: ``mooee`` D - H D^-1 H, ``one`` 1 - D^-1 H D^-1 H, ``two`` 1 - H D^-1 H D^-1, ``staggered`` D^2 - H H.

    With a constant D the first three differ by scale alone, as operators; the field of a
    source must be zero on the other parity, and so is the result.
    """

    def __init__(self, diagonal: complex, hop: Operator, kind: str = "mooee"):
        if kind not in ("mooee", "one", "two", "staggered"):
            raise ValueError(f"no Schur operator {kind}")
        super().__init__(hop.wanted, hop.apply)
        object.__setattr__(self, "how", (diagonal, hop, kind))

    def __call__(self, lat: Lattice, source: str, out: str) -> Lattice:
        _check(lat)
        d, hop, kind = self.how
        keep = dict.fromkeys([*lat.shapes, out])
        got = hop(hop(lat, source, "__h1"), "__h1", "__h2")
        own, twice = {"mooee": (d, -1 / d), "one": (1.0, -1 / d**2), "two": (1.0, -1 / d**2), "staggered": (d * d, -1.0)}[kind]
        return combine(got, **{out: {source: own, "__h2": twice}}).keep(*keep)


def red_black_solve(diagonal: complex, hop: Operator, lat: Lattice, b: str, x: str = "x", kind: str = "mooee", solver: Callable = conjugate_gradient, tol: float = 1e-8, guess: str | None = None) -> Solution:
    """Solves (D + H) x = b: the source is prepared, one parity solved, the other put back.

    The residual reported last is the true one of the whole lattice.  A guess is a field; what
    it leaves is solved for.
    """
    _check(lat)
    own, d = list(lat.shapes), diagonal
    if guess:
        lat = hop(lat, guess, "__hg")
        lat = combine(lat, __b={b: 1.0, guess: -d, "__hg": -1.0}).cut()
    else:
        lat = combine(lat, __b={b: 1.0}).cut()
    lat = on_parity(lat, "__b", 1, "__bo")
    lat = combine(hop(lat, "__bo", "__hb"), __s={"__b": 1.0, "__hb": -1 / d})
    lat = on_parity(lat, "__s", 0, "__s").cut()
    # mooee: S x_e = s;  one: D^-1 S x_e = D^-1 s;  two: S D^-1 y = s with x_e = D^-1 y;  staggered: D S x_e = D s.
    before, after = {"mooee": (1.0, 1.0), "one": (1 / d, 1.0), "two": (1.0, 1 / d), "staggered": (d, 1.0)}[kind]
    lat = combine(lat, __s={"__s": before})
    got = solver(Schur(d, hop, kind), lat, "__s", "__xe", tol=tol)
    lat = combine(got.lattice, __xe={"__xe": after})
    lat = combine(hop(lat, "__xe", "__hx"), __xo={"__b": 1 / d, "__hx": -1 / d})
    lat = on_parity(lat, "__xo", 1, "__xo")
    lat = combine(lat, **{x: {"__xe": 1.0, "__xo": 1.0} | ({guess: 1.0} if guess else {})}).cut()
    lat = combine(hop(lat, x, "__hx"), __r={b: 1.0, x: -d, "__hx": -1.0})
    (rr, bb) = (z.real for z in dots(lat, [("__r", "__r"), (b, b)]))
    return Solution(lat.keep(*dict.fromkeys([*own, x])).cut(), [*got.residuals, rr], tol * tol * bb)


def scalar_hop(d: int) -> Operator:
    """Minus the sum of neighbours: with D = 2 d + m^2 the massive operator."""
    from fieldloom.operators.linear import hops

    def apply(lat: Lattice, names: dict, f: str) -> Tensor:
        total = None
        for h in hops(d):
            t = lat.t(names[(f, h)])
            total = -t if total is None else total - t
        return total

    return Operator(lambda f: [(f, h) for h in hops(d)], apply)
