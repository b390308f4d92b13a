"""Actions of a real scalar field: gradient and mass, and a quartic term."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.operators.linear import hops, unit
from fieldloom.plans.lattice import Lattice


def action(lat: Lattice, phi: str, mass2: float, coupling: float) -> float:
    """sum of ((2 d + mass2) phi^2 / 2 - sum over mu of phi(x) phi(x + mu) + coupling phi^4 / 4), over real parts."""
    d = len(lat.grid.dims)
    got, names = lat.keep(phi).gather([(phi, unit(d, mu)) for mu in range(d)])
    p = column(got.t(phi)[0, 0].re)
    ahead = sum((column(got.t(names[(phi, unit(d, mu))])[0, 0].re) for mu in range(d)), F.lit(0.0))
    return got.df.agg(F.sum(0.5 * (2 * d + mass2) * p * p - p * ahead + 0.25 * coupling * p * p * p * p)).first()[0] or 0.0


def force(lat: Lattice, phi: str, mass2: float, coupling: float, out: str = "force") -> Lattice:
    """The derivative of the action by phi at each site."""
    d = len(lat.grid.dims)
    got, names = lat.gather([(phi, h) for h in hops(d)])
    p = column(got.t(phi)[0, 0].re)
    near = sum((column(got.t(names[(phi, h)])[0, 0].re) for h in hops(d)), F.lit(0.0))
    return got.put(**{out: Tensor([C((2 * d + mass2) * p - near + coupling * p * p * p)])}).keep(*dict.fromkeys([*lat.shapes, out]))
