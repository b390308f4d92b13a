"""Pseudofermions, rational functions of operators and mixed precision, on top of the solvers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from fieldloom.operators import fermions, linear
from fieldloom.operators.linear import Operator, Solution, combine, dots
from fieldloom.operators.sites import random_fields
from fieldloom.plans.lattice import Lattice


def apply_rational(a: Operator, lat: Lattice, b: str, norm: float, residues: Sequence[float], shifts: Sequence[float], out: str, tol: float = 1e-8) -> Lattice:
    """norm b + sum residue_k (A + shift_k)^-1 b from one Krylov space."""
    got = linear.multishift(a, lat, b, shifts, tol).lattice
    return combine(got, **{out: {b: norm} | {f"x{k}_s": w for k, w in enumerate(residues)}}).keep(*dict.fromkeys([*lat.shapes, out]))


def pseudofermion_refresh(lat: Lattice, m_dagger: Operator, seed: int, shape: tuple[int, int], out: str = "phi") -> tuple[Lattice, float]:
    """phi = M† eta for gaussian noise eta (variance 1/2 a part), and its action eta† eta."""
    got = random_fields(lat, seed, "gaussian", "__eta", shape)
    got = m_dagger(combine(got, __eta={"__eta": 2.0**-0.5}).cut(), "__eta", out)
    return got.keep(*dict.fromkeys([*lat.shapes, out])).cut(), dots(got, [("__eta", "__eta")])[0].real


def pseudofermion_action(lat: Lattice, m: Operator, m_dagger: Operator, phi: str, tol: float = 1e-8) -> float:
    """phi† (M† M)^-1 phi."""
    got = linear.conjugate_gradient(fermions.normal(m, m_dagger), lat, phi, "__x", tol).lattice
    return dots(got, [(phi, "__x")])[0].real


def to_single(lat: Lattice, *names: str) -> Lattice:
    """Fields rounded to single precision (kept in double columns)."""
    return replace(lat, df=lat.df.withColumns({c: F.col(c).cast("float").cast("double") for n in names for c in lat.columns(n)}))


def mixed_precision_cg(a: Operator, lat: Lattice, b: str, x: str = "x", tol: float = 1e-8, inner: float = 1e-3, most: int = 20) -> Solution:
    """Outer defect correction in double precision around inner solves of rounded residuals."""
    own = list(lat.shapes)
    lat = combine(lat, **{x: {b: 0.0}, "__d": {b: 1.0}}).cut()
    history = [dots(lat, [("__d", "__d")])[0].real]
    goal = tol * tol * history[0]
    while history[-1] > goal and len(history) <= most:
        lat = linear.conjugate_gradient(a, to_single(lat, "__d"), "__d", "__e", inner).lattice
        lat = a(combine(lat, **{x: {x: 1.0, "__e": 1.0}}), x, "__ax")
        lat = combine(lat, __d={b: 1.0, "__ax": -1.0}).cut()
        history.append(dots(lat, [("__d", "__d")])[0].real)
    return Solution(lat.keep(*dict.fromkeys([*own, x])), history, goal)
