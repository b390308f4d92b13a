"""Gauge evolution and smoothing: smearing, flow, gauge fixing and hybrid Monte Carlo.

Everything here is a driver loop of stencil steps, each ended by a reliable checkpoint, so
that a chain restarts from its last one.  Random numbers are hashes of seed, step and
site, independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.operators import gauge
from fieldloom.operators.gauge import link
from fieldloom.operators.sites import random_fields
from fieldloom.plans.lattice import Lattice


def cold(lat: Lattice, nc: int) -> Lattice:
    one = Tensor.constant(np.eye(nc))
    return lat.put(**{link(mu): one for mu in range(len(lat.grid.dims))})


def algebra_noise(lat: Lattice, seed: int, nc: int, out: str, scale: float = 1.0) -> Lattice:
    """A gaussian antihermitian traceless matrix a site (for Nc = 1: an imaginary number)."""
    got = random_fields(lat, seed, "gaussian", "__g", (nc, nc))
    g = got.t("__g").scale(scale)
    a = (g - g.adj()).scale(0.5)
    a = Tensor([C(0.0, g[0, 0].re)]) if nc == 1 else g.ta()
    return got.put(**{out: a}).keep(*lat.shapes, out)


def hot(lat: Lattice, seed: int, nc: int, scale: float = 1.0) -> Lattice:
    """Random links by the exponential of noise; a small scale gives a tepid start."""
    for mu in range(len(lat.grid.dims)):
        lat = algebra_noise(lat, seed * 1000 + mu, nc, "__a", scale)
        lat = exponentiate(lat, **{link(mu): "__a"}).keep(*[n for n in lat.shapes if n != "__a"], link(mu)).cut()
    return lat


#: Terms of the matrix exponential's series, and squarings after it: exp(A) = exp(A / 2^n)^(2^n).
TERMS, SQUARINGS = 10, 3


def exponentiate(lat: Lattice, alpha: float = 1.0, **fields: str) -> Lattice:
    """out=name pairs: out = exp(alpha name); exact for one color, by series (Horner's scheme) beyond.

    Each term of all fields is one projection, so that expressions do not grow.
    """
    if all(lat.shapes[n] == (1, 1) for n in fields.values()):
        return lat.put(**{o: Tensor([lat.t(n)[0, 0].scale(alpha).exp()]) for o, n in fields.items()})
    one = {o: Tensor.constant(np.eye(lat.shapes[n][0])) for o, n in fields.items()}
    work = lat.put(**one)
    for k in range(TERMS, 0, -1):
        work = work.put(**{o: one[o] + (work.t(n) * work.t(o)).scale(alpha / k / 2.0**SQUARINGS) for o, n in fields.items()})
    for _ in range(SQUARINGS):
        work = work.put(**{o: work.t(o) * work.t(o) for o in fields})
    return work


def _turned(lat: Lattice, alpha: float, algebra: dict[int, str]) -> Lattice:
    """Links of the directions multiplied from the left by exp(alpha algebra field)."""
    work = exponentiate(lat, alpha, **{f"__e{mu}": n for mu, n in algebra.items()})
    return work.put(**{link(mu): work.t(f"__e{mu}") * work.t(link(mu)) for mu in algebra})


def force_direction(u: Tensor, s: Tensor) -> Tensor:
    """Traceless antihermitian part of link times staple; for one color the antihermitian part."""
    w = u * s
    return Tensor([C(0.0, w[0, 0].im)]) if w.shape == (1, 1) else w.ta()


def ape_smear(lat: Lattice, alpha: float, steps: int, dims: list[int] | None = None) -> Lattice:
    """Links plus alpha times the staples, projected back to the group, a number of times."""
    dims = list(range(len(lat.grid.dims))) if dims is None else dims
    for _ in range(steps):
        new = gauge.staples(lat, dims)
        # The staple runs from the link's end to its start: its adjoint runs along the link.
        mixed = {mu: new.t(link(mu)).scale(1.0 - alpha) + new.t(f"__s{mu}").adj().scale(alpha / (2.0 * (len(lat.grid.dims) - 1))) for mu in dims}
        new = new.put(**{f"__m{mu}": m for mu, m in mixed.items()})
        for mu in dims:
            new = gauge.project_unitary(new, f"__m{mu}", link(mu))
        lat = new.keep(*lat.shapes).cut()
    return lat


def stout_smear(lat: Lattice, rho: float, steps: int) -> Lattice:
    """exp(rho Ta(staple† U†)) U, a number of times."""
    return _flowed(lat, rho, steps)


def _flowed(lat: Lattice, rho: float, steps: int) -> Lattice:
    d = len(lat.grid.dims)
    for _ in range(steps):
        new = gauge.staples(lat, list(range(d)))
        new = new.put(**{f"__z{mu}": -force_direction(new.t(link(mu)), new.t(f"__s{mu}")) for mu in range(d)})
        lat = _turned(new, rho, {mu: f"__z{mu}" for mu in range(d)}).keep(*lat.shapes).cut()
    return lat


#: Weights of the three-stage Runge-Kutta scheme of the flow.
FLOW_STAGES = ((1 / 4, 0.0, 0.0), (8 / 9, -17 / 36, 0.0), (3 / 4, -8 / 9, 17 / 36))


def wilson_flow(lat: Lattice, epsilon: float, steps: int, measure: Callable[[float, Lattice], None] | None = None) -> Lattice:
    """Gradient flow of the plaquette action with third-order steps."""
    d = len(lat.grid.dims)
    for k in range(steps):
        work = lat
        for stage, (now, before, first) in enumerate(FLOW_STAGES):
            work = gauge.staples(work, list(range(d)))
            work = work.put(**{f"__z{stage}_{mu}": -force_direction(work.t(link(mu)), work.t(f"__s{mu}")) for mu in range(d)})
            total = {}
            for mu in range(d):
                t = work.t(f"__z{stage}_{mu}").scale(now)
                if stage == 1:
                    t = t + work.t(f"__z0_{mu}").scale(before)
                if stage == 2:
                    t = t + work.t(f"__z1_{mu}").scale(before) + work.t(f"__z0_{mu}").scale(first)
                total[f"__t{mu}"] = t
            work = work.put(**total)
            work = _turned(work, epsilon, {mu: f"__t{mu}" for mu in range(d)})
            work = work.keep(*[n for n in work.shapes if n[:3] not in ("__e", "__t", "__s")]).cut()
        lat = work.keep(*lat.shapes)
        if measure:
            measure((k + 1) * epsilon, lat)
    return lat


def energy_density(lat: Lattice) -> float:
    """2 sum over plaquettes of (1 - Re tr / Nc) Nc a site, the plaquette definition."""
    d, nc = len(lat.grid.dims), lat.shapes[link(0)][0]
    p = gauge.average_plaquette(lat).first()["average"]
    return 2.0 * nc * (1.0 - p) * d * (d - 1) / 2


def gauge_fix(lat: Lattice, alpha: float, steps: int, dims: list[int] | None = None) -> Lattice:
    """Steepest descent to Landau gauge (all dims) or Coulomb gauge (spatial dims): g = exp(alpha dA)."""
    d, nc = len(lat.grid.dims), lat.shapes[link(0)][0]
    dims = list(range(d)) if dims is None else dims
    behind = {mu: tuple(-int(k == mu) for k in range(d)) for mu in dims}
    for _ in range(steps):
        got, names = lat.gather([(link(mu), behind[mu]) for mu in dims])
        total = None
        for mu in dims:
            diff = got.t(link(mu)) - got.t(names[(link(mu), behind[mu])])
            total = diff if total is None else total + diff
        da = Tensor([C(0.0, total[0, 0].im)]) if nc == 1 else total.ta()
        got = got.put(__da=da).keep(*lat.shapes, "__da")
        got = exponentiate(got, -alpha, __g="__da").keep(*lat.shapes, "__g")
        lat = gauge.gauge_transform(got, "__g").keep(*lat.shapes).cut()
    return lat


def fixing_functional(lat: Lattice, dims: list[int] | None = None) -> float:
    """Average real trace of the links that a gauge condition maximises."""
    dims = list(range(len(lat.grid.dims))) if dims is None else dims
    nc = lat.shapes[link(0)][0]
    total = F.lit(0.0)
    for mu in dims:
        total = total + column(lat.t(link(mu)).trace()[0, 0].re)
    return lat.df.agg(F.sum(total)).first()[0] / (nc * lat.grid.volume * len(dims))


def momentum_name(mu: int) -> str:
    return f"p{mu}"


def hamiltonian(lat: Lattice, beta: float) -> float:
    """-sum tr P^2 + beta (1 - plaquette) over plaquettes, in one number."""
    d = len(lat.grid.dims)
    kinetic = F.lit(0.0)
    for mu in range(d):
        p = lat.t(momentum_name(mu))
        kinetic = kinetic - column(p.trace_product(p)[0, 0].re)
    k = lat.df.agg(F.sum(kinetic)).first()[0]
    return k + gauge.wilson_action(lat, beta).first()["action"]


def _kick(lat: Lattice, beta: float, dt: float) -> Lattice:
    d, nc = len(lat.grid.dims), lat.shapes[link(0)][0]
    new = lat
    for mu in range(d):
        new = gauge.staple(new, mu, f"__s{mu}")
    w = beta / (2.0 * nc)
    return new.put(**{momentum_name(mu): new.t(momentum_name(mu)) - force_direction(new.t(link(mu)), new.t(f"__s{mu}")).scale(w * dt) for mu in range(d)}).keep(*lat.shapes).cut()


def _drift(lat: Lattice, dt: float) -> Lattice:
    d = len(lat.grid.dims)
    return _turned(lat, dt, {mu: momentum_name(mu) for mu in range(d)}).keep(*lat.shapes)


#: Fixed value: the parameter of the second-order minimum-norm scheme.
LAMBDA = 0.1931833275037836


def integrate(lat: Lattice, beta: float, length: float, steps: int, scheme: str = "leapfrog") -> Lattice:
    """Molecular dynamics by leapfrog or by the second-order minimum-norm scheme."""
    dt = length / steps
    for _ in range(steps):
        if scheme == "leapfrog":
            lat = _kick(_drift(_kick(lat, beta, dt / 2), dt), beta, dt / 2)
        else:
            lat = _kick(_drift(_kick(lat, beta, LAMBDA * dt), dt / 2), beta, (1 - 2 * LAMBDA) * dt)
            lat = _kick(_drift(lat, dt / 2), beta, LAMBDA * dt)
    return lat


@dataclass
class Trajectory:
    lattice: Lattice
    accepted: bool
    delta_h: float


def hmc_trajectory(lat: Lattice, beta: float, seed: int, number: int, length: float = 1.0, steps: int = 10, scheme: str = "leapfrog") -> Trajectory:
    """Fresh momenta, molecular dynamics and a Metropolis test whose draw is a hash of seed and number."""
    links, d, nc = list(lat.shapes), len(lat.grid.dims), lat.shapes[link(0)][0]
    work = lat
    for mu in range(d):
        work = algebra_noise(work, (seed * 1_000_003 + number) * 16 + mu, nc, momentum_name(mu), 2.0**-0.5 if nc == 1 else 1.0)
    work = work.cut()
    before = hamiltonian(work, beta)
    after_lat = integrate(work, beta, length, steps, scheme)
    delta = hamiltonian(after_lat, beta) - before
    draw = np.random.default_rng([seed, number]).random()
    accepted = bool(draw < np.exp(min(0.0, -delta)))
    return Trajectory(after_lat.keep(*links).cut() if accepted else lat, accepted, float(delta))


def run_chain(lat: Lattice, beta: float, seed: int, trajectories: int, observe: list[Callable[[int, Lattice], None]] | None = None, save: Callable[[int, Lattice], None] | None = None, interval: int = 1, **how) -> tuple[Lattice, list[Trajectory]]:
    """Trajectories with observables after each and a checkpointer every ``interval``."""
    log = []
    for n in range(trajectories):
        t = hmc_trajectory(lat, beta, seed, n, **how)
        lat = t.lattice
        log.append(t)
        for f in observe or []:
            f(n, lat)
        if save and (n + 1) % interval == 0:
            save(n, lat)
    return lat, log


#: Proposals of a site's heat bath; a site that accepts none keeps its link, as in any accept-reject step.
TRIALS = 12


def heat_bath(lat: Lattice, beta: float, seed: int, sweep: int) -> Lattice:
    """One sweep over directions, parities and SU(2) subgroups by the Kennedy-Pendleton method.

    Uniform numbers are hashes of seed, sweep, step, site and trial.
    """
    from fieldloom.functions.groups import su2_extract, su2_insert, su2_subgroups

    d, nc = len(lat.grid.dims), lat.shapes[link(0)][0]
    site, step = lat.grid.site(), 0
    for mu in range(d):
        for parity in (0, 1):
            work = gauge.staple(lat, mu, "__s").cut()
            for pair in su2_subgroups(nc):
                step += 1

                def uniform(draw: int, step: int = step):
                    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(sweep), F.lit(step), site, F.lit(draw)), 11).cast("double") + 0.5) * 2.0**-53

                work = work.put(__w=work.t(link(mu)) * work.t("__s"))
                a, b = su2_extract(work.t("__w"), pair)
                work = work.put(__a=Tensor([a, b], (2, 1)))
                a, b = work.t("__a").items
                work = work.put(__k=Tensor([C(F.sqrt(column(a.norm2()) + column(b.norm2())))]))
                size, tries = F.col("__k_0_re"), []
                for t in range(TRIALS):
                    delta = -(F.log(uniform(4 * t)) + F.pow(F.cos(2 * np.pi * uniform(4 * t + 1)), 2.0) * F.log(uniform(4 * t + 2))) / (2.0 * beta / nc * size)
                    tries.append(F.when(F.pow(uniform(4 * t + 3), 2.0) <= 1.0 - delta / 2.0, 1.0 - delta))
                work = work.put(__x=Tensor([C(F.coalesce(*tries, F.lit(2.0)))]))
                x0 = F.col("__x_0_re")
                radius = F.sqrt(F.greatest(1.0 - x0 * x0, F.lit(0.0)))
                z, angle = 2.0 * uniform(1001) - 1.0, 2.0 * np.pi * uniform(1002)
                flat = F.sqrt(1.0 - z * z)
                # The new part times the inverse of w / |w|: (x0 + i x.sigma) w† / |w|.
                work = work.put(__n=Tensor([C(x0, radius * z), C(radius * flat * F.sin(angle), radius * flat * F.cos(angle))], (2, 1)))
                p, r = work.t("__n").items
                a, b = work.t("__a").items
                top = C(column((p * a.conj() + r * b.conj()).re) / size, column((p * a.conj() + r * b.conj()).im) / size)
                off = r * a - p * b
                side = C(column(off.re) / size, column(off.im) / size)
                new = work.put(__g=su2_insert(top, side, pair, nc))
                moved = new.t("__g") * new.t(link(mu))
                here = (lat.grid.parity() == parity) & (x0 <= 1.0) & (size > 1e-12)
                kept = new.t(link(mu))
                work = new.put(**{link(mu): Tensor([C(F.when(here, m.re).otherwise(o.re), F.when(here, m.im).otherwise(o.im)) for m, o in zip(moved.items, kept.items, strict=True)], kept.shape)}).keep(*lat.shapes, "__s").cut()
            lat = work.keep(*lat.shapes)
    return lat
