"""Discrete Fourier transforms along dimensions of a lattice.

A group holds whole lines of sites, as many as fit a fixed size, and at least one, whose
length is the grid's extent; the transform of its lines is numpy's.  Forward is unnormalised with
sign -1, backward divides by the extent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor
from fieldloom.plans.lattice import Lattice


#: Sites to a group of lines at most, unless one line is longer.
GROUP = 50_000


def _lines(lat: Lattice, name: str, dims: list[int], backward: bool = False) -> Lattice:
    """One field transformed along some dimensions at once; many lines (planes, ...) lie in one group."""
    keys, cols = lat.grid.keys, lat.columns(name)
    rest = [k for k in range(len(keys)) if k not in dims]
    size, line = [lat.grid.dims[k] for k in dims[::-1]], F.lit(0).cast("long")
    for k in rest[::-1]:
        line = line * lat.grid.dims[k] + F.col(keys[k])
    df = lat.keep(name).df.select(*keys, *cols)
    schema = df.schema
    order = [f"x{k}" for k in [*dims, *rest]]
    f = np.fft.ifftn if backward else np.fft.fftn

    def group(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort([t.column(k).to_numpy() for k in order])))
        out = {k: t.column(k) for k in keys}
        for a, b in zip(cols[::2], cols[1::2], strict=True):
            z = t.column(a).to_numpy() + 1j * t.column(b).to_numpy()
            z = f(z.reshape(-1, *size), axes=range(1, len(size) + 1)).ravel()
            out |= {a: pa.array(z.real), b: pa.array(z.imag)}
        return pa.table(out)

    together = max(1, GROUP // int(np.prod(size)))
    done = df.withColumn("__g", F.floor(line / together)).groupBy("__g").applyInArrow(group, schema)
    return Lattice(done, lat.grid, {name: lat.shapes[name]})


def fft_dim(lat: Lattice, name: str, mu: int, backward: bool = False) -> Lattice:
    """One field transformed along one dimension."""
    return _lines(lat, name, [mu], backward)


def fft(lat: Lattice, name: str, dims: list[int] | None = None, backward: bool = False) -> Lattice:
    """All dimensions, or a mask of them: as many at once as fit a group, one shuffle for each such set."""
    out, now = lat.keep(name), []
    for mu in range(len(lat.grid.dims)) if dims is None else dims:
        if now and np.prod([lat.grid.dims[k] for k in [*now, mu]]) > GROUP:
            out, now = _lines(out, name, now, backward), []
        now.append(mu)
    return _lines(out, name, now, backward) if now else out


def momentum(lat: Lattice, mu: int) -> Column:
    return F.col(f"x{mu}") * (2 * np.pi / lat.grid.dims[mu])


def khat2(lat: Lattice, dims: list[int] | None = None) -> Column:
    """sum over mu of (2 sin(k_mu / 2))^2."""
    total = F.lit(0.0)
    for mu in range(len(lat.grid.dims)) if dims is None else dims:
        total = total + F.pow(2.0 * F.sin(momentum(lat, mu) / 2.0), F.lit(2.0))
    return total


def free_scalar(lat: Lattice, name: str, mass: float) -> Lattice:
    """(-Laplacian + mass^2)^-1 by two transforms; without mass the zero mode is taken off."""
    k = fft(lat, name)
    d = khat2(k) + mass * mass
    k = k.put(**{name: k.t(name).map(lambda c: C(F.when(d == 0, 0.0).otherwise(c.re / d), F.when(d == 0, 0.0).otherwise(c.im / d)))})
    return fft(k, name, backward=True)


def photon_weight(lat: Lattice, scheme: str = "qedL") -> Column:
    """1 / khat^2 without the zero modes: of each time slice (qedL) or of the lattice (qedTL)."""
    space = range(len(lat.grid.dims) - (1 if scheme == "qedL" else 0))
    zero = F.lit(True)
    for mu in space:
        zero = zero & (F.col(f"x{mu}") == 0)
    return F.when(zero, 0.0).otherwise(1.0 / khat2(lat))


def photon_field(lat: Lattice, seed: int, scheme: str = "qedL", out: str = "a") -> Lattice:
    """A stochastic photon field in momentum space: gaussian noise times the root of the weight, one component a direction."""
    from fieldloom.operators.sites import random_fields

    got = random_fields(lat, seed, "gaussian", out, (len(lat.grid.dims), 1))
    w = F.sqrt(photon_weight(got, scheme))
    return got.put(**{out: got.t(out).scale(w)})


def gauge_projected(lat: Lattice, name: str) -> Lattice:
    """Feynman field projected to Coulomb gauge in momentum space: spatial part less its longitudinal part, no time part."""
    d = len(lat.grid.dims)
    sines = [2.0 * F.sin(momentum(lat, mu) / 2.0) for mu in range(d - 1)]
    k2 = khat2(lat, list(range(d - 1)))
    a = lat.t(name)
    along_re = sum((sines[mu] * a.items[mu].re for mu in range(d - 1)), F.lit(0.0))
    along_im = sum((sines[mu] * a.items[mu].im for mu in range(d - 1)), F.lit(0.0))

    def part(mu: int) -> C:
        if mu == d - 1:
            return C(F.lit(0.0), F.lit(0.0))
        w = F.when(k2 == 0, 0.0).otherwise(sines[mu] / k2)
        return C(a.items[mu].re - w * along_re, a.items[mu].im - w * along_im)

    return lat.put(**{name: Tensor([part(mu) for mu in range(d)], (d, 1))})
