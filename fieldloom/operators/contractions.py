"""Contractions of fields to correlators: mesons, all-to-all vectors, baryons.

All sum over space per time slice in one aggregation; vectors of a set are columns of one
wide table, so that pairs of them never make rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.spin import times
from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.plans.lattice import Lattice


def _by_time(lat: Lattice, time: int, values: dict[str, C]) -> DataFrame:
    sums = [F.sum(column(x)).alias(f"{n}_{p}") for n, c in values.items() for p, x in (("re", c.re), ("im", c.im))]
    return lat.df.groupBy(F.col(f"x{time}").alias("t")).agg(*sums)


def _phase(lat: Lattice, momentum: tuple[int, ...], time: int) -> C:
    angle: Column = F.lit(0.0)
    space = [k for k in range(len(lat.grid.dims)) if k != time]
    for n, k in zip(momentum, space, strict=True):
        angle = angle + F.col(f"x{k}") * (2 * np.pi * n / lat.grid.dims[k])
    return C(F.cos(angle), F.sin(angle))


def meson_field(lat: Lattice, left: list[str], right: list[str], gammas: dict[str, np.ndarray], time: int, momenta: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Rows (t, i, j, gamma, p, re, im): sum over space of e^{ipx} left_i† Gamma right_j."""
    n_space = len(lat.grid.dims) - 1
    momenta = momenta or [(0,) * n_space]
    values, labels = {}, []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            for g, m in gammas.items():
                v = lat.t(a).inner(times(m, lat.t(b)) if lat.shapes[b][0] == 4 else lat.t(b))
                for p, k in enumerate(momenta):
                    name = f"m{len(labels)}"
                    values[name] = v * _phase(lat, k, time) if any(k) else v
                    labels.append((i, j, g, p, name))
    wide = _by_time(lat, time, values)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(g).alias("gamma"), F.lit(p).alias("p"), F.col(f"{n}_re").alias("re"), F.col(f"{n}_im").alias("im")) for i, j, g, p, n in labels])
    return wide.select("t", F.explode(rows).alias("r")).select("t", "r.*")


def meson_two_point(lat: Lattice, prop: str, time: int) -> DataFrame:
    """Pseudoscalar correlator: sum over space of tr(S S†)."""
    return lat.df.groupBy(F.col(f"x{time}").alias("t")).agg(F.sum(lat.t(prop).norm2()).alias("re"))


def column_of(prop: Tensor, spin: int, color: int, nc: int = 3) -> Tensor:
    """The (spin, color) source column of a (4 nc)^2 propagator as a spinor of 4 x nc."""
    n = spin * nc + color
    return Tensor([prop[r, n] for r in range(4 * nc)], (4, nc))


def with_column(prop: Tensor, spinor: Tensor, spin: int, color: int, nc: int = 3) -> Tensor:
    n = spin * nc + color
    return Tensor.build(prop.shape, lambda r, c: spinor.items[r] if c == n else prop[r, c])


#: The six signed permutations of three colors.
EPSILON = tuple((p, 1 if p in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) else -1) for p in permutations(range(3)))


def baryon(lat: Lattice, quarks: tuple[str, str, str], diquark: np.ndarray, parity: np.ndarray, time: int) -> DataFrame:
    """Baryon two-point function of three color-spin propagators (12 x 12, spin outer), by numpy contraction in Arrow batches.

    eps eps' tr[P q1] tr[q2 G q3^T G~] less the exchange of the first two quarks, whose ends
    at the source keep their colors; summed
    over space per time slice; partial sums leave each batch, not sites.
    """
    eps = np.zeros((3, 3, 3))
    for p, s in EPSILON:
        eps[p] = s
    names = [c for q in quarks for c in lat.columns(q)]
    bar = diquark.conj()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            a = np.stack([b.column(k + 1).to_numpy() for k in range(len(names))], 1)
            z = (a[:, ::2] + 1j * a[:, 1::2]).reshape(-1, 3, 4, 3, 4, 3)
            q1, q2, q3 = z[:, 0], z[:, 1], z[:, 2]
            # q[n, s, c, s', c']: sink spin and color, source spin and color.
            pair = np.einsum("abc,def,ij,niakd,njble,kl->ncf", eps, eps, diquark, q2, q3, bar, optimize=True)
            direct = np.einsum("ncf,nscuf,us->n", pair, q1, parity, optimize=True)
            cross = np.einsum("abc,def,ij,niauf,njbke,nsckd,us->n", eps, eps, diquark, q1, q3, np.einsum("nscld,lk->nsckd", q2, bar), parity, optimize=True)
            v = direct - cross
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.real), pa.array(v.imag)], names=["t", "re", "im"])

    each = lat.df.select(F.col(f"x{time}").alias("t"), *names).mapInArrow(run, "t int, re double, im double")
    return each.groupBy("t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
