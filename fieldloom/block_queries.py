"""Registered queries on packed blocks: halo stencils, clover Schur solves, coarse operator, deflation, block Lanczos.

They register beside those of ``fieldloom.queries``.  What a solver solves is made by the
operators on site tables, so that its SQL, the field it must find, tests both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom import more_queries as more
from fieldloom import queries as base
from fieldloom.functions.tensors import C, Tensor
from fieldloom.operators import checkerboard, coherence, dynamics, fermions, gauge, halo, krylov, linear, multigrid, sites
from fieldloom.plans.blocks import Blocks, Shape
from fieldloom.plans.lattice import Grid, Lattice
from fieldloom.queries import EV, HOPS, _stencil_sql, keys, parts, q, query, r
from fieldloom.sources.tables import abelian_lattice, events_lattice, filled, table

LINKS = ["u0", "u1", "u2"]
#: Extents of a block of the events lattice; its third extent is a multiple of ten.
BLOCK = (5, 5, 10)


def _cells(lat: Lattice, name: str, digits: int):
    return lat.df.select(*keys(lat), *parts(lat.t(name), digits=digits))


@query(base.SQL["wilson_hop"])
def halo_wilson_hop(spark, sf_dir):
    """The Wilson hop by half spinors of surfaces; no link moves."""
    b = Blocks.pack(more._spinor_lattice(spark, sf_dir), BLOCK)
    return _cells(b.stencil(halo.wilson_hop(3, LINKS, "psi", "m", 1)).unpack("m"), "m", 5)


@query(base.SQL["twisted_mass"])
def halo_twisted_mass(spark, sf_dir):
    b = Blocks.pack(more._spinor_lattice(spark, sf_dir), BLOCK)
    return _cells(b.stencil(halo.wilson(3, LINKS, "psi", "m", 1, 0.1, twist=0.25)).unpack("m"), "m", 5)


@query(base.SQL["laplacian"])
def halo_laplacian(spark, sf_dir):
    b = Blocks.pack(events_lattice(spark, sf_dir).keep("v"), BLOCK)
    got = b.stencil(halo.laplacian(3, "v", "l", b.shapes["v"])).unpack("l")
    return got.df.select(*keys(got), r(-F.col("l_0_re"), 4).alias("re"), r(-F.col("l_0_im"), 4).alias("im"))


@query(base.SQL["covariant_laplacian"])
def halo_covariant_laplacian(spark, sf_dir):
    b = Blocks.pack(abelian_lattice(spark, sf_dir), BLOCK)
    got = b.stencil(halo.covariant_laplacian(3, LINKS, "v", "l", b.shapes["v"], 0.5)).unpack("l")
    return got.df.select(*keys(got), r(F.col("l_0_re"), 4).alias("re"))


#: The field v that solvers must find.
FOUND = "SELECT (event_id % 10)::BIGINT AS x0, ((event_id // 10) % 10)::BIGINT AS x1, (event_id // 100)::BIGINT AS x2, round(value, 3) + 0.0 AS c0_re, round(event_id % 7 - 3, 3) + 0.0 AS c0_im FROM events"


@query(FOUND)
def halo_conjugate_gradient(spark, sf_dir):
    """Links lie beside the vectors; an iteration moves surfaces alone."""
    lat = abelian_lattice(spark, sf_dir)
    b = Blocks.pack(linear.covariant_laplacian(3, LINKS, 6.0)(lat, "v", "b").keep("b", *LINKS), BLOCK)
    x, _, done = halo.conjugate_gradient(lambda s, o: halo.covariant_laplacian(3, LINKS, s, o, b.shapes["b"], 6.0), b, "b", b.keep(*LINKS), tol=1e-9)
    if not done:
        raise ArithmeticError("not converged")
    return _cells(x.unpack("x"), "x", 3)


def _su2_lattice(spark, sf_dir) -> Lattice:
    """The embeddings as a [10, N / 10] lattice: SU(2) links from their first 16 numbers and a spinor of two colors from the next.

    Sites past the last row fill its block, with unit links and no spinor.
    """
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = df.count()
    grid = Grid((10, 10 * -(-rows // 100)))
    at = lambda k: C(F.get("embedding", F.lit(2 * k)).cast("double"), F.get("embedding", F.lit(2 * k + 1)).cast("double"))
    lat = Lattice.of(df, grid, "vec_id", m0=Tensor([at(k) for k in range(4)], (2, 2)), m1=Tensor([at(4 + k) for k in range(4)], (2, 2)), psi=Tensor([at(8 + k) for k in range(8)], (4, 2)))
    lat = filled(lat, rows, ("m0", "m1"))
    return gauge.project_unitary(gauge.project_unitary(lat, "m0", "u0"), "m1", "u1").keep("u0", "u1", "psi")


def _su2_found(spark, sf_dir, lat: Lattice):
    """The solution at the sites that are rows of the table."""
    return _cells(Lattice(lat.df.filter(lat.grid.site() < table(spark, sf_dir, "embeddings").count()), lat.grid, lat.shapes), "x", 4)


#: The spinor of that lattice.
SU2_FOUND = "SELECT (vec_id % 10)::BIGINT AS x0, (vec_id // 10)::BIGINT AS x1, " + ", ".join(q(f"embedding[{16 + 2 * k + p + 1}]::DOUBLE", f"c{k}_{('re', 'im')[p]}", 4) for k in range(8) for p in (0, 1)) + " FROM embeddings"


def _clover_schur(spark, sf_dir, kind: str, solver: str, mass: float = 5.0, csw: float = 1.0):
    """The source is the clover matrix on site tables; the solve eliminates the odd sites on blocks."""
    links = ("u0", "u1")
    lat = gauge.clover(_su2_lattice(spark, sf_dir).cut(), 0, 1, "f01").cut()
    b = Blocks.pack(fermions.clover_wilson(2, links, mass, csw)(lat, "psi", "b").keep("u0", "u1", "f01", "b"), (10, 10))
    fixed = checkerboard.site_matrices(b, checkerboard.clover_term(2, 2, mass, csw, ["f01"]), ["f01"], 8).keep(*links, "d0", "d1", "i0", "i1").cut()
    got = checkerboard.red_black_solve(checkerboard.EvenOddWilson(2, links, 2, fixed), b, "b", kind, solver, 1e-7)
    if not got.converged:
        raise ArithmeticError("not converged")
    return _su2_found(spark, sf_dir, got.blocks.unpack("x"))


@query(SU2_FOUND)
def clover_schur_mooee(spark, sf_dir):
    return _clover_schur(spark, sf_dir, "mooee", "normal_cg")


@query(SU2_FOUND)
def clover_schur_one(spark, sf_dir):
    """Through the adjoint of ``one``, which has the form of ``two``."""
    return _clover_schur(spark, sf_dir, "one", "normal_cg")


@query(SU2_FOUND)
def clover_schur_two(spark, sf_dir):
    return _clover_schur(spark, sf_dir, "two", "bicgstab")


@query(SU2_FOUND)
def clover_schur_non_hermitian(spark, sf_dir):
    """The complement alone, which is not hermitian."""
    return _clover_schur(spark, sf_dir, "one", "bicgstab")


_SIZE = "bn AS (SELECT x0 // 5 AS b0, x1 // 5 AS b1, x2 // 10 AS b2, sum(re * re + im * im) AS n FROM e GROUP BY 1, 2, 3)"
_PHI = "b AS (SELECT x0, x1, x2, re / sqrt(n) * (1 + b0 + 2 * b1 + 0.5 * b2) AS fr, im / sqrt(n) * (1 + b0 + 2 * b1 + 0.5 * b2) AS fi FROM e JOIN bn ON b0 = x0 // 5 AND b1 = x1 // 5 AND b2 = x2 // 10)"


@query(
    f"WITH {EV}, {HOPS}, {_SIZE}, {_PHI}, {_stencil_sql('l', 'b', 6.5, -1.0)} "
    f"SELECT b0::BIGINT AS x0, b1::BIGINT AS x1, b2::BIGINT AS x2, {q('sum(re * fr + im * fi) / sqrt(any_value(n))', 'c0_re', 6)}, {q('sum(re * fi - im * fr) / sqrt(any_value(n))', 'c0_im', 6)} "
    "FROM e JOIN l USING (x0, x1, x2) JOIN bn ON b0 = x0 // 5 AND b1 = x1 // 5 AND b2 = x2 // 10 GROUP BY b0, b1, b2"
)
def coarse_operator(spark, sf_dir):
    """P† A P on coarse coefficients by the table of coarse links; SQL promotes, applies A and projects."""
    b = Blocks.pack(events_lattice(spark, sf_dir).keep("v"), BLOCK)
    b = b.local(lambda x, site: {"basis": x["v"] / np.sqrt(halo.inner(x["v"], x["v"]).real)[:, None, None, None]}, ("v",), {"basis": b.shapes["v"]}).keep("basis").cut()
    a = lambda s, o, shape: halo.laplacian(3, s, o, shape, 0.5)
    around = multigrid.neighbours(b.geometry, a("basis", "_", b.shapes["basis"]))
    c = b.local(lambda x, site: {"c": (1 + site.keys @ [1.0, 2.0, 0.5])[:, None]}, ("basis",), {"c": Shape((1,), None, True)}).keep("c")
    names = [f"l{j}" for j in range(len(around))]
    coarse = multigrid.coarse_links(a, b).join(c.cut()).coarsened([*names, "c"], (2, 2, 1))
    return _cells(coarse.stencil(multigrid.coarse_stencil(around, "c", "y", 1)).unpack("y"), "y", 6)


@query(FOUND)
def deflated_conjugate_gradient(spark, sf_dir):
    """Conjugate gradients with a coarse solve in each iteration, the coarse space made of smoothed random vectors."""
    lat = abelian_lattice(spark, sf_dir)
    b = Blocks.pack(linear.massive(3, 2.0)(lat.keep("v"), "v", "b"), BLOCK)
    a = lambda s, o, shape: halo.laplacian(3, s, o, shape, 2.0)
    fixed = multigrid.near_null(a, b, "b", 2, 14.0, 4).keep("basis").cut()
    around = multigrid.neighbours(fixed.geometry, a("basis", "_", fixed.shapes["basis"]))
    solver = multigrid.CoarseSolver(multigrid.coarse_links(a, fixed), around)
    x, _, done = multigrid.deflated_cg(a, b, "b", fixed, solver, tol=1e-8)
    if not done:
        raise ArithmeticError("not converged")
    return _cells(x.unpack("x"), "x", 3)


@query(more.SQL_BLOCK_LANCZOS)
def lanczos_block(spark, sf_dir):
    """Both ends of the spectrum of the massive operator by blocks of three starts through filters, to a tolerance."""
    lat, d = more._start(spark, sf_dir)
    lat = sites.random_fields(lat.put(g=lat.t("f").conj()), 4, "uniform", "w")
    lat = lat.put(s=Tensor([*lat.t("f").items, *lat.t("g").items, *lat.t("w").items], (1, 3))).keep("s")
    b, degree = more._slabs(lat)
    got = krylov.extremes(lambda s, o, shape: halo.laplacian(d, s, o, shape, 1.0), b, "s", tol=1e-4, degree=degree)
    return spark.createDataFrame([(round(float(got.values[0]), 3), round(float(got.values[-1]), 3))], "lowest double, highest double")


@query(SU2_FOUND)
def solve_ca_gmres(spark, sf_dir):
    """The twisted Wilson operator, which is not hermitian, on SU(2) links; four applications an exchange."""
    links = ["u0", "u1"]
    lat = fermions.wilson(2, links, 1.0, twist=0.3)(_su2_lattice(spark, sf_dir), "psi", "b").keep(*links, "b")
    b = Blocks.pack(lat, (10, 10))
    got = krylov.ca_gmres(lambda s, o: halo.wilson(2, links, s, o, 2, 1.0, twist=0.3), b, "b", s=4, restart=16, tol=1e-7)
    if not got.converged:
        raise ArithmeticError("not converged")
    return _su2_found(spark, sf_dir, got.blocks.unpack("x"))


@query(f"WITH m AS ({more._MODES.replace('SELECT DISTINCT', 'SELECT')}), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM m) SELECT k::BIGINT AS k, round(v, 3) + 0.0 AS v FROM o WHERE k < 3")
def lanczos_local_coherence(spark, sf_dir):
    """The lowest modes, with multiplicity, of the covariant Laplacian on links that turn the embeddings' phases away.

    Such links are a change of gauge, so the spectrum is that of the free operator.
    """
    lat, d = more._start(spark, sf_dir)
    links = [f"u{mu}" for mu in range(d)]
    angle = lat.t("f")[0, 0].re
    lat = lat.put(g=Tensor([C(F.cos(angle), F.sin(angle))])).cut()
    lat, names = lat.gather([("g", linear.unit(d, mu)) for mu in range(d)])
    lat = lat.put(**{u: lat.t("g") * lat.t(names["g", linear.unit(d, mu)]).conj() for mu, u in enumerate(links)}).keep("f", *links)
    lat = sites.random_fields(sites.random_fields(lat, 4, "uniform", "w"), 5, "uniform", "z")
    lat = lat.put(s=Tensor([*lat.t("f").items, *lat.t("w").items, *lat.t("z").items], (1, 3))).keep("s", *links)
    b = Blocks.pack(lat, (5, 5, next(n for n in (5, 4, 3, 2, 1) if lat.grid.dims[2] % n == 0)))
    a = lambda s, o, shape: halo.covariant_laplacian(d, links, s, o, shape, 1.0)
    got = coherence.local_coherence(a, b, "s", 4, 3, 4.0 * d + 1.0, degree=16, spare=3, tol=2e-3, fixed=b.keep(*links).cut())
    return spark.createDataFrame([(k, round(float(v), 3) + 0.0) for k, v in enumerate(got.values)], "k long, v double")


@query(base.SQL["staple_u1"])
def halo_gauge_force(spark, sf_dir):
    """The plaquette action's force on all links; freed of its link, that of direction 0 is the staple."""
    b = Blocks.pack(abelian_lattice(spark, sf_dir).keep(*LINKS), BLOCK)
    b = b.stencil(dynamics.Plaquettes(3, 1, 1.0).stencil(LINKS, "f"))
    b = b.local(lambda x, site: {"v": -np.conj(x["u0"]) * x["f"][:, :, 0]}, ("u0", "f"), {"v": Shape((1, 1))})
    got = b.unpack("v")
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("re"), r(F.col("v_0_im")).alias("im"))
