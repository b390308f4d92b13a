"""More registered lattice queries: fermions, Schur solves, solvers, files, groups, smearing, logic.

They register beside those of ``fieldloom.queries``.  A solver's query solves for a field of
the table that its source was made from, so its SQL is the table itself: a true residual.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom import queries as base
from fieldloom.functions import groups, predicates, spin
from fieldloom.functions import tensors as T
from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.operators import evolution, fermions, fourier, gauge, halo, krylov, linear, reductions, scalar, schur, sites, solvers
from fieldloom.plans.blocks import Blocks
from fieldloom.plans.lattice import Grid, Lattice
from fieldloom.queries import _A, _B, _CC, _D, EV, PI2, SITE, XYZ, _loop_sql, _m, _psi, _staple_sql, _tensor_query, keys, moved, parts, q, query, r
from fieldloom.sources.tables import abelian_lattice, events_lattice, filled, matrix_lattice, table

# ---- tensors ---------------------------------------------------------------------------------


def _z(k: int, part: int, mu: int = 0) -> str:
    return _m(mu, k, part)


def _cells(cells: list[tuple[str, str]], digits: int = 6) -> str:
    return "SELECT " + SITE + ", " + ", ".join(q(x, f"c{k}_{p}", digits) for k, z in enumerate(cells) for p, x in zip(("re", "im"), z, strict=True)) + " FROM embeddings"


@query(_cells([(_z(2 * j + i, 0), _z(2 * j + i, 1)) for i in range(2) for j in range(2)]))
def transpose(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0").transpose())


@query(_cells([(_z(k, 1), "-" + _z(k, 0)) for k in range(4)] + [(_z(k, 0), "-" + _z(k, 1)) for k in range(4)]))
def times_minus_i_conjugate(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: Tensor([x.times_minus_i() for x in t.t("m0").items] + t.t("m0").conj().items, (8, 1)))


@query(base.SQL["ta_project_2x2"])
def sp_ta_2x2(spark, sf_dir):
    """The algebra of Sp(2) is that of SU(2): both projections agree."""
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0").sp_ta())


_N0 = f"sqrt({' + '.join(f'{_z(k, p)} * {_z(k, p)}' for k in (0, 1) for p in (0, 1))})"


@query(_cells([(f"{_z(0, 0)} / {_N0}", f"{_z(0, 1)} / {_N0}"), (f"{_z(1, 0)} / {_N0}", f"{_z(1, 1)} / {_N0}"), (f"-{_z(1, 0)} / {_N0}", f"{_z(1, 1)} / {_N0}"), (f"{_z(0, 0)} / {_N0}", f"-{_z(0, 1)} / {_N0}")]))
def project_on_sp_2x2(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: T.project_on_sp(t.t("m0")))


_C = [f"(({_z(0, 0)} * {_z(2, 0)} + {_z(0, 1)} * {_z(2, 1)} + {_z(1, 0)} * {_z(3, 0)} + {_z(1, 1)} * {_z(3, 1)}) / ({_N0} * {_N0}))", f"(({_z(0, 0)} * {_z(2, 1)} - {_z(0, 1)} * {_z(2, 0)} + {_z(1, 0)} * {_z(3, 1)} - {_z(1, 1)} * {_z(3, 0)}) / ({_N0} * {_N0}))"]
_R1 = [(f"({_z(2 + k, 0)} - ({_C[0]} * {_z(k, 0)} - {_C[1]} * {_z(k, 1)}))", f"({_z(2 + k, 1)} - ({_C[0]} * {_z(k, 1)} + {_C[1]} * {_z(k, 0)}))") for k in range(2)]
_N1 = "sqrt(" + " + ".join(f"{x} * {x}" for z in _R1 for x in z) + ")"


@query(_cells([(f"{_z(k, 0)} / {_N0}", f"{_z(k, 1)} / {_N0}") for k in range(2)] + [(f"{a} / {_N1}", f"{b} / {_N1}") for a, b in _R1], 5))
def project_on_group_2x2(spark, sf_dir):
    lat = gauge.project_unitary(matrix_lattice(spark, sf_dir), "m0", "g")
    return lat.df.select(lat.grid.site().alias("site"), *parts(lat.t("g"), digits=5))


def _product(a: int, b: int) -> tuple[str, str]:
    """Element a of m0 times element b of m1."""
    return f"({_z(a, 0)} * {_z(b, 0, 1)} - {_z(a, 1)} * {_z(b, 1, 1)})", f"({_z(a, 0)} * {_z(b, 1, 1)} + {_z(a, 1)} * {_z(b, 0, 1)})"


def _plus(*zs: tuple[str, str]) -> tuple[str, str]:
    return "(" + " + ".join(z[0] for z in zs) + ")", "(" + " + ".join(z[1] for z in zs) + ")"


@query(_cells([_plus(_product(0, 0), _product(1, 2), _product(2, 1), _product(3, 3))]))
def trace_product(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0").trace_product(t.t("m1")))


@query(_cells([_plus((_z(2 * i + j, 0, 2), _z(2 * i + j, 1, 2)), _product(2 * i, j), _product(2 * i + 1, 2 + j)) for i in range(2) for j in range(2)]))
def fused_multiply_add(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: T.mac(t.t("m2"), t.t("m0"), t.t("m1")))


@query(_cells([_product(0, k) for k in range(4)] + [(f"2 * {_z(k, 0)} - 3 * {_z(k, 0, 1)}", f"2 * {_z(k, 1)} - 3 * {_z(k, 1, 1)}") for k in range(4)]))
def scalar_times_tensor(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: Tensor([*(Tensor([t.t("m0")[0, 0]]) * t.t("m1")).items, *T.axpby(2.0, t.t("m0"), -3.0, t.t("m1")).items], (8, 1)))


@query(_cells([(f"({_z(k, 0)} * {_z(0, 0, 1)} + {_z(k, 1)} * {_z(0, 1, 1)}) / ({_z(0, 0, 1)} * {_z(0, 0, 1)} + {_z(0, 1, 1)} * {_z(0, 1, 1)})", f"({_z(k, 1)} * {_z(0, 0, 1)} - {_z(k, 0)} * {_z(0, 1, 1)}) / ({_z(0, 0, 1)} * {_z(0, 0, 1)} + {_z(0, 1, 1)} * {_z(0, 1, 1)})") for k in range(4)], 4))
def tensor_over_scalar(spark, sf_dir):
    lat = matrix_lattice(spark, sf_dir)
    return lat.df.select(lat.grid.site().alias("site"), *parts(lat.t("m0") / Tensor([lat.t("m1")[0, 0]]), digits=4))


@query(f"SELECT {SITE}, ({' AND '.join(f'{_z(k, p)} = {_z(k, p, 1)}' for k in range(4) for p in (0, 1))}) AS same, true AS itself FROM embeddings")
def tensor_equality(spark, sf_dir):
    lat = matrix_lattice(spark, sf_dir)
    return lat.df.select(lat.grid.site().alias("site"), lat.t("m0").equals(lat.t("m1")).alias("same"), lat.t("m0").equals(lat.t("m0")).alias("itself"))


@query(_cells([(_z(0, 0), "0.0"), (_z(0, 1), "0.0"), (_z(2, 0), _z(2, 1)), (_z(1, 0), _z(1, 1)), ("7.0", _z(3, 0))]))
def real_imag_index_poke(spark, sf_dir):
    def f(lat: Lattice) -> Tensor:
        m = lat.t("m0")
        z = C(7.0, T.to_real(Tensor([m[1, 1]])))
        return Tensor([m.real()[0, 0], m.imag()[0, 0], m.transpose()[0, 1], m[0, 1], m.poke(1, 1, z)[1, 1]], (5, 1))

    return _tensor_query(spark, sf_dir, f)


@query("SELECT " + SITE + ", " + ", ".join([q(_psi(3 * s + c)[0] if not (s == 2 or c == 1) else (f"2 * {_psi(3 * s + c)[0]}" if c != 1 else f"-{_psi(3 * s + c)[0]}" if s != 2 else f"-2 * {_psi(3 * s + c)[0]}"), f"c{3 * s + c}_re") for s in range(4) for c in range(3)]) + " FROM embeddings")
def named_index_access(spark, sf_dir):
    """Spin row 2 doubled and color 1 negated, each peeked and poked by its name."""
    lat = matrix_lattice(spark, sf_dir)
    psi = spin.poke_spin(lat.t("psi"), 2, spin.peek_spin(lat.t("psi"), 2).scale(2.0))
    psi = spin.poke_color(psi, 1, -spin.peek_color(psi, 1))
    return lat.df.select(lat.grid.site().alias("site"), *[x for k, x in enumerate(parts(psi)) if k % 2 == 0])


@query(_cells([(f"{_z(1, 1)} + {_z(2, 1)}", f"-({_z(1, 0)} + {_z(2, 0)})"), (f"{_z(1, 0)} - {_z(2, 0)}", f"{_z(1, 1)} - {_z(2, 1)}"), (f"{_z(0, 1)} - {_z(3, 1)}", f"-({_z(0, 0)} - {_z(3, 0)})")]))
def algebra_vector_su2(spark, sf_dir):
    """-2 i tr(T_a M) for the three generators of SU(2)."""
    return _tensor_query(spark, sf_dir, lambda t: groups.project_on_algebra(t.t("m0"), 2))


@query(_cells([(f"({_z(0, 0)} * {_z(3, 0)} - {_z(0, 1)} * {_z(3, 1)} - {_z(1, 0)} * {_z(2, 0)} + {_z(1, 1)} * {_z(2, 1)})", f"({_z(0, 0)} * {_z(3, 1)} + {_z(0, 1)} * {_z(3, 0)} - {_z(1, 0)} * {_z(2, 1)} - {_z(1, 1)} * {_z(2, 0)})")]))
def two_index_antisymmetric(spark, sf_dir):
    """The antisymmetric representation of a 2 x 2 matrix is its determinant."""
    return _tensor_query(spark, sf_dir, lambda t: groups.two_index_representation(t.t("m0"), 2, False))


@query(f"SELECT {SITE}, " + ", ".join(q(f"({z.real}) * {_psi(3 * t_ + c)[p]} {'-' if p == 0 else '+'} ({z.imag}) * {_psi(3 * t_ + c)[1 - p]}", f"c{3 * s + c}_{'re' if p == 0 else 'im'}") for m in [np.kron(np.eye(1), spin.gamma('X5'))] for s in range(4) for t_ in [int(np.flatnonzero(m[s])[0])] for z in [m[s, t_]] for c in range(3) for p in (0, 1)) + " FROM embeddings")
def gamma_x5(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: spin.times(spin.gamma("X5"), t.t("psi")))


def _projected_sql(mu: int, sign: int) -> str:
    p = spin.projector(mu, sign)
    out = []
    for s in range(4):
        for c in range(3):
            terms = [(p[s, t], _psi(3 * t + c)) for t in np.flatnonzero(p[s])]
            out.append(q(" + ".join(f"(({z.real}) * {x} - ({z.imag}) * {y})" for z, (x, y) in terms), f"c{3 * s + c}_re"))
            out.append(q(" + ".join(f"(({z.real}) * {y} + ({z.imag}) * {x})" for z, (x, y) in terms), f"c{3 * s + c}_im"))
    return f"SELECT {SITE}, {', '.join(out)} FROM embeddings"


@query(_projected_sql(1, -1))
def spin_project_reconstruct(spark, sf_dir):
    """1 - gamma_y by its upper half alone, put together again."""
    return _tensor_query(spark, sf_dir, lambda t: spin.full_spinor(1, -1, spin.half_spinor(1, -1, t.t("psi"))))


# ---- predicates and sites ----------------------------------------------------------------------


@query(f"WITH {EV} SELECT {XYZ}, ((re < 50 AND im >= 0) OR event_id % 3 <> 0)::INT::BIGINT AS either, (NOT (re > 20 AND im <= 1))::INT::BIGINT AS neither, (event_id & 12)::BIGINT AS masked, (event_id | 5)::BIGINT AS filled, (event_id % 7)::BIGINT AS mod7, (event_id // 7)::BIGINT AS div7 FROM e")
def logic_and_integers(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    p, v, i = predicates, lat.t("v"), lat.t("i")
    im = v.imag()
    out = {
        "either": p.either(p.both(p.compare(v, "<", 50), p.compare(im, ">=", 0)), p.compare(p.mod(i, 3), "!=", 0)),
        "neither": p.negated(p.both(p.compare(v, ">", 20), p.compare(im, "<=", 1))),
        "masked": p.bit_and(i, Tensor([C(12.0)])), "filled": p.bit_or(i, Tensor([C(5.0)])), "mod7": p.mod(i, 7), "div7": p.div(i, 7),
    }
    return lat.df.select(*keys(lat), *[T.to_real(t).cast("long").alias(n) for n, t in out.items()])


@query(f"WITH {EV} SELECT {XYZ}, {q('asin(re / 1000)', 'asin_re')}, {q('acos(re / 1000)', 'acos_re')}, 2.5::DOUBLE AS constant, x1::DOUBLE AS along FROM e")
def inverse_functions_constant(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    lat = sites.coordinate(lat.put(k=Tensor.constant(2.5)), 1, "c")
    x = lat.t("v").scale(0.001)[0, 0]
    return lat.df.select(*keys(lat), r(column(x.real_map(F.asin).re)).alias("asin_re"), r(column(x.real_map(F.acos).re)).alias("acos_re"), F.col("k_0_re").alias("constant"), F.col("c_0_re").alias("along"))


@query(f"WITH {EV} SELECT {XYZ}, {q('CASE WHEN (x0 + 1) % 5 = 0 THEN 0 ELSE cos(th) END', 'dirichlet_re')}, {q('CASE WHEN x1 = 9 THEN -re ELSE re END', 'antiperiodic_re')}, {q('CASE WHEN x0 % 5 BETWEEN 1 AND 3 AND x1 % 5 BETWEEN 1 AND 3 AND x2 % 5 BETWEEN 1 AND 3 THEN re ELSE 0 END', 'inner_re')} FROM e")
def boundary_filters(spark, sf_dir):
    lat = abelian_lattice(spark, sf_dir)
    lat = sites.domain_mask(lat, "v", (5, 5, 5), 1, "inner")
    lat = sites.phase_boundary(sites.dirichlet(lat, "u0", 0, (5, 5, 5)), "v", 1, -1)
    return lat.df.select(*keys(lat), r(F.col("u0_0_re")).alias("dirichlet_re"), r(F.col("v_0_re")).alias("antiperiodic_re"), r(F.col("inner_0_re")).alias("inner_re"))


@query(f"WITH {EV} SELECT (x0 + i * 10)::BIGINT AS x0, (x1 + j * 10)::BIGINT AS x1, x2::BIGINT AS x2, event_id::BIGINT AS source FROM e, (SELECT unnest([-2, -1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE x0 + i * 10 BETWEEN -12 AND 21 AND x1 + j * 10 BETWEEN -1 AND 10")
def padded_corners(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("i")
    return sites.pad_all(lat, {0: 12, 1: 1}).select(*keys(lat), F.col("i_0_re").cast("long").alias("source"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re', 're')}, {q('event_id', 'i')} FROM e")
def split_unsplit(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    got = sites.unsplit(sites.split(lat, ["v", "i"]), lat.grid, ["a", "b"], (1, 1))
    return got.df.select(*keys(got), r(F.col("a_0_re")).alias("re"), r(F.col("b_0_re")).alias("i"))


@query(f"WITH {EV}, o AS (SELECT event_id, re FROM e WHERE re >= 30 ORDER BY re DESC, event_id LIMIT 25) SELECT event_id::BIGINT AS site, {q('re', 'value')} FROM o")
def top_k_sites(spark, sf_dir):
    got = reductions.top_k(events_lattice(spark, sf_dir), "v", 25, 30.0)
    return got.select("site", r(F.col("value")).alias("value"))


@query("SELECT true AS in_range, true AS mean, true AS variance, true AS dealt_alike")
def random_field_moments(spark, sf_dir):
    """Uniform numbers lie in [0, 1); gaussian ones have mean 0 and variance 1 within six standard errors; partitions do not matter."""
    lat = events_lattice(spark, sf_dir).keep("i")
    u = sites.random_fields(lat, "a seed in words", "uniform", "u")
    g = sites.random_fields(u, [1, 2, 3, 4], "gaussian", "g", engine="murmur3")
    n = lat.grid.volume
    again = sites.random_fields(Lattice(lat.df.repartition(7), lat.grid, lat.shapes), "a seed in words", "uniform", "w")
    ends = F.min("u_0_re").alias("lo"), F.max("u_0_re").alias("hi"), F.avg("g_0_re").alias("m"), F.var_pop("g_0_re").alias("v"), F.bit_xor(F.xxhash64("x0", "x1", "x2", "u_0_re")).alias("s")
    one = g.df.agg(*ends).crossJoin(F.broadcast(again.df.agg(F.bit_xor(F.xxhash64("x0", "x1", "x2", "w_0_re")).alias("t"))))
    return one.select(((F.col("lo") >= 0) & (F.col("hi") < 1)).alias("in_range"), (F.abs("m") < 6 / n**0.5).alias("mean"), (F.abs(F.col("v") - 1) < 9 / n**0.5).alias("variance"), (F.col("s") == F.col("t")).alias("dealt_alike"))


# ---- reductions ------------------------------------------------------------------------------


@query("WITH v AS (SELECT unnest(range(12)) AS k, embedding FROM embeddings) SELECT k::BIGINT AS k, round(sum(embedding[2 * k + 1]::DOUBLE), 4) + 0.0 AS re, round(sum(embedding[2 * k + 2]::DOUBLE), 4) + 0.0 AS im FROM v GROUP BY k")
def large_sum(spark, sf_dir):
    got = reductions.total_large(matrix_lattice(spark, sf_dir), "psi")
    return got.select(F.col("k").cast("long").alias("k"), r(F.col("re"), 4).alias("re"), r(F.col("im"), 4).alias("im"))


@query(f"WITH {EV}, s AS (SELECT x0, sum(re * event_id) AS ab FROM e GROUP BY x0) SELECT {XYZ}, {q('e.event_id + e.re * s.ab / 1e6', 're', 4)} FROM e JOIN s USING (x0)")
def slice_matrix_ops(spark, sf_dir):
    """Inner products of two fields by slice, and a field plus its slice's product times another."""
    lat = events_lattice(spark, sf_dir)
    g = reductions.slice_gram(lat, ["v"], ["i"], 0)
    small = g.select(F.col("x0").alias("slice"), "i", "j", (F.col("re") / 1e6).alias("re"), F.lit(0.0).alias("im"))
    got = reductions.slice_multiply(lat, small, ["v"], 0, ["z"], ["i"])
    return got.df.select(*keys(got), r(F.col("z_0_re"), 4).alias("re"))


@query(f"WITH {EV} SELECT (x0 // 5)::BIGINT AS x0, (x1 // 2)::BIGINT AS x1, (x2 // 5)::BIGINT AS x2, {q('sum(CASE WHEN re > 40 THEN re * event_id ELSE 0 END)', 're', 3)} FROM e GROUP BY x0 // 5, x1 // 2, x2 // 5")
def masked_block_inner_product(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    got = reductions.block_inner_product(lat, "v", "i", (5, 2, 5), where=F.col("v_0_re") > 40)
    return got.df.select(*keys(got), r(F.col("ip_0_re"), 3).alias("re"))


@query(f"WITH {EV}, b AS (SELECT x0 // 5 AS b0, x1 // 2 AS b1, x2 // 5 AS b2, sum(re) AS s FROM e GROUP BY x0 // 5, x1 // 2, x2 // 5) SELECT {XYZ}, {q('0.001 * s * e.re + event_id', 're', 7)} FROM e JOIN b ON b0 = x0 // 5 AND b1 = x1 // 2 AND b2 = x2 // 5")
def block_zaxpy(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    coarse = reductions.block_sum(lat.put(a=lat.t("v").real().scale(0.001)), "a", (5, 2, 5))
    got = reductions.block_zaxpy(lat, coarse, "a", "v", "i", (5, 2, 5))
    # Values have two decimals, so seven hold the result whole: fewer would leave ties to the order of the sums.
    return got.df.select(*keys(got), r(F.col("z_0_re"), 7).alias("re"))


@query(f"WITH {EV}, s AS (SELECT sqrt(sum(re * re + im * im)) AS n FROM e), c AS (SELECT sum(re * event_id) / n AS cr, sum(-im * event_id) / n AS ci, n FROM e, s GROUP BY n) SELECT {XYZ}, {q('event_id - (cr * re - ci * im) / n', 're', 4)}, {q('-(cr * im + ci * re) / n', 'im', 4)} FROM e, c")
def basis_orthogonalise(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    n = reductions.norm2(lat, "v").first()["norm2"] ** 0.5
    lat = lat.put(e=lat.t("v").scale(1 / n))
    got = reductions.orthogonalise(lat, ["e"], "i", "o")
    return got.df.select(*keys(got), r(F.col("o_0_re"), 4).alias("re"), r(F.col("o_0_im"), 4).alias("im"))


# ---- solvers -----------------------------------------------------------------------------------

#: The field that the solvers' sources are made from, as SQL.
SOLVED = f"SELECT {SITE}, {q(_psi(0)[0], 're', 5)}, {q(_psi(0)[1], 'im', 5)} FROM embeddings"


def _rows(spark, sf_dir) -> int:
    return table(spark, sf_dir, "embeddings").count()


def _scalar(spark, sf_dir, dims: str = "3d") -> tuple[Lattice, int]:
    """The first component of the embeddings as a scalar field f, on [5, 10, T], or on [10, T] with even extents.

    Sites past the last row hold zero.
    """
    lat, n = matrix_lattice(spark, sf_dir), _rows(spark, sf_dir)
    lat = lat.put(f=Tensor([lat.t("psi")[0, 0]])).keep("f")
    if dims == "2d":
        grid = Grid((10, 2 * -(-n // 20)))
        lat = Lattice(lat.df.select(*grid.coordinates(lat.grid.site()), *lat.columns("f")), grid, lat.shapes)
    return filled(lat, n).cut(), len(lat.grid.dims)


def _start(spark, sf_dir) -> tuple[Lattice, int]:
    """The same field on the whole slices alone, whose spectrum is asked for; rows past them are added to the first sites."""
    lat, n = matrix_lattice(spark, sf_dir), _rows(spark, sf_dir)
    lat = lat.put(f=Tensor([lat.t("psi")[0, 0]])).keep("f")
    if n % 50:
        grid = Grid((5, 10, n // 50))
        df = lat.df.select(*grid.coordinates(lat.grid.site()), *lat.columns("f")).groupBy(*grid.keys).agg(*[F.sum(c).alias(c) for c in lat.columns("f")])
        lat = Lattice(df, grid, lat.shapes)
    return lat.cut(), 3


def _found(lat: Lattice, x: str, rows: int):
    """The field that a solver found, at the sites that are rows of the table."""
    site = lat.grid.site()
    return lat.df.filter(site < rows).select(site.alias("site"), r(F.col(f"{x}_0_re"), 5).alias("re"), r(F.col(f"{x}_0_im"), 5).alias("im"))


def _solve(spark, sf_dir, solver, **how):
    """The field that a solver gets back from A times the field, A the massive operator."""
    lat, d = _scalar(spark, sf_dir)
    a = linear.massive(d, 20.0)
    got = solver(a, a(lat, "f", "b").keep("b").cut(), "b", **how)
    if not got.converged:
        raise ArithmeticError("not converged")
    return _found(got.lattice, "x", _rows(spark, sf_dir))


@query(SOLVED)
def solve_cg(spark, sf_dir):
    return _solve(spark, sf_dir, linear.conjugate_gradient)


@query(SOLVED)
def solve_conjugate_residual(spark, sf_dir):
    return _solve(spark, sf_dir, linear.conjugate_residual)


@query(SOLVED)
def solve_minimal_residual(spark, sf_dir):
    return _solve(spark, sf_dir, linear.minimal_residual)


@query(SOLVED)
def solve_bicgstab(spark, sf_dir):
    return _solve(spark, sf_dir, linear.bicgstab)


@query(SOLVED)
def solve_gcr(spark, sf_dir):
    return _solve(spark, sf_dir, linear.gcr)


@query(SOLVED)
def solve_gmres(spark, sf_dir):
    return _solve(spark, sf_dir, linear.gmres, steps=12)


@query(SOLVED)
def solve_reliable_update(spark, sf_dir):
    return _solve(spark, sf_dir, solvers.reliable_update_cg)


@query(SOLVED)
def solve_quasi_minimal_residual(spark, sf_dir):
    return _solve(spark, sf_dir, lambda a, lat, b: solvers.quasi_minimal_residual(a, a, lat, b))


@query(SOLVED)
def solve_mixed_precision(spark, sf_dir):
    from fieldloom.operators.actions import mixed_precision_cg

    return _solve(spark, sf_dir, mixed_precision_cg)


@query(SOLVED)
def solve_normal_equations(spark, sf_dir):
    return _solve(spark, sf_dir, lambda a, lat, b: solvers.normal_equations(a, a)(None, lat, b, tol=1e-9))


@query(SOLVED)
def solve_normal_equations_right(spark, sf_dir):
    return _solve(spark, sf_dir, lambda a, lat, b: solvers.normal_equations(a, a, left=False)(None, lat, b, tol=1e-9))


def _block(spark, sf_dir, solver):
    lat, d = _scalar(spark, sf_dir)
    a = linear.massive(d, 20.0)
    lat = lat.put(g=lat.t("f").conj()).put(h=lat.t("f").scale(F.cos(F.col("x0").cast("double"))))
    lat = solvers.apply_all(a, lat, ["g", "f", "h"], ["b0", "b1", "b2"]).keep("b0", "b1", "b2").cut()
    got = solver(a, lat, ["b0", "b1", "b2"])
    if not got.converged:
        raise ArithmeticError("not converged")
    return _found(got.lattice, "x1_b", _rows(spark, sf_dir))


@query(SOLVED)
def solve_block_cg(spark, sf_dir):
    return _block(spark, sf_dir, solvers.block_cg)


@query(SOLVED)
def solve_multi_rhs(spark, sf_dir):
    return _block(spark, sf_dir, linear.multi_rhs_cg)


def _shifted(spark, sf_dir, solve):
    """(A + 3) applied to the solution for the shift 3 gives the source back."""
    lat, d = _scalar(spark, sf_dir)
    lat = solve(linear.massive(d, 20.0), lat)
    return _found(solvers.shifted(linear.massive(d, 20.0), 3.0)(lat, "x1_s", "back"), "back", _rows(spark, sf_dir))


@query(SOLVED)
def solve_multishift(spark, sf_dir):
    return _shifted(spark, sf_dir, lambda a, lat: linear.multishift(a, lat, "f", [0.0, 3.0, 11.0]).lattice)


@query(SOLVED)
def solve_multishift_cleanup(spark, sf_dir):
    return _shifted(spark, sf_dir, lambda a, lat: solvers.multishift_with_cleanup(a, lambda s: solvers.shifted(a, s), lat, "f", [0.0, 3.0, 11.0]))


def _schur(spark, sf_dir, kind, solver=linear.conjugate_gradient, guess=None):
    lat, d = _scalar(spark, sf_dir, "2d")
    hop, diagonal = schur.scalar_hop(d), 2.0 * d + 8.0
    lat = linear.combine(hop(lat, "f", "__h"), b={"f": diagonal, "__h": 1.0}, g={"f": 0.5}).keep("b", "g").cut()
    got = schur.red_black_solve(diagonal, hop, lat, "b", kind=kind, solver=solver, guess=guess)
    return _found(got.lattice, "x", _rows(spark, sf_dir))


@query(SOLVED)
def schur_diag_mooee(spark, sf_dir):
    return _schur(spark, sf_dir, "mooee")


@query(SOLVED)
def schur_diag_one(spark, sf_dir):
    return _schur(spark, sf_dir, "one")


@query(SOLVED)
def schur_diag_two(spark, sf_dir):
    return _schur(spark, sf_dir, "two", guess="g")


@query(SOLVED)
def schur_staggered(spark, sf_dir):
    return _schur(spark, sf_dir, "staggered")


@query(SOLVED)
def schur_non_hermitian(spark, sf_dir):
    return _schur(spark, sf_dir, "mooee", linear.bicgstab)


@query(SOLVED)
def solution_forecast(spark, sf_dir):
    """Earlier solutions that span the new one forecast it without a solve."""
    lat, d = _scalar(spark, sf_dir)
    a = linear.massive(d, 20.0)
    lat = a(lat.put(p=lat.t("f").conj()), "f", "b")
    lat = linear.combine(lat, s={"f": 1.0, "p": 0.3}, t={"f": -0.2, "p": 1.0}).cut()
    return _found(solvers.forecast(a, lat, "b", ["s", "t"]), "guess", _rows(spark, sf_dir))


def _slabs(lat: Lattice) -> tuple[Blocks, int]:
    """A lattice in blocks of whole slices, and the degree of a filter whose layers stay in proportion to them."""
    n = lat.grid.dims[-1]
    depth = max(m for m in range(1, min(64, max(10, n // 16)) + 1) if n % m == 0)
    return Blocks.pack(lat, (*lat.grid.dims[:-1], depth)), min(31, 8 * depth - 1)


#: Distinct eigenvalues of the massive operator on [5, 10, T], the lowest first.
_MODES = f"SELECT DISTINCT round(1 + 6 - 2 * cos({PI2} * a / 5) - 2 * cos({PI2} * b / 10) - 2 * cos({PI2} * c / (SELECT count(*) // 50 FROM embeddings)), 6) AS v FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(10)) AS b), (SELECT unnest(range((SELECT count(*) // 50 FROM embeddings))) AS c)"


@query(f"WITH m AS ({_MODES}) SELECT (row_number() OVER (ORDER BY v) - 1)::BIGINT AS k, round(v, 4) + 0.0 AS eigenvalue FROM m QUALIFY row_number() OVER (ORDER BY v) <= 2")
def lanczos_thick_restart(spark, sf_dir):
    """Restarts at 14 columns, through filters; one start meets each eigenvalue once."""
    lat, d = _start(spark, sf_dir)
    b, degree = _slabs(lat)
    got = krylov.extremes(lambda s, o, shape: halo.laplacian(d, s, o, shape, 1.0), b, "f", (0, 1), 1e-5, degree=degree, longest=14)
    pairs = solvers.sorted_pairs(got.values[:2], ["e0", "e1"])
    return spark.createDataFrame([(k, round(v, 4)) for k, (v, _) in enumerate(pairs)], "k long, eigenvalue double")


#: Both ends of that spectrum.
SQL_BLOCK_LANCZOS = f"WITH m AS ({_MODES}) SELECT round(min(v), 3) + 0.0 AS lowest, round(max(v), 3) + 0.0 AS highest FROM m"


@query(f"WITH {EV} SELECT round(sum(0.5 * 6.5 * a.re * a.re + 0.25 * 0.01 * pow(a.re, 4) - a.re * (b.re + c.re + d.re)) / 1e6, 4) + 0.0 AS action FROM e a CROSS JOIN n JOIN e b ON {moved((1, 0, 0))} JOIN e c ON {moved((0, 1, 0)).replace('b.', 'c.')} JOIN e d ON {moved((0, 0, 1)).replace('b.', 'd.')}")
def scalar_action(spark, sf_dir):
    got = scalar.action(events_lattice(spark, sf_dir), "v", 0.5, 0.01)
    return spark.createDataFrame([(round(got / 1e6, 4),)], "action double")


@query("WITH " + EV + ", h AS (" + " UNION ALL ".join(f"SELECT a.x0, a.x1, a.x2, b.re AS s FROM e a CROSS JOIN n JOIN e b ON {moved(tuple(s * int(k == mu) for k in range(3)))}" for mu in range(3) for s in (1, -1)) + f"), g AS (SELECT x0, x1, x2, sum(s) AS s FROM h GROUP BY x0, x1, x2) SELECT {XYZ}, round(6.5 * re - s + 0.01 * re * re * re, 3) + 0.0 AS force FROM e JOIN g USING (x0, x1, x2)")
def scalar_force(spark, sf_dir):
    got = scalar.force(events_lattice(spark, sf_dir).keep("v"), "v", 0.5, 0.01)
    return got.df.select(*keys(got), r(F.col("force_0_re"), 3).alias("force"))


# ---- fermions ------------------------------------------------------------------------------------


def _spinor_lattice(spark, sf_dir) -> Lattice:
    """U(1) links and a spinor of one color: component s is (s + 1) 0.01 value + i (event_id % 7 - 3 + s)."""
    lat = abelian_lattice(spark, sf_dir)
    v = lat.t("v")[0, 0]
    return lat.put(psi=Tensor([C(v.re * (0.01 * (s + 1)), v.im + float(s)) for s in range(4)], (4, 1))).keep("u0", "u1", "u2", "psi")


def _component(row: str, s: int) -> tuple[str, str]:
    return f"({row}.re * {float(0.01 * (s + 1))!r})", f"({row}.im + {s})"


def _turned(row: str, z: tuple[str, str], angle: str) -> tuple[str, str]:
    return f"(cos({angle}) * {z[0]} - sin({angle}) * {z[1]})", f"(cos({angle}) * {z[1]} + sin({angle}) * {z[0]})"


def _hop_terms(dagger: bool, fore: float, spins: int = 4) -> list[str]:
    """SELECTs of x0, x1, x2, s, re, im whose sums are the Wilson hop times ``fore``."""
    out = []
    for mu in range(3):
        for ahead in (True, False):
            d = tuple((1 if ahead else -1) * int(k == mu) for k in range(3))
            sign = (1 if dagger else -1) if ahead else (-1 if dagger else 1)
            p = spin.projector(mu, sign) * fore
            angle = f"{mu + 1} * a.th" if ahead else f"-{mu + 1} * b.th"
            for s in range(spins):
                zs = [(complex(p[s, t]), _turned("b", _component("b", t), angle)) for t in np.flatnonzero(p[s])]
                re = " + ".join(f"({z.real!r} * {x} - ({z.imag!r}) * {y})" for z, (x, y) in zs)
                im = " + ".join(f"({z.real!r} * {y} + ({z.imag!r}) * {x})" for z, (x, y) in zs)
                out.append(f"SELECT a.x0, a.x1, a.x2, {s} AS s, {re} AS re, {im} AS im FROM e a CROSS JOIN n JOIN e b ON {moved(d)}")
    return out


def _local_terms(m: np.ndarray) -> list[str]:
    """A constant spin matrix on the spinor, as such SELECTs."""
    out = []
    for s in range(4):
        zs = [(complex(m[s, t]), _component("a", t)) for t in np.flatnonzero(m[s])]
        re = " + ".join(f"({z.real!r} * {x} - ({z.imag!r}) * {y})" for z, (x, y) in zs) or "0.0"
        im = " + ".join(f"({z.real!r} * {y} + ({z.imag!r}) * {x})" for z, (x, y) in zs) or "0.0"
        out.append(f"SELECT a.x0, a.x1, a.x2, {s} AS s, {re} AS re, {im} AS im FROM e a")
    return out


def _spinor_sql(terms: list[str]) -> str:
    wide = ", ".join(f"round(sum(CASE WHEN s = {s} THEN {p} ELSE 0 END), 5) + 0.0 AS c{s}_{p}" for s in range(4) for p in ("re", "im"))
    return f"WITH {EV}, m AS ({' UNION ALL '.join(terms)}) SELECT {XYZ}, {wide} FROM m GROUP BY x0, x1, x2"


def _spinor_out(lat: Lattice, name: str):
    return lat.df.select(*keys(lat), *parts(lat.t(name), digits=5))


LINKS = ["u0", "u1", "u2"]
_MASS = (0.1 + 3) * np.eye(4)


@query(_spinor_sql(_local_terms(_MASS) + _hop_terms(False, -0.5)))
def wilson_matrix(spark, sf_dir):
    return _spinor_out(fermions.wilson(3, LINKS, 0.1)(_spinor_lattice(spark, sf_dir), "psi", "m"), "m")


@query(_spinor_sql(_local_terms(_MASS) + _hop_terms(True, -0.5)))
def wilson_matrix_dagger(spark, sf_dir):
    return _spinor_out(fermions.wilson(3, LINKS, 0.1, dagger=True)(_spinor_lattice(spark, sf_dir), "psi", "m"), "m")


@query(_spinor_sql(_hop_terms(False, 1.0)))
def wilson_hop(spark, sf_dir):
    return _spinor_out(fermions.wilson_hop(3, LINKS)(_spinor_lattice(spark, sf_dir), "psi", "m"), "m")


@query(_spinor_sql(_local_terms(_MASS + 0.25j * spin.GAMMA5) + _hop_terms(False, -0.5)))
def twisted_mass(spark, sf_dir):
    return _spinor_out(fermions.wilson(3, LINKS, 0.1, twist=0.25)(_spinor_lattice(spark, sf_dir), "psi", "m"), "m")


_G5 = np.real(np.diag(spin.GAMMA5)) if not np.any(spin.GAMMA5 - np.diag(np.diag(spin.GAMMA5))) else None


@query("WITH w AS (" + _spinor_sql(_local_terms(_MASS) + _hop_terms(False, -0.5)) + ") SELECT x0, x1, x2, " + ", ".join(f"{int(_G5[s])} * c{s}_{p} + 0.0 AS c{s}_{p}" for s in range(4) for p in ("re", "im")) + " FROM w")
def gamma5_hermitian_operator(spark, sf_dir):
    op = fermions.gamma5_hermitian(fermions.wilson(3, LINKS, 0.1))
    return _spinor_out(op(_spinor_lattice(spark, sf_dir), "psi", "m"), "m")


@query(f"WITH w AS ({_spinor_sql(_local_terms(_MASS) + _hop_terms(False, -0.5)).replace(', 5) + 0.0', ', 12) + 0.0')}) SELECT round(sum({' + '.join(f'c{s}_{p} * c{s}_{p}' for s in range(4) for p in ('re', 'im'))}), 2) + 0.0 AS norm2 FROM w")
def mdagm_expectation(spark, sf_dir):
    """<psi, M† M psi> is the norm of M psi."""
    op = fermions.normal(fermions.wilson(3, LINKS, 0.1), fermions.wilson(3, LINKS, 0.1, dagger=True))
    z = linear.dots(op(_spinor_lattice(spark, sf_dir), "psi", "mm"), [("psi", "mm")])[0]
    return spark.createDataFrame([(round(z.real, 2) + 0.0,)], "norm2 double")


@query(f"WITH w AS ({_spinor_sql(_local_terms(_MASS) + _hop_terms(True, -0.5)).replace(', 5) + 0.0', ', 12) + 0.0')}), p AS (WITH {EV} SELECT sum({' + '.join(f'{_component("e", s)[p]} * {_component("e", s)[p]}' for s in range(4) for p in (0, 1))}) AS n FROM e) SELECT round(sum({' + '.join(f'c{s}_{p} * c{s}_{p}' for s in range(4) for p in ('re', 'im'))}) + 0.7 * any_value(n), 2) + 0.0 AS norm2 FROM w, p")
def mmdag_shifted_expectation(spark, sf_dir):
    """<psi, (M M† + 0.7) psi>."""
    op = solvers.shifted(fermions.normal(fermions.wilson(3, LINKS, 0.1, dagger=True), fermions.wilson(3, LINKS, 0.1)), 0.7)
    z = linear.dots(op(_spinor_lattice(spark, sf_dir), "psi", "mm"), [("psi", "mm")])[0]
    return spark.createDataFrame([(round(z.real, 2) + 0.0,)], "norm2 double")


def _staggered_terms(hops: dict[int, tuple[float, str]]) -> list[str]:
    """Hops of n sites with a coefficient and the angle of the product of links along them."""
    out = ["SELECT a.x0, a.x1, a.x2, 0.2 * a.re AS re, 0.2 * a.im AS im FROM e a"]
    for mu in range(3):
        eta = " + ".join(f"a.x{k}" for k in range(mu)) or "0"
        for n, c in hops.items():
            for way in (1, -1):
                d = tuple(way * n * int(k == mu) for k in range(3))
                walk = [tuple((j if way == 1 else j - n) * int(k == mu) for k in range(3)) for j in range(n)]
                joins = " ".join(f"LEFT JOIN e w{j} ON {moved(at).replace('b.', f'w{j}.')}" for j, at in enumerate(walk))
                angle = f"{way * (mu + 1)} * (" + " + ".join(f"w{j}.th" for j in range(n)) + ")"
                z = _turned("b", ("b.re", "b.im"), angle)
                f = f"(CASE WHEN ({eta}) % 2 = 0 THEN {way * c / 2!r} ELSE {-way * c / 2!r} END)"
                out.append(f"SELECT a.x0, a.x1, a.x2, {f} * {z[0]} AS re, {f} * {z[1]} AS im FROM e a CROSS JOIN n JOIN e b ON {moved(d)} {joins}")
    return out


def _scalar_sum(terms: list[str]) -> str:
    return f"WITH {EV}, m AS ({' UNION ALL '.join(terms)}) SELECT {XYZ}, round(sum(re), 4) + 0.0 AS c0_re, round(sum(im), 4) + 0.0 AS c0_im FROM m GROUP BY x0, x1, x2"


@query(_scalar_sum(_staggered_terms({1: 1.0})))
def staggered_matrix(spark, sf_dir):
    lat = fermions.staggered(3, LINKS, 0.2)(abelian_lattice(spark, sf_dir), "v", "m")
    return lat.df.select(*keys(lat), *parts(lat.t("m"), digits=4))


@query(_scalar_sum(_staggered_terms({1: 1.125, 3: -1 / 24})))
def improved_staggered_matrix(spark, sf_dir):
    lat = gauge.long_links(abelian_lattice(spark, sf_dir).cut()).cut()
    lat = fermions.improved_staggered(3, LINKS, ["w0", "w1", "w2"], 0.2, 1.125, -1 / 24)(lat, "v", "m")
    return lat.df.select(*keys(lat), *parts(lat.t("m"), digits=4))


# ---- gauge ---------------------------------------------------------------------------------------


def _leaf_sql(mu: int, nu: int, m: int, n: int) -> str:
    f, g, p, w = (mu,) * m, (nu,) * n, (-mu - 1,) * m, (-nu - 1,) * n
    out = []
    for path in (f + g + p + w, g + p + w + f, p + w + f + g, w + f + g + p):
        source, phase = _loop_sql(path)
        out.append(f"SELECT a.x0, a.x1, a.x2, sin({phase}) AS s FROM {source}")
    return " UNION ALL ".join(out)


@query(f"WITH {EV}, l AS ({_leaf_sql(0, 1, 1, 1)}) SELECT {XYZ}, round(sum(s) / 4, 6) + 0.0 AS f FROM l GROUP BY x0, x1, x2")
def clover_u1(spark, sf_dir):
    got = gauge.clover(abelian_lattice(spark, sf_dir), 0, 1)
    return got.df.select(*keys(got), r(F.col("f_0_im")).alias("f"))


@query(f"WITH {EV}, l AS ({_leaf_sql(0, 1, 1, 2)} UNION ALL {_leaf_sql(0, 1, 2, 1)}) SELECT {XYZ}, round(sum(s) / 16, 6) + 0.0 AS f FROM l GROUP BY x0, x1, x2")
def clover_leaf_1x2(spark, sf_dir):
    got = gauge.clover_leaf(abelian_lattice(spark, sf_dir), 0, 1, 1, 2)
    return got.df.select(*keys(got), r(F.col("f_0_im")).alias("f"))


def _transform_sql(mu: int) -> str:
    d = tuple(int(k == mu) for k in range(3))
    return f"WITH {EV} SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, {q(f'cos({mu + 1} * a.th + 0.3 * a.im - 0.3 * b.im)', 're')}, {q(f'sin({mu + 1} * a.th + 0.3 * a.im - 0.3 * b.im)', 'im')} FROM e a CROSS JOIN n JOIN e b ON {moved(d)}"


@query(_transform_sql(1))
def gauge_transform_u1(spark, sf_dir):
    lat = abelian_lattice(spark, sf_dir)
    a = 0.3 * lat.t("v")[0, 0].im
    got = gauge.gauge_transform(lat.put(g=Tensor([C(F.cos(a), F.sin(a))])), "g")
    return got.df.select(*keys(got), r(F.col("u1_0_re")).alias("re"), r(F.col("u1_0_im")).alias("im"))


@query(f"WITH {EV} SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, {q('cos(b.th) * b.re + sin(b.th) * b.im', 're')}, {q('cos(b.th) * b.im - sin(b.th) * b.re', 'im')}, {q('cos(b.th)', 'i_re')}, {q('-sin(b.th)', 'i_im')} FROM e a CROSS JOIN n JOIN e b ON {moved((-1, 0, 0))}")
def covariant_shift_backward(spark, sf_dir):
    lat = gauge.covariant_shift(abelian_lattice(spark, sf_dir), "v", 0, forward=False)
    got = gauge.shift_identity_backward(lat, 0, "id")
    return got.df.select(*keys(got), r(F.col("cs_0_re")).alias("re"), r(F.col("cs_0_im")).alias("im"), r(F.col("id_0_re")).alias("i_re"), r(F.col("id_0_im")).alias("i_im"))


_DA = "(" + " + ".join(f"sin({mu + 1} * a.th) - sin({mu + 1} * w{mu}.th)" for mu in range(3)) + ")"
_DA_SQL = "SELECT a.x0, a.x1, a.x2, a.th, " + _DA + " AS da FROM e a CROSS JOIN n " + " ".join(f"LEFT JOIN e w{mu} ON " + moved(tuple(-int(k == mu) for k in range(3))).replace("b.", f"w{mu}.") for mu in range(3))


@query(f"WITH {EV}, g AS ({_DA_SQL}) SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, {q('cos(a.th - 0.1 * a.da + 0.1 * b.da)', 're')}, {q('sin(a.th - 0.1 * a.da + 0.1 * b.da)', 'im')} FROM g a CROSS JOIN n JOIN g b ON {moved((1, 0, 0))}")
def gauge_fix_step(spark, sf_dir):
    got = evolution.gauge_fix(abelian_lattice(spark, sf_dir).keep(*LINKS), 0.1, 1)
    return got.df.select(*keys(got), r(F.col("u0_0_re")).alias("re"), r(F.col("u0_0_im")).alias("im"))


_STAPLE = f"s AS ({_staple_sql()}), t AS (SELECT x0, x1, x2, sum(c) AS c, sum(s) AS s FROM s GROUP BY x0, x1, x2)"


@query(f"WITH {EV}, {_STAPLE}, m AS (SELECT e.*, 0.4 * cos(th) + 0.15 * c AS re2, 0.4 * sin(th) - 0.15 * s AS im2 FROM e JOIN t USING (x0, x1, x2)) SELECT {XYZ}, {q('re2 / sqrt(re2 * re2 + im2 * im2)', 're')}, {q('im2 / sqrt(re2 * re2 + im2 * im2)', 'im')} FROM m")
def ape_smear_u1(spark, sf_dir):
    got = evolution.ape_smear(abelian_lattice(spark, sf_dir).keep(*LINKS), 0.6, 1, [0])
    return got.df.select(*keys(got), r(F.col("u0_0_re")).alias("re"), r(F.col("u0_0_im")).alias("im"))


@query(f"WITH {EV}, {_STAPLE}, m AS (SELECT e.*, th - 0.1 * (sin(th) * c + cos(th) * s) AS a FROM e JOIN t USING (x0, x1, x2)) SELECT {XYZ}, {q('cos(a)', 're')}, {q('sin(a)', 'im')} FROM m")
def stout_smear_u1(spark, sf_dir):
    got = evolution.stout_smear(abelian_lattice(spark, sf_dir).keep(*LINKS), 0.1, 1)
    return got.df.select(*keys(got), r(F.col("u0_0_re")).alias("re"), r(F.col("u0_0_im")).alias("im"))


def _rectangle_staple_sql() -> str:
    out = []
    for nu in (1, 2):
        for s, t in ((nu, -nu - 1), (-nu - 1, nu)):
            for path in ((0, s, -1, -1, t), (s, -1, -1, t, 0), (s, s, -1, t, t)):
                at, joins, phase = [1, 0, 0], [], []
                for k, step in enumerate(path):
                    mu = step if step >= 0 else -step - 1
                    if step < 0:
                        at[mu] -= 1
                    joins.append(f"LEFT JOIN e w{k} ON " + moved(tuple(at)).replace("b.", f"w{k}."))
                    phase.append(f"{'-' if step < 0 else '+'} {mu + 1} * w{k}.th")
                    if step >= 0:
                        at[mu] += 1
                p = " ".join(phase)
                out.append(f"SELECT a.x0, a.x1, a.x2, cos({p}) AS c, sin({p}) AS s FROM e a CROSS JOIN n {' '.join(joins)}")
    return " UNION ALL ".join(out)


@query(f"WITH {EV}, {_STAPLE}, r AS ({_rectangle_staple_sql()}), u AS (SELECT x0, x1, x2, sum(c) AS c, sum(s) AS s FROM r GROUP BY x0, x1, x2) SELECT {XYZ}, {q('t.c', 're')}, {q('t.s', 'im')}, {q('u.c', 'rect_re')}, {q('u.s', 'rect_im')} FROM e JOIN t USING (x0, x1, x2) JOIN u USING (x0, x1, x2)")
def staple_and_rectangle_u1(spark, sf_dir):
    got = gauge.staple_and_rectangle(abelian_lattice(spark, sf_dir), 0)
    return got.df.select(*keys(got), *[r(F.col(f"{n}_0_{p}")).alias(o + p) for n, o in (("staple", ""), ("rect_staple", "rect_")) for p in ("re", "im")])


def _average_sql(paths: list[tuple[int, ...]]) -> str:
    return "(SELECT sum(s) FROM (" + " UNION ALL ".join(f"SELECT sum(cos({_loop_sql(p)[1]})) AS s FROM {_loop_sql(p)[0]}" for p in paths) + "))"


_PLAQ = _average_sql([base.P01, base.P02, base.P12])
_RECT = _average_sql([gauge.loop_path(2, 1, a, b) for a in range(3) for b in range(3) if a != b])


@query(f"WITH {EV}, v AS (SELECT count(*) AS v FROM e) SELECT round(2.5 * v * ((1 + 8 * 0.331) * (1 - {_PLAQ} / (3 * v)) * 3 - 0.331 * (1 - {_RECT} / (6 * v)) * 6), 3) + 0.0 AS action FROM v")
def iwasaki_action(spark, sf_dir):
    return gauge.named_action(abelian_lattice(spark, sf_dir), "iwasaki", 2.5).select(r(F.col("action"), 3).alias("action"))


# ---- files and transforms ----------------------------------------------------------------------


@query(f"WITH {EV} SELECT {XYZ}, {q('re', 're')}, {q('im', 'im')} FROM e")
def file_round_trip(spark, sf_dir):
    """A field written as big-endian records and read again by byte ranges."""
    import uuid

    from fieldloom.sources import binary

    lat = events_lattice(spark, sf_dir).keep("v")
    path = f"{binary.scratch(spark)}/field-{uuid.uuid4().hex}.bin"
    binary.write_field(lat, ["v"], path)
    got = binary.read_field(spark, path, lat.grid, lat.shapes)
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("re"), r(F.col("v_0_im")).alias("im"))


@query(f"WITH {EV}, s AS (SELECT unnest([0, 1]) AS k0), f AS (SELECT DISTINCT x2 AS k2, x2, l2 FROM e, n) SELECT round(sum(re * re + im * im), 1) + 0.0 AS norm2 FROM e")
def fft_parseval(spark, sf_dir):
    """The norm of all modes over the volume is the norm of the field."""
    lat = events_lattice(spark, sf_dir)
    k = fourier.fft(lat, "v")
    return reductions.norm2(k, "v").select(r(F.col("norm2") / lat.grid.volume, 1).alias("norm2"))
