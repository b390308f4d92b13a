"""The registered lattice queries and, where SQL can express them, the same in DuckDB SQL.

Every query runs over a whole table read as a field.  Floating results are rounded on both
sides; integers are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import predicates, spin
from fieldloom.functions.tensors import C, Tensor, column, log, to_real, trace_index
from fieldloom.operators import contractions, evolution, fermions, fourier, gauge, linear, reductions, sites
from fieldloom.plans.lattice import Grid, Lattice
from fieldloom.sources import binary
from fieldloom.sources.tables import abelian_lattice, events_lattice, filled, matrix_lattice, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def keys(lat: Lattice) -> list[Column]:
    return [F.col(k).cast("long").alias(k) for k in lat.grid.keys]


def parts(t: Tensor, *names: str, digits: int = 6) -> list[Column]:
    """Rounded parts of a tensor's components as name_re and name_im."""
    names = names or tuple(f"c{k}" for k in range(len(t.items)))
    return [r(column(x), digits).alias(f"{n}_{p}") for n, c in zip(names, t.items, strict=True) for p, x in (("re", c.re), ("im", c.im))]


#: The events lattice in SQL.
EV = "n AS (SELECT count(*) // 100 AS l2 FROM events), e AS (SELECT event_id, event_id % 10 AS x0, (event_id // 10) % 10 AS x1, event_id // 100 AS x2, value AS re, (event_id % 7 - 3)::DOUBLE AS im, (0.01 * value) AS th FROM events)"
XYZ = "x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2"


def q(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def moved(d: tuple[int, int, int], a: str = "a") -> str:
    """Condition that the row b lies at a's site displaced by d."""
    return f"b.x0 = (({a}.x0 + {d[0]}) % 10 + 10) % 10 AND b.x1 = (({a}.x1 + {d[1]}) % 10 + 10) % 10 AND b.x2 = (({a}.x2 + {d[2]}) % l2 + l2) % l2"


# ---- sites, predicates, functions ----------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, {XYZ} FROM e")
def coordinate_field(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    lat = Lattice.coordinates(spark, Grid((10, 10, n // 100)))
    return lat.df.select(lat.grid.site().alias("event_id"), *keys(lat))


@query(f"WITH {EV} SELECT {XYZ}, (x0 + 10 * (x1 + 10 * x2))::BIGINT AS site FROM e")
def lex_index(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    return lat.df.select(*keys(lat), lat.grid.site().alias("site"))


@query(f"WITH {EV} SELECT {XYZ}, {q('CASE WHEN event_id < 500 THEN re * re - im * im + 2 ELSE re END', 're')} FROM e")
def where_select(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    lat = lat.put(a=lat.t("v") * lat.t("v") + Tensor.constant(2.0), b=lat.t("v"))
    got = sites.where(lat, F.col("i_0_re") < 500, "a", "b")
    return got.df.select(*keys(got), r(F.col("w_0_re")).alias("re"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re', 're')} FROM e WHERE (x0 + x1 + x2) % 2 = 0")
def checkerboard_even(spark, sf_dir):
    lat = sites.pick_parity(events_lattice(spark, sf_dir), 0)
    return lat.df.select(*keys(lat), r(F.col("v_0_re")).alias("re"))


@query(f"WITH {EV} SELECT {XYZ}, {q('CASE WHEN (x0 + x1 + x2) % 2 = 0 THEN re ELSE -re END', 're')} FROM e")
def checkerboard_set(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("v")
    odd = sites.pick_parity(lat, 1)
    full = sites.set_parity(sites.pick_parity(lat, 0), odd.put(v=-odd.t("v")))
    return full.df.select(*keys(full), r(F.col("v_0_re")).alias("re"))


@query(f"WITH {EV} SELECT x2::BIGINT AS x2, sum((re < 50)::INT)::BIGINT AS lt, sum((re >= 50)::INT)::BIGINT AS ge, sum((im = 0)::INT)::BIGINT AS eq, sum((im <> 0)::INT)::BIGINT AS ne FROM e GROUP BY x2")
def compare_ops(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    v = lat.t("v")
    tests = {"lt": predicates.compare(v, "<", 50), "ge": predicates.compare(v, ">=", 50), "eq": predicates.compare(v.imag(), "==", 0), "ne": predicates.compare(v.imag(), "!=", 0)}
    return lat.df.groupBy(F.col("x2").cast("long").alias("x2")).agg(*[F.sum(to_real(t).cast("long")).alias(n) for n, t in tests.items()])


@query(f"WITH {EV} SELECT {XYZ}, {q('abs(-re)', 'abs_re')}, {q('sqrt(re)', 'sqrt_re')}, {q('sin(re)', 'sin_re')}, {q('cos(re)', 'cos_re')}, {q('ln(re)', 'log_re')}, {q('pow(re, 1.5)', 'pow_re')}, {q('exp(th) * cos(0.01 * im)', 'exp_re')}, {q('exp(th) * sin(0.01 * im)', 'exp_im')} FROM e")
def unary_math_realpart(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    v = lat.t("v")[0, 0]
    maps = {"abs": lambda x: F.abs(-x), "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "log": log, "pow": lambda x: F.pow(x, F.lit(1.5))}
    e = C(F.lit(0.01) * v.re, F.lit(0.01) * v.im).exp()
    return lat.df.select(*keys(lat), *[r(column(v.real_map(f).re)).alias(f"{n}_re") for n, f in maps.items()], r(e.re).alias("exp_re"), r(e.im).alias("exp_im"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re * re - im * im', 'mul_re')}, {q('2 * re * im', 'mul_im')}, {q('-im', 'i_re')}, {q('re', 'i_im')}, {q('(re * re - im * im) / (re * re + im * im)', 'div_re')}, {q('2 * re * im / (re * re + im * im)', 'div_im')}, {q('re - im', 'sub_re')}, {q('im - re', 'sub_im')} FROM e")
def complex_arithmetic(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    v = lat.t("v")
    z = v[0, 0]
    out = Tensor([z * z, z.times_i(), z.over(z.conj()), z - C(z.im, z.re)], (4, 1))
    return lat.df.select(*keys(lat), *parts(out, "mul", "i", "div", "sub"))


@query("SELECT event_id::BIGINT AS site, (event_id % 7)::BIGINT AS mod7, (event_id // 7)::BIGINT AS div7 FROM events")
def integer_mod_div(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    i = lat.t("i")
    return lat.df.select(lat.grid.site().alias("site"), to_real(predicates.mod(i, 7)).cast("long").alias("mod7"), to_real(predicates.div(i, 7)).cast("long").alias("div7"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re * re + im * im', 'norm2')} FROM e")
def local_norm2(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    return lat.df.select(*keys(lat), r(lat.t("v").norm2()).alias("norm2"))


@query(f"WITH {EV} SELECT {XYZ}, {q('CASE WHEN x0 = 1 AND x1 = 2 AND x2 = 3 THEN 7.5 ELSE re END', 're')} FROM e WHERE x0 = 1 AND x1 = 2")
def poke_peek(spark, sf_dir):
    lat = sites.poke(events_lattice(spark, sf_dir), "v", (1, 2, 3), 7.5)
    return lat.df.filter("x0 = 1 and x1 = 2").select(*keys(lat), r(F.col("v_0_re")).alias("re"))


# ---- reductions ---------------------------------------------------------------------------


@query(f"WITH {EV} SELECT {q('sum(re)', 're', 3)}, {q('sum(im)', 'im', 3)} FROM e")
def global_sum(spark, sf_dir):
    got = reductions.total(events_lattice(spark, sf_dir), "v")
    return got.select(r(F.col("v_0_re"), 3).alias("re"), r(F.col("v_0_im"), 3).alias("im"))


@query(f"WITH {EV} SELECT {q('sum(re * re + im * im)', 'norm2', 4)} FROM e")
def norm2(spark, sf_dir):
    return reductions.norm2(events_lattice(spark, sf_dir), "v").select(r(F.col("norm2"), 4).alias("norm2"))


@query(f"WITH {EV} SELECT {q('sum(re * event_id)', 're', 2)}, {q('sum(-im * event_id)', 'im', 2)}, {q('sum(re * re + im * im)', 'norm2', 4)} FROM e")
def inner_product_norm(spark, sf_dir):
    got = reductions.inner_product(events_lattice(spark, sf_dir), "v", "i")
    return got.select(r(F.col("re"), 2).alias("re"), r(F.col("im"), 2).alias("im"), r(F.col("norm2"), 4).alias("norm2"))


@query(f"WITH {EV} SELECT {q('max(re * re + im * im)', 'max_norm2')} FROM e")
def max_local_norm2(spark, sf_dir):
    return reductions.max_local_norm2(events_lattice(spark, sf_dir), "v").select(r(F.col("max_norm2")).alias("max_norm2"))


@query(f"WITH {EV} SELECT {q('sum(pow(0.5 * re + event_id, 2) + pow(0.5 * im, 2))', 'norm2', 2)} FROM e")
def axpy_norm(spark, sf_dir):
    _, got = reductions.axpy_norm(events_lattice(spark, sf_dir), 0.5, "v", "i")
    return got.select(r(F.col("norm2"), 2).alias("norm2"))


@query(f"WITH {EV} SELECT x2::BIGINT AS x2, {q('sum(re)', 're', 4)}, {q('sum(im)', 'im', 4)} FROM e GROUP BY x2")
def slice_sum(spark, sf_dir):
    got = reductions.slice_sum(events_lattice(spark, sf_dir), "v", 2)
    return got.select(F.col("x2").cast("long").alias("x2"), r(F.col("v_0_re"), 4).alias("re"), r(F.col("v_0_im"), 4).alias("im"))


@query(f"WITH {EV} SELECT x0::BIGINT AS x0, {q('sum(re * re + im * im)', 'norm2', 4)}, {q('sum(re * event_id)', 're', 2)} FROM e GROUP BY x0")
def slice_norm_inner(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    a, b = reductions.slice_norm2(lat, "v", 0), reductions.slice_inner_product(lat, "v", "i", 0)
    return a.join(b, "x0").select(F.col("x0").cast("long").alias("x0"), r(F.col("norm2"), 4).alias("norm2"), r(F.col("re"), 2).alias("re"))


@query(f"WITH {EV} SELECT {XYZ}, {q('(x0 + 1) * re + event_id', 're', 4)} FROM e")
def slice_axpy(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    factors = spark.range(10).select(F.col("id").cast("int").alias("slice"), (F.col("id") + 1.0).alias("a"))
    got = reductions.slice_axpy(lat, factors, "v", "i", 0)
    return got.df.select(*keys(got), r(F.col("z_0_re"), 4).alias("re"))


@query(f"WITH {EV} SELECT (x0 // 5)::BIGINT AS x0, (x1 // 2)::BIGINT AS x1, (x2 // 5)::BIGINT AS x2, {q('sum(re)', 're', 4)}, {q('sum(im)', 'im', 4)} FROM e GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY x0 // 5, x1 // 2, x2 // 5"))
def block_sum(spark, sf_dir):
    got = reductions.block_sum(events_lattice(spark, sf_dir), "v", (5, 2, 5))
    return got.df.select(*keys(got), r(F.col("v_0_re"), 4).alias("re"), r(F.col("v_0_im"), 4).alias("im"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re / sqrt(sum(re * re + im * im) OVER (PARTITION BY x0 // 5, x1 // 2, x2 // 5))', 're')} FROM e")
def block_normalise(spark, sf_dir):
    got = reductions.block_normalise(events_lattice(spark, sf_dir), "v", (5, 2, 5))
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("re"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re * sum(re * event_id) OVER (PARTITION BY x0 // 5, x1 // 2, x2 // 5) + im * sum(im * event_id) OVER (PARTITION BY x0 // 5, x1 // 2, x2 // 5)', 're', 4)} FROM e")
def block_project_promote(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    coarse = reductions.block_project(lat, "i", ["v"], (5, 2, 5))
    got = reductions.block_promote(lat, coarse, ["v"], (5, 2, 5))
    return got.df.select(*keys(got), r(F.col("f_0_re"), 4).alias("re"))


@query("WITH e AS (SELECT event_id % 10 AS x0, (event_id // 10) % 10 AS x1, event_id // 100 AS x2, value AS re FROM events), n AS (SELECT count(*) // 100 AS l2 FROM events) SELECT (x0 + 10 * i)::BIGINT AS x0, x1::BIGINT AS x1, (x2 + l2 * j)::BIGINT AS x2, round(re, 6) + 0.0 AS re FROM e, n, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1, 2]) AS j)")
def replicate(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("v")
    a, b, c = lat.grid.dims
    got = sites.replicate(lat, Grid((2 * a, b, 3 * c)))
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("re"))


@query(f"WITH {EV}, v AS (SELECT re AS a_re, im AS a_im, event_id::DOUBLE AS b FROM e) SELECT k.i::BIGINT AS i, k.j::BIGINT AS j, round(CASE WHEN k.i = 0 AND k.j = 0 THEN aa WHEN k.i = 1 AND k.j = 1 THEN bb ELSE ab END, 2) + 0.0 AS re, round(CASE WHEN k.i = k.j THEN 0.0 WHEN k.i = 0 THEN -ib ELSE ib END, 2) + 0.0 AS im FROM (SELECT sum(a_re * a_re + a_im * a_im) AS aa, sum(b * b) AS bb, sum(a_re * b) AS ab, sum(a_im * b) AS ib FROM v), (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) k")
def gram_matrix(spark, sf_dir):
    got = reductions.gram(events_lattice(spark, sf_dir), ["v", "i"])
    return got.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r(F.col("re"), 2).alias("re"), r(F.col("im"), 2).alias("im"))


@query(f"WITH {EV} SELECT {XYZ}, {q('2 * re - event_id', 'a')}, {q('re + 3 * event_id', 'b')} FROM e")
def basis_rotate(spark, sf_dir):
    got = reductions.rotate(events_lattice(spark, sf_dir), ["v", "i"], [[2, -1], [1, 3]])
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("a"), r(F.col("i_0_re")).alias("b"))


PI2 = "6.283185307179586"


@query(f"WITH {EV} SELECT p::BIGINT AS p, x2::BIGINT AS t, round(sum(re * cos(th0) - im * sin(th0)), 4) + 0.0 AS re, round(sum(re * sin(th0) + im * cos(th0)), 4) + 0.0 AS im FROM (SELECT *, {PI2} * (d0 * x0 + d1 * x1) / 10 AS th0 FROM e, (SELECT unnest([0, 1, 2]) AS p, unnest([0, 1, 1]) AS d0, unnest([0, 0, 2]) AS d1)) GROUP BY p, x2")
def momentum_project(spark, sf_dir):
    got = reductions.momentum_project(events_lattice(spark, sf_dir), "v", [(0, 0), (1, 0), (1, 2)], 2)
    return got.select(F.col("p").cast("long").alias("p"), F.col("t").cast("long").alias("t"), r(F.col("re"), 4).alias("re"), r(F.col("im"), 4).alias("im"))


# ---- shifts, slices, regions ----------------------------------------------------------------


def _shift_sql(mu: int, by: int) -> str:
    d = tuple(by * (k == mu) for k in range(3))
    return f"WITH {EV} SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, b.event_id::BIGINT AS source FROM e a, n, e b WHERE {moved(d)}"


def _shifted(spark, sf_dir, *moves):
    lat = events_lattice(spark, sf_dir).keep("i")
    for mu, by in moves:
        lat = lat.shift(mu, by)
    return lat.df.select(*keys(lat), F.col("i_0_re").cast("long").alias("source"))


@query(_shift_sql(0, 1))
def cshift_fwd(spark, sf_dir):
    return _shifted(spark, sf_dir, (0, 1))


@query(_shift_sql(2, -3))
def cshift_bwd(spark, sf_dir):
    return _shifted(spark, sf_dir, (2, -3))


@query(_shift_sql(1, 5))
def cshift_twice(spark, sf_dir):
    return _shifted(spark, sf_dir, (1, 2), (1, 3))


@query(f"WITH {EV} SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, b.event_id::BIGINT AS corner FROM e a, n, e b WHERE {moved((1, -1, 2))}")
def stencil_diagonal(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("i")
    got, names = lat.gather([("i", (1, -1, 2))])
    return got.df.select(*keys(got), got.t(names[("i", (1, -1, 2))])[0, 0].re.cast("long").alias("corner"))


@query(f"WITH {EV} SELECT x0::BIGINT AS x0, x2::BIGINT AS x1, {q('re', 're')} FROM e WHERE x1 = 4")
def extract_slice(spark, sf_dir):
    got = sites.extract_slice(events_lattice(spark, sf_dir), 1, 4)
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("re"))


@query(f"WITH {EV} SELECT {XYZ}, {q('CASE WHEN x1 = 4 THEN -re ELSE re END', 're')} FROM e")
def insert_slice(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("v")
    low = sites.extract_slice(lat, 1, 4)
    got = sites.insert_slice(lat, low.put(v=-low.t("v")), 1, 4)
    return got.df.select(*keys(got), r(F.col("v_0_re")).alias("re"))


@query(f"WITH {EV} SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, coalesce(b.event_id, a.event_id)::BIGINT AS source FROM e a LEFT JOIN e b ON a.x0 BETWEEN 5 AND 7 AND a.x1 BETWEEN 1 AND 2 AND a.x2 BETWEEN 4 AND 7 AND b.x0 = a.x0 - 5 AND b.x1 = a.x1 + 2 AND b.x2 = a.x2 - 3")
def copy_region(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("i")
    got = sites.copy_region(lat, lat, (0, 3, 1), (5, 1, 4), (3, 2, 4))
    return got.df.select(*keys(got), F.col("i_0_re").cast("long").alias("source"))


@query(f"WITH {EV} SELECT {XYZ}, {q('CASE WHEN x0 BETWEEN 5 AND 9 AND x1 BETWEEN 2 AND 3 AND x2 BETWEEN 0 AND 4 THEN re ELSE 0 END', 're')} FROM e")
def block_pick(spark, sf_dir):
    got = sites.block_pick(events_lattice(spark, sf_dir), "v", (5, 2, 5), (1, 1, 0))
    return got.df.select(*keys(got), r(F.col("picked_0_re")).alias("re"))


@query(f"WITH {EV} SELECT (x0 + d)::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, event_id::BIGINT AS source FROM e, (SELECT unnest([-10, 0, 10]) AS d) WHERE x0 + d BETWEEN -2 AND 11")
def padded_cell(spark, sf_dir):
    lat = events_lattice(spark, sf_dir).keep("i")
    return sites.pad(lat, 0, 2).select(*keys(lat), F.col("i_0_re").cast("long").alias("source"))


# ---- stencils and solvers --------------------------------------------------------------------

HOPS = "o AS (SELECT unnest([0, 1, -1, 0, 0, 0, 0]) AS d0, unnest([0, 0, 0, 1, -1, 0, 0]) AS d1, unnest([0, 0, 0, 0, 0, 1, -1]) AS d2)"


def _stencil_sql(name: str, source: str, own: float, hop: float) -> str:
    """A CTE: own f + hop (sum of neighbours), for columns fr and fi."""
    w = f"CASE WHEN d0 = 0 AND d1 = 0 AND d2 = 0 THEN {own} ELSE {hop} END"
    return (
        f"{name} AS (SELECT ((x0 + d0) % 10 + 10) % 10 AS x0, ((x1 + d1) % 10 + 10) % 10 AS x1, ((x2 + d2) % l2 + l2) % l2 AS x2, sum(({w}) * fr) AS fr, sum(({w}) * fi) AS fi "
        f"FROM {source}, n, o GROUP BY ((x0 + d0) % 10 + 10) % 10, ((x1 + d1) % 10 + 10) % 10, ((x2 + d2) % l2 + l2) % l2)"
    )


B0 = "b AS (SELECT x0, x1, x2, re AS fr, im AS fi FROM e)"


@query(f"WITH {EV}, {HOPS}, {B0}, {_stencil_sql('l', 'b', -6.0, 1.0)} SELECT {XYZ}, {q('fr', 're', 4)}, {q('fi', 'im', 4)} FROM l")
def laplacian(spark, sf_dir):
    lat = linear.laplacian(3)(events_lattice(spark, sf_dir).keep("v"), "v", "l")
    return lat.df.select(*keys(lat), r(F.col("l_0_re"), 4).alias("re"), r(F.col("l_0_im"), 4).alias("im"))


@query(f"WITH {EV}, {HOPS}, {B0}, {_stencil_sql('s1', 'b', 1 - 6 * 0.125, 0.125)}, {_stencil_sql('s2', 's1', 1 - 6 * 0.125, 0.125)} SELECT {XYZ}, {q('fr', 're', 8)} FROM s2")
def gaussian_smear_scalar(spark, sf_dir):
    lat = linear.smear(events_lattice(spark, sf_dir).keep("v"), "v", 1.0, 2)
    return lat.df.select(*keys(lat), r(F.col("v_0_re"), 8).alias("re"))


def _axpy_sql(name: str, x: str, a: str, y: str) -> str:
    """A CTE: y + a x with a scalar subquery a."""
    return f"{name} AS (SELECT y.x0, y.x1, y.x2, y.fr + ({a}) * x.fr AS fr, y.fi + ({a}) * x.fi AS fi FROM {y} y JOIN {x} x USING (x0, x1, x2))"


def _dot_sql(a: str, b: str) -> str:
    return f"(SELECT sum(a.fr * b.fr + a.fi * b.fi) FROM {a} a JOIN {b} b USING (x0, x1, x2))"


def _ones(name: str, value: str) -> str:
    return f"{name} AS (SELECT {value} AS a)"


CG_SQL = ", ".join([
    EV, HOPS, B0, _stencil_sql("q0", "b", 7.0, -1.0), _ones("rr0", _dot_sql("b", "b")), _ones("al0", f"(SELECT a FROM rr0) / {_dot_sql('b', 'q0')}"),
    _axpy_sql("r1", "q0", "-(SELECT a FROM al0)", "b"), _ones("rr1", _dot_sql("r1", "r1")), _axpy_sql("p1", "b", "(SELECT a FROM rr1) / (SELECT a FROM rr0)", "r1"),
    _stencil_sql("q1", "p1", 7.0, -1.0), _ones("al1", f"(SELECT a FROM rr1) / {_dot_sql('p1', 'q1')}"), _axpy_sql("r2", "q1", "-(SELECT a FROM al1)", "r1"), _ones("rr2", _dot_sql("r2", "r2")),
])


@query(f"WITH {CG_SQL} SELECT 0::BIGINT AS k, 1.0::DOUBLE AS residual UNION ALL SELECT 1::BIGINT, round((SELECT a FROM rr1) / (SELECT a FROM rr0), 8) + 0.0 UNION ALL SELECT 2::BIGINT, round((SELECT a FROM rr2) / (SELECT a FROM rr0), 8) + 0.0")
def cg_k_iterations(spark, sf_dir):
    got = linear.conjugate_gradient(linear.massive(3, 1.0), events_lattice(spark, sf_dir).keep("v"), "v", tol=0.0, most=2)
    return spark.createDataFrame([(k, round(x / got.residuals[0], 8)) for k, x in enumerate(got.residuals)], "k long, residual double")


@query(f"WITH {EV}, {HOPS}, {B0}, {_stencil_sql('w0', 'b', 7.0, -1.0)}, {_stencil_sql('w1', 'w0', 7.0, -1.0)} SELECT round({_dot_sql('w0', 'w1')} / {_dot_sql('w0', 'w0')}, 6) + 0.0 AS eigenvalue")
def power_method_k(spark, sf_dir):
    got = linear.power_method(linear.massive(3, 1.0), events_lattice(spark, sf_dir).keep("v"), "v", 2)
    return spark.createDataFrame([(round(got, 6),)], "eigenvalue double")


@query(f"WITH {EV}, {HOPS}, {B0}, {_stencil_sql('t1', 'b', 7.0 / 6 - 7.0 / 6, -1.0 / 6)}, {_stencil_sql('a1', 't1', 0.0, -1.0 / 6)} SELECT b.x0::BIGINT AS x0, b.x1::BIGINT AS x1, b.x2::BIGINT AS x2, round(0.5 * b.fr + 0.25 * t1.fr + 0.125 * (2 * a1.fr - b.fr), 7) + 0.0 AS re FROM b JOIN t1 USING (x0, x1, x2) JOIN a1 USING (x0, x1, x2)")
def chebyshev_k(spark, sf_dir):
    lat = linear.chebyshev(linear.massive(3, 1.0), events_lattice(spark, sf_dir).keep("v"), "v", [1.0, 0.25, 0.125], 1.0, 13.0)
    return lat.df.select(*keys(lat), r(F.col("cheb_0_re"), 7).alias("re"))


@query()
def solvers_agree(spark, sf_dir):
    """Relative residuals that six solvers reach on one well-conditioned system."""
    lat, a = events_lattice(spark, sf_dir).keep("v").cut(), linear.massive(3, 20.0)
    runs = {
        "bicgstab": linear.bicgstab(a, lat, "v", tol=1e-4), "cg": linear.conjugate_gradient(a, lat, "v", tol=1e-4), "cr": linear.conjugate_residual(a, lat, "v", tol=1e-4),
        "gcr": linear.gcr(a, lat, "v", tol=1e-4), "gmres": linear.gmres(a, lat, "v", steps=6, tol=1e-4), "mr": linear.minimal_residual(a, lat, "v", tol=1e-4),
    }
    return spark.createDataFrame([(n, bool(s.residuals[-1] <= 1e-6 * s.residuals[0])) for n, s in runs.items()], "solver string, converged boolean")


@query()
def lanczos_bounds(spark, sf_dir):
    """Ritz values of the massive operator lie within its spectrum [1, 13]."""
    values, _ = linear.lanczos(linear.massive(3, 1.0), events_lattice(spark, sf_dir).keep("v").cut(), "v", 5)
    return spark.createDataFrame([(k, float(v), bool(1 - 1e-9 <= v <= 13 + 1e-9)) for k, v in enumerate(values)], "k long, ritz double, inside boolean")


# ---- gauge observables -----------------------------------------------------------------------


def _angle(mu: int, d: tuple[int, int, int], alias: str) -> str:
    return f"({mu + 1} * {alias}.th)"


def _loop_sql(path: tuple[int, ...]) -> tuple[str, str]:
    """FROM clause and phase of a U(1) path from the row a.

    Every site has all its neighbours, so the outer joins lose and add nothing; they keep
    the joins in the order of the path, each by a key.
    """
    at, joins, phase = [0, 0, 0], [], []
    for k, s in enumerate(path):
        mu = s if s >= 0 else -s - 1
        if s < 0:
            at[mu] -= 1
        joins.append(f"LEFT JOIN e w{k} ON " + moved(tuple(at)).replace("b.", f"w{k}."))
        phase.append(f"{'-' if s < 0 else '+'} {mu + 1} * w{k}.th")
        if s >= 0:
            at[mu] += 1
    return "e a CROSS JOIN n " + " ".join(joins), " ".join(phase)


def _loop_select(path: tuple[int, ...], select: str, tail: str = "") -> str:
    source, phase = _loop_sql(path)
    return f"SELECT {select.replace('PHASE', '(' + phase + ')')} FROM {source} {tail}"


P01, P02, P12 = gauge.plaquette_path(0, 1), gauge.plaquette_path(0, 2), gauge.plaquette_path(1, 2)


@query(f"WITH {EV}, p AS ({' UNION ALL '.join(_loop_select(p, 'sum(cos(PHASE)) AS s') for p in (P01, P02, P12))}) SELECT round(sum(s) / (3 * (SELECT count(*) FROM events)), 8) + 0.0 AS average FROM p")
def plaquette_u1(spark, sf_dir):
    return gauge.average_plaquette(abelian_lattice(spark, sf_dir)).select(r(F.col("average"), 8).alias("average"))


@query(f"WITH {EV} " + _loop_select(P01, "a.x2::BIGINT AS t, round(sum(cos(PHASE)), 6) + 0.0 AS plaquette", "GROUP BY a.x2"))
def plaquette_timeslice(spark, sf_dir):
    got = gauge.plaquette_by_slice(abelian_lattice(spark, sf_dir), 2)
    return got.select(F.col("t").cast("long").alias("t"), r(F.col("plaquette")).alias("plaquette"))


@query(f"WITH {EV}, p AS ({' UNION ALL '.join(_loop_select(gauge.loop_path(2, 1, a, b), 'sum(cos(PHASE)) AS s') for a in range(3) for b in range(3) if a != b)}) SELECT round(sum(s) / (6 * (SELECT count(*) FROM events)), 8) + 0.0 AS average FROM p")
def wilson_loop_2x1(spark, sf_dir):
    return gauge.average_loop(abelian_lattice(spark, sf_dir), 2, 1).select(r(F.col("average"), 8).alias("average"))


@query(f"WITH {EV} SELECT round(sum(cos(th) + cos(2 * th) + cos(3 * th)) / (3 * count(*)), 8) + 0.0 AS link_trace FROM e")
def link_trace_u1(spark, sf_dir):
    return gauge.link_trace(abelian_lattice(spark, sf_dir)).select(r(F.col("link_trace"), 8).alias("link_trace"))


def _staple_sql() -> str:
    """Staples of direction 0: the path back from x + 0, with the start displaced first."""
    out = []
    for nu in (1, 2):
        for path in ((nu, -1, -nu - 1), (-nu - 1, -1, nu)):
            at, joins, phase = [1, 0, 0], [], []
            for k, s in enumerate(path):
                mu = s if s >= 0 else -s - 1
                if s < 0:
                    at[mu] -= 1
                joins.append(f"LEFT JOIN e w{k} ON " + moved(tuple(at)).replace("b.", f"w{k}."))
                phase.append(f"{'-' if s < 0 else '+'} {mu + 1} * w{k}.th")
                if s >= 0:
                    at[mu] += 1
            p = " ".join(phase)
            out.append(f"SELECT a.x0, a.x1, a.x2, cos({p}) AS c, sin({p}) AS s FROM e a CROSS JOIN n {' '.join(joins)}")
    return " UNION ALL ".join(out)


@query(f"WITH {EV}, s AS ({_staple_sql()}) SELECT {XYZ}, round(sum(c), 6) + 0.0 AS re, round(sum(s), 6) + 0.0 AS im FROM s GROUP BY x0, x1, x2")
def staple_u1(spark, sf_dir):
    got = gauge.staple(abelian_lattice(spark, sf_dir), 0)
    return got.df.select(*keys(got), r(F.col("staple_0_re")).alias("re"), r(F.col("staple_0_im")).alias("im"))


@query(f"WITH {EV}, l AS (SELECT x0, x2, sum(2 * th) AS a FROM e GROUP BY x0, x2) SELECT round(avg(cos(a)), 6) + 0.0 AS re, round(avg(sin(a)), 6) + 0.0 AS im FROM l")
def polyakov_u1(spark, sf_dir):
    got = gauge.polyakov_loop(abelian_lattice(spark, sf_dir), 1)
    return got.select(r(F.col("re")).alias("re"), r(F.col("im")).alias("im"))


@query(f"WITH {EV}, p AS ({' UNION ALL '.join(_loop_select(p, 'sum(cos(PHASE)) AS s') for p in (P01, P02, P12))}) SELECT round(2.5 * (1 - sum(s) / (3 * (SELECT count(*) FROM events))) * 3 * (SELECT count(*) FROM events), 3) + 0.0 AS action FROM p")
def wilson_gauge_action(spark, sf_dir):
    return gauge.wilson_action(abelian_lattice(spark, sf_dir), 2.5).select(r(F.col("action"), 3).alias("action"))


@query(f"WITH {EV} SELECT a.x0::BIGINT AS x0, a.x1::BIGINT AS x1, a.x2::BIGINT AS x2, round(cos(a.th) * b.re - sin(a.th) * b.im, 6) + 0.0 AS re, round(cos(a.th) * b.im + sin(a.th) * b.re, 6) + 0.0 AS im FROM e a CROSS JOIN n JOIN e b ON {moved((1, 0, 0))}")
def covariant_shift(spark, sf_dir):
    got = gauge.covariant_shift(abelian_lattice(spark, sf_dir), "v", 0)
    return got.df.select(*keys(got), r(F.col("cs_0_re")).alias("re"), r(F.col("cs_0_im")).alias("im"))


def _hop_sql() -> str:
    out = []
    for mu in range(3):
        d = tuple(int(k == mu) for k in range(3))
        m = tuple(-x for x in d)
        out.append(f"SELECT a.x0, a.x1, a.x2, cos({mu + 1} * a.th) * b.re - sin({mu + 1} * a.th) * b.im AS re FROM e a CROSS JOIN n JOIN e b ON {moved(d)}")
        out.append(f"SELECT a.x0, a.x1, a.x2, cos({mu + 1} * b.th) * b.re + sin({mu + 1} * b.th) * b.im AS re FROM e a CROSS JOIN n JOIN e b ON {moved(m)}")
    return " UNION ALL ".join(out)


@query(f"WITH {EV}, h AS ({_hop_sql()}), s AS (SELECT x0, x1, x2, sum(re) AS h FROM h GROUP BY x0, x1, x2) SELECT {XYZ}, round(6.5 * e.re - s.h, 4) + 0.0 AS re FROM e JOIN s USING (x0, x1, x2)")
def covariant_laplacian(spark, sf_dir):
    got = linear.covariant_laplacian(3, ["u0", "u1", "u2"], 0.5)(abelian_lattice(spark, sf_dir), "v", "l")
    return got.df.select(*keys(got), r(F.col("l_0_re"), 4).alias("re"))


@query()
def flow_lowers_energy(spark, sf_dir):
    """Gradient flow of the U(1) links: the energy falls with each step."""
    lat = abelian_lattice(spark, sf_dir).keep("u0", "u1", "u2").cut()
    log = [(0.0, evolution.energy_density(lat))]
    evolution.wilson_flow(lat, 0.02, 2, lambda t, x: log.append((t, evolution.energy_density(x))))
    return spark.createDataFrame([(t, e, bool(k == 0 or e < log[k - 1][1])) for k, (t, e) in enumerate(log)], "flow_time double, energy double, lower boolean")


# ---- matrices and spin -----------------------------------------------------------------------


def _m(mu: int, k: int, part: int) -> str:
    return f"embedding[{8 * mu + 2 * k + part + 1}]::DOUBLE"


def _mm(mu: int, nu: int) -> list[str]:
    """Rounded parts of the 2 x 2 product m_mu m_nu."""
    out = []
    for i in range(2):
        for j in range(2):
            re = " + ".join(f"({_m(mu, 2 * i + k, 0)} * {_m(nu, 2 * k + j, 0)} - {_m(mu, 2 * i + k, 1)} * {_m(nu, 2 * k + j, 1)})" for k in range(2))
            im = " + ".join(f"({_m(mu, 2 * i + k, 0)} * {_m(nu, 2 * k + j, 1)} + {_m(mu, 2 * i + k, 1)} * {_m(nu, 2 * k + j, 0)})" for k in range(2))
            out += [q(re, f"c{2 * i + j}_re"), q(im, f"c{2 * i + j}_im")]
    return out


SITE = "vec_id::BIGINT AS site"


def _tensor_query(spark, sf_dir, f: Callable[[Lattice], Tensor], n: int = 2) -> DataFrame:
    lat = matrix_lattice(spark, sf_dir, n)
    return lat.df.select(lat.grid.site().alias("site"), *parts(f(lat)))


@query(f"SELECT {SITE}, {', '.join(_mm(0, 1))} FROM embeddings")
def matrix_mul_2x2(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0") * t.t("m1"))


@query(f"SELECT {SITE}, {', '.join(x for i in range(2) for j in range(2) for x in (q(_m(0, 2 * j + i, 0), f'c{2 * i + j}_re'), q('-' + _m(0, 2 * j + i, 1), f'c{2 * i + j}_im')))} FROM embeddings")
def adjoint(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0").adj())


@query(f"SELECT {SITE}, {q(_m(0, 0, 0) + ' + ' + _m(0, 3, 0), 'c0_re')}, {q(_m(0, 0, 1) + ' + ' + _m(0, 3, 1), 'c0_im')} FROM embeddings")
def trace(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0").trace())


_A, _B, _CC, _D = ([_m(0, k, p) for p in (0, 1)] for k in range(4))


@query(f"SELECT {SITE}, 0.0::DOUBLE AS c0_re, {q(f'({_A[1]} - {_D[1]}) / 2', 'c0_im')}, {q(f'({_B[0]} - {_CC[0]}) / 2', 'c1_re')}, {q(f'({_B[1]} + {_CC[1]}) / 2', 'c1_im')}, {q(f'({_CC[0]} - {_B[0]}) / 2', 'c2_re')}, {q(f'({_CC[1]} + {_B[1]}) / 2', 'c2_im')}, 0.0::DOUBLE AS c3_re, {q(f'({_D[1]} - {_A[1]}) / 2', 'c3_im')} FROM embeddings")
def ta_project_2x2(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: t.t("m0").ta())


_DET_RE = f"({_A[0]} * {_D[0]} - {_A[1]} * {_D[1]} - {_B[0]} * {_CC[0]} + {_B[1]} * {_CC[1]})"
_DET_IM = f"({_A[0]} * {_D[1]} + {_A[1]} * {_D[0]} - {_B[0]} * {_CC[1]} - {_B[1]} * {_CC[0]})"


@query(f"SELECT {SITE}, {q(_DET_RE, 'c0_re')}, {q(_DET_IM, 'c0_im')} FROM embeddings")
def determinant(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: Tensor([t.t("m0").det()]))


def _over_det(re: str, im: str) -> tuple[str, str]:
    d = f"({_DET_RE} * {_DET_RE} + {_DET_IM} * {_DET_IM})"
    return f"(({re}) * {_DET_RE} + ({im}) * {_DET_IM}) / {d}", f"(({im}) * {_DET_RE} - ({re}) * {_DET_IM}) / {d}"


@query("SELECT " + SITE + ", " + ", ".join(q(x, f"c{k}_{p}", 4) for k, (z, s) in enumerate(((_D, ""), (_B, "-"), (_CC, "-"), (_A, ""))) for p, x in zip(("re", "im"), _over_det(s + z[0], s + z[1]), strict=True)) + " FROM embeddings")
def inverse_2x2(spark, sf_dir):
    lat = matrix_lattice(spark, sf_dir)
    return lat.df.select(lat.grid.site().alias("site"), *parts(lat.t("m0").inverse(), digits=4))


def _psi(k: int) -> tuple[str, str]:
    return f"embedding[{2 * k + 1}]::DOUBLE", f"embedding[{2 * k + 2}]::DOUBLE"


def _gamma_sql(m: np.ndarray) -> str:
    """A spin matrix on the spinor; each row has one element."""
    out = []
    for s in range(4):
        (t,) = np.flatnonzero(m[s])
        z = m[s, t]
        for c in range(3):
            re, im = _psi(3 * t + c)
            out.append(q(f"({z.real}) * {re} - ({z.imag}) * {im}", f"c{3 * s + c}_re"))
            out.append(q(f"({z.real}) * {im} + ({z.imag}) * {re}", f"c{3 * s + c}_im"))
    return f"SELECT {SITE}, {', '.join(out)} FROM embeddings"


@query(_gamma_sql(spin.gamma("XT")))
def gamma_mul(spark, sf_dir):
    return _tensor_query(spark, sf_dir, lambda t: spin.times(spin.gamma("X"), spin.times(spin.gamma("T"), t.t("psi"))))


@query(f"SELECT {SITE}, {', '.join(x for i in range(4) for j in range(4) for x in (q(' + '.join(f'({_psi(3 * i + c)[0]} * {_psi(3 * j + c)[0]} + {_psi(3 * i + c)[1]} * {_psi(3 * j + c)[1]})' for c in range(3)), f'c{4 * i + j}_re'), q(' + '.join(f'({_psi(3 * i + c)[1]} * {_psi(3 * j + c)[0]} - {_psi(3 * i + c)[0]} * {_psi(3 * j + c)[1]})' for c in range(3)), f'c{4 * i + j}_im')))} FROM embeddings")
def trace_index_colour(spark, sf_dir):
    """Color trace of the outer product of a spinor with itself: a spin matrix."""
    return _tensor_query(spark, sf_dir, lambda t: trace_index(t.t("psi").outer(t.t("psi")), 4, 3, True))


@query("WITH v AS (SELECT vec_id // 50 AS t, unnest(embedding[1:24])::DOUBLE AS x FROM embeddings) SELECT t::BIGINT AS t, round(sum(x * x), 4) + 0.0 AS re FROM v GROUP BY t")
def meson_2pt(spark, sf_dir):
    got = contractions.meson_two_point(matrix_lattice(spark, sf_dir), "psi", 2)
    return got.select(F.col("t").cast("long").alias("t"), r(F.col("re"), 4).alias("re"))


@query()
def meson_field(spark, sf_dir):
    """All pairs of two spinors with two spin matrices and two momenta, by time slice."""
    lat = matrix_lattice(spark, sf_dir)
    lat = lat.put(phi=spin.times(spin.gamma("Z"), lat.t("psi")))
    got = contractions.meson_field(lat, ["psi", "phi"], ["psi", "phi"], {"5": spin.gamma("5"), "I": spin.gamma("I")}, 2, [(0, 0), (1, 0)])
    return got.withColumns({"re": r(F.col("re"), 4), "im": r(F.col("im"), 4)})


@query()
def wilson_gamma5_hermitian(spark, sf_dir):
    """<a, g5 M g5 b> = <M a, b> for the Wilson matrix on unitary 3 x 3 links."""
    lat = matrix_lattice(spark, sf_dir, 3)
    lat = filled(lat, table(spark, sf_dir, "embeddings").count(), ("m0", "m1", "m2"))
    lat = lat.put(a=lat.t("psi"))
    for mu in range(3):
        lat = gauge.project_unitary(lat, f"m{mu}", f"u{mu}")
    lat = lat.keep("u0", "u1", "u2", "a").cut()
    lat = sites.random_fields(lat, 3, "gaussian", "b", (4, 3))
    m = fermions.wilson(3, ["u0", "u1", "u2"], 0.1)
    lat = fermions.gamma5(m(lat, "a", "ma"), "b", "gb").cut()
    lat = fermions.gamma5(m(lat, "gb", "mgb"), "mgb", "gmgb")
    x, y = linear.dots(lat, [("ma", "b"), ("a", "gmgb")])
    return spark.createDataFrame([(round(x.real, 6), round(x.imag, 6), bool(abs(x - y) < 1e-6 * abs(x)))], "re double, im double, equal boolean")


# ---- transforms -------------------------------------------------------------------------------


@query(f"WITH {EV}, k AS (SELECT unnest(range(10)) AS k0) SELECT k0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, round(sum(re * cos({PI2} * k0 * x0 / 10) + im * sin({PI2} * k0 * x0 / 10)), 4) + 0.0 AS re, round(sum(im * cos({PI2} * k0 * x0 / 10) - re * sin({PI2} * k0 * x0 / 10)), 4) + 0.0 AS im FROM e, k GROUP BY k0, x1, x2")
def dft_1d(spark, sf_dir):
    got = fourier.fft_dim(events_lattice(spark, sf_dir), "v", 0)
    return got.df.select(*keys(got), r(F.col("v_0_re"), 4).alias("re"), r(F.col("v_0_im"), 4).alias("im"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re', 're', 5)}, {q('im', 'im', 5)} FROM e")
def fft_round_trip(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    got = fourier.fft(fourier.fft(lat, "v"), "v", backward=True)
    return got.df.select(*keys(got), r(F.col("v_0_re"), 5).alias("re"), r(F.col("v_0_im"), 5).alias("im"))


@query(f"WITH {EV} SELECT {XYZ}, {q('re', 're', 4)} FROM e")
def free_propagator_inverse(spark, sf_dir):
    """The massive operator applied to the free propagator's result gives the source back."""
    lat = fourier.free_scalar(events_lattice(spark, sf_dir), "v", 1.0)
    got = linear.massive(3, 1.0)(lat, "v", "b")
    return got.df.select(*keys(got), r(F.col("b_0_re"), 4).alias("re"))


@query(f"WITH {EV} SELECT {XYZ}, {q('4 * pow(sin(3.141592653589793 * x0 / 10), 2) + 4 * pow(sin(3.141592653589793 * x1 / 10), 2) + 4 * pow(sin(3.141592653589793 * x2 / l2), 2)', 'khat2')} FROM e, n")
def photon_khat2(spark, sf_dir):
    lat = events_lattice(spark, sf_dir)
    return lat.df.select(*keys(lat), r(fourier.khat2(lat)).alias("khat2"))


@query("SELECT (sum(event_id) % 4294967296)::BIGINT AS word FROM events")
def nersc_checksum(spark, sf_dir):
    """Sum of the 32-bit words of the index field, stored as big-endian integers, modulo 2^32."""
    word, _, _ = binary.checksums(events_lattice(spark, sf_dir).keep("i"), ["i"], ">i4")
    return spark.createDataFrame([(word,)], "word long")


@query()
def scidac_checksum(spark, sf_dir):
    """XOR over sites of the rotated CRCs of the stored bytes."""
    _, a, b = binary.checksums(events_lattice(spark, sf_dir).keep("v"), ["v"])
    return spark.createDataFrame([(a, b)], "suma long, sumb long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plaquette_timeslice(spark, sf_dir)
