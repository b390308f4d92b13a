"""Reductions: to one row, to slices and to blocks; all combine before their one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.plans.lattice import Grid, Lattice


def _sums(t: Tensor, name: str) -> list[Column]:
    return [F.sum(column(x)).alias(f"{name}_{k}_{p}") for k, c in enumerate(t.items) for p, x in (("re", c.re), ("im", c.im))]


def total(lat: Lattice, name: str) -> DataFrame:
    """Sum of every component over the lattice, as one row."""
    return lat.df.agg(*_sums(lat.t(name), name))


def norm2(lat: Lattice, name: str) -> DataFrame:
    return lat.df.agg(F.sum(lat.t(name).norm2()).alias("norm2"))


def inner_product(lat: Lattice, a: str, b: str) -> DataFrame:
    """Sum of conj(a) b, and the norm of a beside it in the same pass."""
    p = lat.t(a).inner(lat.t(b))
    return lat.df.agg(F.sum(column(p.re)).alias("re"), F.sum(column(p.im)).alias("im"), F.sum(lat.t(a).norm2()).alias("norm2"))


def max_local_norm2(lat: Lattice, name: str) -> DataFrame:
    return lat.df.agg(F.max(lat.t(name).norm2()).alias("max_norm2"))


def axpy_norm(lat: Lattice, a: float, x: str, y: str, out: str = "z") -> tuple[Lattice, DataFrame]:
    """z = a x + y and its squared norm, computed in the same stage."""
    done = lat.put(**{out: lat.t(x).scale(a) + lat.t(y)})
    return done, norm2(done, out)


def slice_sum(lat: Lattice, name: str, mu: int) -> DataFrame:
    """Sum over all coordinates but mu."""
    return lat.df.groupBy(f"x{mu}").agg(*_sums(lat.t(name), name))


def slice_norm2(lat: Lattice, name: str, mu: int) -> DataFrame:
    return lat.df.groupBy(f"x{mu}").agg(F.sum(lat.t(name).norm2()).alias("norm2"))


def slice_inner_product(lat: Lattice, a: str, b: str, mu: int) -> DataFrame:
    p = lat.t(a).inner(lat.t(b))
    return lat.df.groupBy(f"x{mu}").agg(F.sum(column(p.re)).alias("re"), F.sum(column(p.im)).alias("im"))


def slice_axpy(lat: Lattice, factors: DataFrame, x: str, y: str, mu: int, out: str = "z") -> Lattice:
    """z = a(x_mu) x + y with one factor (x_mu, a) a slice."""
    met = lat.df.join(factors.select(F.col("slice").alias(f"x{mu}"), F.col("a").alias("__a")), f"x{mu}")
    got = Lattice(met, lat.grid, lat.shapes)
    got = got.put(**{out: got.t(x).scale(F.col("__a")) + got.t(y)})
    return got.keep(*lat.shapes, out)


def gram(lat: Lattice, names: list[str]) -> DataFrame:
    """All inner products of a set of fields in one pass: rows (i, j, re, im)."""
    pairs = [(i, j, lat.t(names[i]).inner(lat.t(names[j]))) for i in range(len(names)) for j in range(len(names))]
    one = lat.df.agg(*[F.sum(column(x)).alias(f"g{i}_{j}_{p}") for i, j, c in pairs for p, x in (("re", c.re), ("im", c.im))])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}_re").alias("re"), F.col(f"g{i}_{j}_im").alias("im")) for i, j, _ in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def rotate(lat: Lattice, names: list[str], matrix) -> Lattice:
    """Basis rotation: new[i] = sum_j matrix[i][j] old[j]."""
    def mixed(i: int) -> Tensor:
        out = lat.t(names[0]) * complex(matrix[i][0])
        for j in range(1, len(names)):
            out = out + lat.t(names[j]) * complex(matrix[i][j])
        return out

    return lat.put(**{n: mixed(i) for i, n in enumerate(names)})


def coarse_grid(grid: Grid, block: tuple[int, ...]) -> Grid:
    return Grid(tuple(n // b for n, b in zip(grid.dims, block, strict=True)))


def _block_keys(block: tuple[int, ...]) -> list[Column]:
    return [F.floor(F.col(f"x{k}") / b).cast("int").alias(f"x{k}") for k, b in enumerate(block)]


def block_sum(lat: Lattice, name: str, block: tuple[int, ...]) -> Lattice:
    """Sum inside blocks, as a field on the coarse grid."""
    df = lat.df.groupBy(*_block_keys(block)).agg(*_sums(lat.t(name), name))
    return Lattice(df, coarse_grid(lat.grid, block), {name: lat.shapes[name]})


def block_inner_product(lat: Lattice, a: str, b: str, block: tuple[int, ...], out: str = "ip", where: Column | None = None) -> Lattice:
    """Inner product inside blocks; ``where`` masks sites."""
    p = lat.t(a).inner(lat.t(b))
    parts = [column(x) if where is None else F.when(where, column(x)).otherwise(0.0) for x in (p.re, p.im)]
    df = lat.df.groupBy(*_block_keys(block)).agg(F.sum(parts[0]).alias(f"{out}_0_re"), F.sum(parts[1]).alias(f"{out}_0_im"))
    return Lattice(df, coarse_grid(lat.grid, block), {out: (1, 1)})


def with_coarse(lat: Lattice, coarse: Lattice, block: tuple[int, ...]) -> Lattice:
    """Fields of a coarse grid beside those of the fine sites of each block."""
    keys = [F.floor(F.col(f"x{k}") / b).cast("int").alias(f"__b{k}") for k, b in enumerate(block)]
    fine = lat.df.select("*", *keys)
    low = coarse.df.withColumnsRenamed({f"x{k}": f"__b{k}" for k in range(len(block))})
    return Lattice(fine.join(low, [f"__b{k}" for k in range(len(block))]).drop(*[f"__b{k}" for k in range(len(block))]), lat.grid, lat.shapes | coarse.shapes)


def block_zaxpy(lat: Lattice, coarse: Lattice, a: str, x: str, y: str, block: tuple[int, ...], out: str = "z") -> Lattice:
    """Fine z = a(block) x + y."""
    met = with_coarse(lat, coarse.keep(a), block)
    return met.put(**{out: met.t(x) * met.t(a) + met.t(y)}).keep(*lat.shapes, out)


def block_normalise(lat: Lattice, name: str, block: tuple[int, ...]) -> Lattice:
    """Each block scaled to norm one; a block of zeros gives infinities, as its norm to -1/2 is infinite."""
    met = with_coarse(lat, block_inner_product(lat, name, name, block, "__n"), block)
    return met.put(**{name: met.t(name).scale(F.pow(F.col("__n_0_re"), -0.5))}).keep(*lat.shapes)


def block_orthonormalise(lat: Lattice, names: list[str], block: tuple[int, ...]) -> Lattice:
    """Gram-Schmidt inside blocks, one vector after another."""
    for k, n in enumerate(names):
        for earlier in names[:k]:
            met = with_coarse(lat, block_inner_product(lat, earlier, n, block, "__c"), block)
            lat = met.put(**{n: met.t(n) - met.t(earlier) * met.t("__c")}).keep(*lat.shapes).cut()
        lat = block_normalise(lat, n, block).cut()
    return lat


def block_project(lat: Lattice, name: str, basis: list[str], block: tuple[int, ...]) -> Lattice:
    """Coarse c_b = <basis_b, fine>, what is projected being taken off before the next b."""
    coarse, rest = None, lat
    for b in basis:
        c = block_inner_product(rest, b, name, block, f"c_{b}")
        coarse = c if coarse is None else coarse.join(c)
        met = with_coarse(rest, c, block)
        rest = met.put(**{name: met.t(name) - met.t(b) * met.t(f"c_{b}")}).keep(*lat.shapes)
    return coarse


def block_promote(lat: Lattice, coarse: Lattice, basis: list[str], block: tuple[int, ...], out: str = "f") -> Lattice:
    """Fine f = sum_b c_b(block) basis_b."""
    met = with_coarse(lat, coarse, block)
    f = met.t(basis[0]) * met.t(f"c_{basis[0]}")
    for b in basis[1:]:
        f = f + met.t(b) * met.t(f"c_{b}")
    return met.put(**{out: f}).keep(*lat.shapes, out)


def momentum_project(lat: Lattice, name: str, momenta: list[tuple[int, ...]], time: int) -> DataFrame:
    """Per momentum and time slice: sum over space of exp(2 pi i p.x / L) f(x); rows (p, t, re, im)."""
    space = [k for k in range(len(lat.grid.dims)) if k != time]
    phase = F.lit(0.0)
    for i, k in enumerate(space):
        phase = phase + F.col(f"__p.d{i}") * F.col(f"x{k}") * (2 * 3.141592653589793 / lat.grid.dims[k])
    table = F.array(*[F.struct(F.lit(n).alias("p"), *[F.lit(float(x)).alias(f"d{i}") for i, x in enumerate(p)]) for n, p in enumerate(momenta)])
    each = lat.df.withColumn("__p", F.explode(table))
    v = lat.t(name)[0, 0] * C(F.cos(phase), F.sin(phase))
    return each.groupBy(F.col("__p.p").alias("p"), F.col(f"x{time}").alias("t")).agg(F.sum(column(v.re)).alias("re"), F.sum(column(v.im)).alias("im"))


def slice_gram(lat: Lattice, left: list[str], right: list[str], mu: int) -> DataFrame:
    """Inner products of two sets of fields on each slice of mu: rows (x_mu, i, j, re, im) from one pass."""
    pairs = [(i, j, lat.t(a).inner(lat.t(b))) for i, a in enumerate(left) for j, b in enumerate(right)]
    wide = lat.df.groupBy(f"x{mu}").agg(*[F.sum(column(x)).alias(f"g{i}_{j}_{p}") for i, j, c in pairs for p, x in (("re", c.re), ("im", c.im))])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}_re").alias("re"), F.col(f"g{i}_{j}_im").alias("im")) for i, j, _ in pairs])
    return wide.select(f"x{mu}", F.explode(rows).alias("r")).select(f"x{mu}", "r.*")


def slice_multiply(lat: Lattice, matrices: DataFrame, names: list[str], mu: int, outs: list[str], add: list[str] | None = None) -> Lattice:
    """out_j = add_j + sum_i field_i a(x_mu)[i, j], with rows (slice, i, j, re, im) of small matrices, one a slice."""
    n, m = range(len(names)), range(len(outs))
    flat = [F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col(p)).otherwise(0.0)).alias(f"__a{i}_{j}_{p}") for i in n for j in m for p in ("re", "im")]
    met = Lattice(lat.df.join(matrices.groupBy(F.col("slice").alias(f"x{mu}")).agg(*flat), f"x{mu}"), lat.grid, lat.shapes)

    def column_of(j: int) -> Tensor:
        out = met.t(add[j]) if add else None
        for i in n:
            term = met.t(names[i]) * C(F.col(f"__a{i}_{j}_re"), F.col(f"__a{i}_{j}_im"))
            out = term if out is None else out + term
        return out

    return met.put(**{o: column_of(j) for j, o in enumerate(outs)}).keep(*dict.fromkeys([*lat.shapes, *outs]))


def total_large(lat: Lattice, name: str) -> DataFrame:
    """Sum of a field of many components as rows (k, re, im): component by component, not as one wide row."""
    r_, c_ = lat.shapes[name]
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"{name}_{k}_re").alias("re"), F.col(f"{name}_{k}_im").alias("im")) for k in range(r_ * c_)])
    return lat.df.select(F.explode(parts).alias("p")).groupBy("p.k").agg(F.sum("p.re").alias("re"), F.sum("p.im").alias("im"))


def field_crc(lat: Lattice, name: str) -> DataFrame:
    """One checksum of a field: the XOR of the CRCs of each site's index and stored bits."""
    bits = F.concat_ws(",", lat.grid.site().cast("string"), *[F.hex(F.col(c).cast("string")) for c in lat.columns(name)])
    return lat.df.agg(F.bit_xor(F.crc32(bits.cast("binary"))).alias("crc"))


def top_k(lat: Lattice, name: str, k: int, threshold: float | None = None) -> DataFrame:
    """The k sites with the largest real parts, those above a threshold alone; ties by site."""
    value = F.col(f"{name}_0_re")
    rows = lat.df if threshold is None else lat.df.filter(value >= threshold)
    return rows.select(lat.grid.site().alias("site"), value.alias("value")).orderBy(F.col("value").desc(), "site").limit(k)


def orthogonalise(lat: Lattice, basis: list[str], name: str, out: str) -> Lattice:
    """A field less its projections on orthonormal fields, all in one pass."""
    from fieldloom.operators.linear import combine, dots

    c = dots(lat, [(b, name) for b in basis])
    return combine(lat, **{out: {name: 1.0} | {b: -z for b, z in zip(basis, c, strict=True)}})
