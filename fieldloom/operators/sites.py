"""Point access, parity, slices, regions and tilings of a lattice."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.plans.lattice import Grid, Lattice


def coordinate(lat: Lattice, mu: int, out: str = "c") -> Lattice:
    """The coordinate mu of each site as a field."""
    return lat.put(**{out: Tensor([C(F.col(f"x{mu}").cast("double"))])})


def at(site: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for k, x in enumerate(site):
        out = out & (F.col(f"x{k}") == x)
    return out


def peek(lat: Lattice, site: tuple[int, ...]) -> DataFrame:
    return lat.df.filter(at(site))


def poke(lat: Lattice, name: str, site: tuple[int, ...], value: complex) -> Lattice:
    old = lat.t(name)
    return lat.put(**{name: old.map(lambda c: C(F.when(at(site), F.lit(float(complex(value).real))).otherwise(c.re), F.when(at(site), F.lit(float(complex(value).imag))).otherwise(c.im)))})


def where(lat: Lattice, condition: Column, a: str, b: str, out: str = "w") -> Lattice:
    """a where the condition holds, b elsewhere; both must have one shape."""
    pairs = zip(lat.t(a).items, lat.t(b).items, strict=True)
    return lat.put(**{out: Tensor([C(F.when(condition, x.re).otherwise(y.re), F.when(condition, x.im).otherwise(y.im)) for x, y in pairs], lat.shapes[a])})


def pick_parity(lat: Lattice, parity: int) -> Lattice:
    return replace(lat, df=lat.df.filter(lat.grid.parity() == parity))


def set_parity(even: Lattice, odd: Lattice) -> Lattice:
    """The full lattice of its two halves."""
    return replace(even, df=even.df.drop("__slab").unionByName(odd.df.drop("__slab")))


def extract_slice(lat: Lattice, mu: int, at_: int) -> Lattice:
    """The hyperplane x_mu = at_ as a lattice of one dimension less."""
    left = [k for k in range(len(lat.grid.dims)) if k != mu]
    df = lat.df.filter(F.col(f"x{mu}") == at_).drop(f"x{mu}", "__slab").withColumnsRenamed({f"x{k}": f"__x{i}" for i, k in enumerate(left)})
    return Lattice(df.withColumnsRenamed({f"__x{i}": f"x{i}" for i in range(len(left))}), Grid(tuple(lat.grid.dims[k] for k in left)), lat.shapes)


def insert_slice(lat: Lattice, low: Lattice, mu: int, at_: int) -> Lattice:
    """lat with the hyperplane x_mu = at_ replaced."""
    lat = replace(lat, df=lat.df.drop("__slab"))
    left = [k for k in range(len(lat.grid.dims)) if k != mu]
    df = low.df.withColumnsRenamed({f"x{i}": f"__x{k}" for i, k in enumerate(left)}).withColumnsRenamed({f"__x{k}": f"x{k}" for k in left})
    df = df.withColumn(f"x{mu}", F.lit(at_)).select(*lat.df.columns)
    return replace(lat, df=lat.df.filter(F.col(f"x{mu}") != at_).unionByName(df))


def in_box(low: tuple[int, ...], size: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for k, (a, n) in enumerate(zip(low, size, strict=True)):
        out = out & F.col(f"x{k}").between(a, a + n - 1)
    return out


def copy_region(source: Lattice, to: Lattice, source_low: tuple[int, ...], to_low: tuple[int, ...], size: tuple[int, ...]) -> Lattice:
    """``to`` with a box replaced by a box of ``source``."""
    to = replace(to, df=to.df.drop("__slab"))
    part = source.df.filter(in_box(source_low, size)).withColumns({f"x{k}": (F.col(f"x{k}") + (b - a)).cast("int") for k, (a, b) in enumerate(zip(source_low, to_low, strict=True))})
    return replace(to, df=to.df.filter(~in_box(to_low, size)).unionByName(part.select(*to.df.columns)))


def block_pick(lat: Lattice, name: str, block: tuple[int, ...], coarse: tuple[int, ...], out: str = "picked") -> Lattice:
    """The field inside one block, zero elsewhere."""
    inside = in_box(tuple(b * c for b, c in zip(block, coarse, strict=True)), block)
    return lat.put(**{out: lat.t(name).map(lambda c: C(F.when(inside, c.re).otherwise(0.0), F.when(inside, c.im).otherwise(0.0)))})


def dirichlet(lat: Lattice, link: str, mu: int, block: tuple[int, ...]) -> Lattice:
    """Links in direction mu that cross a face of a block set to zero."""
    crossing = F.pmod(F.col(f"x{mu}") + 1, F.lit(block[mu])) == 0
    return lat.put(**{link: lat.t(link).map(lambda c: C(F.when(crossing, 0.0).otherwise(c.re), F.when(crossing, 0.0).otherwise(c.im)))})


def phase_boundary(lat: Lattice, name: str, mu: int, phase: complex) -> Lattice:
    """Links (or a field) on the last slice of mu times a phase: -1 is antiperiodic."""
    last = F.col(f"x{mu}") == lat.grid.dims[mu] - 1
    turned = lat.t(name) * complex(phase)
    return lat.put(**{name: Tensor([C(F.when(last, column(t.re)).otherwise(column(o.re)), F.when(last, column(t.im)).otherwise(column(o.im))) for t, o in zip(turned.items, lat.t(name).items, strict=True)], lat.shapes[name])})


def domain_mask(lat: Lattice, name: str, block: tuple[int, ...], depth: int, out: str = "inner") -> Lattice:
    """The field where it lies at least ``depth`` from the faces of its block, zero beside them."""
    inside = F.lit(True)
    for k, b in enumerate(block):
        inside = inside & F.pmod(F.col(f"x{k}"), F.lit(b)).between(depth, b - 1 - depth)
    return lat.put(**{out: lat.t(name).map(lambda c: C(F.when(inside, c.re).otherwise(0.0), F.when(inside, c.im).otherwise(0.0)))})


def split(lat: Lattice, names: list[str], out: str = "f") -> DataFrame:
    """N fields of one grid as rows (k, site, field): each k is a lattice of its own, dealt by slices of its last dimension."""
    shape = lat.shapes[names[0]]
    parts = Lattice(lat.df, lat.grid, {out: shape}).columns(out)
    one = [F.struct(F.lit(k).alias("k"), *[F.col(c).alias(o) for c, o in zip(lat.columns(n), parts, strict=True)]) for k, n in enumerate(names)]
    return lat.df.select(*lat.grid.keys, F.explode(F.array(*one)).alias("x")).select("x.k", *lat.grid.keys, *[f"x.{o}" for o in parts]).repartition("k", lat.grid.keys[-1])


def unsplit(rows: DataFrame, grid: Grid, names: list[str], shape: tuple[int, int], field: str = "f") -> Lattice:
    """The rows of split as N fields of one lattice again."""
    whole = Lattice(None, grid, {field: shape})
    out = [F.max(F.when(F.col("k") == k, F.col(c))).alias(c.replace(field, n, 1)) for k, n in enumerate(names) for c in whole.columns(field)]
    return Lattice(rows.groupBy(*grid.keys).agg(*out), grid, {n: shape for n in names})


def import_array(spark, grid: Grid, values, name: str = "f") -> Lattice:
    """A field from a numpy array of components in lexicographic order of sites, dimension 0 fastest."""
    import numpy as np

    flat = np.asarray(values, dtype=complex).reshape(grid.volume, -1)
    rows = [(i, *[float(x) for z in row for x in (z.real, z.imag)]) for i, row in enumerate(flat)]
    cols = [f"{name}_{k}_{p}" for k in range(flat.shape[1]) for p in ("re", "im")]
    df = spark.createDataFrame(rows, "site long, " + ", ".join(f"{c} double" for c in cols))
    return Lattice(df.select(*grid.coordinates(F.col("site")), *cols), grid, {name: (flat.shape[1], 1)})


def export_array(lat: Lattice, name: str):
    """A field as a numpy array in lexicographic order of sites; for lattices that fit the driver."""
    import numpy as np

    rows = lat.df.select(lat.grid.site().alias("site"), *lat.columns(name)).orderBy("site").toPandas()
    parts = rows[lat.columns(name)].to_numpy()
    return (parts[:, ::2] + 1j * parts[:, 1::2]).reshape(lat.grid.volume, *lat.shapes[name]) if len(rows) else np.zeros((0, *lat.shapes[name]), complex)


def replicate(coarse: Lattice, grid: Grid) -> Lattice:
    """The coarse field tiled periodically over a larger grid: one row becomes its images."""
    df = coarse.df.drop("__slab")
    for k, (n, m) in enumerate(zip(grid.dims, coarse.grid.dims, strict=True)):
        df = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n // m - 1)))).withColumn(f"x{k}", (F.col(f"x{k}") + F.col("__r") * m).cast("int")).drop("__r")
    return Lattice(df, grid, coarse.shapes)


def pad(lat: Lattice, mu: int, depth: int) -> DataFrame:
    """Rows of ghost zones beside the lattice's own: coordinates from -depth to L + depth - 1, as many images as that takes."""
    n = lat.grid.dims[mu]
    reach = -(-depth // n)
    images = F.array(*[F.struct(F.lit(k * n).alias("s")) for k in range(-reach, reach + 1)])
    each = lat.df.withColumn("__s", F.explode(images)).withColumn(f"x{mu}", (F.col(f"x{mu}") + F.col("__s.s")).cast("int")).drop("__s")
    return each.filter(F.col(f"x{mu}").between(-depth, n + depth - 1))


def pad_all(lat: Lattice, depths: dict[int, int]) -> DataFrame:
    """Ghost zones in several dimensions, corners included."""
    for mu, depth in depths.items():
        lat = replace(lat, df=pad(lat, mu, depth))
    return lat.df


def unpad(padded: DataFrame, lat: Lattice, mu: int) -> Lattice:
    return replace(lat, df=padded.filter(F.col(f"x{mu}").between(0, lat.grid.dims[mu] - 1)))


#: Hash functions that draws can come from.
ENGINES = {"xxhash64": F.xxhash64, "murmur3": lambda *c: F.hash(*c, F.lit(1)).cast("long") * F.lit(2**32) + F.pmod(F.hash(*c, F.lit(2)).cast("long"), F.lit(2**32))}


def seed_of(seed: int | str | list[int]) -> int:
    """A 63-bit seed of an integer, of several, or of a string (by its SHA-256)."""
    import hashlib

    if isinstance(seed, int):
        return seed
    text = seed if isinstance(seed, str) else " ".join(map(str, seed))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 1


class SerialRandom:
    """Draws on the driver that are the same on every run, with a state that can be saved."""

    def __init__(self, seed: int | str | list[int]):
        import numpy as np

        self.generator = np.random.Generator(np.random.PCG64(seed_of(seed)))

    def uniform(self) -> float:
        return float(self.generator.random())

    def gaussian(self) -> float:
        return float(self.generator.normal())

    def state(self) -> str:
        import json

        return json.dumps(self.generator.bit_generator.state)

    def restore(self, state: str) -> None:
        import json

        self.generator.bit_generator.state = json.loads(state)


def random_fields(lat: Lattice, seed: int | str | list[int], kind: str = "uniform", out: str = "r", shape: tuple[int, int] = (1, 1), engine: str = "xxhash64") -> Lattice:
    """Random fields by hashes of seed, site and draw: the same for every partitioning.

    kind: uniform in [0, 1), gaussian (Box-Muller) or bernoulli (0 or 1).  The state of such
    a generator is its seed and engine.
    """
    site, seed = lat.grid.site(), seed_of(seed)

    def uniform(draw: int) -> Column:
        return (F.shiftrightunsigned(ENGINES[engine](F.lit(seed), site, F.lit(draw)), 11).cast("double") + 0.5) * 2.0**-53

    def part(k: int) -> tuple[Column, Column]:
        u, v = uniform(2 * k), uniform(2 * k + 1)
        if kind == "gaussian":
            size = F.sqrt(-2.0 * F.log(u))
            return size * F.cos(2 * 3.141592653589793 * v), size * F.sin(2 * 3.141592653589793 * v)
        if kind == "bernoulli":
            return (u < 0.5).cast("double"), (v < 0.5).cast("double")
        return u, v

    return lat.put(**{out: Tensor([C(*part(k)) for k in range(shape[0] * shape[1])], shape)})
