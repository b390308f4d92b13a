"""Fields on a periodic Cartesian grid as one wide table per grid.

A lattice's key is its coordinates x0, x1, ...; a field ``name`` of complex components is
the columns name_0_re, name_0_im, name_1_re, ...  Conformable arithmetic is a projection.
A shift is a change of key; several shifts at once (a stencil) are one explode over the
offsets and one aggregation by the new key, whatever the number of offsets.

A large lattice that is cut is dealt by slabs of its last dimension, and stays so from cut
to cut: a stencil then moves only the rows that leave their slab.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column


#: Sites from which a cut deals a lattice by slabs, about so many sites to a slab and so many to a partition at most.
DEALT_FROM, SLAB, PARTITION = 200_000, 10_000, 100_000


@dataclass(frozen=True)
class Grid:
    """Extents of a periodic grid; dimension 0 runs fastest."""

    dims: tuple[int, ...]

    @property
    def volume(self) -> int:
        out = 1
        for n in self.dims:
            out *= n
        return out

    @property
    def keys(self) -> list[str]:
        return [f"x{k}" for k in range(len(self.dims))]

    def coordinates(self, site: Column) -> list[Column]:
        out, stride = [], 1
        for k, n in enumerate(self.dims):
            out.append(F.pmod(F.floor(site / stride), F.lit(n)).cast("int").alias(f"x{k}"))
            stride *= n
        return out

    def site(self) -> Column:
        """The lexicographic index of a row's coordinates."""
        total, stride = F.lit(0).cast("long"), 1
        for k, n in enumerate(self.dims):
            total = total + F.col(f"x{k}").cast("long") * stride
            stride *= n
        return total

    def parity(self) -> Column:
        return F.pmod(sum((F.col(k) for k in self.keys), F.lit(0)), F.lit(2))

    def slab(self) -> Column:
        """The slab of a row: a few neighbouring slices of the last dimension."""
        n = self.dims[-1]
        depth = max(1, SLAB * n // max(self.volume, 1))
        return F.floor(F.col(self.keys[-1]) / depth).cast("int")

    def moved(self, mu: int, by: int | Column) -> Column:
        return F.pmod(F.col(f"x{mu}") + by, F.lit(self.dims[mu])).cast("int")


@dataclass(frozen=True)
class Lattice:
    """Fields (name -> shape) in the columns of one table over a grid.

    Rows that are ``dealt`` lie by the column __slab, fresh from a cut.
    """

    df: DataFrame
    grid: Grid
    shapes: dict[str, tuple[int, int]] = field(default_factory=dict)
    dealt: bool = False

    @staticmethod
    def coordinates(spark: SparkSession, grid: Grid) -> Lattice:
        """All sites of a grid, without fields."""
        return Lattice(spark.range(grid.volume).select(*grid.coordinates(F.col("id"))), grid)

    @staticmethod
    def of(df: DataFrame, grid: Grid, site: str, **fields: Tensor) -> Lattice:
        """Fields of the columns of a table whose ``site`` is the lexicographic index."""
        base = Lattice(df.select(*grid.coordinates(F.col(site)), *_columns(fields)), grid, {n: t.shape for n, t in fields.items()})
        return base

    def columns(self, name: str) -> list[str]:
        r, c = self.shapes[name]
        return [f"{name}_{k}_{p}" for k in range(r * c) for p in ("re", "im")]

    def t(self, name: str, prefix: str = "") -> Tensor:
        r, c = self.shapes[name]
        return Tensor([C(F.col(f"{prefix}{name}_{k}_re"), F.col(f"{prefix}{name}_{k}_im")) for k in range(r * c)], (r, c))

    def put(self, **fields: Tensor) -> Lattice:
        """Fields added or replaced; all expressions see the old ones."""
        return replace(self, df=self.df.withColumns({n: x for f, t in fields.items() for n, x in _named(f, t)}), shapes=self.shapes | {f: t.shape for f, t in fields.items()})

    def keep(self, *names: str) -> Lattice:
        cols = [c for n in names for c in self.columns(n)]
        slab = ["__slab"] if "__slab" in self.df.columns else []
        return replace(self, df=self.df.select(*slab, *self.grid.keys, *cols), shapes={n: self.shapes[n] for n in names})

    def rename(self, old: str, new: str) -> Lattice:
        pairs = dict(zip(self.columns(old), [c.replace(old, new, 1) for c in self.columns(old)], strict=True))
        return replace(self, df=self.df.withColumnsRenamed(pairs), shapes={new if n == old else n: s for n, s in self.shapes.items()})

    def join(self, other: Lattice) -> Lattice:
        """Fields of both, by site: for fields that were born in different tables."""
        return Lattice(self.df.drop("__slab").join(other.df.drop("__slab"), self.grid.keys), self.grid, self.shapes | other.shapes)

    def shift(self, mu: int, by: int) -> Lattice:
        """All fields f with out(x) = f(x + by mu), periodic; a change of key without a shuffle."""
        return Lattice(self.df.drop("__slab").withColumn(f"x{mu}", self.grid.moved(mu, -by)), self.grid, self.shapes)

    def gather(self, wanted: Iterable[tuple[str, Sequence[int]]]) -> tuple[Lattice, dict]:
        """The lattice with fields at displaced sites beside its own; one shuffle in all.

        wanted: (field, displacement) pairs.  Returns also the names of the new fields,
        by pair: name(x) = field(x + displacement).
        """
        zero = (0,) * len(self.grid.dims)
        pairs = list(dict.fromkeys((n, tuple(d)) for n, d in wanted if tuple(d) != zero))
        names = {(n, zero): n for n in self.shapes}
        moves = list(dict.fromkeys(d for _, d in pairs))
        if not moves:
            return self, names
        offsets = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for k, d in enumerate([zero, *moves])])
        each = self.df.withColumn("__o", F.explode(offsets))
        each = each.withColumns({f"x{i}": self.grid.moved(i, -F.col(f"__o.d{i}")) for i in range(len(zero))})
        # A row that goes to another site carries only the fields that are wanted there.
        own = [c for n in self.shapes for c in self.columns(n)]
        out = [F.max(F.when(F.col("__o.k") == 0, F.col(c))).alias(c) for c in own]
        shapes = dict(self.shapes)
        for n, d in pairs:
            k = moves.index(d) + 1
            new = f"{n}_at{k}"
            names[(n, d)] = new
            shapes[new] = self.shapes[n]
            out += [F.max(F.when(F.col("__o.k") == k, F.col(c))).alias(c.replace(n, new, 1)) for c in self.columns(n)]
        if not self.dealt or "__slab" not in self.df.columns:
            return Lattice(each.groupBy(*self.grid.keys).agg(*out), self.grid, shapes), names
        # Rows that stay in their slab lie right; only the others move.
        to = self.grid.slab()
        stay = each.filter(F.col("__slab") == to)
        leave = each.filter(F.col("__slab") != to).withColumn("__slab", to).repartition(self._parts(), "__slab")
        return Lattice(stay.union(leave).groupBy("__slab", *self.grid.keys).agg(*out), self.grid, shapes), names

    def _parts(self) -> int:
        return max(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.grid.volume // PARTITION)

    def cut(self) -> Lattice:
        """Lineage cut by a reliable checkpoint, for iterations."""
        from fieldloom.plans.lineage import cut, dealt_cut

        if self.grid.volume < DEALT_FROM:
            return replace(self, df=cut(self.df))
        df = self.df if "__slab" in self.df.columns else self.df.withColumn("__slab", self.grid.slab()).repartition(self._parts(), "__slab")
        return replace(self, df=dealt_cut(df), dealt=True)


def _named(name: str, t: Tensor) -> list[tuple[str, Column]]:
    return [(f"{name}_{k}_{p}", column(x)) for k, c in enumerate(t.items) for p, x in (("re", c.re), ("im", c.im))]


def _columns(fields: dict[str, Tensor]) -> list[Column]:
    return [x.cast("double").alias(n) for f, t in fields.items() for n, x in _named(f, t)]
