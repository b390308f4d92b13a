"""The relational test tables read as lattice fields."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.plans.lattice import Grid, Lattice


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(rows: int, of: int) -> int:
    """How often ``of`` fits into a table's rows; a rest would fall on sites that are taken."""
    if rows % of:
        raise ValueError(f"{rows} rows are no multiple of {of}")
    return rows // of


def events_lattice(spark: SparkSession, sf_dir: str) -> Lattice:
    """The events as a [10, 10, T] lattice: v = value + i (event_id % 7 - 3) and the index as a field."""
    df = table(spark, sf_dir, "events").select("event_id", "value")
    grid = Grid((10, 10, whole(df.count(), 100)))
    v = C(F.col("value"), (F.col("event_id") % 7 - 3).cast("double"))
    return Lattice.of(df, grid, "event_id", v=Tensor([v]), i=Tensor([C(F.col("event_id").cast("double"), F.lit(0.0))]))


def abelian_lattice(spark: SparkSession, sf_dir: str) -> Lattice:
    """U(1) links of angle (mu + 1) 0.01 value on the events lattice, and the scalar v."""
    df = table(spark, sf_dir, "events").select("event_id", "value")
    grid = Grid((10, 10, whole(df.count(), 100)))
    links = {f"u{mu}": Tensor([C(F.cos((mu + 1) * 0.01 * F.col("value")), F.sin((mu + 1) * 0.01 * F.col("value")))]) for mu in range(3)}
    v = Tensor([C(F.col("value"), (F.col("event_id") % 7 - 3).cast("double"))])
    return Lattice.of(df, grid, "event_id", v=v, **links)


def matrix_lattice(spark: SparkSession, sf_dir: str, n: int = 2) -> Lattice:
    """The embeddings as a [5, 10, T] lattice of n x n matrices m0, m1, m2 and a 4 x 3 spinor.

    The last slice may lack sites; what looks at neighbours takes the lattice ``filled``.
    """
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    grid = Grid((5, 10, -(-df.count() // 50)))

    def at(k: int) -> C:
        return C(F.get("embedding", F.lit(2 * k)).cast("double"), F.get("embedding", F.lit(2 * k + 1)).cast("double"))

    fields = {f"m{mu}": Tensor([at(n * n * mu + k) for k in range(n * n)], (n, n)) for mu in range(3)}
    return Lattice.of(df, grid, "vec_id", **fields, psi=Tensor([at(k) for k in range(12)], (4, 3)))


def filled(lat: Lattice, rows: int, links: tuple[str, ...] = ()) -> Lattice:
    """The lattice with the sites past its table's rows: links are unit matrices there, other fields zero."""
    if rows == lat.grid.volume:
        return lat
    values = {f: Tensor.constant(np.eye(*shape) if f in links else np.zeros(shape)) for f, shape in lat.shapes.items()}
    cells = [column(x).alias(c) for f, t in values.items() for c, x in zip(lat.columns(f), (p for z in t.items for p in (z.re, z.im)), strict=True)]
    rest = lat.df.sparkSession.range(rows, lat.grid.volume, 1, 1)
    return replace(lat, df=lat.df.drop("__slab").unionByName(rest.select(*lat.grid.coordinates(F.col("id")), *cells)))
