"""Binary field files: raw records, NERSC gauge files, SciDAC/ILDG records in LIME containers.

A file is read by byte ranges of whole sites, one task a range, and written by ranges of
sites in order, each task into its own part of the file; neither the driver nor any task
holds more than its range.  Paths must lie on a file system that all executors share.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.lattice import Grid, Lattice

#: Sites of a task's range.
SITES = 1 << 16
#: The LIME record header's magic number and version.
LIME_MAGIC, LIME_VERSION = 0x456789AB, 1


def _lattice_schema(grid: Grid, shapes: dict[str, tuple[int, int]]) -> str:
    empty = Lattice(None, grid, shapes)
    return ", ".join([f"{k} int" for k in grid.keys] + [f"{c} double" for n in shapes for c in empty.columns(n)])


def read_field(spark: SparkSession, path: str, grid: Grid, shapes: dict[str, tuple[int, int]], offset: int = 0, dtype: str = ">f8") -> Lattice:
    """Records of all fields' complex components, site after site, from a byte offset."""
    reals = 2 * sum(r * c for r, c in shapes.values())
    size = reals * np.dtype(dtype).itemsize
    ranges = spark.range(0, grid.volume, SITES, numPartitions=max(1, min(10_000, -(-grid.volume // SITES))))
    schema = _lattice_schema(grid, shapes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                n = min(SITES, grid.volume - first)
                with open(path, "rb") as f:
                    f.seek(offset + first * size)
                    values = np.frombuffer(f.read(n * size), dtype=dtype).astype(np.float64).reshape(n, reals)
                yield pa.RecordBatch.from_arrays([*_coordinates(grid, first, n), *[pa.array(values[:, k]) for k in range(reals)]], names=[x.split()[0] for x in schema.split(", ")])

    return Lattice(ranges.mapInArrow(run, schema), grid, dict(shapes))


def _coordinates(grid: Grid, first: int, n: int) -> list[pa.Array]:
    site, out = np.arange(first, first + n), []
    for extent in grid.dims:
        out.append(pa.array((site % extent).astype(np.int32)))
        site = site // extent
    return out


def _in_order(lat: Lattice, names: list[str]) -> DataFrame:
    cols = [c for n in names for c in lat.columns(n)]
    rows = lat.df.select(lat.grid.site().alias("__site"), *cols)
    return rows.repartitionByRange(max(1, min(10_000, -(-lat.grid.volume // SITES))), "__site").sortWithinPartitions("__site")


def write_field(lat: Lattice, names: list[str], path: str, offset: int = 0, dtype: str = ">f8") -> None:
    """The inverse of read_field; each task writes its sites at their own place."""
    reals = 2 * sum(r * c for r, c in (lat.shapes[n] for n in names))
    size = reals * np.dtype(dtype).itemsize
    if not offset:
        open(path, "wb").close()

    def run(batches) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for b in batches:
                sites = b.column(0).to_numpy()
                values = np.stack([b.column(k + 1).to_numpy() for k in range(reals)], 1).astype(dtype)
                for part in np.split(np.arange(len(sites)), np.flatnonzero(np.diff(sites) != 1) + 1):
                    if len(part):
                        f.seek(offset + int(sites[part[0]]) * size)
                        f.write(values[part].tobytes())
                done += len(sites)
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

    written = _in_order(lat, names).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    assert written == lat.grid.volume, f"{written} of {lat.grid.volume} sites"


def checksums(lat: Lattice, names: list[str], dtype: str = ">f8") -> tuple[int, int, int]:
    """(sum of 32-bit words mod 2^32, XOR of CRCs rotated by site % 29, and by site % 31) of the stored bytes.

    Batches are packed to the bytes of their sites; CRCs, rotations and sums are columns.
    """
    reals = 2 * sum(r * c for r, c in (lat.shapes[n] for n in names))
    cols = [c for n in names for c in lat.columns(n)]
    size = reals * np.dtype(dtype).itemsize

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            values = np.stack([b.column(k + 1).to_numpy() for k in range(reals)], 1).astype(dtype)
            words = values.view(dtype[0] + "u4").astype(np.int64).sum(1) if n else np.zeros(0, np.int64)
            ends = pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes())
            data = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), data], names=["site", "words", "data"])

    each = lat.df.select(lat.grid.site().alias("site"), *cols).mapInArrow(run, "site long, words long, data binary")
    each = each.withColumn("crc", F.crc32("data"))

    def turned(n: int):
        by = F.pmod("site", F.lit(n)).cast("int")
        left, right = F.call_function("shiftleft", F.col("crc"), by), F.call_function("shiftrightunsigned", F.col("crc"), 32 - by)
        return F.bit_xor(left.bitwiseOR(right).bitwiseAND(0xFFFFFFFF))

    row = each.agg((F.sum(F.col("words") % (1 << 32)) % (1 << 32)).alias("w"), turned(29).alias("a"), turned(31).alias("c")).first()
    return int(row["w"] or 0), int(row["a"] or 0), int(row["c"] or 0)


def scratch(spark: SparkSession) -> str:
    """A folder for files of the session, in that of its checkpoints, which all executors share."""
    import os
    from urllib.parse import urlparse

    from fieldloom.plans.lineage import checkpoint_dir

    at = urlparse(checkpoint_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"binary files need a mounted folder, not {at.scheme}")
    os.makedirs(at.path, exist_ok=True)
    return at.path


def rotated(x: int, by: int) -> int:
    """A 32-bit rotation to the left; by zero it is x."""
    return ((x << by) | (x >> (32 - by))) & 0xFFFFFFFF if by else x


# ---- NERSC gauge files -------------------------------------------------------------------


def read_header(path: str) -> tuple[dict[str, str], int]:
    """Keys of a text header, and where the data begins."""
    with open(path, "rb") as f:
        head = f.read(1 << 16)
    end = head.index(b"END_HEADER\n") + len(b"END_HEADER\n")
    lines = head[:end].decode("ascii").splitlines()
    assert lines[0] == "BEGIN_HEADER"
    return {k.strip(): v.strip() for k, v in (x.split("=", 1) for x in lines[1:-1])}, end


def write_gauge(lat: Lattice, path: str, two_rows: bool = False, bits32: bool = False) -> None:
    """Links u0..u3 of 3 x 3 matrices with checksum, plaquette and link trace in the header."""
    from fieldloom.operators import gauge

    d = len(lat.grid.dims)
    stored, names = _stored_rows(lat, two_rows), [f"s{mu}" for mu in range(d)]
    dtype = ">f4" if bits32 else ">f8"
    head = {"HDR_VERSION": "1.0", "DATATYPE": "4D_SU3_GAUGE" if two_rows else "4D_SU3_GAUGE_3x3", "STORAGE_FORMAT": "1.0"}
    head |= {f"DIMENSION_{k + 1}": str(n) for k, n in enumerate(lat.grid.dims)}
    head |= {"LINK_TRACE": f"{gauge.link_trace(lat).first()[0]:.12g}", "PLAQUETTE": f"{gauge.average_plaquette(lat).first()['average']:.12g}"}
    head |= {"CHECKSUM": f"{checksums(stored, names, dtype)[0]:x}", "FLOATING_POINT": "IEEE32BIG" if bits32 else "IEEE64BIG"}
    text = "BEGIN_HEADER\n" + "".join(f"{k} = {v}\n" for k, v in head.items()) + "END_HEADER\n"
    with open(path, "wb") as f:
        f.write(text.encode("ascii"))
    write_field(stored, names, path, len(text), dtype)


def _stored_rows(lat: Lattice, two_rows: bool) -> Lattice:
    from fieldloom.functions.tensors import Tensor

    n = 6 if two_rows else 9
    return lat.put(**{f"s{mu}": Tensor(lat.t(f"u{mu}").items[:n], (n // 3, 3)) for mu in range(len(lat.grid.dims))})


def read_gauge(spark: SparkSession, path: str) -> Lattice:
    """A gauge field, checked against its header: checksum, plaquette (1e-5) and link trace (1e-6)."""
    from fieldloom.functions.tensors import reconstruct_row
    from fieldloom.operators import gauge

    head, offset = read_header(path)
    grid = Grid(tuple(int(head[f"DIMENSION_{k + 1}"]) for k in range(4)))
    rows = 3 if head["DATATYPE"].endswith("3x3") else 2
    dtype = (">" if head["FLOATING_POINT"].endswith("BIG") else "<") + ("f4" if "32" in head["FLOATING_POINT"] else "f8")
    stored = read_field(spark, path, grid, {f"s{mu}": (rows, 3) for mu in range(4)}, offset, dtype)
    word = checksums(stored, list(stored.shapes), dtype)[0]
    if word != int(head["CHECKSUM"], 16):
        raise ValueError(f"checksum {word:x}, the header has {head['CHECKSUM']}")
    lat = stored.put(**{f"u{mu}": stored.t(f"s{mu}") if rows == 3 else reconstruct_row(stored.t(f"s{mu}")) for mu in range(4)}).keep(*[f"u{mu}" for mu in range(4)])
    for name, got, slack in (("PLAQUETTE", gauge.average_plaquette(lat).first()["average"], 1e-5), ("LINK_TRACE", gauge.link_trace(lat).first()[0], 1e-6)):
        if abs(got - float(head[name])) > slack:
            raise ValueError(f"{name.lower()} {got}, the header has {head[name]}")
    return lat


# ---- LIME containers: SciDAC and ILDG ----------------------------------------------------


def lime_records(path: str) -> list[tuple[str, int, int]]:
    """(type, offset of the data, length) of each record."""
    out = []
    with open(path, "rb") as f:
        f.seek(0, 2)
        end, at = f.tell(), 0
        while at < end:
            f.seek(at)
            magic, version, _, length, kind = struct.unpack(">IHHQ128s", f.read(144))
            if magic != LIME_MAGIC or version != LIME_VERSION:
                raise ValueError(f"no record at {at}")
            out.append((kind.rstrip(b"\0").decode(), at + 144, length))
            at += 144 + length + (-length) % 8
    return out


def _lime_header(kind: str, length: int, begin: bool, end: bool) -> bytes:
    return struct.pack(">IHHQ128s", LIME_MAGIC, LIME_VERSION, (begin << 15) | (end << 14), length, kind.encode())


def write_scidac(lat: Lattice, names: list[str], path: str, record: str = "<record/>", dtype: str = ">f8", kind: str = "scidac-binary-data") -> None:
    """One field set as a LIME message: user record, binary data and checksums."""
    size = lat.grid.volume * 2 * sum(r * c for r, c in (lat.shapes[n] for n in names)) * np.dtype(dtype).itemsize
    form = f"<format><dims>{' '.join(map(str, lat.grid.dims))}</dims><type>{dtype[1:]}</type></format>"
    with open(path, "wb") as f:
        for text_kind, text, first in (("scidac-file-xml", form, True), ("scidac-record-xml", record, False)):
            data = text.encode()
            f.write(_lime_header(text_kind, len(data), first, False) + data + bytes(-len(data) % 8))
        f.write(_lime_header(kind, size, False, False))
        at = f.tell()
    write_field(lat, names, path, at, dtype)
    _, a, b = checksums(lat, names, dtype)
    data = f"<scidacChecksum><version>1.0</version><suma>{a:x}</suma><sumb>{b:x}</sumb></scidacChecksum>".encode()
    with open(path, "r+b") as f:
        f.seek(at + size)
        f.write(bytes(-size % 8) + _lime_header("scidac-checksum", len(data), False, True) + data + bytes(-len(data) % 8))


def read_scidac(spark: SparkSession, path: str, shapes: dict[str, tuple[int, int]], kind: str = "scidac-binary-data") -> tuple[Lattice, str]:
    """The fields and the user record; the stored checksums must match."""
    import re

    with open(path, "rb") as f:
        parts = {}
        for name, at, length in lime_records(path):
            f.seek(at)
            parts[name] = (at, f.read(length).decode() if name != kind else "")
    form = parts["scidac-file-xml"][1]
    grid = Grid(tuple(map(int, re.search(r"<dims>(.*?)</dims>", form)[1].split())))
    dtype = ">" + re.search(r"<type>(.*?)</type>", form)[1]
    lat = read_field(spark, path, grid, shapes, parts[kind][0], dtype)
    stored = tuple(int(re.search(rf"<sum{k}>(.*?)</sum{k}>", parts["scidac-checksum"][1])[1], 16) for k in "ab")
    if checksums(lat, list(shapes), dtype)[1:] != stored:
        raise ValueError("the checksums do not match")
    return lat, parts["scidac-record-xml"][1]


def write_ildg(lat: Lattice, path: str, name: str = "") -> None:
    """Links as an ILDG record."""
    write_scidac(lat, [f"u{mu}" for mu in range(len(lat.grid.dims))], path, f"<ildg><name>{name}</name></ildg>", kind="ildg-binary-data")


def read_ildg(spark: SparkSession, path: str, nc: int = 3) -> Lattice:
    return read_scidac(spark, path, {f"u{mu}": (nc, nc) for mu in range(4)}, "ildg-binary-data")[0]
