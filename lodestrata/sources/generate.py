"""Lattices, slabs, deformed crystals and tabulated synthetic potentials, from spark.range."""

from __future__ import annotations

from math import ceil, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G

#: Basis atoms of a cubic unit cell as (x, y, z, type).
BASES = {
    "fcc": ((0, 0, 0, 0), (0, 0.5, 0.5, 0), (0.5, 0, 0.5, 0), (0.5, 0.5, 0, 0)),
    "b2": ((0, 0, 0, 0), (0.5, 0.5, 0.5, 1)),
    "l12": ((0, 0, 0, 1), (0, 0.5, 0.5, 0), (0.5, 0, 0.5, 0), (0.5, 0.5, 0, 0)),
}
#: Deformations of a cubic cell, by rows.
SYSTEMS = {
    "cubic": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "tetragonal": (1, 0, 0, 0, 1, 0, 0, 0, 1.2),
    "orthorhombic": (1, 0, 0, 0, 1.1, 0, 0, 0, 1.2),
    "hexagonal": (1, -0.5, 0, 0, sqrt(3) / 2, 0, 0, 0, 1.2),
    "rhombohedral": (1.1, 0.1, 0.1, 0.1, 1.1, 0.1, 0.1, 0.1, 1.1),
    "monoclinic": (1, 0, 0.2, 0, 1.1, 0, 0, 0, 1.2),
    "triclinic": (1, 0.10, 0.20, 0.15, 1.10, 0.25, 0.05, 0.30, 1.20),
}
PRIMES = (7919, 104729, 1299709)
#: Atoms of an ensemble that a task holds, about.
ATOMS_OF_A_TASK = 100_000
NINE = [f"{i}{j}" for i in range(3) for j in range(3)]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of given rows as a local relation, whose size Spark knows: it is broadcast where it is small."""
    kinds = spark.createDataFrame([], schema).schema
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(to_arrow_schema(kinds).types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.names), kinds)


def basis(spark: SparkSession, name: str) -> DataFrame:
    rows = [(k, *map(float, b[:3]), int(b[3])) for k, b in enumerate(BASES[name])]
    return literal(spark, rows, "basis int, bx double, by double, bz double, type int")


def lattice(spark: SparkSession, kind: str, a: float, reps: tuple[int, int, int], config_id: str = "lattice") -> DataFrame:
    """Atoms of a cubic crystal: a row for each unit cell times the basis, ids dense from 0."""
    nx, ny, nz = reps
    n = len(BASES[kind])
    u = F.col("id")
    at = {"ux": u % nx, "uy": F.floor(u / nx) % ny, "uz": F.floor(u / (nx * ny))}
    units = spark.range(nx * ny * nz).withColumns(at)
    every = units.crossJoin(basis(spark, kind))  # the basis has at most four atoms
    return every.select(F.lit(config_id).alias("config_id"), (u * n + F.col("basis")).alias("atom_id"), "type", *((F.lit(a) * (F.col(f"u{c}") + F.col(f"b{c}"))).alias(c) for c in "xyz"))


def lattices(crystals: DataFrame, kind: str, reps: tuple[int, int, int]) -> DataFrame:
    """A cubic crystal for each row of crystals (config_id, a): the product with the sites of one, which are `reps`
    unit cells whatever the number of crystals."""
    sites = lattice(crystals.sparkSession, kind, 1.0, reps).drop("config_id")
    return crystals.crossJoin(sites).select("config_id", "atom_id", "type", *((F.col("a") * F.col(c)).alias(c) for c in "xyz"))


def boxes(crystals: DataFrame, lx: Column, ly: Column, lz: Column) -> DataFrame:
    """A periodic rectangular cell for each row of crystals (config_id), sides by its columns."""
    sides = {"h00": lx, "h11": ly, "h22": lz}
    return crystals.select("config_id", F.lit(True).alias("pbc"), *(sides.get(f"h{k}", F.lit(0.0)).cast("double").alias(f"h{k}") for k in NINE))


def strains(rows: DataFrame, name: Column, **given: Column) -> DataFrame:
    """Deformations (name, m00..m22), one for each row: the unit matrix but for the entries given by columns."""
    return rows.select(name.cast("string").alias("name"), *(given.get(f"m{i}{j}", F.lit(float(i == j))).cast("double").alias(f"m{i}{j}") for i in range(3) for j in range(3)))


def orthorhombic(spark: SparkSession, rows: list[tuple[str, float, float, float]]) -> DataFrame:
    """Periodic cells (config_id, lx, ly, lz)."""
    return matrices(spark, [(c, (lx, 0, 0, 0, ly, 0, 0, 0, lz)) for c, lx, ly, lz in rows])


def matrices(spark: SparkSession, rows: list[tuple[str, tuple | None]]) -> DataFrame:
    """Cells from nine numbers by rows; None is a cluster."""
    values = [(c, m is not None, *(map(float, m) if m is not None else [None] * 9)) for c, m in rows]
    return literal(spark, values, "config_id string, pbc boolean, " + ", ".join(f"h{k} double" for k in NINE))


def deform(atoms: DataFrame, cells: DataFrame, strains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every configuration under every deformation (name, m00..m22): cells H M, atoms moved with them.
    Configurations are named config/name. The product is what is asked for; Spark broadcasts the strains where
    it knows them to be small."""
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    name = F.concat_ws("/", "config_id", "name").alias("config_id")
    moved = [sum((F.col(c) * m[k][j] for k, c in enumerate("xyz")), F.lit(0.0)) for j in range(3)]
    new_atoms = atoms.crossJoin(strains).select(name, "atom_id", "type", *(v.alias(c) for v, c in zip(moved, "xyz")))
    new_cells = cells.crossJoin(strains).select(name, "pbc", *(v.alias(k) for k, v in G.strained().items()))
    return new_atoms, new_cells


def ensemble(atoms: DataFrame, cells: DataFrame, strains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """deform() of small crystals under many deformations. The deformations are dealt out by config_id before they get
    their atoms, which are broadcast as those of a few crystals, so joins and sums within a configuration move nothing
    afterwards. Parts are as many as keep a task's atoms few."""
    spark = strains.sparkSession
    rows = strains.count() * atoms.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / ATOMS_OF_A_TASK))
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    each = cells.withColumnRenamed("config_id", "base_").crossJoin(strains).withColumn("config_id", F.concat_ws("/", "base_", "name")).repartition(parts, "config_id")
    moved = [sum((F.col(c) * m[k][j] for k, c in enumerate("xyz")), F.lit(0.0)) for j in range(3)]
    sites = F.broadcast(atoms.withColumnRenamed("config_id", "base_"))
    new_atoms = each.join(sites, "base_").select("config_id", "atom_id", "type", *(v.alias(c) for v, c in zip(moved, "xyz")))
    return new_atoms, each.select("config_id", "pbc", *(v.alias(k) for k, v in G.strained().items()))


def deformations(spark: SparkSession, rows: list[tuple[str, tuple]]) -> DataFrame:
    return literal(spark, [(n, *map(float, m)) for n, m in rows], "name string, " + ", ".join(f"m{k} double" for k in NINE))


def rattled(atoms: DataFrame, size: float) -> DataFrame:
    """Atoms shifted by an amount that their id alone decides."""
    return atoms.withColumns({c: F.col(c) + G.rattle(F.col("atom_id"), p, size) for c, p in zip("xyz", PRIMES)})


def fcc_slab(spark: SparkSession, face: str, a: float, reps: tuple[int, int, int], vacuum: float = 0.0, config_id: str = "slab") -> tuple[DataFrame, DataFrame]:
    """An FCC crystal along (100) or (111) with vacuum on top: atoms and their cell."""
    if face == "100":
        box, rows = (a, a, a), BASES["fcc"]
    else:  # two atoms in each of the three layers of an orthogonal cell
        box = (a / sqrt(2), a * sqrt(1.5), a * sqrt(3))
        rows = [(x, y, layer / 3, 0) for layer in range(3) for x, y in ((0, (layer / 3) % 1), (0.5, (0.5 + layer / 3) % 1))]
    nx, ny, nz = reps
    table = literal(spark, [(k, *map(float, r[:3])) for k, r in enumerate(rows)], "basis int, bx double, by double, bz double")
    u = F.col("id")
    units = spark.range(nx * ny * nz).withColumns({"ux": u % nx, "uy": F.floor(u / nx) % ny, "uz": F.floor(u / (nx * ny))})
    atoms = units.crossJoin(table).select(F.lit(config_id).alias("config_id"), (u * len(rows) + F.col("basis")).alias("atom_id"), F.lit(0).alias("type"), *((F.lit(b) * (F.col(f"u{c}") + F.col(f"b{c}"))).alias(c) for b, c in zip(box, "xyz")))
    return atoms, orthorhombic(spark, [(config_id, box[0] * nx, box[1] * ny, box[2] * nz + vacuum)])


def synthetic_grids(spark: SparkSession, n_elem: int = 1, nrho: int = 601, drho: float = 0.01, nr: int = 100, dr: float = 0.05, cutoff: float = 4.5, pot_id: str = "synthetic") -> DataFrame:
    """Tables (pot_id, kind, key, k, x, value) of AnalyticPotential's functions, r times phi as in files."""
    s, p = (1.0, 0.9), (1.0, 0.95, 0.9)
    k = F.col("id")

    def rows(n, kind, key, x, value):
        return spark.range(n).select(F.lit(pot_id).alias("pot_id"), F.lit(kind).alias("kind"), F.lit(key).alias("key"), k.cast("int").alias("k"), x.alias("x"), value.alias("value"))

    rho, r = k * drho, k * dr
    inside = F.greatest(F.lit(0.0), F.lit(cutoff) - r)
    parts = [rows(nrho, "embed", t, rho, -s[t] * F.sqrt(rho + 0.01)) for t in range(n_elem)]
    parts += [rows(nr, "rho", t, r, s[t] * F.pow(inside / cutoff, 2)) for t in range(n_elem)]
    parts += [rows(nr, "rphi", q, r, p[q] * r * F.pow(inside, 2)) for q in range(n_elem * (n_elem + 1) // 2)]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def repeats_for(n: int, per_cell: int = 4) -> int:
    """Smallest cube of unit cells with room for n atoms."""
    rep = max(1, ceil((n / per_cell) ** (1 / 3)) - 1)
    while per_cell * rep**3 < n:
        rep += 1
    return rep
