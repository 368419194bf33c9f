"""Atoms on disk in Z-order of their cells.

Files are dealt by range of (configuration, Morton code of the grid cell) and sorted within, so that a
Parquet row group is a small stretch of the curve and its statistics bound the codes in it. A box of space
is a few intervals of codes; with them as a filter Spark reads only the row groups that meet the box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import geometry as G
from ..operators import neighbors

#: Intervals that a box is written as, at most; with more, fewer atoms around it are read in vain.
INTERVALS = 64


def coded(atoms: DataFrame, cells: DataFrame, width: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """atoms with `code`, the Morton code of their grid cell of at least `width`."""
    binned = neighbors.assign_cells(atoms, cells, width, carry)
    return binned.select("config_id", "atom_id", "type", "x", "y", "z", *carry, G.morton(F.col("cx"), F.col("cy"), F.col("cz")).alias("code"))


def write_z_ordered(coded_atoms: DataFrame, path: str, files: int, group_bytes: int = 16 << 20) -> None:
    """Write coded() atoms as `files` Parquet files with row groups of about group_bytes."""
    order = ("config_id", "code")
    coded_atoms.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("parquet.block.size", group_bytes).parquet(path)


def _code(x: int, y: int, z: int) -> int:
    return sum((v >> b & 1) << (3 * b + k) for k, v in enumerate((x, y, z)) for b in range(v.bit_length()))


def code_intervals(low: tuple[int, int, int], high: tuple[int, int, int], most: int = INTERVALS) -> list[tuple[int, int]]:
    """Intervals (first, last) of codes that hold all cells from low to high, ends included: cubes of the curve
    that meet the box are split, largest first, while there are no more than `most`."""
    bits = max(1, max(high).bit_length())
    meets = lambda c, n: all(c[k] <= high[k] and c[k] + n > low[k] for k in range(3))
    inside = lambda c, n: all(low[k] <= c[k] and c[k] + n - 1 <= high[k] for k in range(3))
    done, split = [], [((0, 0, 0), 1 << bits)]
    while split:
        whole, finer = [], []
        for c, n in split:
            if inside(c, n) or n == 1:
                whole.append((c, n))
            else:
                h = n // 2
                finer += [(d, h) for x in (0, h) for y in (0, h) for z in (0, h) if meets(d := (c[0] + x, c[1] + y, c[2] + z), h)]
        if len(done) + len(whole) + len(finer) > most:
            done += split
            break
        done += whole
        split = finer
    out: list[list[int]] = []
    for first, size in sorted((_code(*c), n**3) for c, n in done):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], first + size - 1)
        else:
            out.append([first, first + size - 1])
    return [tuple(i) for i in out]


def read_box(spark: SparkSession, path: str, cells: DataFrame, config_id: str, width: float, low: tuple[float, float, float], high: tuple[float, float, float], most: int = INTERVALS) -> DataFrame:
    """The atoms of a periodic configuration whose wrapped fractional coordinates are in [low, high), from what
    write_z_ordered() wrote with the same width. The driver reads one cell."""
    cell = G.with_geometry(cells.filter((F.col("config_id") == config_id) & F.col("pbc"))).withColumns({f"n{k}": G.grid_size(F.col(f"height{k}"), width) for k in range(3)}).first()
    if cell is None:
        raise InvalidInput(f"no periodic cell {config_id}")
    n = [cell[f"n{k}"] for k in range(3)]
    first = tuple(min(n[k] - 1, max(0, int(low[k] * n[k]))) for k in range(3))
    last = tuple(min(n[k] - 1, max(0, int(high[k] * n[k]))) for k in range(3))
    near = F.lit(False)
    for a, b in code_intervals(first, last, most):
        near = near | F.col("code").between(a, b)
    atoms = spark.read.parquet(path).filter((F.col("config_id") == config_id) & near)
    s = [G.wrapped(sum((F.col(c) * F.lit(cell[G.INV[i][k]]) for i, c in enumerate("xyz")), F.lit(0.0))) for k in range(3)]
    inside = F.lit(True)
    for k in range(3):
        inside = inside & (s[k] >= low[k]) & (s[k] < high[k])
    return atoms.filter(inside)
