"""Extended-XYZ text and JSON results as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions import geometry as G


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(config_id, value), a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("config_id"), "value")


def lattice_numbers(comment: Column) -> Column:
    """The numbers between the quotes of Lattice="..."; null without it. Tokens that aren't numbers are null."""
    text = F.regexp_extract(comment, r'Lattice="([^"]*)"', 1)
    return F.when(text != "", F.transform(F.split(F.trim(text), r"\s+"), lambda t: t.try_cast("double")))


def lattice_matrix(numbers: Column) -> Column:
    """Nine numbers by rows: three are an orthorhombic box, nine a full cell, anything else is null."""
    clean = F.size(F.filter(numbers, lambda v: v.isNull())) == 0
    zero = F.lit(0.0)
    diagonal = F.array(*(F.get(numbers, F.lit(k // 4)) if k % 4 == 0 else zero for k in range(9)))
    return F.when(clean & (F.size(numbers) == 9), numbers).when(clean & (F.size(numbers) == 3), diagonal)


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms with symbol, cells) of frames (config_id, value): a count line, a comment, `symbol x y z`
    lines. Columns after z are ignored. Rows that can't be read have null coordinates."""
    lines = files.select("config_id", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("line"))
    head = lines.select("config_id", "line", F.trim(F.col("line")[0]).try_cast("int").alias("n"), F.coalesce(F.get("line", F.lit(1)), F.lit("")).alias("comment"))
    rows = head.select("config_id", F.posexplode(F.slice("line", 3, F.greatest("n", F.lit(0)))).alias("atom_id", "row"))
    part = F.split(F.trim("row"), r"\s+")
    atoms = rows.select("config_id", F.col("atom_id").cast("long").alias("atom_id"), part[0].alias("symbol"), *(F.get(part, F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyz")))
    numbers = lattice_numbers(F.col("comment"))
    m = lattice_matrix(numbers)
    cells = head.select("config_id", "n", numbers.isNotNull().alias("pbc"), m.alias("m"))
    return atoms, cells.select("config_id", "n", "pbc", *(F.get("m", F.lit(k)).alias(c) for k, c in enumerate(c for r in G.H for c in r)))


def check(atoms: DataFrame, cells: DataFrame) -> None:
    """Counts must hold, coordinates be numbers, lattices have three or nine."""
    have = atoms.groupBy("config_id").agg(F.count("*").alias("have"), F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("bad"))
    wrong = cells.join(have, "config_id", "left").filter((F.coalesce("have", F.lit(0)) != F.coalesce("n", F.lit(-1))) | (F.col("bad") > 0) | (F.col("pbc") & F.col("h00").isNull()))
    rows = [tuple(r) for r in wrong.select("config_id", "n", "have", "bad").limit(5).collect()]
    if rows:
        raise ParseError(f"frames with wrong counts, coordinates or lattices (id, count, rows, bad rows): {rows}")


def frame_lines(per_atom: DataFrame, symbol: Column) -> DataFrame:
    """(config_id, line_no, line): atoms as `symbol x y z fx fy fz` with six decimals, in order of ids."""
    at = ["x", "y", "z", "fx", "fy", "fz"]
    return per_atom.select("config_id", F.col("atom_id").alias("line_no"), F.format_string("%s" + " %.6f" * 6, symbol, *(F.col(c) for c in at)).alias("line"))


def frames(per_atom: DataFrame, cells: DataFrame, symbol: Column) -> DataFrame:
    """(config_id, value): whole frames as extended XYZ. A frame's text is built in one row, as a file is;
    larger ones are written by line from frame_lines()."""
    lines = frame_lines(per_atom, symbol).groupBy("config_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    box = F.concat_ws(" ", *(F.format_string("%.6f", F.col(c)) for r in G.H for c in r))
    comment = F.concat(F.when(F.col("pbc"), F.concat(F.lit('Lattice="'), box, F.lit('" '))).otherwise(""), F.lit("Properties=species:S:1:pos:R:3:forces:R:3"))
    both = lines.join(cells, "config_id")
    return both.select("config_id", F.concat_ws("\n", F.col("n").cast("string"), comment, F.transform("lines", lambda s: s["line"])).alias("value"))


def json_results(totals: DataFrame, per_atom: DataFrame) -> DataFrame:
    """(config_id, value): a JSON object with the energy, and each atom's forces and energy in order of ids."""
    rows = per_atom.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", F.array("fx", "fy", "fz").alias("f"), "energy"))).alias("a"))
    both = totals.select("config_id", F.col("energy").alias("total")).join(rows, "config_id")
    body = F.struct(F.col("total").alias("energy_ev"), F.transform("a", lambda s: s["f"]).alias("forces_ev_per_aa"), F.transform("a", lambda s: s["energy"]).alias("energy_per_atom_ev"))
    return both.select("config_id", F.to_json(body).alias("value"))


def from_arrays(spark: SparkSession, positions, types, cell=None, config_id: str = "arrays") -> tuple[DataFrame, DataFrame]:
    """(atoms, cells) from arrays (N, 3) and (N,), and a (3, 3) cell or None for a cluster. Flat arrays of
    3 N and 9 numbers do as well."""
    import numpy as np
    import pandas as pd

    from ..errors import InvalidInput
    from ..schema import ATOMS
    from .generate import matrices

    p, t = np.asarray(positions, float), np.asarray(types)
    p = p.reshape(-1, 3) if p.ndim == 1 and p.size % 3 == 0 else p
    if p.ndim != 2 or p.shape[1] != 3 or len(p) != len(t) or not len(p):
        raise InvalidInput(f"positions need the shape (N, 3) and types (N,), not {p.shape} and {t.shape}")
    if cell is not None and np.asarray(cell).size != 9:
        raise InvalidInput("a cell needs the shape (3, 3)")
    frame = pd.DataFrame({"config_id": config_id, "atom_id": np.arange(len(p)), "type": t.astype("int32"), **{c: p[:, k] for k, c in enumerate("xyz")}})
    return spark.createDataFrame(frame, ATOMS), matrices(spark, [(config_id, None if cell is None else tuple(np.asarray(cell, float).ravel()))])


def write_text(frames_: DataFrame, path: str) -> None:
    frames_.select("value").write.mode("error").text(path)
