"""python -m lodestrata calc --pot FILE --in FILE.xyz|- [--out FOLDER] [--format json|xyz] [--elem Cu Ag]
[--all-pairs | --cell-list [--cell-size A]] [--no-pbc]: energy and forces of XYZ frames, to standard output or
as text files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import InvalidInput
from .operators import validation
from .plans.quickcheck import quick_check
from .sources import setfl, xyz


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestrata")
    commands = parser.add_subparsers(dest="command", required=True)
    quick = commands.add_parser("check", help="five quick checks of a potential")
    quick.add_argument("--pot", required=True, dest="pot_path")
    quick.add_argument("--lattice", type=float, required=True, help="lattice constant of the FCC crystal")
    quick.add_argument("--cohesive", type=float, help="energy of an atom to compare with")
    quick.add_argument("--elem", help="element symbol; the potential's first if left out")
    quick.add_argument("--interpolation", choices=("spline", "hermite", "linear"), default="spline")
    calc = commands.add_parser("calc", help="energy and forces of XYZ frames")
    calc.add_argument("--pot", required=True, dest="pot_path")
    calc.add_argument("--in", required=True, dest="in_path", help="a file, a pattern of files, or - for standard input")
    calc.add_argument("--out", dest="out_path", help="a new folder; standard output if left out")
    calc.add_argument("--format", choices=("json", "xyz"), default="json")
    calc.add_argument("--elem", nargs="+", help="element symbols in the order of the potential, in place of its own")
    calc.add_argument("--all-pairs", action="store_true")
    calc.add_argument("--cell-list", action="store_true")
    calc.add_argument("--cell-size", type=float, help="least size of a grid cell, if over the cutoff")
    calc.add_argument("--no-pbc", action="store_true")
    calc.add_argument("--interpolation", choices=("spline", "hermite", "linear"), default="spline")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    potential = setfl.load(setfl.read_files(spark, a.pot_path), a.interpolation)
    if a.command == "check":
        known = potential.meta["elements"]
        if a.elem and a.elem not in known:
            raise InvalidInput(f"the potential ({', '.join(known)}) doesn't have {a.elem}")
        rows = quick_check(spark, potential, a.lattice, a.cohesive, known.index(a.elem) if a.elem else 0).orderBy("step").collect()
        for r in rows:
            print(f"{r.step} {r.name}: {'skipped' if r.ok is None else 'ok' if r.ok else 'FAILED'} ({r.value!r})")
        if any(r.ok is False for r in rows):
            raise SystemExit(1)
        return
    if a.in_path == "-":
        files = spark.createDataFrame([("stdin", sys.stdin.read())], "config_id string, value string")
    else:
        files = xyz.read_files(spark, a.in_path)
    atoms, cells = xyz.parse(files)
    xyz.check(atoms, cells)
    elements = a.elem or potential.meta["elements"]
    if len(elements) != potential.meta["n_elem"]:
        raise InvalidInput(f"the potential has {potential.meta['n_elem']} elements, --elem names {len(elements)}")
    atoms = validation.with_types(atoms, elements)
    if a.no_pbc:
        cells = cells.withColumn("pbc", F.lit(False))
    cells = cells.drop("n")
    strategy = "all_pairs" if a.all_pairs else "cell_list" if a.cell_list or a.cell_size else "auto"
    result = Engine(potential, strategy, elements=elements, cell_size=a.cell_size).compute_stress(atoms, cells)
    if a.format == "json":
        out = xyz.json_results(result.totals, result.per_atom)
    else:
        out = xyz.frames(result.per_atom.join(atoms, ["config_id", "atom_id"]), cells, F.col("symbol"))
    if a.out_path:
        xyz.write_text(out, a.out_path)
    else:
        for row in out.orderBy("config_id").toLocalIterator():
            print(row["value"])


if __name__ == "__main__":
    main()
