"""Five quick checks of a potential on a small crystal, before long work with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.potentials import Potential
from ..operators import eam, neighbors
from ..operators.exact import exact_sum
from ..sources import generate

#: Largest component of the sum of forces that counts as none, in eV/A.
STILL = 1e-3


def quick_check(spark: SparkSession, potential: Potential, a: float, cohesive: float | None = None, element: int = 0, reps: int = 4, tolerance: float = 0.05) -> DataFrame:
    """(step, name, ok, value) for an FCC crystal of one element: the potential has the element; energy, forces
    and stress are finite; forces add up to nothing; the energy of an atom is the given one within the
    tolerance (ok is null where none is given); the same energy to the bit from other partitions."""
    engine = Engine(potential)
    atoms = generate.lattice(spark, "fcc", a, (reps,) * 3).withColumn("type", F.lit(element))
    cells = generate.orthorhombic(spark, [("lattice", *[a * reps] * 3)])
    full = engine.compute_stress(atoms, cells)
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    names = ["energy", *(f"s_{n}" for n, *_ in eam.VOIGT)]
    point = full.totals.select("n_atoms", F.col("energy").alias("whole"), F.array_min(F.array(*(finite(F.col(n)).cast("int") for n in names))).alias("totals_ok"))
    forces = eam.net_forces(full.per_atom).select(F.greatest(*(F.abs(f"f{c}") for c in "xyz")).alias("net"), finite(F.col("f_max")).alias("forces_ok"))
    pairs = potential.at_pairs(neighbors.pairs(atoms, cells, potential.cutoff, "cell_list"))
    dealt = [eam.densities_and_energies(atoms, pairs.repartition(n), potential, total=exact_sum).agg(exact_sum("energy").alias(f"dealt{n}")) for n in (3, 17)]
    row = point.crossJoin(forces).crossJoin(dealt[0]).crossJoin(dealt[1])  # one row each
    off = F.abs(F.col("whole") / F.col("n_atoms") - cohesive) / abs(cohesive) if cohesive else F.lit(None).cast("double")
    steps = [
        ("potential", F.lit(0 <= element < engine.n_elements and engine.cutoff > 0), F.lit(float(engine.cutoff))),
        ("single point", (F.col("totals_ok") == 1) & F.col("forces_ok"), F.col("whole")),
        ("net force", F.col("net") < STILL, F.col("net")),
        ("cohesive energy", off <= tolerance, F.col("whole") / F.col("n_atoms")),
        ("same to the bit", F.col("dealt3") == F.col("dealt17"), F.col("dealt3") - F.col("dealt17")),
    ]
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), ok.alias("ok"), v.alias("value")) for k, (n, ok, v) in enumerate(steps, 1))))
    return row.select(each)
