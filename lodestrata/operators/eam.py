"""Energies, forces, virials and stresses as two grouped sums over pairs.

Pass one sums the partners' densities at each atom; its result is written, as pass two reads it three times. The
embedding slope of that density is the only thing that pass two needs of both atoms. It is cheaper to make the pairs again, with the slopes carried
on the atoms, than to shuffle pairs by either atom to fetch them. Partial sums run before each shuffle. Atoms without partners
have density 0 and stay, by a left join. Columns that nobody selects are pruned by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.potentials import Potential

#: Voigt components as (name, first axis, second axis).
VOIGT = (("xx", "x", "x"), ("yy", "y", "y"), ("zz", "z", "z"), ("yz", "y", "z"), ("xz", "x", "z"), ("xy", "x", "y"))
GPA = 160.21766


def densities(atoms: DataFrame, evaluated: DataFrame, potential: Potential) -> DataFrame:
    """atoms with rho, embedding and dembedding, from pairs that potential.at_pairs() has evaluated."""
    rho = evaluated.groupBy("config_id", F.col("i").alias("atom_id")).agg(F.sum("f_j").alias("rho"))
    joined = atoms.join(rho, ["config_id", "atom_id"], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    return potential.at_atoms(joined)


def forces_and_virials(dense: DataFrame, evaluated: DataFrame) -> DataFrame:
    """dense with pair_energy, energy, fx, fy, fz and the atom's virial w_xx..w_xy (half of each pair's).
    Pairs that carry dembedding from both atoms are only summed; others are joined with it first."""
    if "dembedding_i" in evaluated.columns:
        return _summed(dense, evaluated.withColumnsRenamed({"dembedding_i": "slope_i", "dembedding_j": "slope_j"}))
    slope = dense.select("config_id", F.col("atom_id").alias("i"), F.col("dembedding").alias("slope_i"))
    other = dense.select("config_id", F.col("atom_id").alias("j"), F.col("dembedding").alias("slope_j"))
    return _summed(dense, evaluated.join(slope, ["config_id", "i"]).join(other, ["config_id", "j"]))


def _summed(dense: DataFrame, both: DataFrame) -> DataFrame:
    pull = (F.col("slope_i") * F.col("df_j") + F.col("slope_j") * F.col("df_i") + F.col("dphi")) / F.sqrt("r2")
    both = both.withColumns({f"f{a}": pull * F.col(f"d{a}") for a in "xyz"})
    sums = both.groupBy("config_id", F.col("i").alias("atom_id")).agg(
        F.sum(F.col("phi") / 2).alias("pair_energy"),
        *(F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"),
        *(F.sum(F.lit(-0.5) * F.col(f"d{p}") * F.col(f"f{q}")).alias(f"w_{n}") for n, p, q in VOIGT),
    )
    names = ["pair_energy", "fx", "fy", "fz", *(f"w_{n}" for n, *_ in VOIGT)]
    joined = dense.join(sums, ["config_id", "atom_id"], "left").fillna(0.0, names)
    return joined.withColumn("energy", F.col("embedding") + F.col("pair_energy"))


def energies(dense: DataFrame, evaluated: DataFrame) -> DataFrame:
    """dense with pair_energy and energy; no forces, so pairs are summed once more but not joined."""
    sums = evaluated.groupBy("config_id", F.col("i").alias("atom_id")).agg(F.sum(F.col("phi") / 2).alias("pair_energy"))
    joined = dense.join(sums, ["config_id", "atom_id"], "left").fillna(0.0, ["pair_energy"])
    return joined.withColumn("energy", F.col("embedding") + F.col("pair_energy"))


def densities_and_energies(atoms: DataFrame, evaluated: DataFrame, potential: Potential, total=F.sum) -> DataFrame:
    """Densities and energies from one sum over pairs; for when no forces are wanted. total=exact_sum gives
    the same to the bit however the pairs are dealt."""
    sums = evaluated.groupBy("config_id", F.col("i").alias("atom_id")).agg(total(F.col("f_j")).alias("rho"), total(F.col("phi") / 2).alias("pair_energy"), F.count("*").alias("n_partners"))
    joined = atoms.join(sums, ["config_id", "atom_id"], "left").fillna(0.0, ["rho", "pair_energy"]).fillna(0, ["n_partners"])
    return potential.at_atoms(joined).withColumn("energy", F.col("embedding") + F.col("pair_energy"))


def totals(per_atom: DataFrame, cells: DataFrame) -> DataFrame:
    """(config_id, n_atoms, energy, virial w_*, stress s_* = -w / volume); stress is 0 for clusters."""
    has = [n for n, *_ in VOIGT if f"w_{n}" in per_atom.columns]
    summed = per_atom.groupBy("config_id").agg(F.count("*").alias("n_atoms"), F.sum("energy").alias("energy"), *(F.sum(f"w_{n}").alias(f"w_{n}") for n in has))
    space = cells.select("config_id", F.when(F.col("pbc"), G.volume()).alias("volume"))
    out = summed.join(space, "config_id")
    return out.withColumns({f"s_{n}": F.coalesce(F.when(F.col("volume") > 0, -F.col(f"w_{n}") / F.col("volume")), F.lit(0.0)) for n in has})


def totals_of_pairs(evaluated: DataFrame, potential: Potential, cells: DataFrame, virial: bool = True) -> DataFrame:
    """totals() by one sum over pairs in both directions that have each atom with itself, when no forces are wanted. Over
    both directions of a pair the terms of slope_j df_i are those of slope_i df_j, so an atom's own slope times twice the
    sum of df_j gives the same total; no pair has to know its partner's slope, and nothing is joined. The atoms' virials
    are not those of forces_and_virials(). Without `virial` there are energies alone."""
    other = F.col("i") != F.col("j")
    of_pairs = lambda v: F.coalesce(F.sum(F.when(other, v)), F.lit(0.0))
    over_r = {n: F.col(f"d{p}") * F.col(f"d{q}") / F.sqrt("r2") for n, p, q in VOIGT} if virial else {}
    atoms = evaluated.groupBy("config_id", F.col("i").alias("atom_id")).agg(
        F.first("ti").alias("type"),
        of_pairs(F.col("f_j")).alias("rho"),
        of_pairs(F.col("phi") / 2).alias("pair_energy"),
        *(of_pairs(F.col("df_j") * v).alias(f"u_{n}") for n, v in over_r.items()),
        *(of_pairs(F.col("dphi") * v).alias(f"v_{n}") for n, v in over_r.items()),
    )
    per = potential.at_atoms(atoms).withColumn("energy", F.col("embedding") + F.col("pair_energy"))
    return totals(per.withColumns({f"w_{n}": F.lit(-0.5) * (F.lit(2.0) * F.col("dembedding") * F.col(f"u_{n}") + F.col(f"v_{n}")) for n in over_r}), cells)


def atom_stresses(per_atom: DataFrame, cells: DataFrame) -> DataFrame:
    """per_atom with s_* = -N / V w_*, whose mean over atoms is the configuration's stress."""
    space = cells.select("config_id", F.when(F.col("pbc"), G.volume()).alias("volume"))
    n = per_atom.groupBy("config_id").agg(F.count("*").alias("n"))
    out = per_atom.join(space.join(n, "config_id"), "config_id")
    return out.withColumns({f"s_{v}": F.coalesce(F.when(F.col("volume") > 0, -F.col("n") / F.col("volume") * F.col(f"w_{v}")), F.lit(0.0)) for v, *_ in VOIGT}).drop("n", "volume")


def net_forces(per_atom: DataFrame) -> DataFrame:
    """(config_id, fx, fy, fz, f_max): the sums, which vanish by Newton's third law, and the largest force."""
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    return per_atom.groupBy("config_id").agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"), F.max(size).alias("f_max"))


def top_forces(per_atom: DataFrame, k: int = 20) -> DataFrame:
    """The k atoms with the largest forces."""
    size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz"))
    return per_atom.withColumn("force", size).orderBy(F.desc("force"), "config_id", "atom_id").limit(k)


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row (n, max_abs, rms, max_relative) of the differences of a column in two results."""
    both = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys)
    d = F.abs(F.col("va") - F.col("vb"))
    return both.agg(F.count("*").alias("n"), F.max(d).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(d / F.greatest(F.abs("vb"), F.lit(1e-12))).alias("max_relative"))


def field_statistics(per_atom: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return per_atom.groupBy("config_id").agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def field_histogram(per_atom: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(config_id, bin, n) over [low, high]; the last bin takes its upper end."""
    k = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return per_atom.filter(F.col(value).between(low, high)).groupBy("config_id", k.alias("bin")).agg(F.count("*").alias("n"))
