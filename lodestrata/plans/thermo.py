"""Thermodynamics from ensembles and series: equation of state, elastic constants, defects, Debye models."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.generate import literal

GPA, K_B, HBAR = 160.21766, 8.617333e-5, 6.582119e-16
MJ_PER_M2 = 16021.766


def bm3_sums(points: DataFrame) -> DataFrame:
    """(config_id, n, the moments) of E by x = V^(-2/3) around their means; all that the cubic fit needs."""
    x = F.pow(F.col("volume"), -2 / 3)
    w = Window.partitionBy("config_id")
    scaled = points.withColumn("x", x).withColumns({"x0": F.avg("x").over(w), "s": F.stddev_pop("x").over(w)})
    u = (F.col("x") - F.col("x0")) / F.col("s")
    powers = [F.sum(F.pow(u, k)).alias(f"u{k}") for k in range(7)]
    return scaled.groupBy("config_id").agg(F.first("x0").alias("x0"), F.first("s").alias("s"), *powers, *(F.sum(F.col("energy") * F.pow(u, k)).alias(f"e{k}") for k in range(4)))


def birch_murnaghan(points: DataFrame) -> DataFrame:
    """(config_id, e0, v0, b0 in GPa, b0_prime) of each configuration's (volume, energy). The third-order form
    is a cubic in V^(-2/3), so the fit is linear: moments in Spark, then a 4 x 4 system in each of their
    rows. A configuration without a minimum at a positive volume has no row."""

    def fits(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist(_minima(batch.to_pylist()), schema=to_arrow_schema(schema))

    sums = bm3_sums(points)
    schema = StructType([sums.schema["config_id"], *(StructField(n, DoubleType()) for n in ("e0", "v0", "b0", "b0_prime"))])
    return sums.mapInArrow(fits, schema)


def _minima(rows: list[dict]) -> list[dict]:
    out = []
    for r in rows:
        a = np.array([[r[f"u{i + j}"] for j in range(4)] for i in range(4)])
        c = np.polynomial.Polynomial(np.linalg.solve(a, [r[f"e{k}"] for k in range(4)]))
        d1, d2, d3 = c.deriv(1), c.deriv(2), c.deriv(3)
        low = [u.real for u in d1.roots() if abs(u.imag) < 1e-9 and d2(u.real) > 0 and r["x0"] + r["s"] * u.real > 0]
        if not low:
            continue
        u = min(low, key=abs)
        x, s = r["x0"] + r["s"] * u, r["s"]
        e2, e3 = d2(u) / s**2, d3(u) / s**3
        out.append({"config_id": r["config_id"], "e0": float(c(u)), "v0": float(x**-1.5), "b0": float(4 / 9 * e2 * x**3.5 * GPA), "b0_prime": float(4 + 2 / 3 * x * e3 / e2)})
    return out


def elastic_constants(slopes: DataFrame, *keys: str) -> DataFrame:
    """C11, C12, C44, bulk, shear modulus and anisotropy (GPa) of a cubic crystal, one row for each value of keys, from
    stresses under strains (mode, delta, s_xx, s_yy, s_yz): mode 'axial' strains x, mode 'shear' yz by delta / 2 each."""
    axial, shear = F.col("mode") == "axial", F.col("mode") == "shear"
    c = slopes.groupBy(*keys).agg(
        (F.regr_slope(F.when(axial, F.col("s_xx")), F.col("delta")) * GPA).alias("c11"),
        (F.regr_slope(F.when(axial, F.col("s_yy")), F.col("delta")) * GPA).alias("c12"),
        (F.regr_slope(F.when(shear, F.col("s_yz")), F.col("delta")) * GPA).alias("c44"),
    )
    c11, c12, c44 = F.col("c11"), F.col("c12"), F.col("c44")
    return c.withColumns({"bulk": (c11 + 2 * c12) / 3, "shear": (c11 - c12 + 3 * c44) / 5, "zener": 2 * c44 / (c11 - c12)})


def vacancy_energy(energy_less: Column, n: Column, energy: Column) -> Column:
    """E(N - 1) - (N - 1) / N E(N)."""
    return energy_less - (n - 1) / n * energy


def surface_energy(slab: Column, n: Column, bulk_per_atom: Column, area: Column) -> Column:
    """(E - N e) / (2 A) in J/m^2; two faces."""
    return (slab - n * bulk_per_atom) / (2 * area) * (MJ_PER_M2 / 1000)


def shells(d: Column, a0: float) -> Column:
    """Shell of a distance from a defect: 1 to 3 by 0.85, 1.15, 1.45 lattice constants, else 4."""
    return F.when(d < 0.85 * a0, 1).when(d < 1.15 * a0, 2).when(d < 1.45 * a0, 3).otherwise(4)


def thermal_expansion(series: DataFrame, atoms_per_cell: int = 4) -> DataFrame:
    """One row (slope, a0, alpha) of the lattice constant by temperature from (temperature, volume, n_atoms)."""
    a = F.cbrt(F.avg(F.col("volume") / F.col("n_atoms")) * atoms_per_cell).alias("a")
    by_t = series.groupBy("temperature").agg(a)
    fit = by_t.agg(F.regr_slope("a", "temperature").alias("slope"), F.min_by("a", "temperature").alias("a0"))
    return fit.withColumn("alpha", F.col("slope") / F.col("a0"))


def heat_capacity(series: DataFrame) -> DataFrame:
    """(config_id, c_v) in k_B: 3/2 N + Var(E) / (k T)^2 from (config_id, n_atoms, temperature, e_pot)."""
    t = F.avg("temperature")
    return series.groupBy("config_id").agg((F.lit(1.5) * F.max("n_atoms") + F.var_pop("e_pot") / (F.lit(K_B) ** 2 * t * t)).alias("c_v"))


def at_pressure(c_v: Column, temperature: Column, alpha: float, bulk: float, volume: float) -> Column:
    """Heat capacity of an atom at constant pressure: c_v + 9 alpha^2 B V T, with the linear expansion alpha, the
    bulk modulus in GPa and the atom's volume."""
    return c_v + F.lit(9 * alpha**2 * bulk / GPA * volume) * temperature


def npt_statistics(series: DataFrame, atoms_per_cell: int = 4) -> DataFrame:
    """(config_id, n, temperature, volume, a, a_deviation) of a series at constant pressure (config_id,
    temperature, volume, n_atoms): means, the lattice constant of the mean volume and its deviation."""
    edge = F.cbrt(F.col("volume") / F.col("n_atoms") * atoms_per_cell)
    of_mean = F.cbrt(F.avg("volume") / F.max("n_atoms") * atoms_per_cell)
    return series.groupBy("config_id").agg(F.count("*").alias("n"), F.avg("temperature").alias("temperature"), F.avg("volume").alias("volume"), of_mean.alias("a"), F.stddev_pop(edge).alias("a_deviation"))


def debye_classical(temperatures: DataFrame, theta: float) -> DataFrame:
    """(temperature, a_vib, s_vib) per atom of the classical Debye model, in eV and eV/K."""
    t = F.col("temperature")
    x = F.log(F.lit(theta) / t)
    return temperatures.select("temperature", (F.lit(K_B) * t * (3 * x - 1)).alias("a_vib"), (F.lit(3 * K_B) * (F.lit(4 / 3) - x)).alias("s_vib"))


def gauss_legendre(spark: SparkSession, n: int = 16) -> DataFrame:
    """Nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return literal(spark, [(float((a + 1) / 2), float(b / 2)) for a, b in zip(x, w)], "u double, w double")


def debye_quantum(temperatures: DataFrame, theta: float, nodes: DataFrame) -> DataFrame:
    """(temperature, d3, free_energy, entropy) per atom of the quantum Debye model with zero-point energy;
    the integral by the quadrature nodes."""
    t = F.col("temperature")
    both = temperatures.crossJoin(F.broadcast(nodes))  # a fixed number of nodes
    x = F.lit(theta) / t
    z = F.col("u") * x
    term = F.col("w") * x * F.pow(z, 3) / F.expm1(z)
    d3 = both.groupBy("temperature").agg((3 / F.pow(F.lit(theta) / F.first("temperature"), 3) * F.sum(term)).alias("d3"))
    free = F.lit(K_B) * t * (F.lit(9 / 8) * x + 3 * F.log1p(-F.exp(-x)) - F.col("d3"))
    entropy = F.lit(K_B) * (4 * F.col("d3") - 3 * F.log1p(-F.exp(-x)))
    return d3.select("temperature", "d3", free.alias("free_energy"), entropy.alias("entropy"))


def gruneisen(points: DataFrame) -> DataFrame:
    """One row (gamma): minus the slope of ln frequency by ln volume."""
    return points.agg((-F.regr_slope(F.log("frequency"), F.log("volume"))).alias("gamma"))


def quasi_harmonic(static: DataFrame, temperatures: DataFrame, theta0: float, v0: float, gamma: float) -> DataFrame:
    """(temperature, volume, free_energy): the volume of the least static energy plus classical Debye free
    energy, theta = theta0 (v0 / V)^gamma, on the grid of static (volume, energy)."""
    both = static.crossJoin(temperatures)  # two short grids
    t = F.col("temperature")
    theta = F.lit(theta0) * F.pow(F.lit(v0) / F.col("volume"), gamma)
    free = F.col("energy") + F.lit(K_B) * t * (3 * F.log(theta / t) - 1)
    best = both.select("temperature", F.struct(free.alias("free_energy"), "volume").alias("p")).groupBy("temperature").agg(F.min("p").alias("p"))
    return best.select("temperature", "p.volume", "p.free_energy")


def quasi_harmonic_quantum(static: DataFrame, temperatures: DataFrame, nodes: DataFrame, theta0: float, v0: float, gamma: float) -> DataFrame:
    """(temperature, volume, free_energy, entropy, alpha): as quasi_harmonic(), with the quantum Debye model;
    alpha is a third of the central difference of ln volume, null at the first and last temperature."""
    both = static.crossJoin(temperatures).crossJoin(F.broadcast(nodes))  # two short grids and a fixed number of nodes
    t, x = F.col("temperature"), F.lit(theta0) * F.pow(F.lit(v0) / F.col("volume"), gamma) / F.col("temperature")
    term = F.col("w") * F.pow(F.col("u") * F.col("x"), 3) / F.expm1(F.col("u") * F.col("x"))
    d3 = both.withColumn("x", x).groupBy("temperature", "volume", "energy", "x").agg((F.lit(3.0) / F.pow("x", F.lit(2)) * F.sum(term)).alias("d3"))
    logs = F.log1p(-F.exp(-F.col("x")))
    free = F.col("energy") + F.lit(K_B) * t * (F.lit(9 / 8) * F.col("x") + 3 * logs - F.col("d3"))
    entropy = F.lit(K_B) * (4 * F.col("d3") - 3 * logs)
    best = d3.groupBy("temperature").agg(F.min(F.struct(free.alias("free_energy"), "volume", entropy.alias("entropy"))).alias("p")).select("temperature", "p.volume", "p.free_energy", "p.entropy")
    near = Window.orderBy("temperature")  # a short grid
    rise, step = F.lead("volume").over(near) - F.lag("volume").over(near), F.lead("temperature").over(near) - F.lag("temperature").over(near)
    return best.withColumn("alpha", rise / (3 * F.col("volume") * step))


def quasi_harmonic_consistent(volumes: DataFrame, spectra: DataFrame, temperatures: DataFrame, nodes: DataFrame) -> DataFrame:
    """(config_id, temperature, volume, free_energy, gamma, theta, alpha) from static energies (config_id, volume,
    energy) and spectra (config_id, volume, theta), at volumes of their own: gamma and theta(V) are the spectra's
    regression, not given. The least free energy lies between volumes, on the parabola through the lowest point and
    its neighbours (the point itself at the ends); alpha is a third of the central difference of ln volume."""
    v = F.col("volume")
    fit = spectra.groupBy("config_id").agg(F.regr_slope(F.log("theta"), F.log("volume")).alias("slope"), F.regr_intercept(F.log("theta"), F.log("volume")).alias("cut"))
    smooth = volumes.join(fit, "config_id").withColumn("theta", F.exp(F.col("cut") + F.col("slope") * F.log(v)))
    both = smooth.crossJoin(temperatures).withColumn("x", F.col("theta") / F.col("temperature"))  # each volume at each temperature
    term = F.col("w") * F.pow(F.col("u") * F.col("x"), 3) / F.expm1(F.col("u") * F.col("x"))
    keys = ["config_id", "temperature", "volume", "energy", "slope", "cut", "x"]
    d3 = both.crossJoin(nodes).groupBy(*keys).agg((F.lit(3.0) / F.pow("x", F.lit(2)) * F.sum(term)).alias("d3"))
    free = F.col("energy") + F.lit(K_B) * F.col("temperature") * (F.lit(9 / 8) * F.col("x") + 3 * F.log1p(-F.exp(-F.col("x"))) - F.col("d3"))
    w = Window.partitionBy("config_id", "temperature").orderBy("volume")  # the volumes of one curve
    curve = d3.withColumn("f", free).withColumns({"v0": F.lag("volume").over(w), "f0": F.lag(F.col("f")).over(w), "v2": F.lead("volume").over(w), "f2": F.lead(F.col("f")).over(w)})
    low = curve.groupBy("config_id", "temperature").agg(F.min(F.struct("f", "volume", "v0", "f0", "v2", "f2", "slope", "cut")).alias("p")).select("config_id", "temperature", "p.*")
    d1, d2 = (F.col("f") - F.col("f0")) / (v - F.col("v0")), (F.col("f2") - F.col("f")) / (F.col("v2") - v)
    bend = (d2 - d1) / (F.col("v2") - F.col("v0"))
    at = (F.col("v0") + v) / 2 - d1 / (2 * bend)
    least = F.col("f0") + d1 * (at - F.col("v0")) + bend * (at - F.col("v0")) * (at - v)
    found = low.select("config_id", "temperature", F.coalesce(at, v).alias("volume"), F.coalesce(least, F.col("f")).alias("free_energy"), (-F.col("slope")).alias("gamma"), "slope", "cut")
    near = Window.partitionBy("config_id").orderBy("temperature")  # the temperatures of one material
    rise, step = F.lead("volume").over(near) - F.lag("volume").over(near), F.lead("temperature").over(near) - F.lag("temperature").over(near)
    theta = F.exp(F.col("cut") + F.col("slope") * F.log(v))
    return found.withColumns({"theta": theta, "alpha": rise / (3 * v * step)}).drop("slope", "cut")


def compared(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, value, expected, deviation, verdict): 'pass' within the reference's tolerance, else 'warn'."""
    both = values.join(reference, "name")
    off = F.abs(F.col("value") - F.col("expected")) / F.abs("expected")
    return both.select("name", "value", "expected", off.alias("deviation"), F.when(off <= F.col("tolerance"), "pass").otherwise("warn").alias("verdict"))


def dynamical_matrices(force_constants: DataFrame, wave_vectors: DataFrame, mass: float) -> DataFrame:
    """(q_id, a, b, re, im): sum over atoms of Phi_ab exp(i q R) / m, from force constants (a, b, phi, rx, ry,
    rz), minus the force's change by the displacement, and wave vectors (q_id, qx, qy, qz)."""
    both = force_constants.crossJoin(wave_vectors)  # every atom has a phase at every wave vector
    phase = sum((F.col(f"q{c}") * F.col(f"r{c}") for c in "xyz"), F.lit(0.0))
    return both.groupBy("q_id", "a", "b").agg((F.sum(F.col("phi") * F.cos(phase)) / mass).alias("re"), (F.sum(F.col("phi") * F.sin(phase)) / mass).alias("im"))


def phonon_frequencies(matrices: DataFrame) -> DataFrame:
    """(q_id, branch, thz) from dynamical matrices in eV / (A^2 u): square roots of the eigenvalues; imaginary
    ones are negative."""
    unit = np.sqrt(1.602176634e-19 / 1e-20 / 1.66053906660e-27) / (2 * pi) / 1e12

    def solve(rows):
        import pyarrow as pa

        m = np.zeros((3, 3), complex)
        for r in rows.to_pylist():
            m[r["a"], r["b"]] = r["re"] + 1j * r["im"]
        e = np.linalg.eigvalsh((m + m.conj().T) / 2)
        return pa.table({"q_id": [rows.column("q_id")[0].as_py()] * 3, "branch": [0, 1, 2], "thz": (np.sign(e) * np.sqrt(np.abs(e)) * unit).tolist()}).cast(pa.schema([("q_id", pa.int64()), ("branch", pa.int32()), ("thz", pa.float64())]))

    return matrices.groupBy("q_id").applyInArrow(solve, "q_id long, branch int, thz double")  # nine rows a group
