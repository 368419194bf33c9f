"""Embedded-atom potentials.

A potential gives Column expressions: the density that a donor of type t spreads at distance r, the
pair energy of types (ti, tj), the embedding energy at density rho, and the derivatives. Analytic
potentials are closed forms; tabulated ones look up one row of coefficients by grid interval."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import POT_SPLINE


class Potential(Protocol):
    cutoff: float

    def at_pairs(self, pairs: DataFrame) -> DataFrame:
        """pairs (with ti, tj, r2) with f_j, df_i, df_j, phi, dphi: what donor j spreads at i, the
        slopes of both donors' densities, the pair energy and its slope."""

    def at_atoms(self, atoms: DataFrame) -> DataFrame:
        """atoms (with type, rho) with embedding and dembedding."""


class AnalyticPotential:
    """F = -s sqrt(rho + 0.01), f = s ((rc - r)/rc)^2, phi = p (rc - r)^2, with s by the donor's type
    and p by the pair's types."""

    def __init__(self, cutoff: float = 4.95, density_scale=(1.0, 0.9), pair_scale=(1.0, 0.95, 0.9)):
        self.cutoff, self.density_scale, self.pair_scale = cutoff, density_scale, pair_scale

    def _scale(self, kind: Column) -> Column:
        out = F.lit(float(self.density_scale[0]))
        for k, s in enumerate(self.density_scale[1:], 1):
            out = F.when(kind == k, float(s)).otherwise(out)
        return out

    def _pair(self, ti: Column, tj: Column) -> Column:
        index, out = pair_index(ti, tj, len(self.density_scale)), F.lit(float(self.pair_scale[0]))
        for k, s in enumerate(self.pair_scale[1:], 1):
            out = F.when(index == k, float(s)).otherwise(out)
        return out

    def at_pairs(self, pairs: DataFrame) -> DataFrame:
        rc, r = F.lit(float(self.cutoff)), F.sqrt("r2")
        ti, tj = F.col("ti"), F.col("tj")
        part, slope, p = (rc - r) / rc, F.lit(-2.0) * (rc - r) / (rc * rc), self._pair(ti, tj)
        return pairs.withColumns(
            {"f_j": self._scale(tj) * part * part, "df_i": self._scale(ti) * slope, "df_j": self._scale(tj) * slope, "phi": p * (rc - r) * (rc - r), "dphi": F.lit(-2.0) * p * (rc - r)}
        )

    def at_atoms(self, atoms: DataFrame) -> DataFrame:
        root, s = F.sqrt(F.col("rho") + 0.01), self._scale(F.col("type"))
        return atoms.withColumns({"embedding": -s * root, "dembedding": -s / (F.lit(2.0) * root)})


def pair_index(a: Column, b: Column, n: int) -> Column:
    """Row-major number of an unordered pair of n elements."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low * n - F.floor(low * (low - 1) / 2).cast("int") + high - low


def central_differences(grid: DataFrame) -> DataFrame:
    """(pot_id, kind, key, k, value, slope) from (pot_id, kind, key, k, dx, value): one-sided at the ends."""
    w = Window.partitionBy("pot_id", "kind", "key").orderBy("k")
    before, after, v, dx = F.lag("value").over(w), F.lead("value").over(w), F.col("value"), F.col("dx")
    slope = F.when(before.isNull(), (after - v) / dx).when(after.isNull(), (v - before) / dx).otherwise((after - before) / (2 * dx))
    return grid.withColumn("slope", slope)


def natural_spline(grid: DataFrame) -> DataFrame:
    """Natural cubic splines of equidistant tables (pot_id, kind, key, k, x, value): per interval k the
    coefficients of a + b t + c t^2 + d t^3, t = x - x_k. One table is one group; a table is small."""

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        x, y = rows.column("x").to_numpy(), rows.column("value").to_numpy()
        n, h = len(x), np.diff(x)
        slope, c = np.diff(y) / h, np.zeros(n)
        if n > 2:
            diag, upper, right = np.empty(n), np.empty(n), np.zeros(n)
            for k in range(1, n - 1):
                lower = h[k - 1] * (upper[k - 1] if k > 1 else 0)
                diag[k] = 2 * (h[k - 1] + h[k]) - lower
                upper[k] = h[k] / diag[k]
                right[k] = (3 * (slope[k] - slope[k - 1]) - h[k - 1] * right[k - 1]) / diag[k]
            for k in range(n - 2, 0, -1):
                c[k] = right[k] - upper[k] * c[k + 1]
        b = slope - h * (2 * c[:-1] + c[1:]) / 3
        d = np.diff(c) / (3 * h)
        head = rows.slice(0, n - 1)
        return pa.table({**{k: head.column(k) for k in ("pot_id", "kind", "key", "k", "x")}, "a": y[:-1], "b": b, "c": c[:-1], "d": d}).cast(pa.schema([("pot_id", pa.string()), ("kind", pa.string()), ("key", pa.int32()), ("k", pa.int32()), *((q, pa.float64()) for q in "xabcd")]))

    return grid.select("pot_id", "kind", "key", "k", "x", "value").groupBy("pot_id", "kind", "key").applyInArrow(fit, POT_SPLINE)


def hermite_spline(grid: DataFrame) -> DataFrame:
    """Piecewise cubics from five-point slopes, by windows alone: (pot_id, kind, key, k, x, a, b, c, d).
    The first and last two points have one-sided and three-point slopes."""
    w = Window.partitionBy("pot_id", "kind", "key").orderBy("k")
    v = {o: F.lead("value", o).over(w) if o > 0 else F.lag("value", -o).over(w) if o < 0 else F.col("value") for o in range(-2, 3)}
    slope = F.coalesce((v[-2] - v[2] + 8 * (v[1] - v[-1])) / 12, (v[1] - v[-1]) / 2, v[1] - v[0], v[0] - v[-1])
    step = F.lead("x").over(w) - F.col("x")
    s = grid.withColumns({"slope": slope, "next": v[1], "h": step})
    s = s.withColumn("next_slope", F.lead("slope").over(w)).filter("next is not null")
    rise, m0, m1, h = F.col("next") - F.col("value"), F.col("slope"), F.col("next_slope"), F.col("h")
    return s.select("pot_id", "kind", "key", "k", "x", F.col("value").alias("a"), (m0 / h).alias("b"), ((3 * rise - 2 * m0 - m1) / (h * h)).alias("c"), ((m0 + m1 - 2 * rise) / (h * h * h)).alias("d"))


def interval(x: Column, dx: Column, n: Column) -> Column:
    """Grid interval of x: the first or last one beyond the table."""
    return F.greatest(F.lit(0), F.least(F.floor(x / dx), n - 2)).cast("int")


def polynomial(t: Column, c: dict[str, Column]) -> tuple[Column, Column]:
    """Value and slope of a + b t + c t^2 + d t^3."""
    return c["a"] + t * (c["b"] + t * (c["c"] + t * c["d"])), c["b"] + t * (2 * c["c"] + 3 * t * c["d"])


def linear_coefficients(grid: DataFrame) -> DataFrame:
    """Intervals of straight lines, as splines with c = d = 0."""
    w = Window.partitionBy("pot_id", "kind", "key").orderBy("k")
    step = F.lead("x").over(w) - F.col("x")
    return grid.select("pot_id", "kind", "key", "k", "x", F.col("value").alias("a"), ((F.lead("value").over(w) - F.col("value")) / step).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d")).filter("b is not null")


def resampled(splines: DataFrame, n: int, dx: float, samples: int) -> DataFrame:
    """(pot_id, kind, key, i, x, value, slope): tables of n points at distance dx on a uniform grid of `samples` points over
    the same range, read from their interval coefficients. An interval makes its own points, so nothing is joined."""
    m, k = samples - 1, F.col("k").cast("long")
    first = F.ceil(k * m / (n - 1) - 1e-12)
    last = F.when(k == n - 2, m).otherwise(F.ceil((k + 1) * m / (n - 1) - 1e-12) - 1)
    points = splines.filter(first <= last).select("pot_id", "kind", "key", F.col("x").alias("x0"), *"abcd", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("i"))
    x = F.col("i") * ((n - 1) * dx / m)
    value, slope = polynomial(x - F.col("x0"), {c: F.col(c) for c in "abcd"})
    return points.select("pot_id", "kind", "key", "i", x.alias("x"), value.alias("value"), slope.alias("slope"))


class TabulatedPotential:
    """A potential from interval coefficients (pot_id, kind, key, k, x, a..d) of one pot_id. For pairs
    one row for each (ti, tj, k) has all three functions, so a pair needs one lookup for both passes.
    Beyond the table values and slopes are those at its end; with `extrapolate` the embedding energy goes on
    from there on a straight line, as the form for Hermite tables has it."""

    #: Rows of coefficients up to which the lookup is broadcast; larger ones are joined by shuffle.
    BROADCAST_ROWS = 2_000_000

    def __init__(self, meta: dict, splines: DataFrame, extrapolate: bool = False):
        self.extrapolate = extrapolate
        self.meta, self.cutoff, n = meta, meta["cutoff"], meta["n_elem"]
        self.splines = splines
        f = splines.filter("kind = 'rho'").select("key", "k", F.col("x").alias("x0"), *"abcd")
        phi = splines.filter("kind = 'phi'").select(F.col("key").alias("pair"), "k", *(F.col(c).alias(f"p{c}") for c in "abcd"))
        kinds = splines.sparkSession.range(n).select(F.col("id").cast("int").alias("t"))
        both = kinds.select(F.col("t").alias("ti")).crossJoin(kinds.select(F.col("t").alias("tj")))  # n_elem squared
        both = both.withColumn("pair", pair_index(F.col("ti"), F.col("tj"), n))
        fi = f.select(F.col("key").alias("ti"), "k", "x0", *(F.col(c).alias(f"i{c}") for c in "abcd"))
        fj = f.select(F.col("key").alias("tj"), "k", *(F.col(c).alias(f"j{c}") for c in "abcd"))
        self._pairs = both.join(phi, "pair").join(fi, ["ti", "k"]).join(fj, ["tj", "k"]).drop("pair")
        self._embed = splines.filter("kind = 'embed'").select(F.col("key").alias("type"), "k", F.col("x").alias("x0"), *"abcd")
        self._small = n * n * meta["nr"] + n * meta["nrho"] <= self.BROADCAST_ROWS

    def _looked_up(self, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(F.broadcast(right) if self._small else right, on)

    def at_pairs(self, pairs: DataFrame) -> DataFrame:
        m, r = self.meta, F.sqrt("r2")
        found = self._looked_up(pairs.withColumn("k", interval(r, F.lit(m["dr"]), F.lit(m["nr"]))), self._pairs, ["ti", "tj", "k"])
        t = F.least(F.sqrt("r2"), F.lit(m["dr"] * (m["nr"] - 1))) - F.col("x0")
        of = {p: polynomial(t, {c: F.col(p + c) for c in "abcd"}) for p in "ijp"}
        kept = [F.col(c) for c in pairs.columns]
        return found.select(*kept, of["j"][0].alias("f_j"), of["i"][1].alias("df_i"), of["j"][1].alias("df_j"), of["p"][0].alias("phi"), of["p"][1].alias("dphi"))

    def at_atoms(self, atoms: DataFrame) -> DataFrame:
        m = self.meta
        found = self._looked_up(atoms.withColumn("k", interval(F.col("rho"), F.lit(m["drho"]), F.lit(m["nrho"]))), self._embed, ["type", "k"])
        t = F.greatest(F.lit(0.0), F.least("rho", F.lit(m["drho"] * (m["nrho"] - 1)))) - F.col("x0")
        value, slope = polynomial(t, {c: F.col(c) for c in "abcd"})
        if self.extrapolate:
            value = value + slope * F.greatest(F.lit(0.0), F.col("rho") - m["drho"] * (m["nrho"] - 1))
        return found.select(*(F.col(c) for c in atoms.columns), value.alias("embedding"), slope.alias("dembedding"))


def sample_count(n: Column, domain: Column, step: float, least: int, most: int, times: int) -> Column:
    """Samples of a denser grid: at least `times` per interval and one every `step`, within bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), (n - 1) * times + 1, F.ceil(domain / step).cast("int") + 1))
