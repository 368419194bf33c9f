"""What is computed from trajectories (config_id, frame, t, atom_id, x, y, z[, vx, vy, vz]) and pairs.

Frames of an atom are a window partition; lagged products are equi-joins on (atom, frame + lag); sums are
grouped. Nothing is gathered by configuration."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import geometry as G
from . import neighbors
from .ranks import sum_before

_ATOM = ["config_id", "atom_id"]


def _by_frame() -> Window:
    return Window.partitionBy(*_ATOM).orderBy("frame")


def rdf(pairs: DataFrame, totals: DataFrame, r_max: float, bins: int) -> DataFrame:
    """(config_id, bin, r, g) from ordered pairs within r_max and totals (config_id, n_atoms, volume):
    counts over those of an even density in each shell, with N - 1 partners. All bins are there."""
    dr = r_max / bins
    counts = pairs.filter("r2 > 0").groupBy("config_id", F.least(F.floor(F.sqrt("r2") / dr), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = totals.select("config_id", "n_atoms", "volume", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    k = F.col("bin")
    shell = F.lit(4 / 3 * pi * dr**3) * (F.pow(k + 1.0, 3) - F.pow(k + 0.0, 3))
    ideal = F.col("n_atoms") * (F.col("n_atoms") - 1) / F.col("volume") * shell
    return every.join(counts, ["config_id", "bin"], "left").select("config_id", "bin", ((k + 0.5) * dr).alias("r"), (F.coalesce("n", F.lit(0)) / ideal).alias("g"))


def rdf_over_frames(traj: DataFrame, cells: DataFrame, r_max: float, bins: int) -> DataFrame:
    """(config_id, bin, r, g, deviation, n_frames): mean and deviation over all frames with two atoms or more.

    All frames are one neighbour join on (config_id, frame, cell); counts are summed before the shuffle, and a
    frame without a pair in a bin counts as 0 there. Cells may have a frame column of their own. Atoms of a frame at the
    same place, which are no pair, are one place with their number: a pair of places counts for the product, twice."""
    dr = r_max / bins
    places = traj.groupBy("config_id", "frame", "x", "y", "z").agg(F.count("*").alias("held"), F.min("atom_id").alias("atom_id"))
    places = places.select("config_id", "frame", "atom_id", F.lit(0).alias("type"), "x", "y", "z", "held")
    found = neighbors.cell_list_pairs(places, cells, r_max, lowest=0.0, half=True, carry=("held",), by=("frame",))
    k = F.least(F.floor(F.sqrt("r2") / dr), F.lit(bins - 1)).cast("int")
    counts = found.groupBy("config_id", "frame", k.alias("bin")).agg((F.lit(2) * F.sum(F.col("held_i") * F.col("held_j"))).alias("n"))
    keys = ["config_id", "frame"] if "frame" in cells.columns else ["config_id"]
    sizes = traj.groupBy("config_id", "frame").agg(F.count("*").alias("n_atoms")).filter("n_atoms > 1")
    sizes = sizes.join(G.with_geometry(cells).select(*keys, "volume"), keys)
    shell = F.lit(4 / 3 * pi * dr**3) * (F.pow(F.col("bin") + 1.0, 3) - F.pow(F.col("bin") + 0.0, 3))
    g = F.col("n") / (F.col("n_atoms") * (F.col("n_atoms") - 1) / F.col("volume") * shell)
    sums = counts.join(sizes, ["config_id", "frame"]).withColumn("g", g).groupBy("config_id", "bin").agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.col("g")).alias("g2"))
    frames = sizes.groupBy("config_id").agg(F.count("*").alias("n_frames"))
    every = frames.select("config_id", "n_frames", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    mean, square = F.coalesce("g", F.lit(0.0)) / F.col("n_frames"), F.coalesce("g2", F.lit(0.0)) / F.col("n_frames")
    return every.join(sums, ["config_id", "bin"], "left").select("config_id", "bin", ((F.col("bin") + 0.5) * dr).alias("r"), mean.alias("g"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("deviation"), "n_frames")


def first_peak(curve: DataFrame, skip: float = 0.1) -> DataFrame:
    """(config_id, r, g) of the highest bin, without the first tenth of them."""
    n = F.max("bin").over(Window.partitionBy("config_id")) + 1
    rest = curve.withColumn("bins", n).filter(F.col("bin") >= F.floor(F.col("bins") * skip))
    best = rest.groupBy("config_id").agg(F.max(F.struct("g", (-F.col("bin")).alias("b"), "r")).alias("p"))
    return best.select("config_id", "p.r", "p.g")


def msd(traj: DataFrame) -> DataFrame:
    """(config_id, frame, msd) of displacements from the first frame, as they are."""
    start = {c: F.first(c).over(_by_frame()) for c in "xyz"}
    d2 = sum(((F.col(c) - s) * (F.col(c) - s) for c, s in start.items()), F.lit(0.0))
    return traj.select("config_id", "frame", d2.alias("d2")).groupBy("config_id", "frame").agg(F.avg("d2").alias("msd"))


def unwrapped(traj: DataFrame, cells: DataFrame) -> DataFrame:
    """traj with ux, uy, uz: displacements from the first frame, summed from frame to frame by minimum
    images."""
    placed = traj.join(G.with_geometry(cells).select("config_id", *(c for r in (*G.H, *G.INV) for c in r)), "config_id")
    steps = [F.coalesce(F.col(c) - F.lag(c).over(_by_frame()), F.lit(0.0)) for c in "xyz"]
    moved = placed.withColumns({f"s{c}": s for c, s in zip("xyz", steps)})
    image = dict(zip(("mx", "my", "mz"), G.minimum_image(F.col("sx"), F.col("sy"), F.col("sz"))))
    so_far = _by_frame().rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumns(image).withColumns({f"u{c}": F.sum(f"m{c}").over(so_far) for c in "xyz"}).select(*traj.columns, "ux", "uy", "uz")


def msd_unwrapped(traj: DataFrame, cells: DataFrame) -> DataFrame:
    d2 = sum((F.col(f"u{c}") * F.col(f"u{c}") for c in "xyz"), F.lit(0.0))
    return unwrapped(traj, cells).groupBy("config_id", "frame").agg(F.avg(d2).alias("msd"))


def slope_of_tail(series: DataFrame, x: str, y: str, skip: Column) -> DataFrame:
    """(config_id, slope, intercept) of y by x over the points after the first skip(n) ones."""
    w = Window.partitionBy("config_id")
    numbered = series.withColumns({"nth": F.row_number().over(w.orderBy(x)), "n": F.count("*").over(w)})
    return numbered.filter(F.col("nth") > skip).groupBy("config_id").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def diffusion(msd_by_time: DataFrame) -> DataFrame:
    """(config_id, slope, diffusion) from (config_id, t in ps, msd in A^2), over the last two thirds; the
    coefficient is slope / 6 in m^2/s."""
    fit = slope_of_tail(msd_by_time, "t", "msd", F.floor(F.col("n") / 3))
    return fit.select("config_id", "slope", (F.col("slope") / 6 * 1e-8).alias("diffusion"))


def arrhenius(points: DataFrame, k_boltzmann: float = 8.617333e-5) -> DataFrame:
    """One row (activation energy in eV, prefactor) of ln D by 1 / T from (temperature, diffusion)."""
    x, y = 1 / F.col("temperature"), F.log("diffusion")
    return points.agg((-F.regr_slope(y, x) * k_boltzmann).alias("activation"), F.exp(F.regr_intercept(y, x)).alias("prefactor"))


#: Frames of a block of the transform, at least.
BLOCK = 1024
#: Numbers that a worker transforms at once.
AT_ONCE = 1 << 21


def _correlated(offsets: np.ndarray, values: np.ndarray, row: np.ndarray, rows: int, block: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of products, numbers of them) for each of `rows` blocks and lag, by zero-padded transforms: values
    [:, column] stand at offsets of their row; those from `block` on only end products."""
    n = 1 << int(offsets.max() + lags).bit_length()
    dense = np.zeros((rows, values.shape[1] + 1, n))
    np.add.at(dense, (row, slice(None), offsets), np.column_stack([values, np.ones(len(row))]))
    ends = np.fft.rfft(dense)
    dense[:, :, block:] = 0
    products = np.fft.irfft(np.conj(np.fft.rfft(dense)) * ends, n)[:, :, :lags]
    return products[:, :-1].sum(1), np.rint(products[:, -1]).astype(np.int64)


def autocorrelation(series: DataFrame, columns: list[str], lags: int, keys: list[str], unbiased: bool = True) -> DataFrame:
    """As autocorrelation_by_join(), by Fourier transforms (Wiener and Khinchin): frames of a key are cut into
    blocks, each with the first lags - 1 frames of the next, so that a row is shuffled twice at most, whatever
    the number of lags, and no group is longer than a block. A task adds up its blocks' sums by configuration.
    Rows with a null in one of the columns are left out; frames that occur twice count twice."""
    block = max(BLOCK, 1 << (lags - 1).bit_length())
    frame = F.col("frame").cast("long")
    own = F.floor(frame / block)
    into = F.when(F.pmod(frame, F.lit(block)) < lags - 1, F.array(own, own - 1)).otherwise(F.array(own))
    rows = series.dropna(subset=[*keys, "frame", *columns]).withColumn("block_", F.explode(into))
    each = F.struct((frame - F.col("block_") * block).cast("int").alias("at"), *(F.col(c).cast("double").alias(c) for c in columns))
    grouped = rows.groupBy(*dict.fromkeys(["config_id", *keys, "block_"])).agg(F.collect_list(each).alias("rows_")).select("config_id", "rows_")
    config = series.schema["config_id"]

    def sums(batches):
        total: dict = {}
        schema = None
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            kind = names.type
            schema = schema or pa.schema([("config_id", kind), ("lag", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])
            names = names.to_pylist()
            at = 0
            while at < len(names):  # as many blocks as fit
                some = 1
                width = 2 * block * (len(columns) + 1)
                while at + some < len(names) and (some + 1) * width <= AT_ONCE * 8:
                    some += 1
                part = lists.slice(at, some)
                flat = part.flatten()
                row = np.repeat(np.arange(some), np.asarray(pa.compute.list_value_length(part)))
                values = np.column_stack([np.asarray(flat.field(c + 1)) for c in range(len(columns))])
                products, n = _correlated(np.asarray(flat.field(0)), values, row, some, block, lags)
                for k, name in enumerate(names[at : at + some]):
                    if name in total:
                        total[name][0] += products[k]
                        total[name][1] += n[k]
                    else:
                        total[name] = [products[k].copy(), n[k].copy()]
                at += some
                if len(total) * lags > AT_ONCE:
                    yield from out(total, schema)
                    total = {}
        if total:
            yield from out(total, schema)

    def out(total, schema):
        for name, (products, n) in total.items():
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(has), schema.types[0]), pa.array(has, pa.int32()), pa.array(products[has]), pa.array(n[has])], schema=schema)

    both = grouped.mapInArrow(sums, StructType([config, StructField("lag", IntegerType()), StructField("total", DoubleType()), StructField("n", LongType())]))
    return _divided(series, both.groupBy("config_id", "lag").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), unbiased)


def autocorrelation_by_join(series: DataFrame, columns: list[str], lags: int, keys: list[str], unbiased: bool = True) -> DataFrame:
    """(config_id, lag, c): products of a row's columns with those `lag` frames on, over all origins and
    all `keys`; divided by the number of products, or by that of frames if not unbiased. Rows times lags are
    shuffled; for a few lags."""
    later = series.select(*keys, F.col("frame").alias("later"), *(F.col(c).alias(f"{c}_later") for c in columns))
    spread = series.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1)))).withColumn("later", F.col("frame") + F.col("lag"))
    dot = sum((F.col(c) * F.col(f"{c}_later") for c in columns), F.lit(0.0))
    both = spread.join(later, [*keys, "later"]).groupBy("config_id", "lag").agg(F.sum(dot).alias("total"), F.count("*").alias("n"))
    return _divided(series, both, unbiased)


def _divided(series: DataFrame, both: DataFrame, unbiased: bool) -> DataFrame:
    if unbiased:
        return both.select("config_id", "lag", (F.col("total") / F.col("n")).alias("c"))
    frames = series.groupBy("config_id").agg(F.count("*").alias("frames"))
    return both.join(frames, "config_id").select("config_id", "lag", (F.col("total") / F.col("frames")).alias("c"))


def vacf(traj: DataFrame, lags: int) -> DataFrame:
    """(config_id, lag, c, normalised) of the velocities."""
    c = autocorrelation(traj, ["vx", "vy", "vz"], lags, _ATOM)
    start = F.first("c").over(Window.partitionBy("config_id").orderBy("lag"))
    return c.withColumn("normalised", F.col("c") / start)


def vdos(correlation: DataFrame, lags: int, dt_ps: float, frequencies: int, step_thz: float) -> DataFrame:
    """(config_id, k, frequency, intensity): squared modulus of the Hann-windowed normalised correlation's
    Fourier transform at k * step_thz, scaled to unit area."""
    hann = F.lit(0.5) * (1 - F.cos(F.lit(2 * pi) * F.col("lag") / (lags - 1)))
    rows = correlation.select("config_id", (F.col("normalised") * hann).alias("v"), "lag", F.explode(F.sequence(F.lit(0), F.lit(frequencies - 1))).alias("k"))
    phase = F.lit(2 * pi * step_thz * dt_ps) * F.col("k") * F.col("lag")
    sums = rows.groupBy("config_id", "k").agg(F.sum(F.col("v") * F.cos(phase)).alias("re"), F.sum(F.col("v") * F.sin(phase)).alias("im"))
    power = sums.select("config_id", "k", (F.col("k") * step_thz).alias("frequency"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
    area = F.sum("power").over(Window.partitionBy("config_id")) * step_thz
    return power.withColumn("intensity", F.col("power") / area).drop("power")


def debye_cutoff(spectrum: DataFrame, share: float = 0.99, k_boltzmann: float = 8.617333e-5, h_ev_ps: float = 4.135667696e-3) -> DataFrame:
    """(config_id, frequency, theta): the first frequency up to which `share` of the spectrum lies, and its
    temperature."""
    w = Window.partitionBy("config_id").orderBy("k")
    so_far = F.sum("intensity").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("intensity").over(Window.partitionBy("config_id"))
    found = spectrum.withColumn("so_far", so_far).filter(F.col("so_far") >= share).groupBy("config_id").agg(F.min("frequency").alias("frequency"))
    return found.withColumn("theta", F.col("frequency") * h_ev_ps / k_boltzmann)


def running_integral(series: DataFrame, x: str, y: str) -> DataFrame:
    """series with `integral`, the trapezoid sum so far."""
    w = Window.partitionBy("config_id").orderBy(x)
    step = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return series.withColumn("area", F.coalesce(step, F.lit(0.0))).withColumn("integral", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("area")


def gradient(series: DataFrame, x: str, y: str) -> DataFrame:
    """series with `slope`: second-order differences on uneven points, one-sided at the ends."""
    w = Window.partitionBy("config_id").orderBy(x)
    back, ahead = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    down, up = (F.col(y) - F.lag(y).over(w)) / back, (F.lead(y).over(w) - F.col(y)) / ahead
    return series.withColumn("slope", F.coalesce((down * ahead + up * back) / (back + ahead), up, down))


def green_kubo(flux: DataFrame, lags: int, dt_ps: float, volume: float, temperature: float, k_boltzmann: float = 8.617333e-5) -> DataFrame:
    """(config_id, lag, t, c, kappa) from heat fluxes (config_id, frame, jx, jy, jz): correlation over the
    number of frames, mean of the components, running integral times V / (k T^2)."""
    c = autocorrelation(flux, ["jx", "jy", "jz"], lags, ["config_id"], unbiased=False)
    c = c.select("config_id", "lag", (F.col("lag") * dt_ps).alias("t"), (F.col("c") / 3).alias("c"))
    factor = volume / (k_boltzmann * temperature**2)
    return running_integral(c, "t", "c").withColumn("kappa", F.col("integral") * factor).drop("integral")


def debye_waller(traj: DataFrame) -> DataFrame:
    """(config_id, u2, b): mean squared deviation of x from each atom's mean place, and B = 8 pi^2 u2."""
    mean = F.avg("x").over(Window.partitionBy(*_ATOM))
    u = F.col("x") - mean
    return traj.select("config_id", (u * u).alias("u2")).groupBy("config_id").agg(F.avg("u2").alias("u2")).withColumn("b", F.col("u2") * (8 * pi**2))


def interpolated(points: DataFrame, at: DataFrame, x: str, y: str) -> DataFrame:
    """(config_id, x, y) for each x of `at` and each configuration of points(config_id, x, y): between the points
    before and after on a straight line, beyond the ends the end's value. An as-of join: points and questions
    in one order by x, each question takes the last point before and the first after."""
    asked = points.select("config_id").distinct().crossJoin(at.select(x).distinct()).select("config_id", x, F.lit(None).cast("double").alias("y_"), F.lit(True).alias("asked_"))
    mixed = points.select("config_id", x, F.col(y).alias("y_"), F.lit(False).alias("asked_")).unionByName(asked)
    known = F.when(F.col("y_").isNotNull(), F.struct(F.col(x).alias("x"), F.col("y_").alias("y")))
    w = Window.partitionBy("config_id").orderBy(x, "asked_")  # a point at the same place comes first
    mixed = mixed.withColumns({"a": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.col("a"), F.col("b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])
    return mixed.filter("asked_").select("config_id", x, F.when(b.isNull() | (a["x"] == F.col(x)), a["y"]).when(a.isNull(), b["y"]).otherwise(line).alias(y))


def path_profile(images: DataFrame, energies: DataFrame, cells: DataFrame) -> DataFrame:
    """(config_id, n_images, length, saddle, barrier, backward, image) of paths through images(config_id, image,
    atom_id, x, y, z) with energies(config_id, image, energy): arc length from minimum images of the atoms'
    steps, cubics with the slopes of the neighbouring images between, and their highest point."""
    step = Window.partitionBy(*_ATOM).orderBy("image")
    placed = images.join(G.with_geometry(cells), "config_id").withColumns({f"s{c}": F.col(c) - F.lag(c).over(step) for c in "xyz"})
    d = G.minimum_image(*(F.col(f"s{c}") for c in "xyz"), F.col("pbc"))
    steps = placed.groupBy("config_id", "image").agg(F.sqrt(F.sum(F.coalesce(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], F.lit(0.0)))).alias("step"))
    w = Window.partitionBy("config_id").orderBy("image")  # images of one path
    curve = steps.join(energies, ["config_id", "image"]).withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    curve = gradient(curve, "s", "energy").withColumns({"next": F.lead("energy").over(w), "next_slope": F.lead("slope").over(w), "h": F.lead("s").over(w) - F.col("s")})
    # E(u) = a + b u + c u^2 + d u^3 on u in [0, 1]
    rise, b, b1 = F.col("next") - F.col("energy"), F.col("slope") * F.col("h"), F.col("next_slope") * F.col("h")
    parts = curve.withColumns({"b": b, "c": 3 * rise - 2 * b - b1, "d": b + b1 - 2 * rise})
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("c") * F.col("c") - 3 * F.col("d") * F.col("b")))
    tops = [F.when(F.col("d") != 0, (-F.col("c") + sign * root) / (3 * F.col("d"))) for sign in (1, -1)] + [F.when((F.col("d") == 0) & (F.col("c") != 0), -F.col("b") / (2 * F.col("c")))]
    at = F.array(F.lit(0.0), *(F.when((t > 0) & (t < 1), t) for t in tops))
    highest = F.array_max(F.transform(F.filter(at, lambda u: u.isNotNull()), lambda u: F.struct((F.col("energy") + F.when(u == 0, 0.0).otherwise(u * (F.col("b") + u * (F.col("c") + u * F.col("d"))))).alias("e"), (F.col("s") + F.when(u == 0, 0.0).otherwise(u * F.col("h"))).alias("s"))))
    best = parts.withColumn("top", F.when(F.col("h") > 0, highest).otherwise(F.struct(F.col("energy").alias("e"), F.col("s").alias("s"))))
    out = best.groupBy("config_id").agg(F.count("*").alias("n_images"), F.max("s").alias("length"), F.max("top").alias("top"), F.min_by("energy", "image").alias("first"), F.max_by("energy", "image").alias("last"), F.max(F.struct("energy", (-F.col("image")).alias("k"))).alias("high"))
    return out.select("config_id", "n_images", "length", F.col("top.s").alias("saddle"), (F.col("top.e") - F.col("first")).alias("barrier"), (F.col("top.e") - F.col("last")).alias("backward"), (-F.col("high.k")).cast("int").alias("image"))


def phases(atoms: DataFrame, cells: DataFrame, cutoff: float, partners: int = 12) -> DataFrame:
    """(config_id, atom_id, z, n, solid): atoms with as many neighbours within the cutoff as the crystal has."""
    near = neighbors.cell_list_pairs(atoms, cells, cutoff).groupBy("config_id", F.col("i").alias("atom_id")).agg(F.count("*").alias("n"))
    joined = atoms.select("config_id", "atom_id", "z").join(near, ["config_id", "atom_id"], "left").fillna(0, ["n"])
    return joined.withColumn("solid", F.col("n") == partners)


def two_phase(states: DataFrame, layer: float) -> DataFrame:
    """(config_id, n_layers, share, solid_layers, longest): layers along z of phases(), a layer being solid if
    half of its atoms are; the share of solid atoms, the solid layers and the longest run of them."""
    layers = states.groupBy("config_id", F.floor(F.col("z") / layer).alias("layer")).agg(F.count("*").alias("n"), F.count_if("solid").alias("n_solid"))
    layers = layers.withColumn("is_solid", F.col("n_solid") * 2 >= F.col("n"))
    w = Window.partitionBy("config_id", "is_solid").orderBy("layer")  # layers, not atoms
    runs = layers.withColumn("run", F.col("layer") - F.row_number().over(w)).groupBy("config_id", "is_solid", "run").agg(F.count("*").alias("length"), F.sum("n").alias("n"), F.sum("n_solid").alias("n_solid"))
    longest = F.max(F.when(F.col("is_solid"), F.col("length")).otherwise(0))
    return runs.groupBy("config_id").agg(F.sum("length").alias("n_layers"), (F.sum("n_solid") / F.sum("n")).alias("share"), F.sum(F.when(F.col("is_solid"), F.col("length")).otherwise(0)).alias("solid_layers"), longest.alias("longest"))


def second_half(series: DataFrame, order: str, value: str) -> DataFrame:
    """(config_id, n, mean, deviation) of a series' second half, by `order`; of an odd number the larger half."""
    n = series.groupBy("config_id").agg(F.floor(F.count("*") / 2).alias("skipped"))
    numbered = sum_before(series, "config_id", order, F.lit(1), "before").join(n, "config_id").filter(F.col("before") >= F.col("skipped"))
    return numbered.groupBy("config_id").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def last_frames(traj: DataFrame, n: int) -> DataFrame:
    """The last n frames of each configuration; ranks are taken over frames, not over atoms."""
    frames = traj.select("config_id", "frame").distinct()
    nth = F.row_number().over(Window.partitionBy("config_id").orderBy(F.desc("frame")))
    return traj.join(frames.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth"), ["config_id", "frame"], "left_semi")


def trimmed(series: DataFrame, order: str) -> DataFrame:
    """A series without its first fifth (at least one point), by `order`, whole numbers."""
    n = series.groupBy("config_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 5)).alias("skipped"))
    numbered = sum_before(series, "config_id", order, F.lit(1), "before").join(n, "config_id")
    return numbered.filter(F.col("before") >= F.col("skipped")).drop("before", "skipped")
