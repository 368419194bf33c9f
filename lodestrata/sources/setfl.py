"""setfl (.eam.alloy) potentials: three comment lines, `n name...`, `Nrho drho Nr dr cutoff`, then for
each element a header of four values, F and f, then r * phi of each pair of elements.

Files are split into tokens with their positions in Spark; a token's position says which table and
which point it is. One row per file, so many potentials are read at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.potentials import TabulatedPotential, hermite_spline, linear_coefficients, natural_spline, pair_index


def number(token: Column) -> Column:
    """A number, also with Fortran's D as exponent mark."""
    return F.regexp_replace(token, "[dD]", "e").try_cast("double")


def tokens(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, tokens) of files (pot_id, value): headers as in the fourth and fifth line, tokens
    (pot_id, n_elem, nrho, drho, nr, dr, pos, token) of the rest by position."""
    lines = files.select("pot_id", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("line"))
    head = lines.select("pot_id", "line", F.split(F.trim(F.col("line")[3]), r"\s+").alias("names"), F.split(F.trim(F.col("line")[4]), r"\s+").alias("grid"))
    grid = [number(F.get("grid", F.lit(k))) for k in range(5)]
    head = head.select("pot_id", "line", F.get("names", F.lit(0)).try_cast("int").alias("n_elem"), F.slice("names", 2, 1000).alias("elements"), grid[0].cast("int").alias("nrho"), grid[1].alias("drho"), grid[2].cast("int").alias("nr"), grid[3].alias("dr"), grid[4].alias("cutoff"))
    rest = F.filter(F.split(F.concat_ws(" ", F.slice("line", 6, 100_000_000)), r"\s+"), lambda t: t != "")
    body = head.select("pot_id", "n_elem", "nrho", "drho", "nr", "dr", F.posexplode(rest).alias("pos", "token"))
    return head.drop("line"), body


def grids(body: DataFrame, pair_order: str = "upper") -> DataFrame:
    """(pot_id, kind, key, k, x, value) with kind embed, rho, rphi. pair_order: whether pairs come as
    AA AB AC BB BC CC ('upper') or AA BA BB CA CB CC ('lower'); key is the upper order's number."""
    per = F.lit(4) + F.col("nrho") + F.col("nr")
    own, n = F.floor(F.col("pos") / per).cast("int"), F.col("n_elem")
    at = F.col("pos") - own * per
    after = F.col("pos") - n * per
    nth, k_pair = F.floor(after / F.col("nr")).cast("int"), F.pmod(after, F.col("nr"))
    row = F.floor((F.sqrt(8 * nth + 1.0) - 1) / 2 + 1e-9).cast("int")
    key = nth if pair_order == "upper" else pair_index(row, nth - F.floor(row * (row + 1) / 2).cast("int"), n)
    element, embed, rho = F.col("pos") < n * per, at.between(4, F.col("nrho") + 3), at >= F.col("nrho") + 4
    kind = F.when(element & embed, "embed").when(element & rho, "rho").when(~element & (nth < n * (n + 1) / 2), "rphi")
    k = F.when(kind == "embed", at - 4).when(kind == "rho", at - 4 - F.col("nrho")).otherwise(k_pair).cast("int")
    x = k * F.when(kind == "embed", F.col("drho")).otherwise(F.col("dr"))
    return body.select("pot_id", kind.alias("kind"), F.when(element, own).otherwise(key).alias("key"), k.alias("k"), x.alias("x"), number(F.col("token")).alias("value")).filter("kind is not null")


def element_headers(body: DataFrame) -> DataFrame:
    """(pot_id, element, atomic_number, mass, lattice_constant, lattice) of the elements' header lines."""
    per = F.lit(4) + F.col("nrho") + F.col("nr")
    head = body.filter((F.col("pos") < F.col("n_elem") * per) & (F.col("pos") % per < 4)).select("pot_id", F.floor(F.col("pos") / per).cast("int").alias("element"), (F.col("pos") % per).alias("at"), "token")
    pick = lambda k: F.max(F.when(F.col("at") == k, F.col("token")))
    return head.groupBy("pot_id", "element").agg(number(pick(0)).cast("int").alias("atomic_number"), number(pick(1)).alias("mass"), number(pick(2)).alias("lattice_constant"), pick(3).alias("lattice"))


def phi_of_rphi(grid: DataFrame) -> DataFrame:
    """Rows of kind rphi as kind phi: v / r, and at r = 0 the value of the next point."""
    pairs = grid.filter("kind = 'rphi'")
    w = Window.partitionBy("pot_id", "key").orderBy("k")
    value = F.when(F.col("k") > 0, F.try_divide("value", "x")).otherwise(F.lead(F.try_divide("value", "x")).over(w))
    return pairs.withColumn("value", value).withColumn("kind", F.lit("phi")).unionByName(grid.filter("kind <> 'rphi'"))


def read_text(spark: SparkSession, text: str, pot_id: str = "text") -> DataFrame:
    return spark.createDataFrame([(pot_id, text)], "pot_id string, value string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(pot_id, value) of the files at path; pot_id is the file's path, so equal element names don't mix."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("pot_id"), "value")


def load(files: DataFrame, interpolation: str = "spline", pair_order: str = "upper") -> TabulatedPotential:
    """The potential of one file. interpolation: 'spline' (natural), 'hermite' (beyond the last density the
    embedding energy goes on straight) or 'linear'."""
    head, body = tokens(files)
    meta = [r.asDict() for r in head.collect()]
    if len(meta) != 1:
        raise ParseError(f"one potential at a time, not {len(meta)}")
    m = meta[0]
    if None in m.values() or m["n_elem"] != len(m["elements"]) or m["nr"] < 2 or m["nrho"] < 2:
        raise ParseError(f"lines 4 and 5 need the elements and five numbers with two points at least: {m}")
    grid = phi_of_rphi(grids(body, pair_order))
    want = m["n_elem"] * (m["nrho"] + m["nr"]) + m["n_elem"] * (m["n_elem"] + 1) // 2 * m["nr"]
    have, bad = grid.agg(F.count("*"), F.count_if(F.col("value").isNull())).first()
    if have != want or bad:
        raise ParseError(f"{want} numbers are needed after line 5; {have - bad} are there")
    fit = {"spline": natural_spline, "hermite": hermite_spline, "linear": linear_coefficients}[interpolation]
    return TabulatedPotential(m, fit(grid), extrapolate=interpolation == "hermite")


def format_files(grid: DataFrame, elements: list[str], nrho: int, drho: float, nr: int, dr: float, cutoff: float) -> DataFrame:
    """(pot_id, value): a file's text for each potential of grid (pot_id, kind, key, k, value) with kinds embed, rho and
    rphi, all on the given grids. A potential is a row here, as its file is; potentials are spread over tasks."""
    start = "\n".join(["made by lodestrata", "", "", " ".join([str(len(elements)), *elements]), f"{nrho} {drho!r} {nr} {dr!r} {cutoff!r}"])
    number_text = F.col("value").cast("string")
    line = F.when((F.col("kind") == "embed") & (F.col("k") == 0), F.concat(F.lit("29 63.546 3.615 fcc\n"), number_text)).otherwise(number_text)
    block = F.when(F.col("kind") == "rphi", 2 * len(elements) + F.col("key")).otherwise(2 * F.col("key") + (F.col("kind") == "rho").cast("int"))
    lines = F.sort_array(F.collect_list(F.struct(block.alias("block"), "k", line.alias("line"))))
    return grid.groupBy("pot_id").agg(F.concat_ws("\n", F.lit(start), F.transform(lines, lambda e: e["line"])).alias("value"))


def write_text(grid_rows: DataFrame, elements: list[str], nrho: int, drho: float, nr: int, dr: float, cutoff: float) -> str:
    """A file's text of a small potential's grids; for tests and export."""
    rows = sorted(map(tuple, grid_rows.select("kind", "key", "k", "value").collect()))
    of = lambda kind, key: [repr(v) for a, b, _, v in rows if (a, b) == (kind, key)]
    out = ["made by lodestrata", "", "", " ".join([str(len(elements)), *elements]), f"{nrho} {drho!r} {nr} {dr!r} {cutoff!r}"]
    for e in range(len(elements)):
        out += ["29 63.546 3.615 fcc", *of("embed", e), *of("rho", e)]
    for p in range(len(elements) * (len(elements) + 1) // 2):
        out += of("rphi", p)
    return "\n".join(out) + "\n"
