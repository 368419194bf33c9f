"""Pairs of atoms within a cutoff.

The cell-list join bins atoms in a grid of at least the cutoff's width, deals each atom to the up to
27 cells around its own and joins on (config_id, cell): an equi-join that Spark shuffles or broadcasts
by size, in place of the nested loop that a distance condition alone would be. Only ids, types and
coordinates are multiplied. On axes of fewer than three cells, the cells around are distinct ones, so
no pair is found twice. Displacements are minimum images; the cutoff is strict, and so is the lower
bound, which leaves out an atom and its image at the same place. A join tests the squared distance by the cell's
metric with some slack, which is arithmetic alone; only what passes gets its displacement and the exact test."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .ranks import sum_before
from .stored import stored

LOWEST_R2 = 1e-4
#: Atoms in a configuration up to which all pairs are compared when no strategy is asked for.
ALL_PAIRS_UP_TO = 700
#: Most cells of a block on an axis.
BLOCK = 3
#: Atoms of a tile where all pairs of a large configuration are compared.
TILE = 8192
_CELL = ["cx", "cy", "cz"]


#: Products of a cell's lattice vectors: |d|^2 of a fractional displacement.
_METRIC = {f"g{i}{j}": (i, j) for i in range(3) for j in range(i, 3)}
#: Slack of the test before the exact one, far above the rounding of either.
_SLACK = 1 + 1e-6


def _positions(atoms: DataFrame, cells: DataFrame, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """atoms with their cell's geometry, and q0, q1, q2: fractional coordinates, in clusters Cartesian ones under a unit
    matrix and without images (wrap 0). Coordinates that can't be had are NaN, which is near to nothing."""
    keys = ["config_id", *(b for b in by if b in cells.columns)]
    unit = {c: F.when(F.col("pbc"), F.col(c)).otherwise(F.lit(float(i == j))) for i, r in enumerate(G.H) for j, c in enumerate(r)}
    known = lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))
    geometry = G.with_geometry(cells).withColumns({**unit, "wrap": F.when(F.col("pbc"), 1.0).otherwise(0.0)})
    geometry = geometry.withColumns({c: known(F.col(c)) for r in G.H for c in r})
    geometry = geometry.withColumns({f"d{k}": known(F.when(F.col("pbc"), F.col(f"height{k}")).otherwise(F.lit(1.0))) for k in range(3)})
    h = G.vectors()
    geometry = geometry.withColumns({g: sum((p * q for p, q in zip(h[i], h[j])), F.lit(0.0)) for g, (i, j) in _METRIC.items()})
    geometry = geometry.select(*keys, "pbc", "wrap", "d0", "d1", "d2", *_METRIC, *(c for r in (*G.H, *G.INV) for c in r), *(f"height{k}" for k in range(3)))
    placed = atoms.select("config_id", *by, "atom_id", "type", "x", "y", "z", *carry).join(geometry, keys)
    placed = placed.withColumns({f"s{k}": s for k, s in enumerate(G.fractional("x", "y", "z"))})
    return placed.withColumns({f"q{k}": known(F.when(F.col("pbc"), F.col(f"s{k}")).otherwise(F.col(c))) for k, c in enumerate("xyz")})


def kinds_of(cells: DataFrame) -> frozenset:
    """Whether there are periodic cells and clusters: two values at most, by one job."""
    return frozenset(r[0] for r in cells.select("pbc").distinct().collect())


def assign_cells(atoms: DataFrame, cells: DataFrame, width: float, carry: tuple[str, ...] = (), by: tuple[str, ...] = (), kinds: frozenset | None = None) -> DataFrame:
    """atoms with geometry, grid size nx, ny, nz and cell cx, cy, cz. Clusters get the grid of their
    bounding box with half a width around it, clamped at its ends. Further keys `by`, a frame for one, part
    the atoms of a configuration. kinds_of() the cells, if known, saves its job."""
    placed, parts = _positions(atoms, cells, carry, by), []
    kinds = kinds_of(cells) if kinds is None else kinds
    if True in kinds or not kinds:
        sizes = {f"n{a}": G.grid_size(F.col(f"height{k}"), width) for k, a in enumerate("xyz")}
        periodic = placed.filter("pbc").withColumns({**sizes, **{f"s{a}": G.wrapped(F.col(f"s{k}")) for k, a in enumerate("xyz")}})
        parts.append(periodic.withColumns({f"c{a}": G.grid_index(F.col(f"s{a}"), F.col(f"n{a}")) for a in "xyz"}).drop("sx", "sy", "sz"))
    if False in kinds:
        open_ = placed.filter("not pbc")
        box = open_.groupBy("config_id", *by).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("low", F.min), ("high", F.max))))
        size = {f"n{a}": F.greatest(F.lit(1), F.floor((F.col(f"high_{a}") - F.col(f"low_{a}") + width) / width)).cast("int") for a in "xyz"}
        boxed = open_.join(box, ["config_id", *by]).withColumns(size)
        at = {f"c{a}": F.greatest(F.lit(0), F.least(F.col(f"n{a}") - 1, F.floor((F.col(a) - F.col(f"low_{a}") + width / 2) / width).cast("int"))) for a in "xyz"}
        parts.append(boxed.withColumns(at).drop(*(f"{n}_{a}" for a in "xyz" for n in ("low", "high"))))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _around(cell: str, n: str):
    """The cells next to one on an axis and itself; beyond the end those of the other end, for clusters none."""
    moved = [F.col(cell) + o for o in (-1, 0, 1)]
    inside = F.filter(F.array(*moved), lambda c: (c >= 0) & (c < F.col(n)))
    return F.when(F.col("pbc"), F.array_distinct(F.array(*(F.pmod(m, F.col(n)) for m in moved)))).otherwise(inside)


def stencil(binned: DataFrame) -> DataFrame:
    """One row for each atom and cell around it."""
    for a in "xyz":
        binned = binned.withColumn(f"c{a}", F.explode(_around(f"c{a}", f"n{a}")))
    return binned


def _image() -> list[Column]:
    """The displacement to the partner in q, its shortest image where there are images."""
    off = [F.col(f"jq{k}") - F.col(f"q{k}") for k in range(3)]
    return [o - F.col("wrap") * F.rint(o) for o in off]


def _close(both: DataFrame, reach: float) -> DataFrame:
    """both without the pairs beyond the reach, but for the slack: first by the distance between a pair's planes along each
    axis, then by the distance itself."""
    m, g = _image(), {k: F.col(k) for k in _METRIC}
    for k in range(3):
        both = both.filter(F.abs(m[k]) * F.col(f"d{k}") < reach * _SLACK)
    r2 = m[0] * (g["g00"] * m[0] + F.lit(2.0) * (g["g01"] * m[1] + g["g02"] * m[2])) + m[1] * (g["g11"] * m[1] + F.lit(2.0) * g["g12"] * m[2]) + g["g22"] * m[2] * m[2]
    return both.filter(r2 < reach * reach * _SLACK)


def _displaced(both: DataFrame, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """both with dx, dy, dz, r2. The generator keeps the optimizer from writing the displacement out
    again for each use of it in the join's condition."""
    d = F.struct(*(v.alias(f"d{a}") for v, a in zip(G.cartesian(_image()), "xyz")))
    found = both.select("config_id", *by, "atom_id", "j_id", "type", "j_type", *carry, *(f"j_{c}" for c in carry), F.inline(F.array(d)))
    return found.withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))


def _within(both: DataFrame, cutoff: float, lowest: float | None, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    found = _displaced(_close(both, cutoff), carry, by)
    found = found.filter(F.col("r2") < cutoff * cutoff)
    if lowest is not None:
        found = found.filter((F.col("r2") > lowest) | (F.col("atom_id") == F.col("j_id")))
    return found.select("config_id", *by, F.col("atom_id").alias("i"), F.col("j_id").alias("j"), F.col("type").alias("ti"), F.col("j_type").alias("tj"), "dx", "dy", "dz", "r2", *(F.col(c).alias(f"{c}_i") for c in carry), *(F.col(f"j_{c}").alias(f"{c}_j") for c in carry))


def _partners(atoms: DataFrame, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return atoms.select("config_id", *keys, F.col("atom_id").alias("j_id"), F.col("type").alias("j_type"), *(F.col(f"q{k}").alias(f"jq{k}") for k in range(3)), *(F.col(c).alias(f"j_{c}") for c in carry))


def cell_list_pairs(atoms: DataFrame, cells: DataFrame, cutoff: float, skin: float = 0.0, lowest: float | None = LOWEST_R2, half: bool = False, carry: tuple[str, ...] = (), width: float | None = None, by: tuple[str, ...] = (), kinds: frozenset | None = None) -> DataFrame:
    """Ordered pairs (config_id, *by, i, j, ti, tj, dx, dy, dz, r2) with r < cutoff + skin; i < j only if half.
    Columns to carry come along from both atoms, as c_i and c_j. `width`: least size of a grid cell, if it
    is to be more than the reach. `by`: keys besides config_id that both atoms of a pair share."""
    reach = cutoff + skin
    binned = assign_cells(atoms, cells, max(reach, width or 0.0), carry, by, kinds)
    both = binned.join(_partners(stencil(binned), *by, *_CELL, carry=carry), ["config_id", *by, *_CELL])
    both = both.filter(F.col("atom_id") < F.col("j_id") if half else F.col("atom_id") != F.col("j_id"))
    return _within(both, reach, lowest, carry, by)


def _block(cell: Column, n: Column) -> Column:
    """Number, on an axis of n cells, of the block of at most BLOCK cells that has the cell; blocks are about equal."""
    return F.floor(cell * F.ceil(n / BLOCK) / n)


def _blocks_around(cell: str, n: str) -> Column:
    return F.array_distinct(F.transform(_around(cell, n), lambda c: _block(c, F.col(n))))


def blocked_pairs(atoms: DataFrame, cells: DataFrame, cutoff: float, skin: float = 0.0, lowest: float | None = LOWEST_R2, kinds: frozenset | None = None, lists: DataFrame | None = None) -> DataFrame:
    """cell_list_pairs() for many atoms of an even density, with the atom's block as block_. Atoms are dealt to the blocks of
    cells where they may have partners, a few in place of 27 cells, and compared with all that are there. All partners of
    an atom are in its block, so what is summed by config_id, block_ and i isn't moved again. `lists` (config_id, i, list)
    keep the pairs that they have: a list goes with its atom."""
    binned = assign_cells(atoms, cells, cutoff + skin, kinds=kinds)
    count = {a: F.ceil(F.col(f"n{a}") / BLOCK) for a in "xyz"}
    number = lambda x, y, z: ((x * count["y"] + y) * count["z"] + z).alias("block_")
    home, extra = binned.select("*", number(*(_block(F.col(f"c{a}"), F.col(f"n{a}")) for a in "xyz"))), ["block_"]
    if lists is not None:
        home, extra = home.join(lists.select("config_id", F.col("i").alias("atom_id"), "list"), ["config_id", "atom_id"]), ["block_", "list"]
    far = binned
    for a in "xyz":
        far = far.withColumn(f"b{a}", F.explode(_blocks_around(f"c{a}", f"n{a}")))
    far = _partners(far.select("*", number(*(F.col(f"b{a}") for a in "xyz"))), "block_")
    both = home.join(far.hint("merge"), ["config_id", "block_"]).filter(F.col("atom_id") != F.col("j_id"))
    found = _within(both, cutoff + skin, lowest, by=tuple(extra))
    return found if lists is None else found.filter(F.array_contains("list", F.col("j"))).drop("list")


def lists_alone(atoms: DataFrame, cells: DataFrame, cutoff: float, skin: float) -> DataFrame:
    """(config_id, i, list): sorted neighbours within cutoff + skin, of atoms that have any; made in the atoms' blocks."""
    found = blocked_pairs(atoms, cells, cutoff, skin, lowest=None)
    return found.groupBy("config_id", "block_", "i").agg(F.sort_array(F.collect_list("j")).alias("list")).drop("block_")


def all_pairs(atoms: DataFrame, cells: DataFrame, cutoff: float, skin: float = 0.0, lowest: float | None = LOWEST_R2, half: bool = False, carry: tuple[str, ...] = (), kinds: frozenset | None = None, itself: bool = False) -> DataFrame:
    """The same pairs by comparing all atoms of a configuration; for small configurations. `itself` adds each atom with
    itself (i = j, r2 = 0), so that sums over i have a row for all atoms whose place is known."""
    placed = _positions(atoms, cells, carry)
    both = placed.join(_partners(placed, carry=carry), "config_id")
    order = F.col("atom_id") < F.col("j_id") if half else F.col("atom_id") != F.col("j_id")
    return _within(both if itself else both.filter(order), cutoff + skin, lowest, carry)


def tiled_pairs(atoms: DataFrame, cells: DataFrame, cutoff: float, lowest: float | None = LOWEST_R2, most: int = TILE) -> DataFrame:
    """all_pairs() of configurations of any size. Atoms are dealt to tiles of about `most`, and each two tiles of a configuration
    meet in a task of their own, which holds one of them and compares each pair once; a pair found is given in both
    directions. One small job counts the largest configuration. Comparisons grow with the square of its atoms, a task's
    memory doesn't."""
    largest = atoms.groupBy("config_id").count().agg(F.max("count")).first()[0] or 0
    n = max(1, ceil(largest / most))
    spark, tile = atoms.sparkSession, F.pmod(F.xxhash64("atom_id"), F.lit(n)).cast("int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * (n + 1) // 2)
    placed = _positions(atoms, cells).withColumn("own_", tile)
    dealt = lambda df, low, high: df.withColumn("other_", F.explode(F.sequence(low, high)))
    one = dealt(placed, F.col("own_"), F.lit(n - 1)).withColumn("tile_", F.col("own_") * n + F.col("other_")).repartition(parts, "config_id", "tile_")
    two = dealt(placed, F.lit(0), F.col("own_")).withColumn("tile_", F.col("other_") * n + F.col("own_"))
    two = _partners(two, "tile_").repartition(parts, "config_id", "tile_")
    both = one.join(two.hint("merge"), ["config_id", "tile_"])  # however small the atoms, their multiples aren't for a broadcast
    both = both.filter((F.col("own_") != F.col("other_")) | (F.col("atom_id") < F.col("j_id")))
    return _both_ways(_within(both, cutoff, lowest))


def _both_ways(half: DataFrame) -> DataFrame:
    """mirrored(), from one reading of the half pairs."""
    there = F.struct("i", "j", "ti", "tj", "dx", "dy", "dz")
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("tj").alias("ti"), F.col("ti").alias("tj"), *((-F.col(d)).alias(d) for d in ("dx", "dy", "dz")))
    return half.select("config_id", "r2", F.inline(F.array(there, back))).select("config_id", "i", "j", "ti", "tj", "dx", "dy", "dz", "r2")


def chosen(atoms: DataFrame) -> str:
    """The strategy for the size of the largest configuration; one small job."""
    largest = atoms.groupBy("config_id").count().agg(F.max("count")).first()[0] or 0
    return "all_pairs" if largest <= ALL_PAIRS_UP_TO else "cell_list"


def pairs(atoms: DataFrame, cells: DataFrame, cutoff: float, strategy: str = "auto", **options) -> DataFrame:
    """Pairs by strategy 'cell_list', 'all_pairs', or by the size of the largest configuration."""
    if strategy == "auto":
        strategy = chosen(atoms)
    return {"cell_list": cell_list_pairs, "all_pairs": all_pairs}[strategy](atoms, cells, cutoff, **options)


def mirrored(half: DataFrame) -> DataFrame:
    """Both directions of half pairs."""
    back = half.select("config_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("tj").alias("ti"), F.col("ti").alias("tj"), *((-F.col(d)).alias(d) for d in ("dx", "dy", "dz")), "r2")
    return half.unionByName(back)


def neighbor_lists(atoms: DataFrame, cells: DataFrame, cutoff: float, skin: float | None = None, find=None) -> DataFrame:
    """(config_id, i, start, n, list): sorted neighbours within cutoff + skin (1 % unless given), without
    a lower bound; start counts those of the atoms before. An atom's list is bounded by its density.
    `find` gives the pairs in place of blocks; all_pairs does for small configurations."""
    skin = 0.01 * cutoff if skin is None else skin
    if find is None:
        lists = lists_alone(atoms, cells, cutoff, skin)
    else:
        lists = find(atoms, cells, cutoff, skin, lowest=None).groupBy("config_id", "i").agg(F.sort_array(F.collect_list("j")).alias("list"))
    every = atoms.select("config_id", F.col("atom_id").alias("i")).join(lists, ["config_id", "i"], "left")
    every = every.select("config_id", "i", F.coalesce("list", F.array().cast("array<bigint>")).alias("list")).withColumn("n", F.size("list"))
    every = stored(every, "lists")  # used for the sums and for the result
    starts = sum_before(every.select("config_id", "i", "n"), "config_id", "i", F.col("n"), "start").drop("n")  # lists stay out of it
    return every.join(starts, ["config_id", "i"])


def pairs_of_lists(lists: DataFrame, atoms: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """Pairs within the cutoff from neighbour lists made with a skin, at the atoms' present positions. A list goes with its
    atom to the atom's block, where all that is within the cutoff is, and says which of it are its own; entries as rows
    would be moved to either atom. A list is a set: an entry twice is one pair."""
    return blocked_pairs(atoms, cells, cutoff, lists=lists).drop("block_")


def largest_moves(before: DataFrame, atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """(config_id, moved): the largest minimum-image displacement of a configuration's atoms; null if an atom
    is new or gone."""
    ids = ["config_id", "atom_id"]
    was = before.select(*ids, *(F.col(c).alias(f"was_{c}") for c in "xyz"))
    both = atoms.select(*ids, "x", "y", "z").join(was, ids, "full").join(G.with_geometry(cells), "config_id")
    d = G.minimum_image(*(F.col(c) - F.col(f"was_{c}") for c in "xyz"), F.col("pbc"))
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return both.groupBy("config_id").agg(F.when(F.count(far) == F.count("*"), F.max(far)).alias("moved"))


def current_lists(lists: DataFrame, before: DataFrame, atoms: DataFrame, cells: DataFrame, cutoff: float, skin: float) -> tuple[DataFrame, DataFrame]:
    """(lists good for the atoms as they are, (config_id, moved, stale)). Lists made with a skin from the atoms
    before hold all pairs while no atom has gone further than half of it; only configurations over that get
    new ones. One aggregate over atoms decides; a handful of bytes for each configuration is joined. New lists have
    the columns of those given: neighbor_lists() or lists_alone()."""
    state = stored(largest_moves(before, atoms, cells).withColumn("stale", F.coalesce(F.col("moved") * 2 > skin, F.lit(True))), "moves")
    stale = state.filter("stale").select("config_id")
    kept = lists.join(state.filter("not stale").select("config_id"), "config_id", "left_semi")
    make = neighbor_lists if "start" in lists.columns else lists_alone
    new = make(atoms.join(stale, "config_id", "left_semi"), cells.join(stale, "config_id", "left_semi"), cutoff, skin)
    return kept.unionByName(new), state


def occupancy(binned: DataFrame) -> DataFrame:
    """(config_id, code, n, start): atoms in each occupied cell by Morton code, and atoms before it."""
    counts = binned.groupBy("config_id", G.morton(F.col("cx"), F.col("cy"), F.col("cz")).alias("code")).agg(F.count("*").alias("n"))
    return sum_before(counts, "config_id", "code", F.col("n"), "start")


def visit_statistics(atoms: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """(config_id, visits, hits): ordered pairs that the stencil compares, and those within the cutoff."""
    binned = assign_cells(atoms, cells, cutoff)
    both = binned.join(_partners(stencil(binned), *_CELL), ["config_id", *_CELL]).filter("atom_id <> j_id")
    r2 = F.col("r2")
    return _displaced(both).groupBy("config_id").agg(F.count("*").alias("visits"), F.count_if((r2 < cutoff * cutoff) & (r2 > LOWEST_R2)).alias("hits"))


def nearest_sites(atoms: DataFrame, sites: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """(config_id, atom_id, site_id, d2): each atom's nearest site (config_id, site_id, x, y, z) closer than
    radius, the lower site of two at the same distance. Atoms and sites are joined by cells."""
    binned = assign_cells(atoms, cells, radius)
    placed = assign_cells(sites.select("config_id", F.col("site_id").alias("atom_id"), F.lit(0).alias("type"), "x", "y", "z"), cells, radius)
    near = _within(binned.join(_partners(stencil(placed), *_CELL), ["config_id", *_CELL]), radius, None)
    best = near.groupBy("config_id", F.col("i").alias("atom_id")).agg(F.min(F.struct("r2", F.col("j").alias("site_id"))).alias("b"))
    return best.select("config_id", "atom_id", "b.site_id", F.col("b.r2").alias("d2"))


def vacancies(atoms: DataFrame, sites: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """Sites that no atom has as its nearest."""
    return sites.join(nearest_sites(atoms, sites, cells, radius), ["config_id", "site_id"], "left_anti")
