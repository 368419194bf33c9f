"""Work that grows with the tables: what is moved between tasks, what is compared, and that results stay whole."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestrata import catalog
from lodestrata.functions.potentials import AnalyticPotential
from lodestrata.operators import eam, neighbors, trajectory
from lodestrata.sources import generate

SF = "/root/testdata/sf0.001"
RC = 4.95


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _moved(df):
    """Names of the columns by which the plan's exchanges deal rows out."""
    return {k.split("#")[0] for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(df)) for k in keys.split(", ")}


@pytest.mark.parametrize("name", ["crystal_systems", "elastic_constants", "ideal_strength", "surface_energy"])
def test_ensembles_move_rows_of_the_table_alone(spark, name):
    """Crystals are dealt out before they have atoms; no stencil multiplies atoms, and no join or sum moves them."""
    found = catalog.QUERIES[name](spark, SF)
    assert not _moved(found) & {"atom_id", "i", "j", "cx"} and "explode(CASE WHEN pbc" not in _plan(found)


def test_totals_of_pairs_equal_those_of_forces(spark):
    """Two types, skewed cells, a cluster, and an atom without partners."""
    atoms = generate.rattled(generate.lattice(spark, "b2", 3.1, (4, 4, 4), "c"), 0.2)
    atoms, cells = generate.deform(atoms, generate.orthorhombic(spark, [("c", *[12.4] * 3)]), generate.deformations(spark, [(n, m) for n, m in generate.SYSTEMS.items() if n in ("cubic", "triclinic", "hexagonal")]))
    atoms = atoms.unionByName(spark.createDataFrame([("u", 0, 0, 0.0, 0.0, 0.0), ("u", 1, 1, 2.0, 0.5, 0.0), ("u", 2, 1, 90.0, 0.0, 0.0)], atoms.schema))
    cells = cells.unionByName(generate.matrices(spark, [("u", None)]))
    potential = AnalyticPotential(RC)
    plain = potential.at_pairs(neighbors.cell_list_pairs(atoms, cells, RC))
    want = {r.config_id: r for r in eam.totals(eam.forces_and_virials(eam.densities(atoms, plain, potential), plain), cells).collect()}
    found = potential.at_pairs(neighbors.all_pairs(atoms, cells, RC, itself=True))
    for virial in (True, False):
        got = {r.config_id: r for r in eam.totals_of_pairs(found, potential, cells, virial).collect()}
        assert set(got) == set(want) == {"c/cubic", "c/triclinic", "c/hexagonal", "u"}
        for c, r in got.items():
            assert r.n_atoms == want[c].n_atoms
            for n in ["energy"] + [f"{k}_{v}" for k in "ws" for v, *_ in eam.VOIGT if virial]:
                assert r[n] == pytest.approx(want[c][n], rel=1e-9, abs=1e-9), (c, n)


def test_pairs_near_the_cutoff_are_whole(spark):
    """The test before the exact one drops nothing: distances a rounding below, at and above the cutoff, in skewed and long cells."""
    d = 2.5
    at = [d * (1 - 1e-15), d * (1 - 1e-9), d, d * (1 + 1e-9), d * (1 + 1e-5)]
    skewed, long_ = (9.0, 0.9, 1.8, 1.35, 9.9, 2.25, 0.45, 2.7, 10.8), (1e5, 0, 0, 3e4, 9e4, 0, 0, 0, 8.0)
    rows = [(f"{n}{k}", 2 * k + e, 0, o + e * a, 0.3, 0.2) for k, a in enumerate(at) for n, o in (("skewed", 8.0), ("long", 99999.0), ("open", 0.0)) for e in (0, 1)]
    atoms = spark.createDataFrame(rows, "config_id string, atom_id long, type int, x double, y double, z double")
    cells = generate.matrices(spark, [(f"{n}{k}", m) for k in range(len(at)) for n, m in (("skewed", skewed), ("long", long_), ("open", None))])
    near = {c[:-1] for c in ("open0x", "open1x", "skewed1x", "long1x")}
    for find in (neighbors.all_pairs, neighbors.cell_list_pairs):
        got = {r.config_id for r in find(atoms, cells, d).collect()}
        assert near <= got and not {c for c in got if c[-1] in "4"} and "open2" not in got
    half = neighbors.all_pairs(atoms, cells, d, half=True)
    assert half.count() * 2 == neighbors.all_pairs(atoms, cells, d).count()
    assert half.filter(F.col("i") >= F.col("j")).count() == 0


def test_tiles_compare_all_pairs(spark):
    """Configurations of one tile and of many, periodic and not: the pairs of the plain form, each in both directions once."""
    big = generate.rattled(generate.lattice(spark, "b2", 3.1, (5, 5, 5), "big"), 0.3)
    small = big.filter("atom_id < 9").withColumn("config_id", F.lit("small"))
    open_ = big.filter("atom_id < 120").withColumn("config_id", F.lit("open"))
    atoms = big.unionByName(small).unionByName(open_)
    cells = generate.matrices(spark, [(c, m) for c, m in (("big", (15.5, 0, 0, 2, 15.5, 0, 0, 1, 15.5)), ("small", (15.5, 0, 0, 0, 15.5, 0, 0, 0, 15.5)), ("open", None))])
    columns = ["config_id", "i", "j", "ti", "tj", "dx", "dy", "dz", "r2"]
    want = sorted(map(tuple, neighbors.all_pairs(atoms, cells, RC).select(*columns).collect()))
    for most in (40, 100_000):
        assert sorted(map(tuple, neighbors.tiled_pairs(atoms, cells, RC, most=most).select(*columns).collect())) == want
    assert len(want) > 3000 and neighbors.tiled_pairs(atoms.limit(0), cells, RC).count() == 0


@pytest.mark.parametrize("name", ["pairs_allpairs", "pairs_triclinic", "pairs_cluster"])
def test_all_pairs_of_a_large_configuration_are_many_tasks(spark, name):
    """The key of the query's join has the tile, so no task compares a whole configuration, and no stencil multiplies a dense one."""
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert "tile_" in "".join(re.findall(r"SortMergeJoin \[.*?\], \[.*?\]", plan)) and "explode(CASE WHEN pbc" not in plan


def test_rdf_counts_places_for_all_that_hold_them(spark):
    """Three hundred atoms at three places: pairs of places stand for all pairs of atoms, those at one place for none."""
    xs = (1.0, 4.0, 8.5)
    rows = [("c", f, k, xs[k % 3 if k % 7 else 0], 2.0, 3.0) for f in (0, 1) for k in range(300)]
    traj = spark.createDataFrame(rows, "config_id string, frame int, atom_id long, x double, y double, z double")
    got = {r.bin: r.g for r in trajectory.rdf_over_frames(traj, generate.orthorhombic(spark, [("c", 40.0, 40.0, 40.0)]), 7.0, 20).collect()}
    held = [sum(r[3] == x for r in rows if r[1] == 0) for x in xs]
    shell = lambda k: 300 * 299 / 64000 * 4 / 3 * math.pi * 0.35**3 * ((k + 1) ** 3 - k**3)
    want = {8: 2 * held[0] * held[1] / shell(8), 12: 2 * held[1] * held[2] / shell(12)}
    assert set(got) == set(range(20)) and {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, v in got.items() if v}


def test_frames_are_joined_by_places(spark):
    plan = _plan(catalog.QUERIES["rdf_frames"](spark, SF))
    assert "sum((held_i" in plan and "Generate explode(CASE WHEN pbc" in plan


@pytest.mark.parametrize("block", [1, 2, 8])
def test_blocks_give_the_pairs_of_cells(spark, monkeypatch, block):
    """Grids of one to nine cells on an axis, a skewed cell, a cluster; all pairs, and those of lists that have some of them."""
    monkeypatch.setattr(neighbors, "BLOCK", block)
    sites = generate.rattled(generate.lattice(spark, "b2", 2.0, (9, 5, 3), "long"), 0.4)
    atoms = sites.unionByName(sites.withColumn("config_id", F.lit("skewed"))).unionByName(sites.filter("atom_id % 3 = 0").withColumn("config_id", F.lit("open")))
    cells = generate.matrices(spark, [("long", (18.0, 0, 0, 0, 10.0, 0, 0, 0, 6.0)), ("skewed", (18.0, 3, 0, 1, 10.0, 0.5, 0, 1, 6.0)), ("open", None)])
    want = set(map(tuple, neighbors.cell_list_pairs(atoms, cells, 2.0, 0.2).collect()))
    got = list(map(tuple, neighbors.blocked_pairs(atoms, cells, 2.0, 0.2).drop("block_").collect()))
    assert set(got) == want and len(got) == len(want) > 300
    some = neighbors.lists_alone(atoms, cells, 2.2, 0.0).withColumn("list", F.filter("list", lambda j: (j + F.col("i")) % 3 > 0)).filter("i % 4 < 3")
    got = list(map(tuple, neighbors.pairs_of_lists(some, atoms, cells, 2.2).collect()))
    assert set(got) == {p for p in want if (p[1] + p[2]) % 3 and p[1] % 4 < 3} and len(got) == len(set(got))


def test_entries_of_lists_are_not_moved(spark):
    """Lists go to the blocks of their atoms; no exchange is by a partner or deals an atom to the cells around."""
    plan = catalog.QUERIES["list_reuse"](spark, SF)
    assert not _moved(plan) & {"j_id", "j", "cx"} and "block_" in _moved(plan)
