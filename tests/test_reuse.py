"""What is read again: stored rows, neighbour lists, files in Z-order; and results that don't depend on how rows are dealt."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata import catalog
from lodestrata.engine import Engine
from lodestrata.functions.potentials import AnalyticPotential
from lodestrata.operators import eam, neighbors, ranks, trajectory
from lodestrata.operators.exact import exact_sum
from lodestrata.sources import generate, layout

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _crystal(spark, rep=5, size=0.1):
    atoms = generate.rattled(generate.lattice(spark, "fcc", 3.615, (rep,) * 3), size)
    return atoms, generate.orthorhombic(spark, [("lattice", *[3.615 * rep] * 3)])


@pytest.mark.parametrize("name", ["forces", "stress", "virial_per_atom", "stress_per_atom"])
def test_forces_make_pairs_once_more(spark, name):
    """The density pass is stored before; what is left has one stencil, so two pair joins in all, and no product."""
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert plan.count("inline(array(struct(dx") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("explode(CASE WHEN pbc") == 3


@pytest.mark.parametrize("name", ["neighbor_csr", "embedding_trace"])
def test_ranks_read_stored_rows(spark, name):
    assert "inline(array(struct(dx" not in _plan(catalog.QUERIES[name](spark, SF))


def test_exact_sums_are_equal_to_the_bit(spark):
    atoms, cells = _crystal(spark)
    potential, found = AnalyticPotential(), set()
    for n in (1, 7, 200):
        pairs = potential.at_pairs(neighbors.cell_list_pairs(atoms, cells, 4.95)).repartition(n)
        per = eam.densities_and_energies(atoms, pairs, potential, total=exact_sum).repartition(n)
        found.add(per.agg(exact_sum("energy").alias("e")).first()["e"].hex())
    assert len(found) == 1
    plain = Engine(potential, "cell_list").compute(atoms, cells).totals.first()["energy"]
    assert float.fromhex(found.pop()) == pytest.approx(plain, rel=1e-12)
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    import math

    assert df.agg(exact_sum("v")).first()[0] == pytest.approx(math.fsum(values), abs=2000 * 2.0**-60, rel=1e-15)
    assert df.limit(0).agg(exact_sum("v")).first()[0] is None


@pytest.mark.parametrize("gap", [1, 1 << 40])
def test_running_sums_of_scattered_ids(spark, gap):
    """Ids next to each other or hash-like far apart: chunks are cut by quantiles, so neither makes a chunk of each row."""
    rng = random.Random(4)
    ids = rng.sample(range(5000), 1500)
    df = spark.createDataFrame([(f"c{k % 2}", i * gap, k % 7, (k * k) % 5) for k, i in enumerate(ids)], "c string, i long, v int, tied int")
    got = {(r.c, r.i): r.before for r in ranks.sum_before(df, "c", "i", F.col("v"), "before").collect()}
    want, rows = {}, df.collect()
    for c in ("c0", "c1"):
        so_far = 0
        for r in sorted((r for r in rows if r.c == c), key=lambda r: r.i):
            want[c, r.i], so_far = so_far, so_far + r.v
    assert got == want
    ranked = {(r.c, r.i): r.nth for r in ranks.rank_by(df, "c", "tied", "i", "nth").collect()}
    for c in ("c0", "c1"):
        order = sorted((r for r in rows if r.c == c), key=lambda r: (r.tied, r.i))
        assert [ranked[c, r.i] for r in order] == list(range(1, len(order) + 1))
    chunks = ranks._cut(df, "c", cuts_="i").select("c", ranks._under("cuts_", "i").alias("k")).distinct().count()
    assert chunks <= 2 * (ranks.CUTS + 1)


def test_lists_hold_until_half_the_skin(spark):
    before, cells = _crystal(spark)
    for size, stale in ((0.05, False), (0.4, True)):
        atoms = before.withColumns({c: F.col(c) + size * (F.pmod(F.col("atom_id") * m, F.lit(100)) / 100.0 - 0.5) for c, m in (("x", 31), ("y", 57))})
        lists = neighbors.neighbor_lists(before, cells, 4.5, 0.15)
        now, state = neighbors.current_lists(lists, before, atoms, cells, 4.5, 0.15)
        assert state.first()["stale"] == stale
        got = neighbors.pairs_of_lists(now, atoms, cells, 4.5).select("i", "j")
        want = neighbors.cell_list_pairs(atoms, cells, 4.5).select("i", "j")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    gone = before.filter("atom_id <> 3")
    assert neighbors.largest_moves(before, gone, cells).first()["moved"] is None  # atoms changed, so lists are stale
    assert neighbors.current_lists(lists, before, gone, cells, 4.5, 0.15)[1].first()["stale"]


def test_boxes_read_few_row_groups(spark, tmp_path):
    atoms, cells = _crystal(spark, 14)
    path = str(tmp_path / "z")
    coded = layout.coded(atoms, cells, 4.95)
    layout.write_z_ordered(coded, path, 4, 1 << 12)
    low, high = (0.1, 0.1, 0.6), (0.3, 0.3, 0.8)
    box = layout.read_box(spark, path, cells, "lattice", 4.95, low, high)
    n = 14 * 3.615
    want = {r.atom_id for r in atoms.collect() if all(a <= (v / n) % 1 < b for v, a, b in zip((r.x, r.y, r.z), low, high))}
    assert {r.atom_id for r in box.collect()} == want and want
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "z").glob("*.parquet")]
    codes = [(g.row_group(k).column(g.schema.names.index("code")).statistics, g.row_group(k).num_rows) for g in groups for k in range(g.num_row_groups)]
    dims = [int(n // 4.95)] * 3
    spans = layout.code_intervals(tuple(int(a * d) for a, d in zip(low, dims)), tuple(int(b * d) for b, d in zip(high, dims)))
    met = [rows for s, rows in codes if any(s.min <= b and a <= s.max for a, b in spans)]
    assert len(codes) > 12 and len(met) < len(codes) / 2
    assert "PushedFilters" in box._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(ValueError):
        layout.read_box(spark, path, cells, "none", 4.95, low, high)


def test_code_intervals_cover_the_box():
    rng = random.Random(1)
    for _ in range(100):
        low = tuple(rng.randrange(20) for _ in range(3))
        high = tuple(a + rng.randrange(9) for a in low)
        most = rng.choice([1, 8, 64, 1000])
        spans = layout.code_intervals(low, high, most)
        cells = [layout._code(x, y, z) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1) for z in range(low[2], high[2] + 1)]
        assert len(spans) <= most and all(any(a <= c <= b for a, b in spans) for c in cells)
    assert sum(b - a + 1 for a, b in layout.code_intervals((3, 3, 3), (6, 6, 6), 10_000)) == 64  # nothing else


def test_codes_of_large_grids(spark):
    from lodestrata.functions import geometry as G

    rows = [(0, 0, 0), (1023, 1, 2), (1024, 4097, 70_000), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("code", G.morton(F.col("x"), F.col("y"), F.col("z")))
    back = df.select("x", "y", "z", "code", *(v.alias(n) for v, n in zip(G.unmorton(F.col("code")), "abc")))
    for r in back.collect():
        assert r.code == layout._code(r.x, r.y, r.z) and (r.a, r.b, r.c) == (r.x, r.y, r.z)


@pytest.mark.parametrize("lags", [1, 5, 40, 1500])
def test_transforms_equal_lagged_products(spark, lags):
    """Gaps, frames that occur twice, runs over several blocks, nulls; to 1e-9 of joins by lag."""
    rng = np.random.default_rng(6)
    rows = [("a", int(f), k, *map(float, rng.normal(size=2))) for k in range(3) for f in (rng.choice(2600, 300, replace=False) if k else range(1200))]
    rows += [("b", int(f), 9, *map(float, rng.normal(size=2))) for f in [*range(-20, 30), 7, 7, 5_000_000_000 % (1 << 31)]]
    df = spark.createDataFrame(rows, "config_id string, frame int, atom_id long, u double, v double")
    keys = ["config_id", "atom_id"]
    for unbiased in (True, False):
        got = {(r.config_id, r.lag): r.c for r in trajectory.autocorrelation(df, ["u", "v"], lags, keys, unbiased).collect()}
        want = {(r.config_id, r.lag): r.c for r in trajectory.autocorrelation_by_join(df, ["u", "v"], lags, keys, unbiased).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert trajectory.autocorrelation(df.limit(0), ["u"], lags, keys).collect() == []
    nulls = df.unionByName(df.limit(5).withColumn("u", F.lit(None).cast("double")))
    assert trajectory.autocorrelation(nulls, ["u", "v"], lags, keys).count() == trajectory.autocorrelation(df, ["u", "v"], lags, keys).count()


def test_frames_count_alike_alone_and_together(spark):
    """The mean over frames is the mean of each frame's own curve; a frame of one atom has none."""
    rng = np.random.default_rng(8)
    rows = [("c", f, k, *map(float, rng.uniform(0, 15, 3))) for f in range(4) for k in range(30 + f)] + [("c", 9, 0, 1.0, 1.0, 1.0)]
    traj = spark.createDataFrame(rows, "config_id string, frame int, atom_id long, x double, y double, z double")
    cells = generate.orthorhombic(spark, [("c", 15.0, 15.0, 15.0)])
    got = {r.bin: r for r in trajectory.rdf_over_frames(traj, cells, 5.0, 10).collect()}
    alone = []
    for f in range(4):
        one = traj.filter(F.col("frame") == f).withColumn("type", F.lit(0))
        sizes = one.groupBy("config_id").agg(F.count("*").alias("n_atoms")).withColumn("volume", F.lit(15.0**3))
        alone.append({r.bin: r.g for r in trajectory.rdf(neighbors.all_pairs(one, cells, 5.0, lowest=None), sizes, 5.0, 10).collect()})
    for b in range(10):
        values = [a[b] for a in alone]
        assert got[b].n_frames == 4 and got[b].g == pytest.approx(np.mean(values)) and got[b].deviation == pytest.approx(np.std(values), abs=1e-7)


def test_interpolation_clamps_and_hits(spark):
    points = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("a", 2.0, 15.0), ("b", 5.0, 1.0)], "config_id string, x double, y double")
    at = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 2.9, 3.0, 9.0)], "x double")
    got = {(r.config_id, r.x): r.y for r in trajectory.interpolated(points, at, "x", "y").collect()}
    for (c, x), y in got.items():
        assert y == pytest.approx(np.interp(x, [1, 2, 3], [10, 15, 30]) if c == "a" else 1.0)
    assert len(got) == 14


def test_paths_pass_their_own_maximum(spark):
    """A known curve sampled at uneven images: the saddle lies between images, above all of them."""
    at = [0.0, 0.7, 1.1, 1.9, 2.6, 3.0]
    images = spark.createDataFrame([("p", k, 0, x, 0.0, 0.0) for k, x in enumerate(at)], "config_id string, image int, atom_id long, x double, y double, z double")
    energies = spark.createDataFrame([("p", k, float(np.sin(x))) for k, x in enumerate(at)], "config_id string, image int, energy double")
    r = trajectory.path_profile(images, energies, generate.matrices(spark, [("p", None)])).first()
    assert r.length == pytest.approx(3.0) and r.saddle == pytest.approx(np.pi / 2, abs=0.05) and r.barrier == pytest.approx(1.0, abs=0.02) and r.barrier > np.sin(1.9) and r.image == 3
    flat = energies.withColumn("energy", F.lit(1.0))
    assert trajectory.path_profile(images, flat, generate.matrices(spark, [("p", None)])).first().barrier == 0.0


def test_solid_layers_of_a_crystal(spark):
    atoms, cells = _crystal(spark, 5, 0.0)
    atoms = atoms.withColumn("z", F.col("z") + 0.3)  # planes in the middle of layers
    whole = trajectory.two_phase(trajectory.phases(atoms, cells, 3.0), 3.615 / 2).first()
    assert (whole.n_layers, whole.share, whole.solid_layers, whole.longest) == (10, 1.0, 10, 10)
    holes = atoms.filter("not (z > 8 and z < 10)")
    less = trajectory.two_phase(trajectory.phases(holes, cells, 3.0), 3.615 / 2).first()
    assert less.longest < less.solid_layers < 10
