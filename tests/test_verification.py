"""35 verification cases, 13 of one element and 22 of two, against all pairs in plain numpy; and what must hold
of any result: strategies agree, the stress is the slope of the energy, clusters have none."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import __main__ as cli
from lodestrata import catalog
from lodestrata.engine import Engine
from lodestrata.functions.potentials import AnalyticPotential
from lodestrata.operators import eam, neighbors, ranks
from lodestrata.sources import generate, setfl, xyz
from lodestrata.streaming import dynamics

RC, A = 4.5, 3.615
FCC = ((0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0))


def _crystal(basis, types, a, rep):
    cells = [(x, y, z) for x in range(rep) for y in range(rep) for z in range(rep)]
    places = np.array([[a * (c + b) for c, b in zip(cell, spot)] for cell in cells for spot in basis])
    return places, np.array(list(types) * len(cells)), a * rep * np.eye(3)


def _cases():
    """name: (places, types, cell or None)."""
    rng = np.random.default_rng(11)
    wide = 2 * RC + 6

    def moved(case, size):
        return case[0] + rng.normal(scale=size, size=case[0].shape), *case[1:]

    def sheared(case, by):
        m = np.eye(3)
        m[1, 0] = by
        return case[0] @ m, case[1], case[2] @ m

    def without(case, k):
        return np.delete(case[0], k, 0), np.delete(case[1], k), case[2]

    def shuffled(case):
        order = rng.permutation(len(case[0]))
        return case[0][order], case[1][order], case[2]

    def pair(d, kinds=(0, 0), cell=None):
        return np.array([[0.0, 0, 0], [d, 0, 0]]), np.array(kinds), cell

    def across(kinds):
        return np.array([[0.25, wide / 2, wide / 2], [wide - A / 2**0.5 + 0.25, wide / 2, wide / 2]]), np.array(kinds), wide * np.eye(3)

    fcc = lambda k=0, scale=1.0: _crystal(FCC, [k] * 4, A * scale, 3)
    b2 = lambda a=0, b=1: _crystal(((0, 0, 0), (0.5, 0.5, 0.5)), (a, b), 2.88, 4)
    l12 = lambda a=1, b=0: _crystal(FCC, (a, b, b, b), 3.57, 3)
    mixed = fcc()[0], rng.integers(0, 2, 108), fcc()[2]
    layers = np.array([[A * (x + 0.5 * (y % 2) + 0.5 * (z % 3 == 1)) / 2**0.5, A * (y * 3 + z % 3) / (2 * 6**0.5), A * z / 3**0.5] for z in range(4) for y in range(6) for x in range(5)])
    slab = layers, np.zeros(len(layers), int), np.diag([5 * A / 2**0.5, 18 * A / (2 * 6**0.5), 3 * A / 3**0.5 + RC + 3 + 2 * RC])
    antisite = b2()
    antisite[1][5] = 1 - antisite[1][5]
    cases = {
        "equilibrium": fcc(), "moved 0.01": moved(fcc(), 0.01), "moved 0.05": moved(fcc(), 0.05), "compressed": fcc(0, 0.96), "expanded": fcc(0, 1.04), "sheared": sheared(fcc(), 0.07),
        "vacancy": without(fcc(), 54), "permuted": shuffled(fcc()), "across a face": across((0, 0)), "dimer": pair(A / 2**0.5), "below the cutoff": pair(0.999 * RC), "above the cutoff": pair(1.001 * RC), "slab": slab,
        "pure 0": fcc(0), "pure 1": fcc(1), "B2": b2(), "B2 swapped": b2(1, 0), "B2 moved": moved(b2(), 0.03), "B2 sheared": sheared(b2(), 0.05), "B2 antisite": antisite, "B2 vacancy": without(b2(), 7),
        "L12": l12(), "L12 swapped": l12(0, 1), "random": mixed, "random moved": moved(mixed, 0.03), "random permuted": shuffled(mixed), "binary across a face": across((0, 1)),
    }
    for kinds in ((0, 0), (0, 1), (1, 0), (1, 1)):
        cases |= {f"{kinds} below": pair(0.999 * RC, kinds), f"{kinds} above": pair(1.001 * RC, kinds)}
    return cases


def _plain(places, types, cell):
    """(energies, forces, stress xx yy zz yz xz xy) by comparing all pairs."""
    s, p = np.array([1.0, 0.9])[types], np.array([[1.0, 0.95], [0.95, 0.9]])[types][:, types]
    d = places[None] - places[:, None]  # from i to j
    if cell is not None:
        f = d @ np.linalg.inv(cell)
        d = (f - np.rint(f)) @ cell
    r = np.sqrt((d * d).sum(2))
    near = (r < RC) & (r > 1e-2)
    r = np.where(near, r, 1.0)
    part, slope = np.where(near, (RC - r) / RC, 0), np.where(near, -2 * (RC - r) / RC**2, 0)
    rho = (part**2 * s[None]).sum(1)
    energy = -s * np.sqrt(rho + 0.01) + (p * np.where(near, RC - r, 0) ** 2).sum(1) / 2
    bend = -s / (2 * np.sqrt(rho + 0.01))
    pull = (bend[:, None] * slope * s[None] + bend[None] * slope * s[:, None] - 2 * p * np.where(near, RC - r, 0)) / r
    force = (pull[:, :, None] * d).sum(1)
    w = [(-0.5 * d[:, :, a] * d[:, :, b] * pull).sum() for a, b in ((0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1))]
    return energy, force, -np.array(w) / abs(np.linalg.det(cell)) if cell is not None else np.zeros(6)


def _relations(spark, cases):
    rows = [(n, k, int(t), *map(float, x)) for n, (places, types, _) in cases.items() for k, (x, t) in enumerate(zip(places, types))]
    atoms = spark.createDataFrame(rows, "config_id string, atom_id long, type int, x double, y double, z double")
    return atoms, generate.matrices(spark, [(n, None if c is None else tuple(c.ravel())) for n, (_, _, c) in cases.items()])


@pytest.mark.parametrize("options", [{"strategy": "cell_list"}, {"strategy": "all_pairs"}, {"strategy": "cell_list", "cell_size": 5.2}, {"strategy": "auto", "persist": True}])
def test_verification_cases(spark, options):
    cases = _cases()
    assert len(cases) == 13 + 22
    result = Engine(AnalyticPotential(RC), **options).compute_stress(*_relations(spark, cases))
    per_atom = result.per_atom.toPandas().sort_values(["config_id", "atom_id"])
    totals = result.totals.toPandas().set_index("config_id")
    for name, case in cases.items():
        energy, force, stress = _plain(*case)
        got = per_atom[per_atom.config_id == name]
        assert np.allclose(got.energy, energy, atol=1e-10) and np.allclose(got[["fx", "fy", "fz"]], force, atol=1e-10), name
        assert totals.loc[name].energy == pytest.approx(energy.sum(), abs=1e-9)
        assert np.allclose(totals.loc[name][[f"s_{n}" for n, *_ in eam.VOIGT]].astype(float), stress, atol=1e-10), name


def test_strategies_agree_on_the_crystal_systems(spark):
    base = generate.lattice(spark, "fcc", 4.915, (4, 5, 6))
    box = generate.orthorhombic(spark, [("lattice", 4 * 4.915, 5 * 4.915, 6 * 4.915)])
    atoms, cells = generate.deform(generate.rattled(base, 0.05), box, generate.deformations(spark, list(generate.SYSTEMS.items())))
    a, b = (Engine(AnalyticPotential(RC), s).compute(atoms, cells) for s in ("cell_list", "all_pairs"))
    for column in ("energy", "fx", "fy", "fz"):
        off = eam.differences(a.per_atom, b.per_atom, ["config_id", "atom_id"], column).first()
        assert off["n"] == 7 * 480 and off["max_abs"] < 1e-10


def test_the_stress_is_the_slope_of_the_energy(spark):
    places, types, cell = _cases()["random moved"]
    h = 1e-4
    scaled = {str(k): (places * (1 + k * h), types, cell * (1 + k * h)) for k in (-1, 0, 1)}
    totals = Engine(AnalyticPotential(RC), "cell_list").compute_stress(*_relations(spark, scaled)).totals.toPandas().set_index("config_id")
    volume = np.linalg.det(cell)
    slope = (totals.loc["1"].energy - totals.loc["-1"].energy) / (volume * ((1 + h) ** 3 - (1 - h) ** 3))
    trace = sum(totals.loc["0"][f"s_{v}"] for v in ("xx", "yy", "zz"))
    assert abs(trace / 3) == pytest.approx(abs(slope), rel=1e-5)


def test_clusters_have_no_stress_and_order_does_not_count(spark):
    cases = _cases()
    t = Engine(AnalyticPotential(RC), "cell_list").compute_stress(*_relations(spark, {n: cases[n] for n in ("dimer", "equilibrium", "permuted")})).totals.toPandas().set_index("config_id")
    assert all(t.loc["dimer"][f"s_{n}"] == 0 for n, *_ in eam.VOIGT)
    assert t.loc["equilibrium"].energy == pytest.approx(t.loc["permuted"].energy)


def test_cells_hold_each_atom_once(spark):
    atoms, cells = _relations(spark, {"moved": _cases()["moved 0.05"]})
    binned, occupied = Engine(AnalyticPotential(RC)).debug_cells(atoms, cells)
    assert binned.select("atom_id").distinct().count() == binned.count() == 108
    rows = occupied.orderBy("code").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n for r in rows)])[:-1].tolist() and sum(r.n for r in rows) == 108
    lists = neighbors.neighbor_lists(atoms, cells, RC).orderBy("i").collect()
    assert [r.start for r in lists] == np.cumsum([0, *(r.n for r in lists)])[:-1].tolist() and all(r.n == len(r.list) for r in lists)


def test_ranks_in_two_levels(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if k % 3 else "b", int(k * 40_000), float(rng.integers(0, 6) if k % 2 else rng.normal())) for k in range(3000)]
    frame = spark.createDataFrame(rows, "c string, i long, v double")
    got = {(r.c, r.i): r.nth for r in ranks.rank_by(frame, "c", "v", "i", "nth").collect()}
    sums = {(r.c, r.i): r.s for r in ranks.sum_before(frame, "c", "i", F.col("i") % 7, "s").collect()}
    for c in "ab":
        own = [r for r in rows if r[0] == c]
        assert [got[c, r[1]] for r in sorted(own, key=lambda r: (r[2], r[1]))] == list(range(1, len(own) + 1))
        assert [sums[c, r[1]] for r in own] == np.cumsum([0, *(r[1] % 7 for r in own)])[:-1].tolist()


def test_acoustic_branches_start_at_zero(spark):
    found = catalog.QUERIES["phonon_dispersion"](spark, "/root/testdata/sf0.001").toPandas()  # the wave vector of supplier 0 is 0
    first = found[found.q_id == 0].thz
    assert len(first) == 3 and abs(first).max() < 1e-2 and found.thz.notna().all()


def test_leapfrog_keeps_the_energy(spark, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    places, types, _ = _cases()["dimer"]
    atoms, cells = xyz.from_arrays(spark, places.ravel(), types)
    engine = Engine(AnalyticPotential(RC), "all_pairs", validate=False)
    start = engine.compute(atoms, cells).totals.first()["energy"]
    end = dynamics.run(engine, atoms, cells, 10, 0.003, [9648.5 / 63.546, 9648.5 / 107.87], every=1)
    result = engine.compute(end.select("config_id", "atom_id", "type", "x", "y", "z"), cells)
    after = result.totals.first()["energy"]
    # velocities are half a step behind the places; half a kick brings them to the same time
    inverse = F.when(F.col("type") == 1, 9648.5 / 107.87).otherwise(9648.5 / 63.546)
    both = end.join(result.per_atom, ["config_id", "atom_id"])
    square = sum((F.pow(F.col(f"v{c}") + F.col(f"f{c}") * inverse * 0.0015, 2) for c in "xyz"), F.lit(0.0))
    kinetic = both.select(F.sum(square / (2 * inverse))).first()[0]
    assert kinetic > 0 and after + kinetic == pytest.approx(start, abs=0.02 * abs(start))
    assert end.agg(F.sum("vx")).first()[0] == pytest.approx(0, abs=1e-9)


def test_frames_of_a_stream(spark, tmp_path):
    atoms, cells = _relations(spark, {n: _cases()[n] for n in ("dimer", "below the cutoff")})
    atoms.write.parquet(str(tmp_path / "in"))
    engine = Engine(AnalyticPotential(RC), "all_pairs")
    stream = dynamics.evaluate_stream(spark.readStream.schema(atoms.schema).parquet(str(tmp_path / "in")), cells, engine, str(tmp_path / "out"), str(tmp_path / "log"))
    stream.processAllAvailable()
    stream.stop()
    got = {r.config_id: r.energy for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({r.config_id: r.energy for r in engine.compute(atoms, cells).totals.collect()})


@pytest.fixture(scope="module")
def potential_file(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pot") / "two.eam.alloy"
    rows = setfl.write_text(generate.synthetic_grids(spark, 2), ["Cu", "Ag"], 601, 0.01, 100, 0.05, 4.5)
    path.write_text(rows if isinstance(rows, str) else "\n".join(r[0] for r in rows.collect()))
    return str(path)


def test_command_line(spark, potential_file, tmp_path, monkeypatch, capsys):
    frame = "2\nno box\nCu 0 0 0\nAg 2.5 0 0\n"
    monkeypatch.setattr("sys.stdin", io.StringIO(frame))
    cli.main(["calc", "--pot", potential_file, "--in", "-", "--cell-list", "--cell-size", "5"])
    first = json.loads(capsys.readouterr().out)
    monkeypatch.setattr("sys.stdin", io.StringIO(frame.replace("Cu", "Xa").replace("Ag", "Xb")))
    cli.main(["calc", "--pot", potential_file, "--in", "-", "--elem", "Xa", "Xb", "--all-pairs"])
    assert json.loads(capsys.readouterr().out)["energy_ev"] == pytest.approx(first["energy_ev"])
    (tmp_path / "a.xyz").write_text(frame)
    cli.main(["calc", "--pot", potential_file, "--in", str(tmp_path / "a.xyz"), "--out", str(tmp_path / "out"), "--format", "xyz"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "Properties=species" in text and text.count("Cu") == 1
    energy, force, _ = _plain(np.array([[0.0, 0, 0], [2.5, 0, 0]]), np.array([0, 1]), None)
    assert first["energy_ev"] == pytest.approx(energy.sum(), abs=2e-3) and first["forces_ev_per_aa"][1][0] == pytest.approx(force[1][0], abs=1e-2)
    with pytest.raises(Exception, match="elements"):
        monkeypatch.setattr("sys.stdin", io.StringIO(frame))
        cli.main(["calc", "--pot", potential_file, "--in", "-", "--elem", "Cu"])
