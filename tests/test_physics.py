"""Invariants: finite differences, Newton's law, rejected inputs, tables against closed forms."""

import pytest

from lodestrata.engine import Engine
from lodestrata.errors import InvalidInput, ParseError
from lodestrata.functions.potentials import AnalyticPotential
from lodestrata.operators import eam, neighbors, validation
from lodestrata.plans import thermo
from lodestrata.sources import generate, setfl, xyz
from lodestrata.streaming import dynamics

BOX = 11.0
PLACES = [(0.3, 0.2, 0.1), (2.4, 0.5, 0.3), (1.1, 2.2, 1.3), (10.6, 10.7, 0.2), (5.0, 5.0, 5.0)]


def _system(spark, places=PLACES, types=(0, 1, 0, 1, 0)):
    return xyz.from_arrays(spark, places, list(types), [[BOX, 0, 0], [1.0, BOX, 0], [0, 0.5, BOX]])


def _energy(spark, places):
    atoms, cells = _system(spark, places)
    return Engine(AnalyticPotential(), "all_pairs").compute(atoms, cells).totals.first()["energy"]


def test_forces_are_energy_slopes_and_sum_to_zero(spark):
    atoms, cells = _system(spark)
    rows = {r["atom_id"]: r for r in Engine(AnalyticPotential(), "cell_list").compute(atoms, cells).per_atom.collect()}
    assert all(abs(sum(r[f"f{c}"] for r in rows.values())) < 1e-10 for c in "xyz")
    h = 1e-5
    moved = [[list(p) for p in PLACES] for _ in range(2)]
    moved[0][1][0] += h
    moved[1][1][0] -= h
    slope = (_energy(spark, moved[0]) - _energy(spark, moved[1])) / (2 * h)
    assert abs(rows[1]["fx"] + slope) < 1e-6
    assert rows[4]["fx"] == rows[4]["fy"] == 0.0  # alone, but still there


def test_atom_stresses_average_to_the_stress(spark):
    result = Engine(AnalyticPotential()).compute_per_atom(*_system(spark))
    mean = result.per_atom.agg({"s_xy": "avg", "s_zz": "avg"}).first()
    total = result.totals.first()
    assert mean["avg(s_xy)"] == pytest.approx(total["s_xy"]) and mean["avg(s_zz)"] == pytest.approx(total["s_zz"])


def test_bad_input_is_rejected(spark):
    atoms, cells = _system(spark)
    with pytest.raises(InvalidInput):
        validation.check_cells(cells, 5.6)
    with pytest.raises(InvalidInput):
        validation.check_atoms(atoms, cells, 1)
    with pytest.raises(InvalidInput):
        validation.check_cells(generate.matrices(spark, [("flat", (1, 0, 0, 2, 0, 0, 0, 0, 1))]), 0.1)
    with pytest.raises(InvalidInput):
        validation.with_types(spark.createDataFrame([("Xx",)], "symbol string"), ["Cu"])
    with pytest.raises(InvalidInput):
        xyz.from_arrays(spark, [[0, 0]], [0])
    with pytest.raises(ParseError):
        setfl.load(setfl.read_text(spark, "a\nb\nc\n1 Cu\n3 0.1 3 0.1 1.0\n29 1 1 fcc\n1 2 3\n"))
    with pytest.raises(ParseError):
        xyz.check(*xyz.parse(spark.createDataFrame([("f", "3\nx\nCu 0 0 0\n")], "config_id string, value string")))


def test_tables_agree_with_the_closed_forms(spark):
    text = setfl.write_text(generate.synthetic_grids(spark, 2), ["Cu", "Ag"], 601, 0.01, 100, 0.05, 4.5)
    atoms, cells = _system(spark)
    for fit, most in (("spline", 2e-3), ("hermite", 2e-3), ("linear", 2e-2)):
        tabulated = Engine(setfl.load(setfl.read_text(spark, text), fit), "all_pairs")
        closed = Engine(AnalyticPotential(4.5), "all_pairs")
        off = eam.differences(tabulated.compute(atoms, cells).per_atom, closed.compute(atoms, cells).per_atom, ["config_id", "atom_id"], "energy").first()
        assert off["n"] == 5 and off["max_abs"] < most


def test_neighbours_across_a_face_and_in_small_boxes(spark):
    atoms, cells = xyz.from_arrays(spark, [[0.1, 5, 5], [9.9, 5, 5]], [0, 0], [[10, 0, 0], [0, 10, 0], [0, 0, 10]])
    assert neighbors.cell_list_pairs(atoms, cells, 2.0).count() == 2
    a, c = generate.lattice(spark, "fcc", 3.615, (3, 3, 3)), generate.orthorhombic(spark, [("lattice", *[3.615 * 3] * 3)])
    assert neighbors.cell_list_pairs(a, c, 4.95).count() == neighbors.all_pairs(a, c, 4.95).count() == 108 * 42
    half = neighbors.cell_list_pairs(a, c, 4.95, half=True)
    assert neighbors.mirrored(half).count() == 108 * 42


def test_equation_of_state_comes_back(spark):
    e0, v0, b0, b1 = -3.5, 11.8, 0.87, 5.1
    rows = []
    for k in range(15):
        v = v0 * (0.9 + 0.2 * k / 14)
        x = (v0 / v) ** (2 / 3)
        rows.append(("s", v, e0 + 9 * v0 * b0 / 16 * ((x - 1) ** 3 * b1 + (x - 1) ** 2 * (6 - 4 * x))))
    fit = thermo.birch_murnaghan(spark.createDataFrame(rows, "config_id string, volume double, energy double")).first()
    assert fit["e0"] == pytest.approx(e0) and fit["v0"] == pytest.approx(v0)
    assert fit["b0"] == pytest.approx(b0 * thermo.GPA, rel=1e-6) and fit["b0_prime"] == pytest.approx(b1, rel=1e-5)


def test_leapfrog_moves_by_force(spark):
    atoms, cells = _system(spark)
    out = dynamics.run(Engine(AnalyticPotential(), "all_pairs"), atoms, cells, 1, 0.01, [1.0, 2.0])
    f = Engine(AnalyticPotential(), "all_pairs").compute(atoms, cells).per_atom.filter("atom_id = 1").first()
    r = out.filter("atom_id = 1").first()
    assert r["vx"] == pytest.approx(f["fx"] * 0.02) and r["x"] == pytest.approx(PLACES[1][0] + f["fx"] * 0.0002)
