"""Rules of input and lists, each broken once; tables read in every form; the cases with tabulated potentials."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_verification import RC, _cases, _relations

from lodestrata import __main__ as cli
from lodestrata.engine import Engine
from lodestrata.errors import InvalidInput
from lodestrata.functions.potentials import AnalyticPotential
from lodestrata.operators import eam, neighbors, validation
from lodestrata.sources import generate, setfl, xyz

ATOMS = "config_id string, atom_id long, type int, x double, y double, z double"


def _executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def _good(spark):
    atoms = generate.lattice(spark, "fcc", 3.615, (3, 3, 3))
    return atoms, generate.orthorhombic(spark, [("lattice", *[3.615 * 3] * 3)])


BROKEN = {
    "types must be": lambda a: a.withColumn("type", F.when(F.col("atom_id") == 7, 5).otherwise(F.col("type"))),
    "types must": lambda a: a.withColumn("type", F.when(F.col("atom_id") != 7, F.col("type"))),
    "finite": lambda a: a.withColumn("y", F.when(F.col("atom_id") == 3, float("nan")).otherwise(F.col("y"))),
    "coordinates": lambda a: a.withColumn("z", F.when(F.col("atom_id") != 3, F.col("z"))),
    "ids must be there and differ": lambda a: a.withColumn("atom_id", F.when(F.col("atom_id") == 9, 8).otherwise(F.col("atom_id"))),
    "ids must": lambda a: a.withColumn("atom_id", F.when(F.col("atom_id") != 9, F.col("atom_id"))),
    "atoms without a cell": lambda a: a.withColumn("config_id", F.when(F.col("atom_id") == 1, "elsewhere").otherwise(F.col("config_id"))),
    "cells without atoms": lambda a: a.withColumn("config_id", F.lit("elsewhere")),
}


@pytest.mark.parametrize("say", BROKEN)
def test_each_rule_names_its_offender(spark, say):
    atoms, cells = _good(spark)
    with pytest.raises(InvalidInput, match=say):
        validation.check(BROKEN[say](atoms), cells, 4.95, 1)


def test_all_rules_are_one_job(spark):
    atoms, cells = _good(spark)
    before = _executions(spark)
    assert validation.check(atoms, cells, 4.95, 1) == {True}
    assert _executions(spark) == before + 1
    with pytest.raises(InvalidInput, match="heights.*inverse|inverse.*heights"):  # both in one message
        both = generate.matrices(spark, [("lattice", (9, 0, 0, 0, 9, 0, 0, 0, 9)), ("flat", (1, 0, 0, 2, 0, 0, 0, 0, 1))])
        validation.check(atoms.unionByName(atoms.withColumn("config_id", F.lit("flat"))), both, 4.95, 1)
    with pytest.raises(InvalidInput, match="cutoff"):
        validation.check(atoms, cells, float("nan"), 1)
    assert validation.check(atoms, cells.withColumn("pbc", F.lit(False)), 4.95, 1) == {False}


LISTS = {
    "each atom has one list": lambda x: x.filter("i <> 5"),
    "each atom": lambda x: x.unionByName(x.filter("i = 5")),
    "without repeats": lambda x: x.withColumn("list", F.when(F.col("i") == 4, F.reverse("list")).otherwise(F.col("list"))),
    "the atom itself": lambda x: x.withColumn("list", F.when(F.col("i") == 4, F.sort_array(F.concat(F.slice("list", 2, 99), F.array("i")))).otherwise(F.col("list"))),
    "aren't there": lambda x: x.withColumn("list", F.when(F.col("i") == 4, F.concat(F.slice("list", 1, F.size("list") - 1), F.array(F.lit(10_000).cast("long")))).otherwise(F.col("list"))),
    "follow on": lambda x: x.withColumn("start", F.when(F.col("i") == 4, F.col("start") + 1).otherwise(F.col("start"))),
    "starts": lambda x: x.withColumn("start", F.col("start") + 3),
}


@pytest.mark.parametrize("say", [None, *LISTS])
def test_lists_are_checked(spark, say):
    atoms, cells = _good(spark)
    lists = neighbors.neighbor_lists(atoms, cells, 4.5)
    if say is None:
        before = _executions(spark)
        validation.check_lists(lists, atoms)
        assert _executions(spark) == before + 1
    else:
        with pytest.raises(InvalidInput, match=say):
            validation.check_lists(LISTS[say](lists), atoms)


def test_headers_orders_and_exponents(spark):
    """The element lines; pairs written row by row of the lower triangle; exponents with D."""
    grids = generate.synthetic_grids(spark, 3 - 1, nrho=11, drho=0.1, nr=12, dr=0.4)
    text = setfl.write_text(grids, ["Cu", "Ag"], 11, 0.1, 12, 0.4, 4.5)
    body = setfl.tokens(setfl.read_text(spark, text))[1]
    head = [r.asDict() for r in setfl.element_headers(body).collect()]
    assert len(head) == 2 and all(63.546 in h.values() and 3.615 in h.values() and "fcc" in h.values() for h in head)
    d = setfl.read_text(spark, text.replace("e-", "D-").replace("0.1 12 0.4", "1.0D-1 12 4.0d-1"))
    key = ["kind", "key", "k"]
    plain, fortran = (setfl.load(f).splines.orderBy(*key).collect() for f in (setfl.read_text(spark, text), d))
    assert [r.a for r in fortran] == pytest.approx([r.a for r in plain])
    upper, lower = (setfl.grids(body, o).filter("kind = 'rphi'").select("key", "k", "value").orderBy("key", "k").collect() for o in ("upper", "lower"))
    assert [r.value for r in lower] == [r.value for r in upper]  # of two elements both orders are the same


def test_lower_order_of_three_elements(spark):
    """00, 10, 11, 20, 21, 22 in the file against 00, 01, 02, 11, 12, 22 in the tables."""
    rows = [("embed", e, k, 0.0) for e in range(3) for k in range(3)] + [("rho", e, k, 0.0) for e in range(3) for k in range(3)] + [("rphi", p, k, 100.0 * p + k) for p in range(6) for k in range(3)]
    text = setfl.write_text(spark.createDataFrame(rows, "kind string, key int, k int, value double"), ["A", "B", "C"], 3, 0.1, 3, 0.1, 1.0)
    body = setfl.tokens(setfl.read_text(spark, text))[1]
    got = {r.key: int(r.value // 100) for r in setfl.grids(body, "lower").filter("kind = 'rphi' and k = 0").collect()}
    assert got == {0: 0, 1: 1, 3: 2, 2: 3, 4: 4, 5: 5}
    assert {r.key: int(r.value // 100) for r in setfl.grids(body).filter("kind = 'rphi' and k = 0").collect()} == {k: k for k in range(6)}


NR, DR, NRHO, DRHO = 100, 0.05, 41, 0.01  # densities go far beyond 0.4


def _cubic(y, dx):
    """Value and slope of the Hermite form on a grid, straight on after the end if asked."""
    n = len(y)
    m = np.empty(n)
    m[2:-2] = (y[:-4] - y[4:] + 8 * (y[3:-1] - y[1:-3])) / 12
    m[1], m[-2], m[0], m[-1] = (y[2] - y[0]) / 2, (y[-1] - y[-3]) / 2, y[1] - y[0], y[-1] - y[-2]

    def at(x, straight=False):
        k = np.clip((x / dx).astype(int), 0, n - 2)
        t = np.minimum(x / dx - k, 1.0)
        rise = y[k + 1] - y[k]
        c, d = 3 * rise - 2 * m[k] - m[k + 1], m[k] + m[k + 1] - 2 * rise
        value, slope = y[k] + t * (m[k] + t * (c + t * d)), (m[k] + t * (2 * c + 3 * t * d)) / dx
        return value + (slope * np.maximum(0, x - dx * (n - 1)) if straight else 0), slope

    return at


def test_cases_with_hermite_tables(spark):
    """All 35 cases against plain numpy that reads the same tables, dense ones beyond the last density."""
    r, rho = np.arange(NR) * DR, np.arange(NRHO) * DRHO
    inside = np.maximum(0, RC - r)
    embed = [_cubic(-s * np.sqrt(rho + 0.01), DRHO) for s in (1.0, 0.9)]
    donor = [_cubic(s * (inside / RC) ** 2, DR) for s in (1.0, 0.9)]
    phi = [_cubic(np.concatenate([[v[1]], v[1:]]), DR) for v in ((p * inside**2) for p in (1.0, 0.95, 0.9))]
    text = setfl.write_text(generate.synthetic_grids(spark, 2, NRHO, DRHO, NR, DR, RC), ["Cu", "Ag"], NRHO, DRHO, NR, DR, RC)
    cases = _cases()
    result = Engine(setfl.load(setfl.read_text(spark, text), "hermite"), "cell_list").compute(*_relations(spark, cases))
    rows = result.per_atom.toPandas().sort_values(["config_id", "atom_id"])
    beyond = 0
    for name, (places, types, cell) in cases.items():
        d = places[None] - places[:, None]
        if cell is not None:
            f = d @ np.linalg.inv(cell)
            d = (f - np.rint(f)) @ cell
        r = np.sqrt((d * d).sum(2))
        near = (r < RC) & (r > 1e-2)
        r = np.where(near, r, 1.0)
        f = np.stack([donor[t](r) for t in (0, 1)])  # [type, value or slope, i, j]
        pair = np.stack([p(r) for p in phi])
        kind = types[:, None] + types[None]
        value, slope = (np.where(near, np.take_along_axis(pair[:, q], kind[None], 0)[0], 0) for q in (0, 1))
        to_i, df_j, df_i = (np.where(near, np.where(t, f[1, q], f[0, q]), 0) for q, t in ((0, types[None] == 1), (1, types[None] == 1), (1, types[:, None] == 1)))
        rho_i = to_i.sum(1)
        beyond += int((rho_i > DRHO * (NRHO - 1)).sum())
        e, bend = (np.where(types == 1, *(embed[t](rho_i, True)[q] for t in (1, 0))) for q in (0, 1))
        pull = (bend[:, None] * df_j + bend[None] * df_i + slope) / r
        got = rows[rows.config_id == name]
        assert np.allclose(got.energy, e + value.sum(1) / 2, atol=1e-9), name
        assert np.allclose(got[["fx", "fy", "fz"]], (pull[:, :, None] * d).sum(1), atol=1e-9), name
    assert beyond > 1000


def test_flat_and_open_arrays(spark):
    """In-memory arrays, nested or flat, with and without a cell."""
    places = [[0.0, 0, 0], [2.5, 0, 0]]
    nested, flat = (Engine(AnalyticPotential(), "all_pairs").compute(*xyz.from_arrays(spark, p, [0, 1])) for p in (places, [v for p in places for v in p]))
    assert nested.totals.first()["energy"] == flat.totals.first()["energy"]
    assert eam.differences(nested.per_atom, flat.per_atom, ["config_id", "atom_id"], "fx").first()["max_abs"] == 0


def test_quick_check(spark, tmp_path, capsys):
    """Five steps from the shell, and those that fail."""
    text = setfl.write_text(generate.synthetic_grids(spark, 2, 601, 0.01, 100, 0.05, 4.5), ["Cu", "Ag"], 601, 0.01, 100, 0.05, 4.5)
    (tmp_path / "p.eam").write_text(text)
    cli.main(["check", "--pot", str(tmp_path / "p.eam"), "--lattice", "3.615"])
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 5 and "skipped" in said[3] and all("ok" in said[k] for k in (0, 1, 2, 4))
    energy = float(said[3].split("(")[1].rstrip(")"))
    with pytest.raises(SystemExit):
        cli.main(["check", "--pot", str(tmp_path / "p.eam"), "--lattice", "3.615", "--cohesive", str(energy * 1.2), "--elem", "Ag"])
    with pytest.raises(InvalidInput):
        cli.main(["check", "--pot", str(tmp_path / "p.eam"), "--lattice", "3.615", "--elem", "Xx"])


def test_text_arrays_and_summaries(spark):
    from lodestrata.sources import tables

    rows = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, -1.23456789, 3.0)], "config_id string, n long, x double, y double")
    assert sorted(map(tuple, tables.array_lines(rows, "n", "x", "y").collect())) == [("a", 1, "0.500000 nan"), ("a", 2, "-1.234568 3.000000")]
    assert tables.array_lines(rows.limit(0), "n", "x").collect() == []
    named = rows.withColumn("label", F.lit("z"))
    found = tables.summary({"one": named, "two": rows.agg(F.sum("x").alias("total"))})
    assert {(r.analysis, r.config_id, r.name) for r in found.collect()} == {("one", "a", "n"), ("one", "a", "x"), ("one", "a", "y"), ("two", "all", "total")}
    assert found.count() == 7


@pytest.mark.parametrize("samples", [2, 5, 12, 100, 23])
def test_a_resampled_table_has_each_point_once(spark, samples):
    from lodestrata.functions import potentials

    n, dx = 12, 0.25
    table = spark.createDataFrame([("p", "rho", 0, k, k * dx, 3.0 * k * dx - 1) for k in range(n)], "pot_id string, kind string, key int, k int, x double, value double")
    for fit in (potentials.natural_spline, potentials.linear_coefficients, potentials.hermite_spline):
        got = sorted((r.i, r.x, r.value, r.slope) for r in potentials.resampled(fit(table), n, dx, samples).collect())
        assert [g[0] for g in got] == list(range(samples))
        assert abs(got[-1][1] - (n - 1) * dx) < 1e-12
        assert all(abs(v - (3 * x - 1)) < 1e-9 and abs(s - 3) < 1e-9 for _, x, v, s in got)


def test_lists_of_all_pairs_equal_those_of_cells(spark):
    atoms = generate.rattled(generate.lattice(spark, "fcc", 3.615, (3, 3, 3), "c"), 0.1)
    cells = generate.orthorhombic(spark, [("c", *[3 * 3.615] * 3)])
    near, plain = ({r.i: (r.start, r.list) for r in neighbors.neighbor_lists(atoms, cells, 4.5, 0.2, find).collect()} for find in (neighbors.cell_list_pairs, neighbors.all_pairs))
    assert len(near) == 108 and near == plain


def test_powers_of_two_keep_the_width(spark):
    from lodestrata.functions import geometry

    rows = [(1, 10.0), (3, 16.0), (3, 19.9), (5, 40.0), (5, 39.0), (8, 40.0), (8, 30.0)]
    found = spark.createDataFrame(rows, "n int, height double").select("n", "height", geometry.power_of_two_within(F.col("n"), F.col("height"), 5.0).alias("p"))
    assert {(r.n, r.height): r.p for r in found.collect()} == {(1, 10.0): 1, (3, 16.0): 2, (3, 19.9): 2, (5, 40.0): 8, (5, 39.0): 4, (8, 40.0): 8, (8, 30.0): 8}
