"""Rules that atoms, cells and lists must keep. A check is one job, all of its rules counted in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import geometry as G


def _first(found: DataFrame, say: str) -> None:
    rows = [tuple(r) for r in found.limit(5).collect()]
    if rows:
        raise InvalidInput(f"{say}: {rows}")


def _count(bad: Column, name: str) -> list[Column]:
    """Number of configurations that break a rule, and the first of them."""
    return [F.count_if(bad).alias(f"n_{name}"), F.min(F.when(bad, F.col("config_id"))).alias(f"first_{name}")]


def _raise(row, rules: dict[str, str]) -> None:
    broken = [f"{say} ({row[f'n_{name}']} configurations, the first is {row[f'first_{name}']})" for name, say in rules.items() if row[f"n_{name}"]]
    if broken:
        raise InvalidInput("; ".join(broken))


def _cutoff(cutoff: float) -> None:
    if not cutoff > 0 or cutoff == float("inf"):
        raise InvalidInput(f"a cutoff must be positive and finite, not {cutoff}")


def _cell_rules(cutoff: float) -> tuple[dict[str, Column], dict[str, str]]:
    low = F.least("height0", "height1", "height2")
    bad = {"singular": F.col("pbc") & F.col("i00").isNull(), "low": F.col("pbc") & F.col("i00").isNotNull() & (low <= 2 * cutoff)}
    return bad, {"singular": "cells without an inverse", "low": f"heights must be over {2 * cutoff}"}


def check_cells(cells: DataFrame, cutoff: float) -> None:
    """Periodic cells have an inverse, and all heights are more than twice the cutoff. One job."""
    _cutoff(cutoff)
    bad, say = _cell_rules(cutoff)
    _raise(G.with_geometry(cells).agg(*(c for n, b in bad.items() for c in _count(F.coalesce(b, F.lit(False)), n))).first(), say)


def check(atoms: DataFrame, cells: DataFrame, cutoff: float, n_elem: int) -> frozenset:
    """All rules for cells and atoms in one job: atoms are summed by configuration and atom, met with the cells,
    and what breaks a rule is counted. Besides check_cells(): each cell has atoms, each atom a cell, a type
    below n_elem, finite coordinates and an id of its own. Returns the kinds of cells, pbc or not."""
    _cutoff(cutoff)
    wrong = F.col("type").isNull() | (F.col("type") < 0) | (F.col("type") >= n_elem)
    lost = F.greatest(*(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")) for c in "xyz"))
    each = atoms.groupBy("config_id", "atom_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(lost).alias("lost"))
    sums = each.groupBy("config_id").agg(F.sum("n").alias("n"), F.count_if((F.col("n") > 1) | F.col("atom_id").isNull()).alias("again"), F.sum("wrong").alias("wrong"), F.sum("lost").alias("lost"))
    both = G.with_geometry(cells).withColumn("has_cell", F.lit(True)).join(sums, "config_id", "full")
    bad, say = _cell_rules(cutoff)
    bad |= {"empty": F.col("n").isNull(), "no_cell": F.col("has_cell").isNull(), "again": F.col("again") > 0, "wrong": F.col("wrong") > 0, "lost": F.col("lost") > 0}
    say |= {"empty": "cells without atoms", "no_cell": "atoms without a cell", "again": "ids must be there and differ", "wrong": f"types must be 0 to {n_elem - 1}", "lost": "coordinates must be finite"}
    row = both.agg(F.count_if("pbc").alias("periodic"), F.count_if(~F.col("pbc")).alias("open"), *(c for n, b in bad.items() for c in _count(F.coalesce(b, F.lit(False)), n))).first()
    _raise(row, say)
    return frozenset(k for k, n in ((True, row["periodic"]), (False, row["open"])) if n)


def check_atoms(atoms: DataFrame, cells: DataFrame, n_elem: int) -> None:
    """The rules of check() without those for cells' heights."""
    check(atoms, cells.withColumn("pbc", F.lit(False)), 1.0, n_elem)


def check_lists(lists: DataFrame, atoms: DataFrame) -> None:
    """Neighbour lists (config_id, i, start, n, list) are those of the atoms: each atom has one, none names itself
    or an id out of range, all are sorted without repeats, and the stretches [start, start + n) tile the
    numbers up to their sum. That they do shows in sums: (start + n)^2 - start^2 adds up to the square of
    the whole. One job."""
    ids = atoms.groupBy("config_id").agg(F.count("*").alias("atoms"), F.min("atom_id").alias("least"), F.max("atom_id").alias("most"))
    start, n = F.col("start").cast("decimal(18,0)"), F.col("n").cast("decimal(18,0)")
    own = F.exists("list", lambda j: j == F.col("i")) | (F.sort_array(F.array_distinct("list")) != F.col("list")) | (F.size("list") != F.col("n"))
    sums = lists.groupBy("config_id").agg(
        F.count("*").alias("lists"), F.sum("i").alias("sum_i"), F.count_if(own).alias("own"), F.min(F.array_min("list")).alias("low"), F.max(F.array_max("list")).alias("high"),
        F.min("start").alias("first"), F.sum("n").alias("whole"), F.max(F.col("start") + F.col("n")).alias("end"), F.sum(n * (start + start + n)).alias("squares"),
    )
    both = sums.join(ids, "config_id", "full")
    whole = F.col("whole").cast("decimal(18,0)")
    bad = {
        "number": ~F.col("lists").eqNullSafe(F.col("atoms")), "order": F.col("own") > 0, "range": (F.col("low") < F.col("least")) | (F.col("high") > F.col("most")),
        "starts": (F.col("first") != 0) | (F.col("end") != F.col("whole")) | (F.col("squares") != whole * whole),
    }
    say = {"number": "each atom has one list", "order": "lists are sorted, without repeats or the atom itself", "range": "lists name atoms that aren't there", "starts": "starts must follow on each other"}
    _raise(both.agg(*(c for k, b in bad.items() for c in _count(F.coalesce(b, F.lit(False)), k))).first(), say)


def with_types(atoms: DataFrame, elements: list[str], symbol: str = "symbol") -> DataFrame:
    """atoms with the type of their element symbol; unknown symbols are named in the error."""
    known = atoms.sparkSession.createDataFrame(list(enumerate(elements)), "type int, element string")
    unknown = atoms.join(known, F.col(symbol) == F.col("element"), "left_anti").select(symbol).distinct()
    _first(unknown.orderBy(symbol), f"elements that the potential ({', '.join(elements)}) doesn't have")
    return atoms.join(F.broadcast(known), F.col(symbol) == F.col("element")).drop("element")  # one row per element
