"""The public interface: a potential, a way to find pairs, and what to compute.

    engine = Engine(potential, strategy="auto")
    engine.compute(atoms, cells)           # energies and forces
    engine.compute_stress(atoms, cells)    # and the configurations' stresses
    engine.compute_per_atom(atoms, cells)  # and densities, embedding energies, atoms' virials and stresses

All take any number of configurations at once and return a Result of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .functions.potentials import Potential
from .operators import eam, neighbors, validation
from .operators.stored import stored


@dataclass
class Result:
    per_atom: DataFrame
    totals: DataFrame


class Engine:
    def __init__(self, potential: Potential, strategy: str = "auto", skin: float = 0.0, validate: bool = True, persist: bool = False, elements: list[str] | None = None, cell_size: float | None = None):
        self.potential, self.strategy, self.skin, self.validate, self.persist, self.cell_size = potential, strategy, skin, validate, persist, cell_size
        meta = getattr(potential, "meta", {})
        self.elements = elements or meta.get("elements") or [str(k) for k in range(len(getattr(potential, "density_scale", (1,))))]

    @property
    def n_elements(self) -> int:
        return len(self.elements)

    @property
    def cutoff(self) -> float:
        return self.potential.cutoff

    @property
    def backend(self) -> str:
        return "spark"

    def pairs(self, atoms: DataFrame, cells: DataFrame) -> DataFrame:
        """Evaluated pairs; with persist they are kept between the two passes instead of made twice."""
        found = self._evaluated(atoms, cells, self._strategy(atoms), kinds=self._check(atoms, cells))
        return found.persist() if self.persist else found

    def _check(self, atoms: DataFrame, cells: DataFrame) -> frozenset:
        """The kinds of cells, periodic or not; with validation all rules are checked in the same job."""
        if self.validate:
            return validation.check(atoms, cells, self.cutoff, self.n_elements)
        return neighbors.kinds_of(cells)

    def _evaluated(self, atoms: DataFrame, cells: DataFrame, strategy: str, carry: tuple[str, ...] = (), kinds: frozenset | None = None) -> DataFrame:
        width = {"width": self.cell_size} if strategy == "cell_list" else {}
        return self.potential.at_pairs(neighbors.pairs(atoms, cells, self.cutoff, strategy, carry=carry, kinds=kinds, **width))

    def _strategy(self, atoms: DataFrame) -> str:
        return neighbors.chosen(atoms) if self.strategy == "auto" else self.strategy

    def _all(self, atoms: DataFrame, cells: DataFrame) -> DataFrame:
        if self.persist:
            found = self.pairs(atoms, cells)
            return eam.forces_and_virials(eam.densities(atoms, found, self.potential), found)
        strategy, kinds = self._strategy(atoms), self._check(atoms, cells)
        dense = stored(eam.densities(atoms, self._evaluated(atoms, cells, strategy, kinds=kinds), self.potential), "dense")
        return eam.forces_and_virials(dense, self._evaluated(dense, cells, strategy, ("dembedding",), kinds))

    def compute(self, atoms: DataFrame, cells: DataFrame) -> Result:
        full = self._all(atoms, cells)
        per_atom = full.select("config_id", "atom_id", "energy", "fx", "fy", "fz")
        return Result(per_atom, eam.totals(per_atom, cells).select("config_id", "n_atoms", "energy"))

    def compute_stress(self, atoms: DataFrame, cells: DataFrame) -> Result:
        full = self._all(atoms, cells)
        return Result(full.select("config_id", "atom_id", "energy", "fx", "fy", "fz"), eam.totals(full, cells))

    def compute_per_atom(self, atoms: DataFrame, cells: DataFrame) -> Result:
        full = self._all(atoms, cells)
        return Result(eam.atom_stresses(full, cells), eam.totals(full, cells))

    def energies(self, atoms: DataFrame, cells: DataFrame) -> DataFrame:
        """Energies without forces: one sum over pairs, no join of pairs."""
        return eam.densities_and_energies(atoms, self.pairs(atoms, cells), self.potential)

    def debug_cells(self, atoms: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(atoms with their cells, occupied cells with counts and starts)."""
        binned = neighbors.assign_cells(atoms, cells, self.cutoff)
        return binned, neighbors.occupancy(binned)
