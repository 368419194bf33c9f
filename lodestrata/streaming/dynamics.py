"""Leapfrog steps over DataFrames, and evaluation of frames as a stream brings them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import InvalidInput
from ..schema import ATOMS


def leapfrog(state: DataFrame, forces: DataFrame, dt: float, inverse_mass) -> DataFrame:
    """One step of (config_id, atom_id, type, x, y, z, vx, vy, vz): v += f / m dt, then x += v dt.
    inverse_mass: a number, or one for each type; for A/ps^2 from eV/A it is 9648.5 over atomic mass units."""
    per_type = list(inverse_mass) if isinstance(inverse_mass, (list, tuple)) else [inverse_mass]
    im = F.lit(float(per_type[0]))
    for k, v in enumerate(per_type[1:], 1):
        im = F.when(F.col("type") == k, float(v)).otherwise(im)
    both = state.join(forces.select("config_id", "atom_id", "fx", "fy", "fz"), ["config_id", "atom_id"])
    faster = both.withColumns({f"v{c}": F.col(f"v{c}") + F.col(f"f{c}") * im * dt for c in "xyz"})
    return faster.withColumns({c: F.col(c) + F.col(f"v{c}") * dt for c in "xyz"}).select(*state.columns)


def run(engine: Engine, atoms: DataFrame, cells: DataFrame, steps: int, dt: float, inverse_mass, every: int = 5) -> DataFrame:
    """The state after `steps` steps from rest. Every few steps it is written to the folder of
    spark.checkpoint.dir, so plans stay short and a lost executor costs those steps at most."""
    state = atoms.withColumns({f"v{c}": F.lit(0.0) for c in "xyz"})
    folder = atoms.sparkSession.conf.get("spark.checkpoint.dir", None) or atoms.sparkSession.sparkContext.getCheckpointDir()
    if steps > every and not folder:
        raise InvalidInput("set spark.checkpoint.dir for runs of many steps")
    for n in range(1, steps + 1):
        forces = engine.compute(state.select(*ATOMS.names), cells).per_atom
        state = leapfrog(state, forces, dt, inverse_mass)
        if n % every == 0 and n < steps:
            path = f"{folder.rstrip('/')}/lodestrata/state-{uuid.uuid4().hex}"
            state.write.parquet(path)
            state = atoms.sparkSession.read.parquet(path)
    return state


def evaluate_stream(frames: DataFrame, cells: DataFrame, engine: Engine, path: str, checkpoint: str):
    """Starts a query that writes the totals of each frame (as its own config_id) that arrives; an addition
    of this library. A batch that runs again writes its own folder again."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        here = cells.join(batch.select("config_id").distinct(), "config_id", "left_semi")
        engine.compute_stress(batch, here).totals.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return frames.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
