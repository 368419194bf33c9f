"""Explicit schemas. Every relation carries config_id, so an ensemble of configurations is one job."""

from pyspark.sql import types as T


def _of(**columns):
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
ATOMS = _of(config_id=S, atom_id=L, type=I, x=D, y=D, z=D)
CELLS = _of(config_id=S, pbc=B, **{f"h{i}{j}": D for i in range(3) for j in range(3)})
POT_META = _of(pot_id=S, n_elem=I, elements=T.ArrayType(S), nrho=I, drho=D, nr=I, dr=D, cutoff=D)
POT_GRID = _of(pot_id=S, kind=S, key=I, k=I, value=D)
POT_SPLINE = _of(pot_id=S, kind=S, key=I, k=I, x=D, a=D, b=D, c=D, d=D)
PAIRS = _of(config_id=S, i=L, j=L, ti=I, tj=I, dx=D, dy=D, dz=D, r2=D)
TRAJECTORY = _of(config_id=S, frame=I, t=D, atom_id=L, x=D, y=D, z=D, vx=D, vy=D, vz=D)
THERMO = _of(config_id=S, step=I, t=D, temperature=D, e_pot=D, volume=D)
