"""Periodic cells as columns. A cell's rows are its lattice vectors, h00..h22; a row vector of fractional
coordinates s and a Cartesian one d are related by d = s H and s = d H^-1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

H = [[f"h{i}{j}" for j in range(3)] for i in range(3)]
INV = [[f"i{i}{j}" for j in range(3)] for i in range(3)]
#: A determinant below this has no inverse.
SINGULAR = 1e-30


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]


def _dot(a, b) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b)])


def norm(a) -> Column:
    return F.sqrt(_dot(a, a))


def vectors() -> list[list[Column]]:
    return [[F.col(c) for c in row] for row in H]


def determinant() -> Column:
    a, b, c = vectors()
    return _dot(a, _cross(b, c))


def volume() -> Column:
    return F.abs(determinant())


def inverse() -> dict[str, Column]:
    """i00..i22; null where the cell is singular."""
    a, b, c = vectors()
    det = determinant()
    columns = [_cross(b, c), _cross(c, a), _cross(a, b)]
    return {INV[i][j]: F.when(F.abs(det) >= SINGULAR, columns[j][i] / det) for i in range(3) for j in range(3)}


def heights() -> list[Column]:
    """Distances of the cell's opposite faces; null for a face without an area."""
    a, b, c = vectors()
    return [F.try_divide(volume(), norm(n)) for n in (_cross(b, c), _cross(c, a), _cross(a, b))]


def angles() -> list[Column]:
    """alpha, beta, gamma in degrees."""
    a, b, c = vectors()
    return [F.degrees(F.acos(_dot(p, q) / (norm(p) * norm(q)))) for p, q in ((b, c), (a, c), (a, b))]


def with_geometry(cells: DataFrame) -> DataFrame:
    """cells with inverse, volume and the three heights."""
    return cells.withColumns({**inverse(), "volume": volume(), **{f"height{k}": h for k, h in enumerate(heights())}})


def is_orthorhombic() -> Column:
    return reduce(lambda x, y: x & y, [F.abs(F.col(H[i][j])) < 1e-6 for i in range(3) for j in range(3) if i != j])


def fractional(x, y, z) -> list[Column]:
    d = [F.col(c) if isinstance(c, str) else c for c in (x, y, z)]
    return [_dot(d, [F.col(INV[i][k]) for i in range(3)]) for k in range(3)]


def cartesian(s: list[Column]) -> list[Column]:
    return [_dot(s, [F.col(H[i][k]) for i in range(3)]) for k in range(3)]


def wrapped(s: Column) -> Column:
    """s in [0, 1); a fraction that rounds up to 1 is 0."""
    w = s - F.floor(s)
    return F.when(w >= 1, F.lit(0.0)).otherwise(w)


def minimum_image(dx: Column, dy: Column, dz: Column, pbc: Column | None = None) -> list[Column]:
    """The shortest image of a displacement (halves go to the even side); as it is where pbc is false."""
    moved = cartesian([s - F.rint(s) for s in fractional(dx, dy, dz)])
    return moved if pbc is None else [F.when(pbc, m).otherwise(d) for m, d in zip(moved, (dx, dy, dz))]


def grid_size(height: Column, width: float) -> Column:
    return F.greatest(F.lit(1), F.floor(height / width)).cast("int")


def grid_index(s: Column, n: Column) -> Column:
    """Cell of a wrapped fraction; the last cell takes what rounds up to n."""
    raw = F.floor(s * n).cast("int")
    return F.when(raw == n, n - 1).otherwise(F.pmod(raw, n))


def power_of_two(n: Column, up: bool = False) -> Column:
    exponent = F.log2(n.cast("double"))
    return F.pow(F.lit(2.0), F.ceil(exponent - 1e-12) if up else F.floor(exponent + 1e-12)).cast("int")


def power_of_two_within(n: Column, height: Column, width: float) -> Column:
    """The next power of two where grid cells of this height stay at least `width` wide, else the one below."""
    up = power_of_two(n, True)
    return F.when(height / up >= width, up).otherwise(power_of_two(n))


#: Masks that leave two zero bits after each bit of a number of 21 bits.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
_LOW = 0x1FFFFF


def _spread(v: Column) -> Column:
    """The 21 low bits of v, two zero bits after each."""
    v = v.cast("long").bitwiseAND(_LOW)
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """Z-order code of three numbers below 2^21."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def unmorton(code: Column) -> list[Column]:
    out = []
    for k in range(3):
        v = F.shiftright(code, k).bitwiseAND(_SPREAD[-1][1])
        for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [_LOW]):
            v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(mask)
        out.append(v)
    return out


def morton_space(nx: Column, ny: Column, nz: Column) -> Column:
    """One more than the largest code of a grid whose sizes go up to powers of two. It exceeds the number of
    cells where the grid isn't a cube."""
    return morton(*(power_of_two(n, True) - 1 for n in (nx, ny, nz))) + 1


def rattle(key: Column, prime: int, size: float) -> Column:
    """A shift in [-size/2, size/2) that depends on the key alone."""
    return F.lit(size) * (F.pmod(key * prime, F.lit(1000)) / F.lit(1000.0) - F.lit(0.5))


def strained(deformation: str = "m") -> dict[str, Column]:
    """h00..h22 of a cell times a matrix m00..m22."""
    return {H[i][j]: _dot([F.col(H[i][k]) for k in range(3)], [F.col(f"{deformation}{k}{j}") for k in range(3)]) for i in range(3) for j in range(3)}
