"""DuckDB text for the queries: plain all-pairs forms, written apart from the library's plans."""

from __future__ import annotations

A0, RC = 3.615, 4.95
NINE = [f"{i}{j}" for i in range(3) for j in range(3)]

#: Lattice atoms made from part, and their cell.
PART_ATOMS = f"""
select 'part' as config_id, p_partkey as atom_id, (p_size % 2)::int as type,
  {A0}::double * ((p_partkey // 4) % rep + case p_partkey % 4 when 2 then 0.5 when 3 then 0.5 else 0 end::double) + 0.05::double * (((p_partkey * 7919) % 1000) / 1000.0::double - 0.5::double) as x,
  {A0}::double * (((p_partkey // 4) // rep) % rep + case p_partkey % 4 when 1 then 0.5 when 3 then 0.5 else 0 end::double) + 0.05::double * (((p_partkey * 104729) % 1000) / 1000.0::double - 0.5::double) as y,
  {A0}::double * ((p_partkey // 4) // (rep * rep) + case p_partkey % 4 when 1 then 0.5 when 2 then 0.5 else 0 end::double) + 0.05::double * (((p_partkey * 1299709) % 1000) / 1000.0::double - 0.5::double) as z
from part, (select min(r) as rep from range(1, 400) t(r) where 4 * r * r * r >= (select count(*) from part)) q
"""
PART_CELLS = f"""
select 'part' as config_id, true as pbc, l as h00, 0.0::double as h01, 0.0::double as h02, 0.0::double as h10, l as h11, 0.0::double as h12, 0.0::double as h20, 0.0::double as h21, l as h22
from (select {A0}::double * min(r) as l from range(1, 400) t(r) where 4 * r * r * r >= (select count(*) from part))
"""


def cells_values(rows) -> str:
    """Literal cells (config_id, nine numbers or None)."""
    out = [f"('{c}', {'true' if m is not None else 'false'}, " + ", ".join(f"{float(v)!r}::double" if m is not None else "null::double" for v in (m or [None] * 9)) + ")" for c, m in rows]
    return f"select * from (values {', '.join(out)}) t(config_id, pbc, {', '.join('h' + k for k in NINE)})"


def geometry(cells: str = "cells") -> str:
    """A select with inverse, volume and heights."""
    h = [[f"h{i}{j}" for j in range(3)] for i in range(3)]
    cof = lambda i, j: f"({h[(i + 1) % 3][(j + 1) % 3]} * {h[(i + 2) % 3][(j + 2) % 3]} - {h[(i + 1) % 3][(j + 2) % 3]} * {h[(i + 2) % 3][(j + 1) % 3]})"
    det = "(" + " + ".join(f"{h[0][j]} * {cof(0, j)}" for j in range(3)) + ")"
    inv = ", ".join(f"{cof(j, i)} / {det} as i{i}{j}" for i in range(3) for j in range(3))
    hs = ", ".join(f"abs({det}) / sqrt({' + '.join(f'{cof(k, j)} * {cof(k, j)}' for j in range(3))}) as height{k}" for k in range(3))
    return f"select *, {inv}, abs({det}) as volume, {hs} from {cells}"


def image(d: list[str]) -> list[str]:
    s = ["(" + " + ".join(f"{d[i]} * i{i}{k}" for i in range(3)) + ")" for k in range(3)]
    s = [f"({v} - round_even({v}, 0))" for v in s]
    return ["(" + " + ".join(f"{s[i]} * h{i}{k}" for i in range(3)) + ")" for k in range(3)]


def pairs(atoms: str, cells: str, rc: float = RC, lowest: str = "r2 > 1e-4", extra: str = "") -> str:
    """CTEs atoms, cells, geo, pairs."""
    d = [f"(b.{c} - a.{c})" for c in "xyz"]
    moved = ", ".join(f"case when pbc then {m} else {v} end as d{c}" for m, v, c in zip(image(d), d, "xyz"))
    return f"""with recursive atoms as ({atoms}), cells as ({cells}), geo as ({geometry()}), raw as (
  select a.config_id, a.atom_id as i, b.atom_id as j, a.type as ti, b.type as tj, {moved}
  from atoms a join atoms b on a.config_id = b.config_id and a.atom_id <> b.atom_id join geo g on g.config_id = a.config_id
), pairs as (select * from (select *, dx * dx + dy * dy + dz * dz as r2 from raw) where r2 < {rc * rc!r}::double and {lowest}{extra})"""


def eam(atoms: str, cells: str, rc: float = RC, scales=(1.0, 0.9), pair_scales=(1.0, 0.95, 0.9)) -> str:
    """CTEs up to dens, per_atom and totals, with the analytic potential."""
    s = lambda t: f"(case {t} when 1 then {scales[1]}::double else {scales[0]}::double end)"
    p = f"(case ti + tj when 0 then {pair_scales[0]}::double when 1 then {pair_scales[1]}::double else {pair_scales[2]}::double end)"
    r, c = "sqrt(r2)", f"{rc}::double"
    force = f"((-{s('ti')} / (2 * sqrt(di.rho + 0.01)) * {s('tj')} + -{s('tj')} / (2 * sqrt(dj.rho + 0.01)) * {s('ti')}) * -2 * ({c} - {r}) / ({c} * {c}) + -2 * {p} * ({c} - {r})) / {r}"
    voigt = (("xx", "x", "x"), ("yy", "y", "y"), ("zz", "z", "z"), ("yz", "y", "z"), ("xz", "x", "z"), ("xy", "x", "y"))
    return f"""{pairs(atoms, cells, rc)}, dens as (
  select a.config_id, a.atom_id, a.type, a.x, a.y, a.z, coalesce(sum({s('p.tj')} * (({c} - {r}) / {c}) * (({c} - {r}) / {c})), 0) as rho, coalesce(sum({p} * ({c} - {r}) * ({c} - {r}) / 2), 0) as pair_energy, count(p.i) as n_partners
  from atoms a left join pairs p on p.config_id = a.config_id and p.i = a.atom_id group by all
), frc as (
  select p.config_id, p.i as atom_id, sum(pull * dx) as fx, sum(pull * dy) as fy, sum(pull * dz) as fz, {', '.join(f'sum(-0.5::double * d{q} * pull * d{t}) as w_{n}' for n, q, t in voigt)}
  from (select p.*, {force} as pull from pairs p join dens di on di.config_id = p.config_id and di.atom_id = p.i join dens dj on dj.config_id = p.config_id and dj.atom_id = p.j) p group by all
), per_atom as (
  select d.*, -{s('type')} * sqrt(rho + 0.01) as embedding, -{s('type')} * sqrt(rho + 0.01) + pair_energy as energy, {', '.join(f'coalesce({k}, 0) as {k}' for k in ('fx', 'fy', 'fz', *('w_' + n for n, *_ in voigt)))}
  from dens d left join frc f on f.config_id = d.config_id and f.atom_id = d.atom_id
), totals as (
  select t.*, volume, {', '.join(f'coalesce(case when pbc then -w_{n} / volume end, 0) as s_{n}' for n, *_ in voigt)}
  from (select config_id, count(*) as n_atoms, sum(energy) as energy, {', '.join(f'sum(w_{n}) as w_{n}' for n, *_ in voigt)} from per_atom group by config_id) t join geo g on g.config_id = t.config_id
)"""


def r6(*names: str) -> str:
    """Columns rounded to six decimals, without negative zeros."""
    return ", ".join(f"round({n.split(' as ')[0]}, 6) + 0.0 as {n.split(' as ')[-1]}" for n in names)


def fcc(config: str, a: str, rep: int, extra_from: str = "", basis: str = "(0,0,0,0),(1,0,0.5,0.5),(2,0.5,0,0.5),(3,0.5,0.5,0)") -> str:
    """Atoms of an FCC crystal; config and a may be expressions over extra_from."""
    n = basis.count("(")
    return f"""select {config} as config_id, u * {n} + b as atom_id, 0 as type, {a} * (u % {rep} + bx) as x, {a} * ((u // {rep}) % {rep} + by_) as y, {a} * (u // {rep * rep} + bz) as z
from range({rep**3}) q(u), (values {basis}) k(b, bx, by_, bz){extra_from}"""


#: Trajectory made from events: a particle for each user, places from the values in a box of 40.
TRAJECTORY = """
select 'events' as config_id, (row_number() over w - 1)::int as frame, user_id as atom_id,
  fmod(value, 40) as x, fmod(value * 1.7::double, 40) as y, fmod(value * 2.3::double, 40) as z,
  fmod(value * 0.37::double, 5) - 2.5 as vx, fmod(value * 0.59::double, 5) - 2.5 as vy, fmod(value * 0.83::double, 5) - 2.5 as vz
from events window w as (partition by user_id order by ts, event_id)
"""
