"""DuckDB SQL for the queries of plans.queries, and the parameters that both use."""

from __future__ import annotations

from .trajectories import CELL, FRACTIONS, GRID, NET, TRAJ

CUTOFFS = [("P", "O", 2.9), ("Al", "O", 2.9)]
MODIFIER = [("Zn", "O", 2.3)]
WEIGHTS = {"Si": 28.0, "O": 16.0}
#: Coherent neutron scattering lengths in fm, and the five-Gaussian X-ray form factors of Waasmaier and Kirfel (a, s, c).
LENGTHS = {"O": 5.803, "Si": 4.1491}
XRAY = {
    "O": ([2.960427, 2.508818, 0.637853, 0.7228380, 1.142756], [14.18226, 5.936858, 0.112726, 34.95848, 0.3902400], 0.027014),
    "Si": ([5.275329, 3.191038, 1.511514, 1.356849, 2.519114], [2.631338, 33.73073, 0.081119, 86.28864, 1.170087], 0.145073),
}
STATES = [("O", 3.44, -2), ("O", 3.44, -1), ("Si", 1.90, 4), ("Si", 1.90, 2), ("Si", 1.90, -4)]

_A = TRAJ.format(part="part", nation="nation")
_T = FRACTIONS.format(part="part", nation="nation")
_STEP = ", ".join(f"d{x} - floor(d{x} + 0.5e0) as s{x}" for x in "xyz")
_ALONG = ", ".join(f"first_value({{{x}}}) over w + sum(coalesce(s{x}, 0e0)) over w as u{x}" for x in "xyz")


def _unwrapped(source: str, frac: dict[str, str]) -> str:
    diff = ", ".join(f"({frac[x]}) - lag({frac[x]}) over v as d{x}" for x in "xyz")
    return f"""select *, {_ALONG.format(**frac)} from (select *, {_STEP} from (select *, {diff} from {source} window v as (partition by file, aid order by frame)))
 window w as (partition by file, aid order by frame rows unbounded preceding)"""


_NF = "nf as (select file, max(frame) + 1 as n, count(distinct frame) as nf from a group by file)"
_HEAD = f"with a as ({_A}), u as ({_unwrapped('a', {x: f'{x} / 16e0' for x in 'xyz'})}), {_NF}"
_CELLS = ", ".join(f"{e} as {c}" for c, e in CELL.items())
_DET = "m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20)"
_XYZ = ", ".join(f"fx * m0{k} + fy * m1{k} + fz * m2{k} as {x}" for k, x in enumerate("xyz"))
_TILT = f"""with t as (select *, {_CELLS} from ({_T})), a as (select *, abs({_DET}) as volume, {_XYZ} from t),
u as ({_unwrapped('a', {x: f'f{x}' for x in 'xyz'})}), {_NF}"""


def _pairs(source: str, cut: str) -> str:
    """p: ordered pairs of the cube."""
    d = ", ".join(f"(b.{x} - a.{x}) / 16e0 as h{x}" for x in "xyz")
    h = ", ".join(f"(h{x} - floor(h{x} + 0.5e0)) * 16e0 as d{x}" for x in "xyz")
    return f"""p as (select *, dx * dx + dy * dy + dz * dz as d2 from (select file, frame, a, b, el_a, el_b, {h} from (
select a.file, a.frame, a.aid as a, b.aid as b, a.element as el_a, b.element as el_b, {d}
from {source} a join {source} b on a.file = b.file and a.frame = b.frame and a.aid <> b.aid)) where dx * dx + dy * dy + dz * dz < {cut} * {cut})"""


def _tilted_pairs(cut: str) -> str:
    d = ", ".join(f"b.f{x} - a.f{x} as g{x}" for x in "xyz")
    h = ", ".join(f"g{x} - floor(g{x} + 0.5e0) as h{x}" for x in "xyz")
    c = ", ".join(f"hx * m0{k} + hy * m1{k} + hz * m2{k} as d{x}" for k, x in enumerate("xyz"))
    return f"""p as (select *, dx * dx + dy * dy + dz * dz as d2 from (select file, frame, a, b, el_a, el_b, volume, {c} from (select *, {h} from (
select a.*, a.aid as a, b.aid as b, a.element as el_a, b.element as el_b, {d} from a join a b on a.file = b.file and a.frame = b.frame and a.aid <> b.aid)))
where dx * dx + dy * dy + dz * dz < {cut} * {cut})"""


def _gr(low: str, dr: str, bins: int, volume: str, pairs: str, head: str) -> str:
    r = f"({low} + (g.bin + 0.5e0) * {dr})"
    return f"""{head}, {pairs}, n as (select file, element, count(*) / any_value(nf) as n from a join nf using (file) group by file, element),
h as (select file, el_a, el_b, floor((sqrt(d2) - {low}) / {dr})::bigint as bin, count(*) as k, sum({volume}) as kv from p where sqrt(d2) >= {low} group by all),
g as (select x.file, x.element as center, y.element as neighbor, x.n as na, case when x.element = y.element then y.n - 1 else y.n end as np, bin, sum(x.n) over (partition by x.file, y.element, bin) as n_all
  from n x join n y using (file), (select unnest(range({bins}))::bigint as bin) b)
select g.file, g.bin, round({r}, 6) as r, center, neighbor, (coalesce(k, 0) / case when center = neighbor then 2 else 1 end)::bigint as count,
round(coalesce(kv, 0) / (4e0 * pi() * pow({r}, 2) * {dr} * np * na * nf), 6) as gr,
round(coalesce(k, 0) * n_all / (4e0 * pi() * pow({r}, 2) * {dr} * np * na * nf), 6) as rho_g,
round(sum(coalesce(k, 0)) over (partition by g.file, center, neighbor order by g.bin) / (na * nf), 6) as cn
from g join nf using (file) left join h on h.file = g.file and h.el_a = center and h.el_b = neighbor and h.bin = g.bin"""


_GR = _gr("0.01e0", "0.23e0", 17, "4096e0", _pairs("a", "4e0"), _HEAD)
_FORM = lambda x: " + ".join(f"{a}e0 * exp(-{s}e0 * pow(q / (4e0 * pi()), 2))" for a, s in zip(*XRAY[x][:2], strict=True)) + f" + {XRAY[x][2]}e0"
# exact counts, so that S(q) doesn't start from rounded values
_SQ = f"""{_HEAD}, {_pairs("a", "4e0")}, n as (select file, element, count(*) / any_value(nf) as n, any_value(nf) as nf from a join nf using (file) group by file, element),
h as (select file, el_a, el_b, floor((sqrt(d2) - 0.01e0) / 0.23e0)::bigint as bin, count(*) as k from p where sqrt(d2) >= 0.01e0 group by all),
g as (select x.file, x.element as center, y.element as neighbor, x.n as na, case when x.element = y.element then y.n - 1 else y.n end as np, x.nf, bin, 0.01e0 + (bin + 0.5e0) * 0.23e0 as r, t.n_all
  from n x join n y on x.file = y.file and x.element <= y.element join (select file, sum(n) as n_all from n group by file) t on t.file = x.file, (select unnest(range(17))::bigint as bin) b),
rg as (select g.file, center, neighbor, r, n_all / 4096e0 as rho, coalesce(k, 0) * n_all / (4e0 * pi() * r * r * 0.23e0 * np * na * nf) as rho_g
  from g left join h on h.file = g.file and h.el_a = center and h.el_b = neighbor and h.bin = g.bin),
s as (select file, center, neighbor, k::int as k, 0.5e0 + k * 0.5e0 as q, sum(r * (rho_g - rho) * sin((0.5e0 + k * 0.5e0) * r) * 0.23e0) as i from rg, (select unnest(range(10)) as k) group by all),
sq as (select file, center, neighbor, k, q, 1e0 + 4e0 * pi() / q * i as sq from s)"""


def _weighted(f_o: str, f_si: str) -> str:
    return f"""{_SQ}, c as (select file, max(n) filter (where element = 'O') / sum(n) as c_o, max(n) filter (where element = 'Si') / sum(n) as c_si from n group by file),
f as (select sq.*, c_o * ({f_o}) as p_o, c_si * ({f_si}) as p_si from sq join c using (file)),
w as (select *, case when center = neighbor then 1e0 else 2e0 end * case center when 'O' then p_o else p_si end * case neighbor when 'O' then p_o else p_si end / pow(p_o + p_si, 2) * sq as part from f)
select file, center, neighbor, k, round(q, 6) as q, round(sq, 6) as sq, round(part, 6) as part, round(sum(part) over (partition by file, k), 6) as total from w"""


_DOT = " + ".join(f"(o.v{x} * e.v{x})" for x in "xyz")
_MSD = " + ".join(f"((e.u{x} - o.u{x}) * 32e0 * 0.5e0) * ((e.u{x} - o.u{x}) * 32e0 * 0.5e0)" for x in "xyz")
_LAG = "o join e on o.file = e.file and o.aid = e.aid and e.frame - o.frame between 0 and {last} join nf on nf.file = o.file where o.frame % {shift} = 0 and o.frame + {lags} <= nf.n"
_MSD10 = f"{_HEAD}, o as (from u), e as (from u), m as (select o.file, (e.frame - o.frame)::int as lag, (e.frame - o.frame)::double as time, avg({_MSD}) as msd from {_LAG.format(last=9, lags=10, shift=1)} group by all)"
_MEAN_CELL = {k: " + ".join(f"(e.u{x} - o.u{x}) * (o.m{i}{k} + e.m{i}{k}) * 0.5e0" for i, x in enumerate("xyz")) for k in range(3)}
_NPT = " + ".join(f"pow({_MEAN_CELL[k]}, 2)" for k in range(3))
_AXIS = {x: f"pow(e.u{x} - o.u{x}, 2) * (" + " + ".join(f"e.m{i}{k} * e.m{i}{k}" for k in range(3)) + ")" for i, x in enumerate("xyz")}
_PLAIN = {x: f"pow(e.{x} - o.{x}, 2)" for x in "xyz"}


def _parts(parts: dict[str, str]) -> str:
    return ", ".join(f"round(avg({p}), 6) as msd_{n}" for p, n in zip(parts.values(), "abc", strict=True))


def _shifted(tau: int) -> str:
    lead = ", ".join(f"(lead(u{x}, {tau}) over w - u{x}) * 16e0 as r{x}" for x in "xyz")
    return f"m as (select * from (select *, {lead} from u window w as (partition by file, aid order by frame)) where rx is not null), q as (select *, rx * rx + ry * ry + rz * rz as dist2 from m)"


def _hove(head: str, moved: str, low: str, high: str, dr: str, bins: int, where: str = "true") -> str:
    return f"""{head}, {moved}, k as (select * from q where {where}), tt as (select file, count(*) as total from k group by file),
h as (select file, floor((sqrt(dist2) - {low}) / {dr})::bigint as bin, count(*) as c from k where sqrt(dist2) >= {low} and sqrt(dist2) < {high} group by all)
select tt.file, b.bin, round({low} + (b.bin + 0.5e0) * {dr}, 6) as r, coalesce(c, 0)::bigint as count, round(coalesce(c, 0) / total, 6) as gs
from tt cross join (select unnest(range({bins}))::bigint as bin) b left join h on h.file = tt.file and h.bin = b.bin"""


_OWN = ", ".join(f"ux * m0{k} + uy * m1{k} + uz * m2{k} as c{x}" for k, x in enumerate("xyz"))
_TILT_MOVED = f"""c as (select *, {_OWN} from u), m as (select *, {", ".join(f"lead(c{x}, 4) over w - c{x} as r{x}" for x in "xyz")} from c window w as (partition by file, aid order by frame)),
q as (select *, rx * rx + ry * ry + rz * rz as dist2 from m where rx is not null)"""
_AHEAD = ", ".join(f"lead({c}, 3) over w as e_{c}" for c in ["ux", "uy", "uz", *CELL])
_JUMP = " + ".join("pow(" + " + ".join(f"(e_u{x} - u{x}) * (m{i}{k} + e_m{i}{k}) * 0.5e0" for i, x in enumerate("xyz")) + ", 2)" for k in range(3))
_MID = ", ".join(f"floor(((u{x} + e_u{x}) * 0.5e0 - floor((u{x} + e_u{x}) * 0.5e0)) * {n})::bigint as i{x}" for x, n in zip("xyz", (7, 6, 5), strict=True))

_NETS = f"""with a as ({NET.format(part='part', nation='nation')}), nf as (select file, count(distinct frame) as nf from a group by file), {_pairs('a', '2.9e0')},
b as (select file, frame, a as former, el_a as el_f, b as ligand, el_b as el_l from p where el_a in ('P', 'Al') and el_b = 'O'),
k as (select *, count(*) over (partition by file, frame, ligand) as k, count(*) over (partition by file, frame, ligand, el_f) as own from b),
f as (select a.file, a.frame, a.aid, a.element, count(k.k)::bigint as cn, count(*) filter (where k.k >= 2)::bigint as n_bo, coalesce(sum(k.own - 1), 0)::bigint as n,
  coalesce(sum(k.k - k.own), 0)::bigint as other
  from a left join k on a.file = k.file and a.frame = k.frame and a.aid = k.former where a.element in ('P', 'Al') group by a.file, a.frame, a.aid, a.element),
l as (select a.file, a.frame, a.aid, a.element, case count(b.former) when 0 then 'f' when 1 then 'n' when 2 then 'b' else 't' end as kind, list_sort(list(b.el_f) filter (where b.el_f is not null)) as partners
  from a left join b on a.file = b.file and a.frame = b.frame and a.aid = b.ligand where a.element = 'O' group by a.file, a.frame, a.aid, a.element),
zn as (select a.file, a.frame, a.aid, a.element, count(p.b)::bigint as cn from a left join p on a.file = p.file and a.frame = p.frame and a.aid = p.a and p.el_b = 'O' and p.d2 < 2.3e0 * 2.3e0
  where a.element = 'Zn' group by all)"""


def _share(rows: str, state: str, within: str = "element", shown: str | None = None) -> str:
    group = f"file, {within}, " if within else "file, "
    over = f"partition by file, frame{', ' + within if within else ''}"
    return f"""select file, {within + ', ' if within else ''}{shown or state}, count::bigint as count, round(s / nf, 6) as mean, round(sqrt(greatest(0e0, (s2 - s * (s / nf)) / (nf - 1))), 6) as sd from (
select {group}{state}, sum(k) as count, sum(p) as s, sum(p * p) as s2, any_value(nf) as nf from (select *, k / sum(k) over ({over}) as p from (
select {group}frame, {state}, count(*) as k from {rows} group by all)) join nf using (file) group by {group}{state})"""


_UNIT = "element || '-Q' || n as label"
_LABELS = """s as (select a.file, a.frame, a.aid, a.element, case when zn.aid is not null then 'modifier' when f.aid is not null then 'former' when l.aid is not null then 'ligand' else 'other' end as class,
case when zn.aid is not null then a.element when f.aid is not null then a.element || '_' || case a.element when 'P' then f.n else f.cn end when l.aid is not null then a.element || '_' || l.kind else a.element end as label
from a left join zn using (file, frame, aid) left join f using (file, frame, aid) left join l using (file, frame, aid))"""
_MEANS = """m as (select file, element, cn, case element when 'P' then n end as qn, n_bo from f union all select file, element, cn, null, null from zn),
pm as (select file, element, round(avg(cn), 6) as mean_cn, round(avg(qn), 6) as mean_qn, round(avg(n_bo), 6) as mean_n_bo from m group by all)"""


def _sci(c: str) -> str:
    return f"coalesce(replace(regexp_replace(printf('%.6e', {c}), 'e([+-])0*([0-9])', 'e\\1\\2'), 'e+', 'e'), '')"


_ANGLE = """t as (select x.file, x.frame, x.a as c, x.el_a as center, case when x.el_b <= y.el_b then x.el_b else y.el_b end as end_a, case when x.el_b <= y.el_b then y.el_b else x.el_b end as end_c,
case when x.el_b <= y.el_b then x.d2 else y.d2 end as d_lo, case when x.el_b <= y.el_b then y.d2 else x.d2 end as d_hi,
degrees(acos(greatest(-1e0, least(1e0, (x.dx * y.dx + x.dy * y.dy + x.dz * y.dz) / sqrt(x.d2 * y.d2))))) as ang
from p x join p y on x.file = y.file and x.frame = y.frame and x.a = y.a and x.b < y.b where x.d2 > 0 and y.d2 > 0)"""
_TWO_ENDS = "case when end_a = end_c then d_lo < 2.1e0 * 2.1e0 and d_hi < 2.1e0 * 2.1e0 else d_lo < 2.5e0 * 2.5e0 and d_hi < 2.1e0 * 2.1e0 end"


def _voxel(shape: tuple[int, int, int], values: str, shown: str, where: str = "true") -> str:
    at = ", ".join(f"floor({x} * {n} / 16e0)::bigint as i{x}" for x, n in zip("xyz", shape, strict=True))
    grid = " cross join ".join(f"(select unnest(range({n}))::bigint as i{x})" for x, n in zip("xyz", shape, strict=True))
    return f"""{_HEAD}, h as (select file, {at}, count(*) as c, {values} from a where {where} group by all)
select nf.file, g.ix, g.iy, g.iz, coalesce(c, 0)::bigint as count, round(coalesce(c, 0) / (nf * (4096e0 / {shape[0] * shape[1] * shape[2]})), 6) as density, {shown}
from nf cross join (select * from {grid}) g left join h on h.file = nf.file and h.ix = g.ix and h.iy = g.iy and h.iz = g.iz"""


_SPEED = "avg(sqrt(vx * vx + vy * vy + vz * vz)) as sp"
_NEAREST = " + ".join(f"pow(h{x} - floor(h{x} + 0.5e0), 2)" for x in "xyz")
_DIFF = lambda i, j: {x: f"(p{j}.{x} - p{i}.{x})" for x in "xyz"}
_INNER = lambda u, v: " + ".join(f"{u[x]} * {v[x]}" for x in "xyz")


def _cross(u: dict, v: dict) -> dict:
    return {x: f"({u[y]} * {v[z]} - {u[z]} * {v[y]})" for x, y, z in ("xyz", "yzx", "zxy")}


_B1, _B2, _B3, _BACK = _DIFF(0, 1), _DIFF(1, 2), _DIFF(2, 3), _DIFF(1, 0)
_N1, _N2 = _cross(_B1, _B2), _cross(_B2, _B3)
_MASS = "case element when 'Si' then 28e0 else 16e0 end"
_LEN = lambda i: "sqrt(" + " + ".join(f"m{i}{k} * m{i}{k}" for k in range(3)) + ")"
_ANG = lambda i, j: f"round(degrees(acos(({' + '.join(f'm{i}{k} * m{j}{k}' for k in range(3))}) / ({_LEN(i)} * {_LEN(j)}))), 6)"
# joining: the cube's cell, lengthened along z, with the tilted cell behind it
_OFFSETS = {j: " + ".join(f"m{i}{j} / l{i} * {'(16e0 + 1.5e0)' if i == 2 else f'((greatest(16e0, l{i}) - l{i}) / 2e0)'}" for i in range(3)) for j in range(3)}

_BADER = f"""with recursive g as ({GRID.format(part='part')}),
s as (select unnest([-1, 0, 1]) as v), o as (select a.v as a, b.v as b, c.v as c, (a.v + 1) * 9 + (b.v + 1) * 3 + c.v + 1 as o from s a, s b, s c where a.v <> 0 or b.v <> 0 or c.v <> 0),
e as (select g.file, g.k, g.value, o.o, 1e0 / sqrt(o.a * o.a + o.b * o.b + o.c * o.c) as inverse, (g.i0 + o.a + 5) % 5 + 5 * ((g.i1 + o.b + 5) % 5 + 5 * ((g.i2 + o.c + 8) % 8)) as to_ from g cross join o),
u as (select e.file, e.k, e.to_, e.o, e.value + (h.value - e.value) * e.inverse as up, e.value from e join g h on h.file = e.file and h.k = e.to_),
x as (select file, k, to_ from (select *, row_number() over (partition by file, k order by up desc, o) as rn from u where up > value) where rn = 1),
r as (select file, k, k as cur from g union select r.file, r.k, x.to_ from r join x on x.file = r.file and x.k = r.cur),
p as (select r.file, r.k, r.cur as peak from r left join x on x.file = r.file and x.k = r.cur where x.k is null),
f as (select file, peak, min(k) as first from p group by all), n as (select file, peak, row_number() over (partition by file order by first)::bigint as volume from f),
q as (select p.file, p.k, p.peak, n.volume, g.value, abs(g.value) / 200e0 <= 0.02e0 as empty from p join n using (file, peak) join g using (file, k)),
z as (select file, volume, any_value(peak)::bigint as peak, coalesce(sum(value) filter (where not empty), 0) / 200e0 as charge, count(*) filter (where not empty) as points from q group by file, volume),
t as (select file, k as aid, i0 + 0.25e0 as x, i1 + 0.25e0 as y, i2 + 0.25e0 as z from g where k % 25 = 7),
d as (select z.*, t.aid, (peak % 5 - t.x) / 5e0 as h0, (floor(peak / 5) % 5 - t.y) / 5e0 as h1, (floor(peak / 25) - t.z) / 8e0 as h2 from z left join t using (file)),
w as (select *, sqrt(pow((h0 - floor(h0 + 0.5e0)) * 5e0, 2) + pow((h1 - floor(h1 + 0.5e0)) * 5e0, 2) + pow((h2 - floor(h2 + 0.5e0)) * 8e0, 2)) as dist from d),
v as (select file, volume, peak, charge, points, points * 1e0 as size, aid, dist as distance from (select *, row_number() over (partition by file, volume order by dist, aid) as rn from w) where rn = 1)"""

ORACLES = {
    "number_density": f"{_TILT}, v as (select distinct file, frame, volume from a) select file, n, round(n * inv, 6) as rho, round(vm, 6) as v_mean, round(vs, 6) as v_sd from (select file, (count(*) / any_value(nf))::bigint as n from a join nf using (file) group by file) join (select file, avg(1 / volume) as inv, avg(volume) as vm, stddev_pop(volume) as vs from v group by file) using (file)",
    "radial_distribution": _GR,
    "radial_distribution_tilted": _gr("0.01e0", "0.37e0", 16, "volume", _tilted_pairs("6e0"), _TILT),
    "radial_distribution_clamped": _gr("5.01e0", "0.53e0", 5, "4096e0", _pairs("a", "20e0"), _HEAD),
    "structure_factor": f"{_SQ} select file, center, neighbor, k, round(q, 6) as q, round(sq, 6) as sq from sq",
    "neutron_structure_factor": _weighted(f"{LENGTHS['O']}e0", f"{LENGTHS['Si']}e0"),
    "xray_structure_factor": _weighted(_FORM("O"), _FORM("Si")),
    "mean_squared_displacement": f"{_MSD10} select * from m",
    "mean_squared_displacement_tilted": f"{_TILT}, o as (from u), e as (from u) select o.file, (e.frame - o.frame)::int as lag, (e.frame - o.frame)::double as time, round(avg({_NPT}), 6) as msd, {_parts(_AXIS)} from {_LAG.format(last=7, lags=8, shift=2)} group by o.file, e.frame - o.frame",
    "displacement_without_cell": f"{_HEAD}, o as (from a), e as (from a) select o.file, (e.frame - o.frame)::int as lag, (e.frame - o.frame)::double as time, round(avg({' + '.join(_PLAIN.values())}), 6) as msd, {_parts(_PLAIN)} from {_LAG.format(last=5, lags=6, shift=3)} group by o.file, e.frame - o.frame",
    "displacement_all_lags": f"{_HEAD} select o.file, e.frame - o.frame as lag, avg({' + '.join(_PLAIN.values())}) as msd from a o join a e on o.file = e.file and o.aid = e.aid and e.frame >= o.frame group by all",
    "diffusion": f"{_MSD10} select file, round(regr_slope(msd, time) / 6, 6) as d, round(regr_intercept(msd, time), 6) as intercept, round(regr_r2(msd, time), 6) as r2, count(*)::bigint as n from m where lag between 2 and 7 group by file",
    "velocity_autocorrelation": f"{_HEAD}, o as (from a), e as (from a), v as (select o.file, (e.frame - o.frame)::int as lag, avg({_DOT}) as vacf, {', '.join(f'avg(o.v{x} * e.v{x}) as w{x}' for x in 'xyz')} from {_LAG.format(last=9, lags=10, shift=1)} group by o.file, e.frame - o.frame) select file, lag, round(vacf, 6) as vacf, {', '.join(f'round(w{x}, 6) as vacf_{x}' for x in 'xyz')}, round(sum(vacf) over (partition by file order by lag) / 3, 6) as diffusion from v",
    "van_hove": _hove(_HEAD, _shifted(3), "0e0", "6e0", "0.23e0", 27),
    "van_hove_tilted": _hove(_TILT, _TILT_MOVED, "0.3e0", "5e0", "0.29e0", 17, "frame % 2 = 0 and element = 'Si'"),
    "jumps": f"{_HEAD}, {_shifted(2)} select file, {', '.join(f'floor({x} / 2e0)::bigint as i{x}' for x in 'xyz')}, count(*)::bigint as count from q where dist2 >= 1.3e0 * 1.3e0 group by all",
    "jumps_tilted": f"{_TILT}, e as (select *, {_AHEAD} from u window w as (partition by file, aid order by frame)) select file, {_MID}, count(*)::bigint as count from e where e_ux is not null and {_JUMP} >= 1.7e0 * 1.7e0 group by all",
    "rotational_correlation": f"""{_HEAD}, {_pairs("a", "3e0")}, v as (select file, frame, a as aid, sum(dx) as x, sum(dy) as y, sum(dz) as z from p where el_a = 'Si' and el_b = 'O' group by all),
w as (select *, x * x + y * y + z * z as n2 from v where x * x + y * y + z * z >= 1e-30),
c as (select o.file, o.frame, (e.frame - o.frame)::int as lag, avg(1.5e0 * pow(o.x * e.x + o.y * e.y + o.z * e.z, 2) / (o.n2 * e.n2) - 0.5e0) as c
  from w o join w e on o.file = e.file and o.aid = e.aid and e.frame - o.frame between 0 and 4 join nf on nf.file = o.file where o.frame + 5 <= nf.n group by all),
g as (select nf.file, l.lag::int as lag, coalesce(sum(c), 0) / any_value(nf.n - 4) as c2 from nf cross join (select unnest(range(5)) as lag) l left join c on c.file = nf.file and c.lag = l.lag group by nf.file, l.lag)
select file, lag, round(c2, 6) as c2, round(sum(c2) over (partition by file order by lag), 6) as integral from g""",
    "shape": f"""{_HEAD}, m as (select *, {_MASS} as w from a), s as (select file, frame, sum(w) as mass, {", ".join(f"sum(w * {x}) / sum(w) as com_{x}" for x in "xyz")}, sum(w * (x * x + y * y + z * z)) / sum(w) as q, {", ".join(f"max({x}) - min({x}) as size_{x}" for x in "xyz")} from m group by file, frame)
select file, frame, mass, {", ".join(f"round(com_{x}, 6) as com_{x}, size_{x}" for x in "xyz")}, round(sqrt(greatest(0e0, q - com_x * com_x - com_y * com_y - com_z * com_z)), 6) as rg from s""",
    "rmsd": f"{_HEAD} select x.file, x.frame, round(sqrt(avg((x.x - y.x) * (x.x - y.x) + (x.y - y.y) * (x.y - y.y) + (x.z - y.z) * (x.z - y.z))), 6) as rmsd from a x join a y on x.file = y.file and x.aid = y.aid and y.frame = 0 group by x.file, x.frame",
    "internal_coordinates": f"""{_HEAD}, p0 as (from a where aid = 3), p1 as (from a where aid = 17), p2 as (from a where aid = 41), p3 as (from a where aid = 88), k as (select distinct file, frame from a)
select k.file, k.frame, round(sqrt({_INNER(_B1, _B1)}), 6) as distance,
round(degrees(acos(greatest(-1e0, least(1e0, ({_INNER(_BACK, _B2)}) / nullif(sqrt(({_INNER(_BACK, _BACK)}) * ({_INNER(_B2, _B2)})), 0))))), 6) as angle,
round(degrees(atan2(({_INNER(_cross(_N1, _B2), _N2)}) / nullif(sqrt({_INNER(_B2, _B2)}), 0), {_INNER(_N1, _N2)})), 6) as dihedral
from k left join p0 on p0.file = k.file and p0.frame = k.frame left join p1 on p1.file = k.file and p1.frame = k.frame left join p2 on p2.file = k.file and p2.frame = k.frame left join p3 on p3.file = k.file and p3.frame = k.frame
where p0.aid is not null or p1.aid is not null or p2.aid is not null or p3.aid is not null""",
    "bond_angles": f"""{_HEAD}, {_pairs("a", "2.5e0")}, {_ANGLE}, h as (select file, end_a, center, end_c, least(floor((ang - 12e0) / 7.3e0), 21)::bigint as bin, count(*)::bigint as count from t where {_TWO_ENDS} and ang between 12e0 and 171e0 group by all)
select file, end_a, center, end_c, bin, round(12e0 + (bin + 0.5e0) * 7.3e0, 6) as angle, count, round(count / sum(count) over (partition by file, end_a, center, end_c), 6) as p from h""",
    "angle_statistics": f"""{_HEAD}, {_pairs("a", "2.5e0")}, {_ANGLE}, h as (select file, end_a, center, end_c, (least(floor(ang / 7.3e0), 24) + 0.5e0) * 7.3e0 as g from t)
select file, end_a, center, end_c, count(*)::bigint as count, round(avg(g), 6) as mean, round(stddev_pop(g), 6) as sd from h group by all""",
    "voxel_density": _voxel((8, 8, 8), _SPEED, "round(coalesce(sp, 0e0), 6) as speed"),
    "voxel_force": _voxel((4, 5, 6), f"{_SPEED}, avg(sqrt(4e0 * (vx * vx + vy * vy + vz * vz))) as fo", "round(coalesce(sp, 0e0), 6) as speed, round(coalesce(fo, 0e0), 6) as force", "element = 'Si'"),
    "sphere_occupancy": f"""{_HEAD}, g as (select * from (select unnest(range(6))::bigint as ix) cross join (select unnest(range(6))::bigint as iy) cross join (select unnest(range(6))::bigint as iz)),
s as (select file, frame, aid, ix, iy, iz, {", ".join(f"(i{x} + 0.5e0) / 6e0 - {x} / 16e0 as h{x}" for x in "xyz")} from a cross join g where element = 'Si'),
h as (select file, ix, iy, iz, count(*) as c from s where ({_NEAREST}) * 256e0 < 2.3e0 * 2.3e0 group by all)
select nf.file, g.ix, g.iy, g.iz, coalesce(c, 0)::bigint as count from nf cross join g left join h on h.file = nf.file and h.ix = g.ix and h.iy = g.iy and h.iz = g.iz""",
    "mean_positions": f"{_HEAD} select file, aid, arg_min(element, frame) as element, {', '.join(f'avg({x}) as {x}' for x in 'xyz')} from a group by file, aid",
    "ligand_classes": f"{_NETS} " + _share("l", "kind"),
    "ligand_types": f"""{_NETS}, y as (select file, frame, element, element || '_' || kind as type, case when kind in ('n', 'b') then partners[1] else '' end as former_a, case when kind = 'b' then partners[2] else '' end as former_b from l)
select *, case when former_a <> '' then former_a || '-' else '' end || type || case when former_b <> '' then '-' || former_b else '' end as label from ({_share('y', 'type, former_a, former_b')})""",
    "qn_species": f"{_NETS}, y as (from f where element = 'P') " + _share("y", "n", shown=f"n, {_UNIT}"),
    "qn_partners": f"{_NETS}, y as (select *, case when other > 0 then 'Al:' || other else '' end as m from f where element = 'P') " + _share("y", "n, m", shown=f"n, m, {_UNIT}"),
    "coordination": f"{_NETS}, y as (select file, frame, element, cn from f union all select file, frame, element, cn from zn) " + _share("y", "cn"),
    "composition": f"{_NETS}, y as (select file, frame, element, case element when 'P' then 'P-Q' || n else element || '_' || cn end as label from f union all select file, frame, element, element || '_' || cn from zn union all select file, frame, element, element || '_' || kind from l) " + _share("y", "label"),
    "pooled_means": f"{_NETS}, {_MEANS} select * from pm",
    "linkages": f"""{_NETS}, s as (select k.*, f.element || '-' || f.n || '-' || f.cn as state from k join f on f.file = k.file and f.frame = k.frame and f.aid = k.former),
y as (select x.file, x.frame, x.el_l, x.k::bigint as n_of, least(x.state, z.state) as a, greatest(x.state, z.state) as b from s x join s z on x.file = z.file and x.frame = z.frame and x.ligand = z.ligand and x.former < z.former) """
    + _share("(select file, frame, el_l, n_of, a, b from y)", "el_l, n_of, a, b", "", "el_l, n_of as k, a, b"),
    "edge_sharing": f"{_NETS}, e as (select x.file, x.frame from b x join b y on x.file = y.file and x.frame = y.frame and x.ligand = y.ligand and x.former < y.former group by x.file, x.frame, x.former, y.former having count(*) >= 2), c as (select file, frame, count(*) as c from e group by file, frame) select k.file, k.frame, coalesce(c, 0)::bigint as count from (select distinct file, frame from a) k left join c using (file, frame)",
    "site_labels": f"{_NETS}, {_LABELS} select * from s",
    "network_clusters": f"""{_NETS.replace("with a as", "with recursive a as", 1)}, e as (select distinct x.file, x.frame, x.former as a, y.former as b from b x join b y on x.file = y.file and x.frame = y.frame and x.ligand = y.ligand and x.former <> y.former),
r as (select file, frame, aid, aid as c from f union select r.file, r.frame, e.b, r.c from r join e on r.file = e.file and r.frame = e.frame and r.aid = e.a),
m as (select file, frame, aid, min(c) as cluster from r group by all),
s as (select m.file, m.frame, cluster, count(*)::bigint as formers, max(n_bo) as qn_max from m join f using (file, frame, aid) group by all),
g as (select m.file, m.frame, cluster, count(distinct ligand) as ligands from m join b on b.file = m.file and b.frame = m.frame and b.former = m.aid group by all)
select s.file, s.frame, s.cluster, formers, coalesce(ligands, 0)::bigint as ligands, qn_max from s left join g using (file, frame, cluster)""",
    "typed_labels": f"""{_NETS}, {_LABELS}, y as (select distinct label || case when aid % 7 = 0 then '_x' else '' end as name from s union all select 'Xx_1' union all select 'plain'),
z as (select name, split_part(name, '_', 1) as head, contains(name, '_') as cut from y)
select name, case when not cut then 'plain' when head in ('P', 'Al', 'O', 'Zn') then 'split' else 'unknown' end as kind, case when cut and head in ('P', 'Al', 'O', 'Zn') then head else name end as element, case when cut and head in ('P', 'Al', 'O', 'Zn') then name end as label from z""",
    "select_tail": f"{_HEAD} select a.file, frame, aid, element, x, y, z from a join nf using (file) where frame >= n - 8 and frame % 2 = 0",
    "spread_frames": f"{_HEAD} select file, frame, count(*)::bigint as n from a where frame in (0, 8, 16, 24) group by file, frame",
    "of_elements": f"{_HEAD} select file, frame, count(*)::bigint as n from a where (file, aid) in (select (file, aid) from a where frame = 0 and element = 'Si') group by file, frame",
    "supercell": f"{_HEAD}, c as (select file, frame, count(*) as k from a group by file, frame) select file, frame, (r * k + aid)::bigint as aid, element, x + (r % 2) * 16e0 as x, y, z + floor(r / 2) * 16e0 as z from a join c using (file, frame), (select unnest(range(6)) as r) t",
    "vacuum": f"{_TILT}, k as (select distinct file, frame, m00, m20, m21, m22 from a) select file, frame, m00, {', '.join(f'round(m2{k} * ((sqrt(m20 * m20 + m21 * m21 + m22 * m22) + 7.5e0) / sqrt(m20 * m20 + m21 * m21 + m22 * m22)), 6) as m2{k}' for k in range(3))} from k",
    "centered": f"{_HEAD}, c as (select file, frame, {', '.join(f'sum({_MASS} * {x}) / sum({_MASS}) as c{x}' for x in 'xyz')} from a group by file, frame) select file, frame, aid, {', '.join(f'round({x} - c{x}, 6) as {x}' for x in 'xyz')} from a join c using (file, frame)",
    "wrapped": f"""{_TILT}, w as (select *, 40e0 / m22 as sz from a), v as (select *, (-3e0 - sz * m21) / m11 as sy from w), s as (select *, (21e0 - sy * m10 - sz * m20) / m00 as sx from v),
g as (select * replace ({", ".join(f"f{x} + s{x} - floor(f{x} + s{x}) as f{x}" for x in "xyz")}) from s) select file, frame, aid, {", ".join(f"round(fx * m0{k} + fy * m1{k} + fz * m2{k} + 1.23e-7, 6) as {x}" for k, x in enumerate("xyz"))} from g""",
    "merged": f"""{_TILT}, c as ({_A}), l as (select distinct file, frame, {", ".join(CELL)}, {", ".join(f"{_LEN(i)} as l{i}" for i in range(3))} from a),
o as (select *, {", ".join(f"{_OFFSETS[j]} as t{j}" for j in range(3))} from l), k as (select file, frame, count(*) as k from c group by all),
both_ as (select file, frame, aid, element, x, y, z from c union all select a.file, a.frame, a.aid + k, element, x + t0, y + t1, z + t2 from a join o on o.file = a.file and o.frame = a.frame join k on k.file = a.file and k.frame = a.frame)
select b.file, b.frame, b.aid::bigint as aid, element, {", ".join(f"round({x}, 6) as {x}" for x in "xyz")}, round(greatest(16e0, l0), 6) as m00, round(16e0 + 1.5e0 + l2, 6) as m22 from both_ b join o on o.file = b.file and o.frame = b.frame""",
    "frame_info": f"""{_TILT}, e as (select file, min(frame) as lo, max(frame) as hi from a group by file),
s as (select a.file, frame, count(*) as n, 'O: ' || count(*) filter (where element = 'O') || ', Si: ' || count(*) filter (where element = 'Si') as composition, sum(case element when 'O' then 15.999e0 else 28.085e0 end) as mass, any_value(volume) as v
  from a join e on e.file = a.file and (frame = lo or frame = hi) group by a.file, frame), k as (select distinct file, frame, {", ".join(CELL)} from a)
select s.file, s.frame, n::bigint as n, composition, {", ".join(f"round({_LEN(i)}, 6) as {x}" for i, x in enumerate("abc"))}, {_ANG(1, 2)} as alpha, {_ANG(0, 2)} as beta, {_ANG(0, 1)} as gamma, round(v, 6) as volume,
round(mass / v * (1e24 / 6.02214076e23), 6) as density, 0::bigint as unknown from s join k using (file, frame)""",
    "electron_counts": f"{_HEAD}, s as (select file, frame, sum(case element when 'O' then 8 else 14 end) - 1 as e from a group by all) select file, frame, e::bigint as electrons, case when e % 2 = 1 then 2 else 1 end::int as multiplicity from s",
    "oxidation_states": f"""{_HEAD}, c as (select file, element, count(*) as n from a where frame = 0 and aid < 12 group by all),
s as (select o.file, si.n as n, min(st) as st from c o join c si on o.file = si.file and o.element = 'O' and si.element = 'Si', (select unnest([2, 4]) as st) where st * si.n = 2 * o.n group by all)
select file, 'O' as element, -2::int as state from s union all select file, 'Si', st::int from s""",
    "spin_guess": f"""{_HEAD}, c as (select file, count(*) filter (where element = 'O') as o, count(*) filter (where element = 'Si') as si from a where frame = 0 and aid < 12 group by file)
select file, 0::bigint as n_unpaired, 1::bigint as multiplicity, case when o > 0 and si > 0 and (2 * o = 4 * si or 2 * o = 2 * si) then 'oxidation' else 'parity' end as method from c""",
    "extxyz_round_trip": f"{_TILT} select file, frame, aid, element, {', '.join(f'round({x}, 6) as {x}' for x in 'xyz')}, m00, m21 from a",
    "dump_round_trip": f"{_TILT} select file, frame, aid, element, {', '.join(f'round({x}, 6) as {x}' for x in 'xyz')}, m00, m21 from a",
    "poscar_round_trip": f"{_TILT} select file, element, {', '.join(f'round({x}, 6) as {x}' for x in 'xyz')}, m00, m21 from a where frame = 0",
    "data_round_trip": f"{_TILT} select file, aid, element, {', '.join(f'round({x}, 6) as {x}' for x in 'xyz')}, m00, m21 from a where frame = 0",
    "qe_round_trip": f"{_TILT} select file, aid, element, {', '.join(f'round({x}, 6) as {x}' for x in 'xyz')}, m00, m21 from a where frame = 0",
    "cif_round_trip": f"{_TILT} select file, frame, aid, element, {', '.join(f'round({x} + 1.23e-5, 4) as {x}' for x in 'xyz')}, round(m00 + 1.23e-5, 4) as m00, round(m21 + 1.23e-5, 4) as m21 from a",
    "pdb_round_trip": f"{_HEAD} select file, frame, aid, element, 16e0 as m00 from a",
    "cube_round_trip": f"{_HEAD}, g as (select * from (select unnest(range(5))::bigint as ix) cross join (select unnest(range(5))::bigint as iy) cross join (select unnest(range(5))::bigint as iz)), h as (select file, {', '.join(f'floor({x} * 5 / 16e0)::bigint as i{x}' for x in 'xyz')}, count(*) as c from a group by all) select nf.file, g.ix as i0, g.iy as i1, g.iz as i2, coalesce(c, 0)::double as value, 16e0 as m00 from nf cross join g left join h on h.file = nf.file and h.ix = g.ix and h.iy = g.iy and h.iz = g.iz where nf.file < 2",
    "csv_table": f"{_NETS}, {_MEANS} select 0::int as part, '# pooled means' as line union all select 1, 'file,element,mean_cn,mean_qn,mean_n_bo' union all select 2, file || ',' || element || ',' || {_sci('mean_cn')} || ',' || {_sci('mean_qn')} || ',' || {_sci('mean_n_bo')} from pm",
    "charge_volumes": f"{_BADER} select file, volume, peak, round(charge, 6) as charge, points, round(size, 6) as size, aid, round(distance, 6) as distance from v union all select file, 0, -1, null, count(*), count(*) * 1e0, -1, null from q where empty group by file",
    "atom_charges": f"{_BADER} select t.file, t.aid, round(coalesce(sum(charge), 0), 6) as charge, round(coalesce(sum(size), 0), 6) as size, round(min(distance), 6) as distance from t left join v on v.file = t.file and v.aid = t.aid group by t.file, t.aid",
    "streamed_voxels": f"{_HEAD} select file, {', '.join(f'floor({x} / 4e0)::bigint as i{x}' for x in 'xyz')}, count(*)::bigint as count from a group by all",
}
