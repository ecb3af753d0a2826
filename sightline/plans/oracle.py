"""DuckDB SQL for the terrain queries, as common table expressions that build on each other."""

from __future__ import annotations

from ..settings import DEGREE, EARTH_DIAMETER, NODATA, Settings

R = "sign({0}) * floor(abs({0}) + 0.5)"


def dem(s: Settings) -> str:
    w2 = s.width**2
    return f"""cells as (select range as dem_id from range({w2})),
heights as (select (l_partkey * 7 + l_suppkey * 31) % {w2} as dem_id, cast(sum(l_quantity) as bigint) % 300 as h from lineitem group by 1),
dem as (select c.dem_id, cast(case when c.dem_id % 23 = 0 or h is null then {NODATA} else h end as smallint) as elev
        from cells c left join heights using (dem_id))"""


def angles(s: Settings, ids: list[int] | None = None) -> str:
    source = f"(values {', '.join(f'({a})' for a in ids)}) as t(a)" if ids is not None else f"(select range as a from range({s.angles})) t"
    inv = f"case when a > 0 then 360.0::double - a::double / {float(s.subdivisions)}::double else 0::double end"
    return f"""turned as (select cast(a as integer) as angle_id, {inv} as inverse from {source}),
angles as (select angle_id, inverse, cast(floor(inverse / 90) as integer) as quadrant,
                  -tan(radians(inverse - 90 * floor(inverse / 90)) / 2) as alpha, sin(radians(inverse - 90 * floor(inverse / 90))) as beta from turned)"""


def rotated(s: Settings, ids: list[int] | None = None) -> str:
    reach, last, middle = s.reach, s.width - 1, f"{(s.width - 1) / 2}::double"
    return (
        angles(s, ids)
        + f""",
places as (select angle_id, quadrant, alpha, beta, y.range - {reach} as line, x.range - {reach} as pos,
                  case quadrant when 0 then x.range when 1 then {last} - y.range when 2 then {last} - x.range else y.range end - {middle} as x0,
                  case quadrant when 0 then y.range when 1 then x.range when 2 then {last} - y.range else {last} - x.range end - {middle} as y0
           from angles, range({reach}, {2 * reach}) y, range({reach}, {3 * reach}) x),
shear1 as (select *, x0 + {R.format("(alpha * y0)")} as x1 from places),
shear2 as (select *, y0 + {R.format("(beta * x1)")} as y1 from shear1),
shear3 as (select *, x1 + {R.format("(alpha * y1)")} as x2 from shear2),
rotated as (select angle_id, cast(line as integer) as line, cast(pos as integer) as pos,
                   cast(least(greatest(trunc(y1 + {middle}), 0), {last}) * {s.width} + least(greatest(trunc(x2 + {middle}), 0), {last}) as bigint) as dem_id
            from shear3)"""
    )


def lines(s: Settings, ids: list[int] | None = None) -> str:
    return f"""{dem(s)},
{rotated(s, ids)},
gathered as (select angle_id, line, pos, r.dem_id, case when elev <> {NODATA} then elev::integer end as elev from rotated r join dem using (dem_id)),
lines as (select angle_id, line, pos, dem_id,
                 coalesce(last_value(elev ignore nulls) over (partition by angle_id, line order by pos), 0) as elev from gathered)"""


def circle(s: Settings, column: str = "dem_id") -> str:
    reach, radius = s.reach, f"{(s.reach - 1) / 2}::double"
    y, x = f"({column} // {s.width} - {reach} - {radius})", f"({column} % {s.width} - {reach} - {radius})"
    return f"({y} * {y} + {x} * {x} < {radius} * {radius})"


def steps(s: Settings) -> str:
    return f"""distances as (select cast(range as integer) as k, cast(range * {s.scale}::double as float) as d from range(1, {s.reach + 1})),
steps as (select k, d, (d * d) * cast({s.refraction - 1!r}::double as float) / cast({EARTH_DIAMETER} as float) as adj from distances)"""


def slopes(s: Settings, ids: list[int] | None = None, observers: str = "true") -> str:
    return f"""{lines(s, ids)},
{steps(s)},
views as (select p.dem_id, p.angle_id, p.line, p.pos, k, d,
                 ((t.elev::float - (p.elev::float + cast({s.observer_height!r}::double as float))) + adj) / d as slope
          from lines p join steps on true join lines t on t.angle_id = p.angle_id and t.line = p.line and t.pos = p.pos + k
          where p.pos < {s.reach} and {circle(s, "p.dem_id")} and ({observers}))"""


def visibility(s: Settings, ids: list[int] | None = None, observers: str = "true") -> str:
    return f"""{slopes(s, ids, observers)},
seen as materialized (select dem_id, angle_id, k, d,
                slope > greatest(coalesce(max(slope) over (partition by angle_id, line, pos order by k rows between unbounded preceding and 1 preceding), -2000::float), -2000::float) as visible
         from views)"""


def segments(s: Settings, ids: list[int] | None = None, observers: str = "true") -> str:
    return f"""{visibility(s, ids, observers)},
marked as (select dem_id, angle_id, k, k - row_number() over (partition by dem_id, angle_id order by k) as run from seen where visible),
segs as materialized (select dem_id, angle_id, cast(min(k) - 1 as integer) as start, cast(count(*) as integer) as distance from marked group by dem_id, angle_id, run
         union all select dem_id, angle_id, 0, 0 from seen where k = 1 and not visible)"""


def surfaces(s: Settings, ids: list[int] | None = None, observers: str = "true") -> str:
    return f"""{visibility(s, ids, observers)},
surfaces as (select dem_id, cast(sum(k) as bigint) as sum_k from seen where visible group by dem_id),
ranked as (select dem_id, k, angle_id, row_number() over (partition by dem_id order by k desc, angle_id) as place from seen where visible),
longest as (select dem_id, k as longest_k, angle_id as longest_angle from ranked where place = 1)"""


def tvs(s: Settings, column: str = "dem_id") -> str:
    return f"cast(({column} // {s.width} - {s.reach}) * {s.reach} + {column} % {s.width} - {s.reach} as integer)"


def neighbourhood(s: Settings, size: int, column: str = "dem_id") -> str:
    side = int(size**0.5)
    return f"cast(({column} // {s.width} // {side}) * {s.width // side} + ({column} % {s.width}) // {side} as bigint)"


def dense(s: Settings) -> str:
    """Sums of the whole central third, 0 where none was computed."""
    return f"""{surfaces(s)},
third as (select range as tvs_id, (range // {s.reach} + {s.reach}) * {s.width} + range % {s.reach} + {s.reach} as dem_id from range({s.reach**2})),
dense as (select cast(tvs_id as integer) as tvs_id, t.dem_id, coalesce(sum_k, 0) as sum_k, coalesce(sum_k, 0) * {s.scale * DEGREE!r}::double as value
          from third t left join surfaces using (dem_id))"""


def components(s: Settings, rounds: int = 10) -> str:
    """groups: of every observer the number of groups of segments that overlap on neighbouring angles.

    Each round every segment, and the one it points to, points on to the least that
    its neighbours' pointers point to. The rounds more than suffice: twice as many change nothing.
    """
    ctes = [
        f"""{segments(s)},
runs as materialized (select dem_id, angle_id, start, start + distance as stop, dem_id * 33554432 + angle_id * 65536 + start as node from segs where distance > 0),
pairs as (select a.node as a, b.node as b from runs a join runs b on a.dem_id = b.dem_id and b.angle_id = (a.angle_id + 1) % {s.angles}
          where a.start < b.stop and b.start < a.stop),
links as materialized (select a, b from pairs union all select b, a from pairs),
f0 as materialized (select node, node as f from runs)"""
    ]
    for i in range(rounds):
        ctes.append(f"""g{i} as materialized (select x.node, x.f, y.f as g from f{i} x join f{i} y on y.node = x.f),
e{i} as materialized (select u.f as fu, l.a as u, v.g as gv from links l join g{i} u on u.node = l.a join g{i} v on v.node = l.b),
f{i + 1} as materialized (select node, min(f) as f from (select node, g as f from g{i} union all select fu, gv from e{i} union all select u, gv from e{i}) group by node)""")
    ctes.append(f"groups as (select node // 33554432 as dem_id, cast(count(distinct f) as integer) as components from f{rounds} group by 1)")
    return ",\n".join(ctes)


#: WGS84: half the major axis in metres, and the square of the eccentricity.
MAJOR, SQUARE = 6_378_137.0, 2 / 298.257223563 - 1 / 298.257223563**2


def geodesic(source: str, name: str, lon0: str, lat0: str, east: str, north: str, steps: int = 4) -> str:
    """`name`: the rows of `source` with lon and lat, where the geodesic through (lon0, lat0) ends; its equations are integrated in steps (Runge-Kutta)."""
    sine = f"(1 - {SQUARE!r}::double * sin({{0}}) ** 2)"
    slope = (
        f"cos({{1}}) * {sine} ** 1.5::double / ({MAJOR!r}::double * (1 - {SQUARE!r}::double))", f"sin({{1}}) * sqrt{sine} / ({MAJOR!r}::double * cos({{0}}))", f"sin({{1}}) * tan({{0}}) * sqrt{sine} / {MAJOR!r}::double",
    )
    own = "phi, lam, turn, h"
    ctes = [f"{name}_0 as (select *, radians({lat0}) as phi, radians({lon0}) as lam, atan2({east}, {north}) as turn, sqrt(({east}) ** 2 + ({north}) ** 2) / {steps} as h from {source})"]
    for i in range(steps):
        last = f"{name}_{i}"
        for k, share in enumerate((0.0, 0.5, 0.5, 1.0), start=1):
            at = ("phi", "turn") if k == 1 else (f"(phi + h * {share}::double * p{k - 1})", f"(turn + h * {share}::double * t{k - 1})")
            made = ", ".join(f"{f.format(*at)} as {n}{k}" for n, f in zip("plt", slope, strict=True))
            ctes.append(f"{name}_{i}{'abcd'[k - 1]} as (select *, {made} from {last})")
            last = f"{name}_{i}{'abcd'[k - 1]}"
        moved = ", ".join(f"{v} + h / 6 * ({n}1 + 2 * {n}2 + 2 * {n}3 + {n}4) as {v}" for v, n in (("phi", "p"), ("lam", "l"), ("turn", "t")))
        gone = ", ".join(f"{n}{k}" for n in "plt" for k in range(1, 5))
        ctes.append(f"{name}_{i + 1} as (select * exclude ({own}, {gone}), {moved}, h from {last})")
    ctes.append(f"{name} as (select * exclude ({own}), degrees(lam) as lon, degrees(phi) as lat from {name}_{steps})")
    return ",\n".join(ctes)


def query(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"
