"""The registered queries once more, as plain SQL over the same tables."""

from __future__ import annotations

_ORDER = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)

# Tables derived from the order-processing data.
_NUMBERED = f"""
numbered as (
  select *, l_orderkey // 8 as plan_id,
         row_number() over (partition by l_orderkey // 8 order by {_ORDER}) - 1 as seq
  from lineitem)"""

_SEGMENTS = _NUMBERED + """,
drawn as (
  select *, 12 * ((l_suppkey * 7) % 100) as x0, 12 * ((l_partkey * 13) % 83) as y0,
         96 * (cast(trunc(l_quantity) as bigint) % 6 + 1) as size,
         (l_partkey + l_suppkey) % 4 as turn,
         case when plan_id % 11 = 0 then 1000 when plan_id % 7 = 0 then 100 else 1 end as unit
  from numbered),
segments as (
  select plan_id, seq,
         case when l_partkey % 20 < 14 then case when plan_id % 50 = 0 then 'DIMENSIONS' else 'A-WALL' end
              when l_partkey % 20 < 17 then 'DOOR' when l_partkey % 20 < 19 then 'Fenster'
              else 'FURNITURE' end as layer,
         'LINE' as source_type,
         ((x0 + case when turn = 2 then size else 0 end) * unit) / 100.0::double as x1,
         (y0 * unit) / 100.0::double as y1,
         ((x0 + case when turn in (0, 3) then size else 0 end) * unit) / 100.0::double as x2,
         ((y0 + case when turn in (1, 3) then size else 0 end) * unit) / 100.0::double as y2
  from drawn)"""


def _category(layer: str) -> str:
    groups = (
        ("WALL", ("wall", "mur", "wand", "cloison")),
        ("DOOR", ("door", "porte", "tür", "tur")),
        ("WINDOW", ("window", "fenetre", "fenêtre", "fenster")),
    )
    cases = " ".join(
        f"when {' or '.join(f'contains(lower({layer}), {w!r})' for w in words)} then '{name}'"
        for name, words in groups
    )
    return f"case {cases} else 'OTHER' end"


def _stats(scale: str, auto: str, bounds_scaled: bool = True) -> str:
    """Per-plan statistics with the applied scale; ``scale`` and ``auto`` are SQL expressions."""
    factor = "applied_scale" if bounds_scaled else "1.0"
    return f""",
tagged as (select *, {_category('layer')} as category from segments),
summary as (
  select plan_id, min(least(x1, x2)) as minx0, min(least(y1, y2)) as miny0,
         max(greatest(x1, x2)) as maxx0, max(greatest(y1, y2)) as maxy0,
         count(*) filter (category = 'WALL') as wall_segments,
         count(*) filter (category = 'DOOR') as door_segments,
         count(*) filter (category = 'WINDOW') as window_segments,
         count(*) filter (category = 'OTHER') as other_segments,
         count(*) as segments_parsed
  from tagged group by plan_id),
guessed as (
  select *, {scale} as wanted, {auto} as auto,
         case when greatest(maxx0 - minx0, maxy0 - miny0) <= 100 then 1.0::double
              when greatest(maxx0 - minx0, maxy0 - miny0) <= 2000 then 0.0254::double
              else 0.001::double end as inferred
  from summary),
scaled as (
  select *, case when auto and wanted = 1.0 then inferred else wanted end as applied_scale,
         auto and wanted = 1.0 and inferred <> 1.0 as auto_scaled
  from guessed),
stats as (
  select *, minx0 * {factor} as minx, miny0 * {factor} as miny,
         maxx0 * {factor} as maxx, maxy0 * {factor} as maxy
  from scaled)"""


def _lines(shortest: str) -> str:
    return f""",
used as (
  select t.plan_id,
         t.seq + case when t.category = 'WINDOW' then 1099511627776
                      when t.category = 'OTHER' then 2199023255552 else 0 end as seq,
         t.layer, t.category, s.wall_segments = 0 as fallback,
         t.x1 * s.applied_scale as x1, t.y1 * s.applied_scale as y1,
         t.x2 * s.applied_scale as x2, t.y2 * s.applied_scale as y2
  from tagged t join stats s using (plan_id)
  where t.category = 'WALL' or s.wall_segments = 0),
measured as (
  select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length from used),
lines as (
  select *, case when a < 0 then a + 180.0::double else a end as angle
  from (select *, degrees(atan2(y2 - y1, x2 - x1)) % 180.0::double as a
        from measured where length >= {shortest}))"""


def _pairs(near: str) -> str:
    """Measures of the line pairs i < j of a plan that meet by ``near``."""
    return f""",
ends as (
  select a.plan_id, a.seq as i, b.seq as j, a.layer, a.length as la, b.length as lb,
         a.angle as ta, b.angle as tb,
         a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2,
         b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2,
         (a.x2 - a.x1) / a.length as ux, (a.y2 - a.y1) / a.length as uy
  from {near}),
aligned as (
  select *,
         (bx1 - ax1) * ux + (by1 - ay1) * uy as p1, (bx2 - ax1) * ux + (by2 - ay1) * uy as p2,
         (ax2 - ax1) * ux + (ay2 - ay1) * uy as pa,
         abs(((bx1 + bx2) / 2.0::double - (ax1 + ax2) / 2.0::double) * (-uy)
             + ((by1 + by2) / 2.0::double - (ay1 + ay2) / 2.0::double) * ux) as across,
         sqrt(((ax1 + ax2) / 2.0::double - (bx1 + bx2) / 2.0::double)
              * ((ax1 + ax2) / 2.0::double - (bx1 + bx2) / 2.0::double)
              + ((ay1 + ay2) / 2.0::double - (by1 + by2) / 2.0::double)
              * ((ay1 + ay2) / 2.0::double - (by1 + by2) / 2.0::double)) as between_mids
  from ends)"""

# Lines stand in their 5 degree bucket; partners also stand in the next one.
_BUCKETS = """(select *, cast(floor(angle / 5) as int) as own from lines) a
    join (select *, unnest([cast(floor(angle / 5) as int), (cast(floor(angle / 5) as int) + 1) % 36]) as met
          from lines) b on a.plan_id = b.plan_id and a.own = b.met and a.seq < b.seq"""
# Midpoints stand in cells of 1.001 m; partners also stand in the cells around.
_CELLS = """(select *, floor((x1 + x2) / 2.002) as cx, floor((y1 + y2) / 2.002) as cy from lines) a
    join (select l.*, floor((x1 + x2) / 2.002) + dx as cx, floor((y1 + y2) / 2.002) + dy as cy from lines l,
            (values (-1), (0), (1)) h(dx), (values (-1), (0), (1)) v(dy)) b
      on a.plan_id = b.plan_id and a.cx = b.cx and a.cy = b.cy and a.seq < b.seq"""
# All pairs of a plan.
_ALL = "lines a join lines b on a.plan_id = b.plan_id and a.seq < b.seq"

_CANDIDATES = _pairs(_BUCKETS) + """,
candidates as (
  select *, across as distance from aligned
  where cast(floor(ta / 5) as int) in (cast(floor(tb / 5) as int), (cast(floor(tb / 5) as int) + 1) % 36)
    and least(abs(ta - tb), 180.0 - abs(ta - tb)) <= 5.0
    and across between 0.01::double and 0.8::double
    and greatest(0.0, pa) + 0.3::double >= least(p1, p2)
    and greatest(p1, p2) + 0.3::double >= least(0.0, pa))"""

_CANDIDATES_V1 = _pairs(_CELLS) + """,
candidates as (
  select *, between_mids as distance from aligned
  where (abs(ta - tb) < 5.0 or abs(abs(ta - tb) - 180.0) < 5.0)
    and between_mids <= 1.0::double
    and greatest(0.0, pa) + 0.5::double >= least(p1, p2)
    and greatest(p1, p2) + 0.5::double >= least(0.0, pa))"""

_MATCHES = """,
per_plan as (
  select plan_id, list({'i': i, 'd': distance, 'j': j} order by i, distance, j) as edges
  from candidates group by plan_id),
folded as (
  select plan_id, list_reduce(
           list_transform(edges, lambda e: {'used': [e.i, e.j], 'picks': [{'i': e.i, 'j': e.j}]}),
           lambda acc, e: case
             when list_contains(acc.used, e.used[1]) or list_contains(acc.used, e.used[2]) then acc
             else {'used': list_concat(acc.used, e.used), 'picks': list_concat(acc.picks, e.picks)}
             end) as r
  from per_plan),
picked as (select plan_id, unnest(r.picks) as p from folded),
matches as (
  select c.* from candidates c
  join picked on c.plan_id = picked.plan_id and c.i = picked.p.i and c.j = picked.p.j)"""


def _walls(thickness: str = "0.2", height: str = "3.0") -> str:
    return f""",
turned as (select *, p1 > p2 as against from matches),
walls as (
  select plan_id, i as seq, true as paired, layer,
         (ax1 + case when against then bx2 else bx1 end) / 2.0::double as x1,
         (ay1 + case when against then by2 else by1 end) / 2.0::double as y1,
         (ax2 + case when against then bx1 else bx2 end) / 2.0::double as x2,
         (ay2 + case when against then by1 else by2 end) / 2.0::double as y2,
         round(distance, 4) as thickness, {height}::double as height,
         round(least(1.0, 0.7::double + 0.3::double * (least(la, lb) / (greatest(la, lb) + 1e-9::double))), 3) as confidence
  from turned
  union all
  select plan_id, seq, false, layer, x1, y1, x2, y2, {thickness}::double, {height}::double, 0.8::double
  from lines l
  where length >= 0.1::double
    and not exists (select 1 from matches m where m.plan_id = l.plan_id and l.seq in (m.i, m.j))),
sized as (
  select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length,
         greatest(thickness, 0.05::double) as thick from walls),
boxes as (
  select plan_id, seq, paired, layer, round((x1 + x2) / 2, 4) + 0.0 as pos_x,
         round(height / 2, 4) as pos_y, round((y1 + y2) / 2, 4) + 0.0 as pos_z,
         round(greatest(length, thick), 4) as width, round(height, 4) as box_height,
         round(least(length, thick), 4) as depth,
         round(atan2(y2 - y1, x2 - x1), 6) + 0.0 as rotation_y, confidence
  from sized where length >= 1e-6)"""


_WALLS_V1 = """,
walls as (
  select plan_id, i as seq, true as paired, layer, (ax1 + bx1) / 2.0::double as x1,
         (ay1 + by1) / 2.0::double as y1, (ax2 + bx2) / 2.0::double as x2,
         (ay2 + by2) / 2.0::double as y2, round(distance, 3) as thickness, 3.0::double as height
  from matches
  union all
  select plan_id, seq, false, layer, x1, y1, x2, y2, 0.2::double, 3.0::double
  from lines l
  where length >= 0.1::double
    and not exists (select 1 from matches m where m.plan_id = l.plan_id and l.seq in (m.i, m.j))),
sized as (
  select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length,
         greatest(thickness, 0.05::double) as thick from walls),
boxes as (
  select plan_id, seq, paired, layer, round((x1 + x2) / 2, 4) + 0.0 as pos_x,
         round(height / 2, 4) as pos_y, round((y1 + y2) / 2, 4) + 0.0 as pos_z,
         round(length, 4) as width, round(height, 4) as box_height, round(thick, 4) as depth,
         round(-atan2(y2 - y1, x2 - x1), 6) + 0.0 as rotation_y
  from sized where length >= 1e-6)"""

_TOTAL = "round_even(sum(cast(round(width * 10000.0) as bigint)) / 100.0::double, 0) / 100.0::double"

_METADATA = f""",
counted as (
  select plan_id, count(*) as wall_count, {_TOTAL} as total_wall_length,
         count(*) filter (paired) as paired_walls
  from boxes group by plan_id),
metadata as (
  select plan_id, coalesce(wall_count, 0) as wall_count, 1::bigint as floor_count,
         coalesce(total_wall_length, 0.0::double) as total_wall_length,
         coalesce(paired_walls, 0) as paired_walls, round(minx, 4) + 0.0 as minx,
         round(miny, 4) + 0.0 as miny, round(maxx, 4) + 0.0 as maxx, round(maxy, 4) + 0.0 as maxy,
         'floorplan-json-v1' as format
  from stats left join counted using (plan_id))"""

_AUTO = _SEGMENTS + _stats("1.0::double", "true")
_AUTO_LINES = _AUTO + _lines("0.1::double")
_AUTO_MATCHES = _AUTO_LINES + _CANDIDATES + _MATCHES
_AUTO_WALLS = _AUTO_MATCHES + _walls()
_V1_LINES = _SEGMENTS + _stats("1.0::double", "false", bounds_scaled=False) + _lines("0.3::double")
_V1_WALLS = _V1_LINES + _CANDIDATES_V1 + _MATCHES + _WALLS_V1


# One step of the walk for all plans at once: the first free line that continues the chain's end, or
# else the first free line as the next chain's start.
_FRAGMENTS = _AUTO + _lines("0.1::double").replace("\nlines as (", "\npieces as (") + """,
walk as (
  select plan_id, 0 as step, [min(seq)] as used, min(seq) as seed, min(seq) as tail,
         arg_min(x2, seq) as ex, arg_min(y2, seq) as ey
  from pieces group by plan_id
  union all
  select plan_id, step + 1, list_append(used, coalesce(follower, fresh)), coalesce(seed_if, fresh),
         coalesce(follower, fresh), fx, fy
  from (
    select plan_id, step, used, case when follower is null then null else seed end as seed_if, follower, fresh,
           case when follower is null then nx else case when turned then fx1 else fx2 end end as fx,
           case when follower is null then ny else case when turned then fy1 else fy2 end end as fy
    from (
      select plan_id, any_value(step) as step, any_value(used) as used, any_value(seed) as seed,
             min(seq) filter (fits) as follower, min(seq) as fresh,
             arg_min(x2, seq) as nx, arg_min(y2, seq) as ny,
             arg_min(to_end < to_start, seq) filter (fits) as turned,
             arg_min(x1, seq) filter (fits) as fx1, arg_min(y1, seq) filter (fits) as fy1,
             arg_min(x2, seq) filter (fits) as fx2, arg_min(y2, seq) filter (fits) as fy2
      from (
        select w.plan_id, w.step, w.used, w.seed, l.seq, l.x1, l.y1, l.x2, l.y2,
               sqrt((l.x1 - ex) * (l.x1 - ex) + (l.y1 - ey) * (l.y1 - ey)) as to_start,
               sqrt((l.x2 - ex) * (l.x2 - ex) + (l.y2 - ey) * (l.y2 - ey)) as to_end,
               least(abs(t.angle - l.angle), 180.0 - abs(t.angle - l.angle)) <= 5.0
                 and abs(((l.y1 + l.y2) / 2 - (t.y1 + t.y2) / 2) * ((t.x2 - t.x1) / t.length)
                         - ((l.x1 + l.x2) / 2 - (t.x1 + t.x2) / 2) * ((t.y2 - t.y1) / t.length)) <= 0.015::double
                 and least(to_start, to_end) <= 0.5::double as fits
        from walk w
        join pieces t on t.plan_id = w.plan_id and t.seq = w.tail
        join pieces l on l.plan_id = w.plan_id and not list_contains(w.used, l.seq))
      group by plan_id))),
chains as (
  select plan_id, seed, arg_max(ex, step) as x2, arg_max(ey, step) as y2 from walk group by plan_id, seed),
joined as (
  select c.plan_id, c.seed as seq, p.layer, p.x1, p.y1, c.x2, c.y2,
         sqrt((c.x2 - p.x1) * (c.x2 - p.x1) + (c.y2 - p.y1) * (c.y2 - p.y1)) as length
  from chains c join pieces p on p.plan_id = c.plan_id and p.seq = c.seed),
lines as (
  select *, case when a < 0 then a + 180.0::double else a end as angle
  from (select *, degrees(atan2(y2 - y1, x2 - x1)) % 180.0::double as a from joined where length > 1e-6))"""


def _with(ctes: str, select: str) -> str:
    return f"with {ctes.strip().lstrip(',')}\n{select}"


def _rounded(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


_ENDS = ("x1", "y1", "x2", "y2")

# Rooms.
_ROOMS = """
rooms as (
  select o_custkey as plan_id,
         row_number() over (partition by o_custkey order by o_orderkey) - 1 as room_no,
         ['living', 'bedroom', 'kitchen', 'bathroom', 'hallway', 'dining', 'office', 'storage']
           [(o_orderkey % 8 + 1)::int] as room_type,
         (o_orderkey % 30 + 15) / 10.0::double as w, (o_orderkey % 25 + 20) / 10.0::double as h
  from orders)"""


def _room_name(kind: str, count: str) -> str:
    return f"""case {kind} when 'bedroom' then 'Bedroom ' || {count}
      when 'bathroom' then case when {count} > 1 then 'Bathroom ' || {count} else 'Bathroom' end
      when 'living' then 'Living Room' when 'kitchen' then 'Kitchen' when 'dining' then 'Dining Room'
      when 'hallway' then 'Hallway' when 'office' then 'Office' when 'storage' then 'Storage' end"""


def _layout(main: str | None) -> str:
    """Placed rooms; ``main`` lists the types of the left column, None merges the open ones."""
    if main is not None:
        side = f"""case when room_type in ({main}) then 'main' when room_type = 'hallway' then 'hall'
                   else 'side' end"""
        sizes = """coalesce(max(w) filter (side = 'main'), 0.0::double) as main_w,
                   coalesce(sum(h) filter (side = 'main'), 0.0::double) as main_h"""
        left = f"""select plan_id, room_no, {_room_name('room_type', 'nth')} as name, room_type,
                          0.0::double as x, y, col_w as w, h
                   from stacked where side = 'main'"""
    else:
        side = """case when room_type in ('living', 'kitchen', 'dining') then 'main'
                  when room_type = 'hallway' then 'hall' else 'side' end"""
        sizes = "8.0::double as main_w, 5.5::double as main_h"
        left = """select s.plan_id, 0::bigint as room_no, coalesce(label, 'Open Plan') as name,
                         'living' as room_type, 0.0::double as x, 0.0::double as y, main_w as w, main_h as h
                  from sizes s left join labels using (plan_id)"""
    return _ROOMS + f""",
sided as (select *, {side} as side from rooms),
stacked as (
  select *, row_number() over (partition by plan_id, side, room_type order by room_no) as nth,
         coalesce(sum(h) over (partition by plan_id, side order by room_no
                               rows between unbounded preceding and 1 preceding), 0.0) as y,
         max(w) over (partition by plan_id, side) as col_w
  from sided),
labels as (
  select plan_id, string_agg(upper(room_type[1]) || room_type[2:], ' / ' order by room_no) as label
  from sided where side = 'main' group by plan_id),
sizes0 as (
  select plan_id, {sizes}, coalesce(max(w) filter (side = 'side'), 0.0::double) as side_w,
         coalesce(sum(h) filter (side = 'side'), 0.0::double) as side_h,
         coalesce(bool_or(side = 'hall'), false) as has_hall
  from sided group by plan_id),
sizes as (
  select *, case when has_hall then 1.2::double else 0.0::double end as hall_w,
         greatest(main_h, side_h) as total_h from sizes0),
located as (
  {left}
  union all
  select plan_id, room_no + 1099511627776, {_room_name('room_type', 'nth')}, room_type,
         main_w + hall_w, y, col_w, h
  from stacked join sizes using (plan_id) where side = 'side'
  union all
  select plan_id, 2199023255552, 'Hallway', 'hallway', main_w, 0.0, 1.2::double, total_h
  from sizes where has_hall),
placed as (
  select l.*, round(sizes.main_w + hall_w + side_w, 2) as plan_width, round(total_h, 2) as plan_height
  from located l join sizes using (plan_id))"""


_PLACED = _layout("'living', 'kitchen', 'dining', 'office'")
_ROOM_VIEW = (
    "plan_id, room_no, name, room_type, "
    + _rounded(4, "x", "y", "w", "h")
    + ", "
    + _rounded(2, "plan_width", "plan_height")
)

_EDGES = _PLACED + """,
edges as (
  select plan_id, room_no, 0 as side_no, x as x1, y as y1, x + w as x2, y as y2 from placed
  union all select plan_id, room_no, 1, x + w, y, x + w, y + h from placed
  union all select plan_id, room_no, 2, x, y + h, x + w, y + h from placed
  union all select plan_id, room_no, 3, x, y, x, y + h from placed),
gridded as (
  select *, round_even(x1 / 0.01::double, 0)::bigint as gx1, round_even(y1 / 0.01::double, 0)::bigint as gy1,
         round_even(x2 / 0.01::double, 0)::bigint as gx2, round_even(y2 / 0.01::double, 0)::bigint as gy2
  from edges),
keyed as (
  select *, (gx1, gy1) <= (gx2, gy2) as low_first from gridded),
keys as (
  select plan_id, room_no, side_no, x1, y1, x2, y2,
         case when low_first then gx1 else gx2 end as lo_x, case when low_first then gy1 else gy2 end as lo_y,
         case when low_first then gx2 else gx1 end as hi_x, case when low_first then gy2 else gy1 end as hi_y
  from keyed),
ranked as (
  select *, first_value(room_no) over first as room_first, first_value(side_no) over first as side_first,
         row_number() over (partition by plan_id, lo_x, lo_y, hi_x, hi_y order by room_no desc, side_no desc) as back
  from keys
  window first as (partition by plan_id, lo_x, lo_y, hi_x, hi_y order by room_no, side_no)),
unique_edges as (
  select plan_id, room_first as room_no, side_first as side_no, x1, y1, x2, y2 from ranked where back = 1)"""


def _faces(shifts: str) -> str:
    return _with(
        _EDGES + f""",
        faced as (
          select e.*, s.face_no, s.shift, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as size
          from unique_edges e cross join (values {shifts}) s(face_no, shift)),
        moved as (
          select *, -(y2 - y1) / size * 0.2::double * shift as dx, (x2 - x1) / size * 0.2::double * shift as dy
          from faced where size >= 1e-6)""",
        """select plan_id, room_no, side_no, face_no, round(x1 + dx, 4) + 0.0 as x1,
                  round(y1 + dy, 4) + 0.0 as y1, round(x2 + dx, 4) + 0.0 as x2,
                  round(y2 + dy, 4) + 0.0 as y2 from moved""",
    )


def _arc_points(start: str, end: str) -> str:
    """Start and step of an arc in radians."""
    return f"""radians({start}) as a0,
      (case when radians({end}) <= radians({start}) then radians({end}) + 2 * pi() else radians({end}) end
       - radians({start})) / 12.0::double as step"""


_OPENINGS = _PLACED + f""",
doors as (select *, x + w * 0.3::double as door_x from placed where w > 0.9::double + 0.5::double),
swings as (select *, {_arc_points('0.0::double', '90.0::double')} from doors),
windows as (
  select *, least(1.2::double, w * 0.4::double) as win_w from placed
  where room_type not in ('bathroom', 'hallway', 'storage')),
openings as (
  select plan_id, room_no, 0 as item, 0 as part, 'DOOR' as layer, 'LINE' as source_type,
         door_x as x1, y as y1, door_x + 0.9::double as x2, y as y2 from doors
  union all
  select plan_id, room_no, 1, k::int, 'DOOR', 'ARC', door_x + 0.9::double * cos(a0 + k * step),
         y + 0.9::double * sin(a0 + k * step), door_x + 0.9::double * cos(a0 + (k + 1) * step),
         y + 0.9::double * sin(a0 + (k + 1) * step)
  from swings cross join range(12) r(k)
  union all
  select plan_id, room_no, 2, 0, 'WINDOW', 'LINE', x + (w - win_w) / 2, y,
         x + (w - win_w) / 2 + win_w, y from windows),
corners as (
  select *, x + 0.05::double as l, y + 0.05::double as b, x + w - 0.05::double as r,
         y + h - 0.05::double as t from placed),
outlines as (
  select plan_id, room_no, 0 as part, l as x1, b as y1, r as x2, b as y2 from corners
  union all select plan_id, room_no, 1, r, b, r, t from corners
  union all select plan_id, room_no, 2, r, t, l, t from corners
  union all select plan_id, room_no, 3, l, t, l, b from corners)"""

_UPLOADS = """
files as (
  select doc_id as job,
         source || '_' || doc_id || ['.dxf', '.PNG', '.jpg', '.jpeg', '.bmp', '.tif', '.tiff', '.pdf', '.txt', '.svg']
           [(doc_id % 10 + 1)::int] as filename,
         n_chars * 2000 as size_bytes
  from documents),
uploads as (
  select *, lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) as format,
         round(size_bytes / 1048576.0::double, 3) as size_mb
  from files)"""

_JOBS = """
job_events as (
  select user_id as job, ts, event_id,
         case event_type when 'signup' then 'uploaded' when 'click' then 'processing'
              when 'view' then 'processing' when 'purchase' then 'done' when 'error' then 'error' end as status
  from events),
latest as (
  select job, status from (
    select *, row_number() over (partition by job order by ts desc, event_id desc) as n from job_events)
  where n = 1),
requests as (select distinct user_id * 2 as job from events)"""

_KIND = """case when format = '.dxf' then 'dxf' when format = '.pdf' then 'pdf' else 'raster' end"""

_PIXELS = _NUMBERED + """,
pixels as (
  select plan_id, seq as line_no, 1400 as img_w, 1000 as img_h, (l_partkey * 7) % 1200 as x1,
         (l_suppkey * 11) % 900 as y1,
         (l_partkey * 7) % 1200 + cast(trunc(l_quantity) as bigint) * 3 as x2,
         (l_suppkey * 11) % 900 + case when l_linenumber % 2 = 1 then 60 else 0 end as y2
  from numbered),
kept as (
  select * from pixels where sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::double) >= 20),
pixel_segments as (
  select plan_id, line_no as seq, 'WALL' as layer, 'HOUGH' as source_type,
         x1 / 100.0::double as x1, (img_h - y1) / 100.0::double as y1,
         x2 / 100.0::double as x2, (img_h - y2) / 100.0::double as y2
  from kept)"""

_NEIGHBOURS = _SEGMENTS + """,
measured as (
  select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length,
         degrees(atan2(y2 - y1, x2 - x1)) % 180.0::double as a from segments),
lines as (
  select *, case when a < 0 then a + 180.0::double else a end as angle from measured),
next_ends as (
  select plan_id, seq, length as la, angle as ta, x1 as ax1, y1 as ay1, x2 as ax2, y2 as ay2,
         (x2 - x1) / length as ux, (y2 - y1) / length as uy,
         lead(length) over w as lb, lead(angle) over w as tb, lead(x1) over w as bx1,
         lead(y1) over w as by1, lead(x2) over w as bx2, lead(y2) over w as by2
  from lines window w as (partition by plan_id order by seq) qualify lead(seq) over w is not null),
placed as (
  select *, (bx1 - ax1) * ux + (by1 - ay1) * uy as p1, (bx2 - ax1) * ux + (by2 - ay1) * uy as p2,
         (ax2 - ax1) * ux + (ay2 - ay1) * uy as pa,
         (ax1 + ax2) / 2.0::double as mxa, (ay1 + ay2) / 2.0::double as mya,
         (bx1 + bx2) / 2.0::double as mxb, (by1 + by2) / 2.0::double as myb
  from next_ends)"""

_ISLANDS = _AUTO_LINES + """,
turned as (
  select *, cast(round_even(angle * 10.0, 0) as int) % 1800 as tenths from lines),
along as (
  select *, cos(radians(tenths / 10.0::double)) as ux, sin(radians(tenths / 10.0::double)) as uy from turned),
ranges as (
  select plan_id, seq, tenths,
         round_even(((y1 + y2) / 2 * ux - (x1 + x2) / 2 * uy) / 0.03::double, 0)::bigint as "offset",
         round(least(x1 * ux + y1 * uy, x2 * ux + y2 * uy), 6) as lo,
         round(greatest(x1 * ux + y1 * uy, x2 * ux + y2 * uy), 6) as hi
  from along),
opened as (
  select *, case when lo > max(hi) over (partition by plan_id, tenths, "offset" order by lo, hi, seq
                                         rows between unbounded preceding and 1 preceding) + 0.5
                 then 1 else 0 end as opens
  from ranges),
numbered_islands as (
  select *, sum(opens) over (partition by plan_id, tenths, "offset" order by lo, hi, seq
                             rows unbounded preceding) as island
  from opened),
islands as (
  select plan_id, min(seq) as seq, tenths, "offset", count(*) as fragments, min(lo) as lo, max(hi) as hi,
         cos(radians(tenths / 10.0::double)) as ux, sin(radians(tenths / 10.0::double)) as uy
  from numbered_islands group by plan_id, tenths, "offset", island)"""

_WARNINGS = """concat_ws(' | ',
  case when parse_error is not null then 'Could not read the source: ' || parse_error end,
  case when parse_error is null and source_type <> 'dxf' then
    case when coalesce(segments_parsed, 0) = 0 then 'The picture gave no lines.'
         else 'Read from a picture: ' || coalesce(wall_segments, 0) || ' lines; check pixels per metre.' end end,
  case when parse_error is null and coalesce(wall_segments, 0) = 0 then
    case when coalesce(segments_parsed, 0) > 0
         then 'No layer is named as a wall; all segments were taken as walls.'
         else 'The source holds no geometry.' end end,
  case when parse_error is null and auto_scaled then 'Scale inferred: one unit is ' || applied_scale || ' m.' end,
  case when parse_error is null and coalesce(walls_detected, 0) = 0 then 'No walls were found in this plan.' end)"""

_PLANS = """,
plans as (
  select distinct o_orderkey // 8 as plan_id,
         case when (o_orderkey // 8) % 13 = 0 then 'pdf' when (o_orderkey // 8) % 5 = 0 then 'raster'
              else 'dxf' end as source_type,
         case when (o_orderkey // 8) % 17 = 0 then 'no ENTITIES section' end as parse_error
  from orders),
detected as (
  select plan_id, count(*) as walls_detected, count(*) filter (paired) as paired_walls
  from walls group by plan_id)"""

_LINE_TEXT = r"""'  0' || chr(10) || 'LINE' || chr(10) || '  8' || chr(10) || layer || chr(10)
  || ' 10' || chr(10) || printf('%.6f', x1) || chr(10) || ' 20' || chr(10) || printf('%.6f', y1) || chr(10)
  || ' 11' || chr(10) || printf('%.6f', x2) || chr(10) || ' 21' || chr(10) || printf('%.6f', y2) || chr(10)"""

_HEAD_TEXT = (
    "concat_ws(chr(10), '  0', 'SECTION', '  2', 'HEADER', '  9', '$INSUNITS', ' 70', '6', '  0', 'ENDSEC', "
    "'  0', 'SECTION', '  2', 'ENTITIES') || chr(10)"
)
_TAIL_TEXT = "concat_ws(chr(10), '  0', 'ENDSEC', '  0', 'EOF') || chr(10)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["segments"] = _with(_SEGMENTS, "select * from segments")
    strict = _category("layer").replace("contains(lower(layer), 'tur')", "starts_with(lower(layer), 'tur')")
    q["layer_categories"] = _with(
        _SEGMENTS,
        f"select plan_id, seq, {_category('layer')} as category, {strict} as strict_category from segments",
    )
    q["segment_measures"] = _with(
        _NEIGHBOURS,
        """select plan_id, seq, round(length, 6) as length, round(angle, 6) + 0.0 as angle,
                  round((x1 + x2) / 2, 4) + 0.0 as mid_x, round((y1 + y2) / 2, 4) + 0.0 as mid_y,
                  round((x2 - x1) / length, 6) + 0.0 as unit_x, round((y2 - y1) / length, 6) + 0.0 as unit_y
           from lines""",
    )
    q["neighbour_measures"] = _with(
        _NEIGHBOURS,
        """select plan_id, seq, round(least(abs(ta - tb), 180.0 - abs(ta - tb)), 6) + 0.0 as angle_gap,
                  abs(ta - tb) < 5 or abs(abs(ta - tb) - 180) < 5 as parallel_first_rules,
                  round(abs((mxb - mxa) * (-uy) + (myb - mya) * ux), 4) + 0.0 as distance,
                  round(sqrt((mxa - mxb) * (mxa - mxb) + (mya - myb) * (mya - myb)), 4) + 0.0 as mid_distance,
                  greatest(0.0, pa) + 0.3::double >= least(p1, p2)
                    and greatest(p1, p2) + 0.3::double >= least(0.0, pa) as overlap,
                  greatest(0.0, pa) + 0.5::double >= least(p1, p2)
                    and greatest(p1, p2) + 0.5::double >= least(0.0, pa) as overlap_first_rules,
                  round(least(1.0, 0.7::double + 0.3::double * (least(la, lb) / (greatest(la, lb) + 1e-9::double))), 3) as confidence,
                  round((ax1 + case when p1 > p2 then bx2 else bx1 end) / 2, 4) + 0.0 as center_x1,
                  round((ay1 + case when p1 > p2 then by2 else by1 end) / 2, 4) + 0.0 as center_y1,
                  round((ax2 + case when p1 > p2 then bx1 else bx2 end) / 2, 4) + 0.0 as center_x2,
                  round((ay2 + case when p1 > p2 then by1 else by2 end) / 2, 4) + 0.0 as center_y2,
                  round((ax1 + bx1) / 2, 4) + 0.0 as plain_x1, round((ay1 + by1) / 2, 4) + 0.0 as plain_y1,
                  round((ax2 + bx2) / 2, 4) + 0.0 as plain_x2, round((ay2 + by2) / 2, 4) + 0.0 as plain_y2
           from placed""",
    )
    q["unit_names"] = """select p_partkey, case p_size when 0 then 'unitless' when 1 then 'inches'
        when 2 then 'feet' when 4 then 'mm' when 5 then 'cm' when 6 then 'meters'
        else 'code:' || p_size end as units from part"""
    q["plan_bounds"] = _with(
        _SEGMENTS,
        """select plan_id, min(least(x1, x2)) as minx, min(least(y1, y2)) as miny,
                  max(greatest(x1, x2)) as maxx, max(greatest(y1, y2)) as maxy
           from segments group by plan_id""",
    )
    q["category_counts"] = _with(
        _AUTO,
        """select plan_id, wall_segments, door_segments, window_segments, other_segments, segments_parsed
           from stats""",
    )
    q["category_lists"] = _with(
        _AUTO,
        """select category, case category when 'WALL' then 0 when 'DOOR' then 1 when 'WINDOW' then 2 else 3
                  end as category_order, count(*) as segments, sum(seq)::bigint as seq_sum
           from tagged group by category""",
    )
    q["inferred_scale"] = _with(
        _AUTO,
        f"select plan_id, applied_scale, auto_scaled, {_rounded(4, 'minx', 'miny', 'maxx', 'maxy')} from stats",
    )
    wish = "(plan_id % 5 / 2.0::double - 0.5::double)"
    q["requested_scale"] = _with(
        _SEGMENTS + _stats(
            f"case when plan_id % 3 = 0 and {wish} > 0 then {wish} else 1.0::double end",
            "case when plan_id % 3 = 0 then plan_id % 2 = 0 else true end",
        ),
        f"select plan_id, applied_scale, auto_scaled, {_rounded(4, 'minx', 'maxx')} from stats",
    )
    q["effective_params"] = """select c_custkey as plan_id,
        case when (c_custkey % 7 - 3) / 2.0::double > 0 then (c_custkey % 7 - 3) / 2.0::double
             else 1.0::double end as scale from customer"""
    q["no_wall_fallback"] = _with(
        _AUTO + _lines("0.1::double"), "select plan_id, seq, layer, category, fallback from used"
    )
    q["wall_lines"] = _with(
        _AUTO_LINES, f"select plan_id, seq, layer, {_rounded(4, *_ENDS, 'length')} from lines"
    )
    q["plan_extents"] = _with(
        _AUTO,
        """select plan_id, round(maxx - minx, 4) + 0.0 as width, round(maxy - miny, 4) + 0.0 as depth,
                  round((maxx - minx) * (maxy - miny), 2) + 0.0 as footprint_area from stats""",
    )
    q["camera_fit"] = _with(
        _AUTO,
        """select plan_id, round((minx + maxx) / 2, 4) + 0.0 as target_x, 0.0::double as target_y,
                  round((miny + maxy) / 2, 4) + 0.0 as target_z,
                  round(greatest(maxx - minx, maxy - miny) * 2, 4) + 0.0 as radius from stats""",
    )
    pair = "select plan_id, i, j, round(distance, 6) + 0.0 as distance from "
    # Once more without buckets and cells: lines stored, all pairs of a plan tried.
    stored_lines = ("\nlines as (", "\nlines as materialized (")
    q["pair_candidates"] = _with(
        _AUTO_LINES.replace(*stored_lines) + _CANDIDATES.replace(_BUCKETS, _ALL), pair + "candidates"
    )
    q["pair_candidates_first_rules"] = _with(
        _V1_LINES.replace(*stored_lines) + _CANDIDATES_V1.replace(_CELLS, _ALL), pair + "candidates"
    )
    q["greedy_match"] = _with(_AUTO_MATCHES, pair + "matches")
    q["greedy_match_in_rounds"] = q["greedy_match"]
    record = (
        f"select plan_id, seq, {_rounded(4, *_ENDS, 'thickness', 'height', 'length')}, paired, confidence "
        "from sized where "
    )
    q["paired_walls"] = _with(_AUTO_WALLS, record + "paired")
    q["unpaired_walls"] = _with(_AUTO_WALLS, record + "not paired")
    q["wall_records_first_rules"] = _with(
        _V1_WALLS,
        f"""select plan_id, seq, {_rounded(4, *_ENDS, 'thickness', 'height', 'length')},
                   round(degrees(atan2(y2 - y1, x2 - x1)), 2) + 0.0 as angle_deg from sized""",
    )
    q["wall_boxes"] = _with(_AUTO_WALLS, "select * from boxes")
    q["wall_boxes_first_rules"] = _with(_V1_WALLS, "select * exclude (paired) from boxes")
    q["render_table"] = _with(
        _AUTO_WALLS,
        "select plan_id, seq, pos_x, pos_y, pos_z, width, box_height, depth, rotation_y from boxes",
    )
    q["floors"] = _with(
        _AUTO,
        """select plan_id, round((minx + maxx) / 2, 4) + 0.0 as pos_x, 0.0::double as pos_y,
                  round((miny + maxy) / 2, 4) + 0.0 as pos_z, round(maxx - minx, 4) + 0.0 as width,
                  round(maxy - miny, 4) + 0.0 as depth from stats""",
    )
    q["model_metadata"] = _with(_AUTO_WALLS + _METADATA, "select * from metadata")
    q["model_metadata_first_rules"] = _with(
        _V1_WALLS + _METADATA, "select * exclude (paired_walls) from metadata"
    )
    q["fixed_scale_metadata"] = _with(
        _SEGMENTS + _stats("0.5::double", "false") + _lines("0.1::double") + _CANDIDATES + _MATCHES
        + _walls("0.3", "2.5") + _METADATA,
        "select plan_id, wall_count, total_wall_length, paired_walls from metadata",
    )
    q["plan_params_metadata"] = _with(
        _SEGMENTS + _stats("case when plan_id % 2 = 0 then 0.5::double else 1.0::double end", "false")
        + _lines("0.1::double") + _CANDIDATES + _MATCHES + _walls("0.3", "2.5"),
        f"""select plan_id, count(*) as walls, {_TOTAL} as wall_length,
                   {_TOTAL.replace('width', 'depth')} as thickness_sum, max(pos_y) as mid_height
            from boxes group by plan_id""",
    )
    used = "case when wall_segments = 0 then segments_parsed else wall_segments end"
    q["result_stats"] = _with(
        _AUTO_WALLS + _PLANS,
        f"""select plan_id, segments_parsed, {used} as wall_segments,
                   coalesce(walls_detected, 0) as walls_detected, coalesce(paired_walls, 0) as paired_walls
            from stats left join detected using (plan_id)""",
    )
    q["assembled_models"] = _with(
        _AUTO_WALLS + _METADATA,
        """select plan_id, 0::bigint as part_no, any_value(wall_count) as walls, 1::bigint as floors,
                  coalesce(string_agg(printf('%.4f %.4f %.4f %.4f %s', pos_x, pos_z, width, depth, layer), '; '
                                      order by not paired, seq) filter (seq is not null), '') as wall_list,
                  any_value(total_wall_length) as total_wall_length
           from metadata left join boxes using (plan_id) group by plan_id""",
    )
    q["results"] = _with(
        _AUTO_WALLS + _PLANS,
        f"""select plan_id, parse_error is null as success,
                   case when parse_error is not null then 'Parsing failed' end as error,
                   {_WARNINGS} as warnings, source_type,
                   case when parse_error is null then coalesce(applied_scale, 1.0::double) end as applied_scale,
                   case when parse_error is null then coalesce({used}, 0) end as wall_segments,
                   case when parse_error is null then coalesce(walls_detected, 0) end as walls_detected,
                   case when parse_error is null then coalesce(paired_walls, 0) end as paired_walls
            from plans left join stats using (plan_id) left join detected using (plan_id)""",
    )
    q["results_first_rules"] = _with(
        _V1_WALLS + _PLANS,
        f"""select plan_id, true as success, concat_ws(' | ',
                     case when wall_segments = 0 and other_segments = 0 then
                       'The drawing holds no usable geometry.' end,
                     case when wall_segments = 0 then
                       'No layer is named as a wall; all segments were taken as walls.' end,
                     case when walls_detected is null then 'No walls were found in this plan.' end) as warnings,
                   segments_parsed, {used} as wall_segments, coalesce(walls_detected, 0) as walls_detected
            from stats left join detected using (plan_id)""",
    )
    q["nested_boxes"] = _with(
        _AUTO_WALLS + _PLANS,
        """select plan_id, row_number() over (partition by plan_id order by not paired, seq) - 1 as place,
                  layer, paired, confidence, pos_x, pos_z, width, depth, rotation_y
           from boxes join plans using (plan_id) where parse_error is null""",
    )
    q["written_models"] = _with(
        _AUTO_WALLS + _METADATA + _PLANS,
        """select plan_id, coalesce(wall_count, 0) as wall_count, coalesce(wall_count, 0) as stored_walls,
                  coalesce(floor_count, 0) as stored_floors, 'floorplan-json-v1' as format
           from plans left join metadata using (plan_id) where parse_error is null""",
    )
    q["merge_fragments_islands"] = _with(
        _ISLANDS,
        """select plan_id, seq, tenths, "offset", fragments,
                  round(lo * ux - "offset" * 0.03::double * uy, 4) + 0.0 as x1,
                  round(lo * uy + "offset" * 0.03::double * ux, 4) + 0.0 as y1,
                  round(hi * ux - "offset" * 0.03::double * uy, 4) + 0.0 as x2,
                  round(hi * uy + "offset" * 0.03::double * ux, 4) + 0.0 as y2,
                  round(hi - lo, 4) + 0.0 as length from islands""",
    )
    q["merge_fragments"] = "with recursive" + _with(
        _FRAGMENTS, f"select plan_id, seq, {_rounded(4, *_ENDS, 'length')} from lines"
    ).removeprefix("with")
    q["merged_walls"] = "with recursive" + _with(
        _FRAGMENTS + _CANDIDATES + _MATCHES + _walls() + _METADATA,
        "select plan_id, wall_count, total_wall_length, paired_walls from metadata",
    ).removeprefix("with")
    q["pixel_segments"] = _with(_PIXELS, "select * from pixel_segments")
    q["pixel_facts"] = _with(
        _PIXELS + """,
        extents as (
          select plan_id, min(least(x1, x2)) as minx, min(least(y1, y2)) as miny,
                 max(greatest(x1, x2)) as maxx, max(greatest(y1, y2)) as maxy
          from pixel_segments group by plan_id)""",
        """select plan_id, 'raster' as source, '1400x1000px' as image_size, count(*) as lines_detected,
                  100.0::double as pixels_per_meter, 'meters (pixel-estimated)' as units,
                  any_value(minx) as minx, any_value(miny) as miny, any_value(maxx) as maxx,
                  any_value(maxy) as maxy
           from pixels left join extents using (plan_id) group by plan_id""",
    )
    q["pixel_walls"] = _with(
        _PIXELS + ", segments as (select * from pixel_segments)" + _stats("1.0::double", "true")
        + _lines("0.1::double") + _CANDIDATES + _MATCHES + _walls() + _METADATA,
        "select plan_id, wall_count, paired_walls from metadata",
    )
    q["polyline_segments"] = _with(
        _NUMBERED + """,
        points as (
          select l_orderkey as plan_id, seq as part, 12 * ((l_suppkey * 7) % 100) / 100.0::double as x,
                 12 * ((l_partkey * 13) % 83) / 100.0::double as y from numbered),
        steps as (
          select *, lead(x) over w as nx, lead(y) over w as ny, first_value(x) over w as fx,
                 first_value(y) over w as fy, count(*) over (partition by plan_id) as n
          from points window w as (partition by plan_id order by part)),
        chords as (
          select plan_id, part, x as x1, y as y1, nx as x2, ny as y2 from steps where nx is not null
          union all
          select plan_id, part, x, y, fx, fy from steps where nx is null and n >= 2 and plan_id % 2 = 0)""",
        "select plan_id, 0 as rec, part, '0' as layer, 'POLYLINE' as source_type, x1, y1, x2, y2 from chords",
    )
    q["arc_segments"] = _with(
        f"""arcs as (
          select p_partkey as plan_id, p_size::double as cx, (p_partkey % 50)::double as cy,
                 p_size / 10.0::double as radius,
                 {_arc_points('((p_partkey * 37) % 360)::double', '((p_partkey * 53) % 360)::double')}
          from part)""",
        """select plan_id, 0 as rec, k::int as part, 'DOOR' as layer, 'ARC' as source_type,
                  round(cx + radius * cos(a0 + k * step), 6) + 0.0 as x1,
                  round(cy + radius * sin(a0 + k * step), 6) + 0.0 as y1,
                  round(cx + radius * cos(a0 + (k + 1) * step), 6) + 0.0 as x2,
                  round(cy + radius * sin(a0 + (k + 1) * step), 6) + 0.0 as y2
           from arcs cross join range(12) r(k)""",
    )
    q["drawing_text"] = _with(
        _SEGMENTS,
        f"""select plan_id, 0::bigint as part_no,
                   {_HEAD_TEXT} || string_agg({_LINE_TEXT}, '' order by seq) || {_TAIL_TEXT} as text
            from segments group by plan_id""",
    )
    q["drawing_round_trip"] = _with(
        _SEGMENTS, f"select plan_id, seq, layer, source_type, {_rounded(4, *_ENDS)} from segments"
    )
    q["stored_drawings"] = q["drawing_round_trip"]
    q["drawing_by_lines"] = _with(
        _SEGMENTS,
        f"""select row_number() over (order by plan_id, seq) - 1 as seq, layer, source_type, {_rounded(4, *_ENDS)}
            from segments""",
    )
    q["stored_models"] = _with(
        _AUTO_WALLS + _METADATA + _PLANS,
        """select plan_id, 'model' as state, 3 as generation, coalesce(wall_count, 0) as wall_count,
                  coalesce(wall_count, 0) as stored_walls
           from plans left join metadata using (plan_id) where parse_error is null""",
    )
    stored = (
        _AUTO_WALLS + _METADATA + _PLANS + "," + _JOBS + """,
stored as (
  select plan_id, coalesce(wall_count, 0) as wall_count, coalesce(wall_count, 0) as stored_walls
  from plans left join metadata using (plan_id) where parse_error is null)"""
    )
    q["stored_model_answers"] = _with(
        stored,
        """select job, status,
                  case when status is null then '404: job not found' when status = 'uploaded' then '400: not yet processed'
                       when status = 'processing' then 'processing' when stored_walls is null then '500: no result available'
                       else 'result' end as answer,
                  case when answer = 'result' then stored_walls || ' walls' end as result
           from requests left join latest using (job) left join stored on plan_id = job""",
    )
    q["deleted_stored_models"] = _with(stored, "select * from stored where plan_id not in (select job from requests)")
    q["unknown_stored_models"] = _with(
        stored, "select job as plan_id from requests where job not in (select plan_id from stored)"
    )
    q["ingested_results"] = _with(
        _AUTO_WALLS + _METADATA,
        """select plan_id, plan_id % 2 as batch, case when plan_id % 17 = 0 then 'failed' else 'model' end as state,
                  case when plan_id % 17 = 0 then 'error' else 'done' end as status,
                  case when plan_id % 17 <> 0 then (select count(*) from sized s where s.plan_id = m.plan_id) end as walls_detected,
                  case when plan_id % 17 <> 0 then total_wall_length end as total_wall_length, true as timed
           from metadata m""",
    )
    q["ingested_time_stats"] = """select 'dxf' as source_type, count(*) as models, true as ordered
        from (select distinct l_orderkey // 8 as plan_id from lineitem) where plan_id % 17 <> 0"""
    q["drawing_tags"] = _with(
        _SEGMENTS + ", sized as (select plan_id, count(*) as n from segments group by plan_id)",
        """select plan_id, code, n * per_line + fixed as tags
           from sized cross join (values (0, 1, 5), (2, 0, 2), (9, 0, 1), (70, 0, 1), (8, 1, 0), (10, 1, 0),
                                         (20, 1, 0), (11, 1, 0), (21, 1, 0)) v(code, per_line, fixed)""",
    )
    q["drawing_entities"] = _with(
        _SEGMENTS,
        """select plan_id, count(*) as entities, 0::bigint as skipped_entities, 'meters' as units
           from segments group by plan_id""",
    )
    q["mixed_drawing_entities"] = """with
kinds as (
  select p_partkey // 10 as plan_id, p_partkey % 5 as kind, p_size::double as x, (p_partkey % 50)::double as y from part),
drawn as (
  select plan_id, 'LINE' as source_type, x + 4 as x2 from kinds where kind = 0
  union all
  select plan_id, 'POLYLINE', case k when 2 then x else x + 4 end from kinds, range(3) r(k) where kind = 1
  union all
  select plan_id, 'ARC', x + 2.5::double * cos(radians(90.0::double * (k + 1) / 12)) from kinds, range(12) r(k) where kind = 2),
segs as (
  select plan_id, count(*) filter (source_type = 'LINE') as line, count(*) filter (source_type = 'POLYLINE') as polyline,
         count(*) filter (source_type = 'ARC') as arc, count(*) - 1 as last_seq, round(sum(x2), 3) + 0.0 as x2_sum
  from drawn group by plan_id),
found as (
  select plan_id, count(*) as entities, count(*) filter (kind = 3) as skipped_entities
  from kinds where kind <> 4 group by plan_id)
select plan_id, entities, skipped_entities,
       case plan_id % 8 when 0 then 'unitless' when 1 then 'inches' when 2 then 'feet' when 4 then 'mm' when 5 then 'cm'
                        when 6 then 'meters' else 'code:' || (plan_id % 8) end as units,
       line, polyline, arc, last_seq, x2_sum
from found left join segs using (plan_id)"""
    q["line_segments"] = _with(
        _SEGMENTS, f"select plan_id, seq as rec, layer, {_rounded(4, *_ENDS)} from segments"
    )
    q["room_area"] = _with(_ROOMS, "select plan_id, room_no, round(w * h, 4) as area from rooms")
    q["room_names"] = _with(
        _ROOMS + """,
        counted as (
          select *, row_number() over (partition by plan_id, room_type order by room_no) as nth from rooms)""",
        f"select plan_id, room_no, {_room_name('room_type', 'nth')} as name from counted",
    )
    q["stack_column"] = _with(
        _ROOMS,
        """select plan_id, room_no % 2 as col, room_no,
                  round(coalesce(sum(h) over (partition by plan_id, room_no % 2 order by room_no
                        rows between unbounded preceding and 1 preceding), 0), 4) + 0.0 as y,
                  round(max(w) over (partition by plan_id, room_no % 2), 4) + 0.0 as col_w,
                  round(sum(h) over (partition by plan_id, room_no % 2), 4) + 0.0 as col_h
           from rooms""",
    )
    q["layout_rectangular"] = _with(_PLACED, f"select {_ROOM_VIEW} from placed")
    q["layout_open_plan"] = _with(_layout(None), f"select {_ROOM_VIEW} from placed")
    q["layout_l_shape"] = _with(
        _PLACED + """,
        cornered as (
          select *, x + w / 2 > plan_width / 2 and y + h / 2 < plan_height / 2 as corner from placed),
        ranked as (
          select *, count(*) over (partition by plan_id) as rooms_n,
                 count(*) filter (corner) over (partition by plan_id) as corners,
                 coalesce(count(*) filter (corner) over (partition by plan_id order by room_no
                          rows between unbounded preceding and 1 preceding), 0) as earlier
          from cornered),
        kept as (
          select * exclude (plan_width, plan_height) from ranked
          where not (corner and rooms_n > 3 and earlier < corners // 2)),
        resized as (
          select *, max(x + w) over (partition by plan_id) as plan_width,
                 max(y + h) over (partition by plan_id) as plan_height from kept)""",
        f"select {_ROOM_VIEW} from resized",
    )
    q["plan_room_stats"] = _with(
        _PLACED,
        """select plan_id, count(*) as rooms, round(sum(w * h), 4) + 0.0 as floor_area,
                  round(max(x + w), 4) + 0.0 as width, round(max(y + h), 4) + 0.0 as height
           from placed group by plan_id""",
    )
    q["room_report"] = _with(
        _PLACED,
        """select plan_id, 0::bigint as part_no,
                  'Total: ' || printf('%.1f', max(plan_width)) || 'm × ' || printf('%.1f', max(plan_height))
                  || 'm' || chr(10) || 'Floor area: ' || printf('%.1f', round(sum(w * h), 6)) || 'm²' || chr(10)
                  || 'Rooms: ' || count(*) || chr(10) || chr(10)
                  || string_agg('  ' || rpad(name, greatest(20, length(name)::int), ' ') || ' ' || printf('%.1f', w) || '×' || printf('%.1f', h)
                                || 'm  (' || printf('%.1f', w * h) || 'm²)', chr(10) order by room_no) as report
           from placed group by plan_id""",
    )
    ends4 = _rounded(4, *_ENDS)
    q["room_edges"] = _with(_EDGES, f"select plan_id, room_no, side_no, {ends4} from edges")
    q["edge_keys"] = _with(_EDGES, "select plan_id, room_no, side_no, lo_x, lo_y, hi_x, hi_y from keys")
    q["dedupe_edges"] = _with(_EDGES, f"select plan_id, room_no, side_no, {ends4} from unique_edges")
    q["double_lines"] = _faces("(0, -0.5::double), (1, 0.5::double)")
    q["single_lines"] = _faces("(0, 0.0::double)")
    q["offset_lines"] = _faces("(0, 0.0::double), (1, 1.0::double)")
    q["room_openings"] = _with(
        _OPENINGS, f"select plan_id, room_no, item, part, layer, source_type, {ends4} from openings"
    )
    q["room_outline"] = _with(
        _OPENINGS, f"select plan_id, room_no, part, 'ROOM' as layer, {ends4} from outlines"
    )
    q["room_labels"] = _with(
        _PLACED,
        """select plan_id, room_no, 'name' as kind, name as text, 0.25::double as height,
                  round(x + w / 2 - length(name) * 0.07::double, 4) + 0.0 as x, round(y + h / 2, 4) + 0.0 as y
           from placed
           union all
           select plan_id, room_no, 'area', printf('%.1f', w * h) || 'm²', 0.18::double,
                  round(x + w / 2 - 0.3::double, 4) + 0.0, round(y + h / 2 - 0.35::double, 4) + 0.0
           from placed""",
    )
    q["plan_titles"] = _with(
        _PLACED,
        """select plan_id, 'Floor Plan — ' || count(*) || ' Rooms  |  ' || printf('%.1f', max(plan_width))
                  || 'm × ' || printf('%.1f', max(plan_height)) || 'm' as text,
                  0.35::double as height, 0.0::double as x, -1.0::double as y
           from placed group by plan_id""",
    )
    parts = _EDGES + "," + _OPENINGS[len(_PLACED):].lstrip().lstrip(",") + """,
        annotations as (
          select plan_id, 'ROOM' as layer, 'POLYLINE' as source_type, x1, y1, x2, y2 from outlines
          union all select plan_id, layer, source_type, x1, y1, x2, y2 from openings)"""
    both = parts + """,
        faced as (
          select e.*, s.shift, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as size
          from unique_edges e cross join (values (-0.5::double), (0.5::double)) s(shift)),
        all_drawn as (
          select plan_id, 'WALL' as layer, 'LINE' as source_type,
                 x1 - (y2 - y1) / size * 0.2::double * shift as x1, y1 + (x2 - x1) / size * 0.2::double * shift as y1,
                 x2 - (y2 - y1) / size * 0.2::double * shift as x2, y2 + (x2 - x1) / size * 0.2::double * shift as y2
          from faced where size >= 1e-6
          union all select plan_id, layer, source_type, x1, y1, x2, y2 from annotations)"""
    # Only walls enter the chain; the other drawn lines count for bounds and scale.
    one_line = parts + """,
        segments as (
          select plan_id, (room_no * 4 + side_no) * 2 as seq, 'WALL' as layer, 'LINE' as source_type,
                 x1, y1, x2, y2
          from unique_edges where sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 1e-6
          union all select plan_id, null, layer, source_type, x1, y1, x2, y2 from annotations)"""
    q["room_plan_walls"] = _with(
        one_line + _stats("1.0::double", "true") + _lines("0.1::double") + _CANDIDATES + _MATCHES
        + _walls() + _METADATA,
        "select plan_id, wall_count, floor_count from metadata",
    )
    q["room_plan_segments"] = _with(
        both,
        """select plan_id, layer, source_type, count(*) as segments,
                  round(min(least(x1, x2)), 4) + 0.0 as minx, round(max(greatest(y1, y2)), 4) + 0.0 as maxy
           from all_drawn group by plan_id, layer, source_type""",
    )
    q["room_plan_lines"] = _with(
        both, f"select plan_id, layer, source_type, {_rounded(4, *_ENDS)} from all_drawn"
    )
    q["upload_admission"] = _with(
        _UPLOADS,
        f"""select *, case
              when format not in ('.dxf', '.png', '.jpg', '.jpeg', '.bmp', '.tif', '.tiff', '.pdf')
                then '400: unsupported format ' || format
              when size_bytes / 1048576.0::double > 50 then '413: larger than 50 MB' end as reject_reason,
              case when reject_reason is null then {_KIND} end as source_type
            from uploads""",
    )
    q["upload_admission_first_rules"] = _with(
        _UPLOADS,
        """select job, format, case when format <> '.dxf' then '400: unsupported format ' || format
             when size_bytes / 1048576.0::double > 50 then '413: larger than 50 MB' end as reject_reason
           from uploads""",
    )
    q["upload_catalog"] = "select source, sum(length(doc_id::varchar) + 1)::bigint as size_bytes from documents group by source"
    q["streamed_job_status"] = _with(_JOBS, "select job, status from latest")
    q["upload_kinds"] = _with(_UPLOADS, f"select job, {_KIND} as source_type from uploads")
    q["job_status"] = _with(_JOBS, "select job, status from latest")
    q["list_jobs"] = _with(
        _JOBS + "," + _UPLOADS,
        "select job, status, filename, format from latest left join uploads using (job)",
    )
    q["list_jobs_first_rules"] = _with(
        _JOBS + "," + _UPLOADS,
        "select job, status, filename, size_mb from latest left join uploads using (job)",
    )
    q["get_model"] = _with(
        _JOBS,
        """select job, status, case when status in ('done', 'error') then 'result of ' || job end as result,
                  case when status is null then '404: job not found'
                       when status = 'uploaded' then '400: not yet processed'
                       when status = 'processing' then 'processing' else 'result' end as answer
           from requests left join latest using (job)""",
    )
    q["delete_jobs"] = _with(
        _JOBS, "select job, status from latest where job not in (select job from requests)"
    )
    q["unknown_jobs"] = _with(_JOBS, "select job from requests where job not in (select job from latest)")
    q["model_time_stats"] = """select event_type, count(*) as models, min(value) as min_ms,
        round(quantile_cont(value, 0.5), 4) as median_ms, max(value) as max_ms
        from events group by event_type"""
    return q
