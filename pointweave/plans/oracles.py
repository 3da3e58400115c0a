"""DuckDB SQL with the rows of the registered raster queries."""

from __future__ import annotations

from pointweave.sources.derived import sql_with

_W, _H = 128, 96
_P = _W * _H


def _norm(c: str) -> str:
    """A normalised file name, without lookahead and backreference."""
    n = rf"regexp_replace(regexp_replace({c}, '\s*\(\d+\)\s*\.', '.', 'g'), '(?i)[-_]?copy\d*\.', '.', 'g')"
    ext = rf"regexp_extract({n}, '(\.[^./]+)$', 1)"
    base = f"left({n}, length({n}) - length({ext}))"
    return f"case when {ext} <> '' and lower(right({base}, length({ext}))) = lower({ext}) then left({n}, length({n}) - 2 * length({ext})) || {ext} else {n} end"


_NAMES = f"""{sql_with("images", "points")},
ann as (select image_name as annotation_name, min(image_id) as seq from points group by 1),
img as (select distinct image_name from images),
alias as (select {_norm("annotation_name")} as key, min(annotation_name) as annotation_name from ann group by 1),
keys as (select annotation_name as key, annotation_name, 0 as alias from ann union all select key, annotation_name, 1 from alias),
tries as (select image_name, image_name as key, 0 as normal from img union all select image_name, {_norm("image_name")}, 1 from img),
batch as (select image_name, annotation_name from (
  select t.image_name, k.annotation_name, row_number() over (partition by t.image_name order by t.normal, k.alias, k.annotation_name) as r
  from tries t join keys k on t.key = k.key) x where r = 1),
app_i as (select key, image_name from (select {_norm("image_name")} as key, image_name, row_number() over (partition by {_norm("image_name")} order by image_id desc, image_name desc) as r from images) x where r = 1),
app_a as (select key, annotation_name from (select {_norm("annotation_name")} as key, annotation_name, row_number() over (partition by {_norm("annotation_name")} order by seq desc, annotation_name desc) as r from ann) x where r = 1),
app as (select i.key, image_name, annotation_name from app_i i join app_a a on i.key = a.key)
"""

_LOCATED = f"""{sql_with("points", "labelset", "segments")},
located as (select s.image_id, s.round, s.segment_id, l.class_id, p.point_seq
  from points p join labelset l on p.label = l.short_code join segments s on s.image_id = p.image_id and s.y = p.y and s.x = p.x)
"""

_ROUNDS = f"""{sql_with("segments", "voted")},
painted as (select s.image_id, s.round, s.y, s.x, v.class_id, v.votes from segments s join voted v on v.image_id = s.image_id and v.round = s.round and v.segment_id = s.segment_id)
"""


def _fold(order: str) -> str:
    return f"""{_ROUNDS},
folded as (select image_id, y, x, class_id from (select *, row_number() over (partition by image_id, y, x order by {order}) as k from painted) t where k = 1)
"""


_PLACES = "select image_id, class_id, count(*) as pixels, cast(sum(y * 1000 + x) as bigint) as places from {} group by image_id, class_id"
_CONFIDENT = "case when votes >= 3 then 0 else 1 end, case when votes >= 3 then -round else round end"


def _components(slack: int, *more: str) -> str:
    return f"""{sql_with("runs", *more, recursive=True)},
r as (select *, image_id * 4294967296 + y * 65536 + x0 as rid from runs),
near as (select a.rid as a, b.rid as b from r a join r b on a.image_id = b.image_id and a.class_id = b.class_id and b.y = a.y + 1 and b.x0 <= a.x1 + {slack} and b.x1 >= a.x0 - {slack}),
both_ways as (select a, b from near union all select b, a from near),
reach as (select a as x, a as y from both_ways union select reach.x, both_ways.b from reach join both_ways on reach.y = both_ways.a),
low as (select x, min(y) as m from reach group by x),
lab as (select r.*, coalesce(m, rid) as region_id from r left join low on x = rid),
meas as (select image_id, class_id, region_id, cast(sum(x1 - x0 + 1) as bigint) as area, min(x0) as bbox_x, min(y) as bbox_y, max(x1) - min(x0) + 1 as bbox_w, max(y) - min(y) + 1 as bbox_h,
  cast(floor(sum((x1 - x0 + 1) * y) / sum(x1 - x0 + 1)) as int) as centre_y, cast(floor(sum((x1 - x0 + 1) * (x0 + x1)) / (2 * sum(x1 - x0 + 1))) as int) as centre_x
  from lab group by image_id, class_id, region_id)
"""


_CONFIDENCE = f"""{_components(0, "points", "labelset")},
pin as (select l.region_id, count(*) as n, sum(case when ls.class_id = l.class_id then 1 else 0 end) as m
  from points p join lab l on p.image_id = l.image_id and p.y = l.y and p.x between l.x0 and l.x1 left join labelset ls on ls.short_code = p.label group by l.region_id),
base as (select image_id, class_id, meas.region_id, area as size, area / {_P}.0 as size_ratio, coalesce(n, 0) as points_in_region, cast(coalesce(m, 0) as bigint) as matching_points
  from meas left join pin on meas.region_id = pin.region_id),
scored as (select *, cast(case when points_in_region = 0 then 0 when points_in_region = 1 then 20 when points_in_region = 2 then 30 else least(40, 30 + 2 * points_in_region) end as double) as point_score,
  case when points_in_region > 0 then 30.0 * matching_points / points_in_region else 0.0 end as consistency_score,
  cast(case when size_ratio < 0.001 then 5 when size_ratio < 0.005 then 15 when size_ratio < 0.01 then 25 when size_ratio < 0.3 then 30 when size_ratio < 0.5 then 20 else 10 end as double) as size_score from base),
conf as (select *, point_score + consistency_score + size_score as confidence from scored)
"""

_ELLIPSE = "(values (-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0)) as o(dy, a, b)"

_OPTION_ROWS = "values ('superpixel', [30.0, 100.0, 300.0, 900.0, 1500.0, 3000.0]), ('graph', [100.0, 300.0, 500.0, 1000.0]), ('adaptive', [5.0, 10.0, 20.0])"
_ROUND_ROWS = "values (0, 'superpixel', 3000.0), (1, 'superpixel', 900.0), (2, 'graph', 300.0), (3, 'adaptive', 10.0)"


def all_sql() -> dict[str, str]:
    return {
        "normalize_names": f"""
select id, name, {_norm("name")} as normalized from (
  select p_partkey as id, replace(p_name, ' ', '_') || ['.jpg', '.jpeg.jpeg', '.JPG.jpg', ' (1).jpg', '_copy2.png', '-Copy.png', 'photocopy.jpg', ' (12).jpg.jpg', '', '.jpg.jpg.jpg'][cast(p_partkey % 10 + 1 as int)] as name from part) t""",
        "match_batch": f"{_NAMES} select * from batch",
        "match_app": f"{_NAMES} select * from app",
        "images_without_points": f"{_NAMES} select image_name from img where image_name not in (select image_name from batch)",
        "points_without_images": f"{_NAMES} select annotation_name from ann where annotation_name not in (select annotation_name from batch)",
        "resume_remaining": f"""{sql_with("images")}
select image_id, image_name from images where image_name not in (select image_name from images join supplier on s_suppkey = image_id where s_acctbal >= 5000)""",
        "resolve_paths": f"""{_NAMES},
files as (select '/data/' || cast(height as string) || '/' || image_name as path, image_name as file from images),
cand as (select a.annotation_name as image_name, 0 as loose, path from ann a join files f on f.file = a.annotation_name
  union all select a.annotation_name, 1, path from ann a join files f on {_norm("f.file")} = {_norm("a.annotation_name")})
select image_name, path from (select image_name, path, row_number() over (partition by image_name order by loose, path) as r from cand) t where r = 1""",
        "match_report": f"""{_NAMES}
select (select count(*) from images) as images, (select count(*) from ann) as annotated, (select count(*) from app) as matched,
  (select cast(sum(case when image_name <> annotation_name then 1 else 0 end) as bigint) from app) as by_normal_form, (select count(*) from images where contains(lower(image_name), '9.j')) as found""",
        "top_images": f"{sql_with('points')} select image_name, count(*) as points from points group by image_name order by points desc, image_name limit 100",
        "scale_points": f"{sql_with('points')} select image_id, point_seq, cast(round_even(y * 0.5, 0) as int) as y, cast(round_even(x * 0.5, 0) as int) as x from points",
        "pyramid_points": f"{sql_with('points')} select image_id, point_seq, cast(trunc(y * 0.5) as int) as y, cast(trunc(x * 0.25) as int) as x, 32 as width from points",
        "in_bounds": f"{sql_with('points', 'labelset')} select image_id, point_seq, y, x, class_id from points join labelset on label = short_code where y < {_H} and x < {_W}",
        "quality_reasons": f"{_quality()} select image_id, points, cells, reason from q",
        "quality_summary": f"{_quality()} select reason, count(*) as images, cast(sum(points) as bigint) as points from q group by reason",
        "enrich_labels": """
select n_nationkey::int as class_id, n_name as short_code,
  case when n_regionkey < 2 then n_name || ' reef' when n_regionkey > 2 then lower(n_name) else n_name end as name,
  case when n_regionkey < 2 then r_name else 'Unknown' end as functional_group from nation left join region on n_regionkey = r_regionkey""",
        "param_table": f"""
with i as (select cast(s_suppkey as bigint) as image_id, case when s_acctbal < 0 then 0.25 when s_acctbal < 5000 then 0.5 else 1.0 end::double as scale from supplier),
v as (select image_id, round, r.kind, case r.kind when 'superpixel' then value::double * scale * scale when 'graph' then value::double / sqrt(scale) else value::double end as v, options
  from i cross join ({_ROUND_ROWS}) r(round, kind, value) join ({_OPTION_ROWS}) o(kind, options) on r.kind = o.kind),
u as (select image_id, round, kind, v, unnest(options)::double as o from v)
select image_id, round, kind, o as value from (select *, row_number() over (partition by image_id, round order by abs(o - v), o) as k from u) t where k = 1""",
        "unscaled_params": f"""
with i as (select cast(s_suppkey as bigint) as image_id, case when s_acctbal < 0 then 0.25 else 0.5 end::double as scale from supplier)
select image_id, round, round(case kind when 'superpixel' then value::double / (scale * scale) when 'graph' then value::double * sqrt(scale) else value::double end, 6) as value
from i cross join ({_ROUND_ROWS}) r(round, kind, value)""",
        "vote_majority": f"{sql_with('voted')} select image_id, round, segment_id, class_id, cast(votes as bigint) as votes from voted",
        "vote_last_write": f"""{_LOCATED}
select image_id, round, segment_id, class_id from (select *, row_number() over (partition by image_id, round, segment_id order by point_seq desc) as k from located) t where k = 1""",
        "fold_fill": f"{_fold('round')} {_PLACES.format('folded')}",
        "fold_overwrite": f"{_fold('round desc')} {_PLACES.format('folded')}",
        "fold_confident": f"{_fold(_CONFIDENT)} {_PLACES.format('folded')}",
        "round_coverage": f"""{_ROUNDS},
f as (select image_id, y, x, min(round) as round from painted group by image_id, y, x),
n as (select image_id, round, count(*) as n from f group by image_id, round)
select image_id, round, round(sum(n) over (partition by image_id order by round) * 100.0::double / {_P}, 6) as coverage from n""",
        "class_histogram": f"""{_fold("round")},
c as (select image_id, class_id, count(*) as pixels from folded group by image_id, class_id)
select image_id, c.class_id, name, pixels, round(pixels * 100.0::double / sum(pixels) over (partition by image_id), 6) as share from c join labelset on c.class_id = labelset.class_id""",
        "point_histogram": f"""{sql_with("points")},
c as (select image_id, label, count(*) as points from points group by image_id, label)
select image_id, label, points, round(points * 100.0::double / sum(points) over (partition by image_id), 6) as share from c""",
        "annotation_counts": f"""{sql_with("points")}, c as (select image_id, count(*) as n from points group by image_id)
select max(n) as most, min(n) as fewest, round(avg(n), 6) as mean, count(*) as images from c""",
        "distinct_classes": f"{_fold('round desc')} select image_id, count(distinct class_id) as classes, count(*) as pixels from folded group by image_id",
        "runs_encode": f"{sql_with('runs')} select * from runs",
        "resample_nearest": f"""{sql_with("raster")},
dst as (select y, x from (select unnest(range({_H}))::int as y) a cross join (select unnest(range({_W}))::int as x) b),
m as (select y, x, cast(floor(floor(y * 38 / 96.0::double) * 96 / 38.0::double) as int) as sy, cast(floor(floor(x * 51 / 128.0::double) * 128 / 51.0::double) as int) as sx from dst),
out as (select r.image_id, r.class_id, m.y, m.x from m join raster r on r.y = m.sy and r.x = m.sx) {_PLACES.format("out")}""",
        "resample_bilinear": f"""{sql_with("pixels")},
wx as (select t, greatest(least(f + k, 127), 0) as s, case k when 0 then 1 - (a - f) else a - f end as w from (select t, (t + 0.5::double) * 128 / 51 - 0.5 as a, floor((t + 0.5::double) * 128 / 51 - 0.5) as f from (select unnest(range(51)) as t)) q, (values (0), (1)) z(k)),
wy as (select t, greatest(least(f + k, 95), 0) as s, case k when 0 then 1 - (a - f) else a - f end as w from (select t, (t + 0.5::double) * 96 / 38 - 0.5 as a, floor((t + 0.5::double) * 96 / 38 - 0.5) as f from (select unnest(range(38)) as t)) q, (values (0), (1)) z(k)),
v as (select image_id, wy.t as y, wx.t as x, sum(b * wx.w * wy.w) as v from pixels join wx on wx.s = x join wy on wy.s = y where wx.w > 0 and wy.w > 0 group by image_id, wy.t, wx.t)
select image_id, cast(y as int) as y, count(*) as n, round(sum(v), 4) as total from v group by image_id, y""",
        "colour_planes": f"""{sql_with("pixels")},
lin as (select image_id, b, g, r, {", ".join(f"case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else power(({c} / 255.0::double + 0.055) / 1.055, 2.4) end as l{c}" for c in "bgr")} from pixels),
xyz as (select *, (0.412453::double * lr + 0.357580::double * lg + 0.180423::double * lb) / 0.95047 as x, 0.212671::double * lr + 0.715160::double * lg + 0.072169::double * lb as y, (0.019334::double * lr + 0.119193::double * lg + 0.950227::double * lb) / 1.08883 as z from lin),
f as (select *, {", ".join(f"case when {c} > 0.008856 then cbrt({c}) else 7.787 * {c} + 16.0::double / 116 end as f{c}" for c in "xyz")} from xyz)
select image_id, cast(sum(cast(round(0.299::double * r + 0.587::double * g + 0.114::double * b) as int)) as bigint) as grey, round(avg(116 * fy - 16), 4) as l, round(avg(500 * (fx - fy)), 4) as a, round(avg(200 * (fy - fz)), 4) as b from f group by image_id""",
        "closing_ellipse": f"""{sql_with("raster")},
o as (select dy, unnest(generate_series(a, b)) as dx from {_ELLIPSE}),
dil as (select distinct image_id, class_id, y - dy as y, x - dx as x from raster cross join o where y - dy between 0 and {_H - 1} and x - dx between 0 and {_W - 1}),
hits as (select d.image_id, d.class_id, d.y - dy as y, d.x - dx as x, count(*) as n from dil d cross join o where d.y - dy between 0 and {_H - 1} and d.x - dx between 0 and {_W - 1} group by all),
room as (select y, x, count(*) as n from (select unnest(range({_H})) as y) a cross join (select unnest(range({_W})) as x) b cross join o where y + dy between 0 and {_H - 1} and x + dx between 0 and {_W - 1} group by y, x),
closed as (select h.image_id, h.class_id, h.y, h.x from hits h join room on room.y = h.y and room.x = h.x and room.n = h.n),
fills as (select image_id, y, x, min(class_id) as class_id from closed c where not exists (select 1 from raster r where r.image_id = c.image_id and r.y = c.y and r.x = c.x) group by image_id, y, x),
out as (select image_id, y, x, class_id from raster union all select image_id, y, x, class_id from fills) {_PLACES.format("out")}""",
        "components8": f"{_components(1)} select image_id, class_id, area, bbox_x, bbox_y, bbox_w, bbox_h, centre_y, centre_x from meas",
        "components4": f"{_components(0)} select image_id, class_id, area, bbox_x, bbox_y, bbox_w, bbox_h, centre_y, centre_x from meas",
        "count_segments_rollup": f"{_components(1)} select image_id, class_id, count(*) as regions from meas group by image_id, class_id union all select image_id, null, count(*) from meas group by image_id",
        "speckle_removal": f"{_components(1)} select l.image_id, l.class_id, cast(sum(x1 - x0 + 1) as bigint) as pixels, count(*) as runs from lab l join meas on l.region_id = meas.region_id where area >= 40 group by l.image_id, l.class_id",
        "merge_compare": f"{_components(1)} select image_id, class_id, count(*) as before, count(*) filter (where area >= 40) as after, count(*) filter (where area < 40) as gone from meas group by image_id, class_id",
        "region_colours": f"""{_components(1, "pixels")},
m as (select l.region_id, avg(p.b) as b, avg(p.g) as g, avg(p.r) as r from lab l join pixels p on p.image_id = l.image_id and p.y = l.y and p.x between l.x0 and l.x1 group by l.region_id)
select image_id, class_id, bbox_x, bbox_y, area, round(b, 4) as b, round(g, 4) as g, round(r, 4) as r from meas join m on meas.region_id = m.region_id""",
        "region_adjacency": f"""{_components(1)},
p as (select a.image_id, least(a.region_id, b.region_id) as lo, greatest(a.region_id, b.region_id) as hi from lab a join lab b on a.image_id = b.image_id and a.y = b.y and b.x0 = a.x1 + 1 where a.region_id <> b.region_id
  union select a.image_id, least(a.region_id, b.region_id), greatest(a.region_id, b.region_id) from lab a join lab b on a.image_id = b.image_id and b.y = a.y + 1 and b.x0 <= a.x1 and b.x1 >= a.x0 where a.region_id <> b.region_id)
select image_id, count(*) as pairs from p group by image_id""",
        "colour_merge_identity": _colour_groups(30, 1),
        "colour_merge_gap": _colour_groups(12, 3),
        "merge_classes": f"{_components(1)} select image_id, count(distinct class_id) as before, count(distinct class_id) filter (where area >= 150) as after from meas group by image_id",
        "bridge_targets": f"""{_components(1)},
pairs as (select s.image_id, s.class_id, s.region_id, s.centre_y as from_y, s.centre_x as from_x, l.y as to_y, greatest(l.x0, least(l.x1, s.centre_x)) as to_x
  from meas s join lab l on l.image_id = s.image_id and l.class_id = s.class_id join meas b on b.region_id = l.region_id where s.area < 48 and b.area >= 48),
d as (select *, abs(to_x - from_x) as dx, abs(to_y - from_y) as dy from pairs),
w as (select *, floor(min(0.955::double * abs(dx - dy) + 1.3693::double * least(dx, dy)) over (partition by region_id)) + 5 as reach from d)
select image_id, class_id, from_y, from_x, to_y, to_x from (select *, row_number() over (partition by region_id order by dx + dy, to_y, to_x) as k from w where dx <= reach and dy <= reach) t where k = 1""",
        "region_confidence": f"""{_CONFIDENCE}
select image_id, class_id, size, round(size_ratio, 6) as size_ratio, points_in_region, matching_points, point_score, round(consistency_score, 6) as consistency_score, size_score, round(confidence, 6) as confidence from conf""",
        "confidence_summary": f"{_CONFIDENCE} select min(round(confidence, 6)) as least, max(round(confidence, 6)) as greatest, round(avg(round(confidence, 6)), 4) as mean, count(*) as regions from conf",
        "confidence_filter": f"{_CONFIDENCE} select image_id, class_id, cast(sum(size) as bigint) as pixels from conf where confidence >= 70 group by image_id, class_id",
        "score_tables": """
with o as (select l_orderkey as id, count(*) as n, sum(case when l_linenumber < 3 then 1 else 0 end) as m, cast(max(l_discount) as double) * 6 as q from lineitem group by l_orderkey)
select id, cast(case when n = 1 then 20 when n = 2 then 30 else least(40, 30 + 2 * n) end as double) as points, round(30.0::double * m / n, 6) as consistency,
  cast(case when q < 0.001 then 5 when q < 0.005 then 15 when q < 0.01 then 25 when q < 0.3 then 30 when q < 0.5 then 20 else 10 end as double) as size from o""",
        "coco_images": f"{sql_with('images')} select image_id as id, image_name as file_name, width, height from images",
        "coco_categories": "select cast(n_nationkey + 1 as int) as id, case when n_regionkey > 1 then lower(n_name) else n_name end as name from nation",
        "coco_annotations": f"""{_components(1)},
k as (select *, row_number() over (order by image_id, class_id, region_id) as id from meas where area >= 10 and bbox_w > 1 and bbox_h > 1)
select id, image_id, class_id as category_id, bbox_x * 2.5::double as bbox_x, bbox_y * 2.5::double as bbox_y, bbox_w * 2.5::double as bbox_w, bbox_h * 2.5::double as bbox_h, round(area * 6.25::double, 1) as area, 0 as iscrowd from k""",
        "document_read_back": f"""{_components(1, "images", "labelset")},
k as (select *, row_number() over (order by image_id, class_id, region_id) as id from meas where area >= 10 and bbox_w > 1 and bbox_h > 1)
select id, k.image_id, image_name as file_name, width, name, bbox_x * 2.5::double as bbox_x, bbox_y * 2.5::double as bbox_y, bbox_w * 2.5::double as bbox_w, bbox_h * 2.5::double as bbox_h, round(area * 6.25::double, 1) as area
from k left join images on k.image_id = images.image_id join labelset on k.class_id = labelset.class_id""",
        "incremental_export": f"""{sql_with("images", "points")},
c as (select image_id, count(*) as n from points group by image_id),
k as (select row_number() over (order by case when i.image_id % 3 <> 0 then 0 else 1 end, image_name) as id, image_name as file_name, n from images i left join c on i.image_id = c.image_id),
s as (select *, cast(sum(n) over (order by id) as bigint) as last from k)
select id, file_name, coalesce(n, 0) as annotations, case when n > 0 then last - n + 1 end as first, case when n > 0 then last end as last from s""",
        "points_csv": f"{sql_with('points')} select image_name, cast(y as double) as row, x + 0.5::double as col, label from points where image_id % 7 <> 0",
        "labelset_json": """
select cast(n_nationkey as varchar) as label_id, n_name as short_code, cast(n_nationkey * 7 % 256 as int) as cr, cast(n_nationkey * 40 % 256 as int) as cg, cast(n_nationkey * 91 % 256 as int) as cb,
  lower(n_name) as color_name, cast(n_nationkey + 1 as int) as class_id from nation""",
        "resume_ids": f"""{_components(1, "images")}
select (select count(*) from meas where area >= 10 and bbox_w > 1 and bbox_h > 1) as annotation_id, (select max(image_id) from images) as image_id""",
        "run_report": f"""{_components(1, "images")}
select (select count(*) from images) as images, (select count(*) from meas where area >= 10 and bbox_w > 1 and bbox_h > 1) as annotations, cast(5 as bigint) as categories,
  (select count(*) from images where image_id not in (select image_id from meas where area >= 10 and bbox_w > 1 and bbox_h > 1)) as images_without_annotations""",
        "number_images": f"{sql_with('images')} select image_name, row_number() over (order by image_name) + 10 as id from images",
        "label_lookup": """
select label, class_id from (select left(n_name, 1) as label, cast(n_nationkey + 1 as int) as class_id, row_number() over (partition by left(n_name, 1) order by n_nationkey * 7 % 25 desc) as k from nation) t where k = 1""",
        "search_images": f"{sql_with('images')} select distinct image_name from images where contains(lower(image_name), '5.j') order by image_name limit 100",
        "normal_form_examples": f"{_NAMES} select image_name, annotation_name from batch where image_name <> annotation_name order by image_name limit 3",
        "failed_examples": f"""{_NAMES}
select image_name from batch where image_name not in (select image_name from images join supplier on s_suppkey = image_id where s_acctbal >= 5000) order by image_name limit 10""",
        "ranked_classes": f"""{sql_with("raster", "labelset")},
c as (select image_id, class_id, count(*) as pixels from raster group by image_id, class_id)
select image_id, cast(row_number() over (partition by image_id order by pixels desc, c.class_id) as int) as rank, c.class_id, name, pixels, round(pixels * 100.0::double / sum(pixels) over (partition by image_id), 6) as share
from c join labelset on c.class_id = labelset.class_id""",
        "appended_export": f"""{_components(1, "images")},
done as (select image_id as id, image_name as file_name, image_id from images join supplier on s_suppkey = image_id where s_acctbal >= 5000),
more as (select (select max(id) from done) + row_number() over (order by image_name) as id, image_name as file_name, image_id from images where image_name not in (select file_name from done)),
listed as (select *, 0 as later from done union all select *, 1 from more),
k as (select l.id, area, row_number() over (order by later, l.id, class_id, region_id) as ann from meas join listed l on meas.image_id = l.image_id where area >= 10 and bbox_w > 1 and bbox_h > 1),
per as (select id, count(*) as annotations, min(ann) as first, max(ann) as last, round(sum(round(area * 6.25::double, 1)), 1) as area from k group by id)
select listed.id, file_name, annotations, first, last, area from listed left join per on listed.id = per.id""",
        "export_summary": f"""{_NAMES},
done as (select image_name from images join supplier on s_suppkey = image_id where s_acctbal >= 5000),
j as (select img.image_name, annotation_name, img.image_name in (select image_name from done) as done from img left join batch on img.image_name = batch.image_name)
select count(*) as images, count(annotation_name) as matched, count(*) filter (where image_name <> annotation_name) as by_normal_form,
  count(*) filter (where annotation_name is not null and done) as processed, count(*) filter (where annotation_name is not null and not done) as failed from j""",
        "edt": f"""{sql_with("pixels", "points")},
p as (select distinct image_id, y, x from points where y < {_H} and x < {_W}),
d as (select q.image_id, q.y, q.x, sqrt(min((q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x))) as distance from pixels q join p on q.image_id = p.image_id group by q.image_id, q.y, q.x)
select image_id, count(*) as pixels, round(sum(distance), 4) as total, round(max(distance), 6) as farthest from d group by image_id""",
        "density_map": f"""{sql_with("points")},
p as (select distinct image_id, y, x from points where y < {_H} and x < {_W}),
g as (select k, exp(-k * k / (2 * power(0.3::double * 24 + 0.8, 2))) as w from (select unnest(range(-25, 26)) as k)),
n as (select k, w / (select sum(w) from g) as w from g),
t as (select size, t, case when t + k < 0 then -(t + k) when t + k >= size then 2 * (size - 1) - (t + k) else t + k end as s, w
  from (select {_H} as size, unnest(range({_H})) as t union all select {_W}, unnest(range({_W}))) a cross join n),
a as (select image_id, p.y, t.t as x, sum(w) as v from p join t on t.size = {_W} and t.s = p.x group by all),
b as (select image_id, t.t as y, a.x, sum(v * w) as v from a join t on t.size = {_H} and t.s = a.y group by all),
c as (select *, v / max(v) over (partition by image_id) as density from b)
select image_id, count(*) as pixels, round(sum(density), 4) as total, round(max(case when y = 40 and x = 60 then density end), 6) as middle from c group by image_id""",
        "export_coordinates": f"{sql_with('points')} select image_id, point_seq, round(y * 2.5::double, 1) as y, round(x * 5.0::double, 1) as x from points",
    }


def _colour_groups(distance: int, gap: int) -> str:
    return f"""{_components(1, "pixels")},
m as (select l.image_id, l.region_id, avg(p.b) as b, avg(p.g) as g, avg(p.r) as r from lab l join pixels p on p.image_id = l.image_id and p.y = l.y and p.x between l.x0 and l.x1 group by all),
beside as (select distinct a.region_id as a, b.region_id as b from lab a join lab b on a.image_id = b.image_id and a.class_id = b.class_id and a.region_id <> b.region_id
  and ((a.y = b.y and b.x0 > a.x1 and b.x0 <= a.x1 + {gap}) or (b.y > a.y and b.y <= a.y + {gap} and b.x0 <= a.x1 and b.x1 >= a.x0))),
close as (select beside.a, beside.b from beside join m x on beside.a = x.region_id join m y on beside.b = y.region_id where sqrt((x.b - y.b) ** 2 + (x.g - y.g) ** 2 + (x.r - y.r) ** 2) < {distance}),
links as (select a, b from close union select b, a from close),
walk as (select region_id as a, region_id as b from meas union select walk.a, links.b from walk join links on walk.b = links.a),
named as (select a, min(b) as g from walk group by a)
select image_id, count(*) as regions, count(distinct g) as groups from meas join named on a = region_id group by image_id"""


def _quality() -> str:
    return f"""{sql_with("part_points")},
box as (select image_id, count(*) as points, min("row") as r0, max("row") as r1, min(col) as c0, max(col) as c1 from part_points group by image_id),
hit as (select p.image_id, count(distinct least(trunc(("row" - r0) / ((r1 - r0 + 1) / 2)), 1) * 4 + least(trunc((col - c0) / ((c1 - c0 + 1) / 4)), 3)) as cells
  from part_points p join box on p.image_id = box.image_id group by p.image_id),
q as (select box.image_id, points, cells, case when points < 28 then 'low count' when cells < 8 then 'poor spread' else 'kept' end as reason from box join hit on box.image_id = hit.image_id)
"""
