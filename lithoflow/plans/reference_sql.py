"""DuckDB SQL for the queries of ``reference_queries``."""

from __future__ import annotations

WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def first_of(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(c)}, '')" for c in cols) + ", '')"


def join_distinct(*cols: str) -> str:
    """For two or three columns."""
    parts = [f"nullif({strip(c)}, '')" for c in cols]
    kept = [parts[0]]
    for k, p in enumerate(parts[1:], 1):
        kept.append("case when " + " and ".join(f"{p} is distinct from {q}" for q in parts[:k]) + f" then {p} end")
    return f"concat_ws(' / ', {', '.join(kept)})"


POINTS = "pts as (select distinct query_id, query.lat as lat, query.lon as lon from query_points where query.lat between -90 and 90 and query.lon between -180 and 180 and query_id is not null)"
VERTICES = """
verts as (select feature_id, r, v, geom[r][v].lon as x, geom[r][v].lat as y, len(geom[r]) as n from
  (select feature_id, geom, r, unnest(range(1, len(geom[r]) + 1)) as v from (select feature_id, geom, unnest(range(1, len(geom) + 1)) as r from (select distinct feature_id, geom from geology_features where len(geom) > 0)))),
edges as (select a.feature_id, a.r, a.v, a.x as x1, a.y as y1, b.x as x2, b.y as y2, a.n from verts a join verts b on a.feature_id = b.feature_id and a.r = b.r and b.v = case when a.v = a.n then 1 else a.v + 1 end),
boxes as (select feature_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from verts group by 1)"""
HITS = """
cand as (select p.query_id, p.lat, p.lon, b.feature_id from pts p join boxes b on p.lon between b.x0 and b.x1 and p.lat between b.y0 and b.y1),
hits as (select c.query_id, c.lat, c.lon, c.feature_id from cand c join edges e on e.feature_id = c.feature_id where e.n > 2 and (e.y1 > c.lat) <> (e.y2 > c.lat)
  and c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / (e.y2 - e.y1) + e.x1 group by all having count(*) % 2 = 1)"""
REGIONS = "regs as (select distinct p.query_id, r.region from pts p join region_boundaries r on p.lon between r.nominal_quadrangle.lon_min and r.nominal_quadrangle.lon_max and p.lat between r.nominal_quadrangle.lat_min and r.nominal_quadrangle.lat_max)"
MATCH = """
units as (select distinct coalesce(raw_unit_name_ja, '') as name, coalesce(raw_lithology, '') as litho, coalesce(raw_age, '') as age from geology_features),
nl as (select distinct name, litho from units),
kws as (select term_id, match_on, priority, term_id as row_no, trim(k.kw) as kw, k.kw_no from l1_geology_terms,
  lateral (select unnest(string_split(match_keywords_ja, ';')) as kw, generate_subscripts(string_split(match_keywords_ja, ';'), 1) as kw_no) k where trim(k.kw) <> ''),
hit as (select name, litho, term_id, kw, match_on, priority, row_no, kw_no, case when contains(case when match_on = 'name' then name else litho end, kw) then 1 else 2 end as pass
  from nl join kws on contains(name || ' ' || litho, kw)),
best as (select name, litho, arg_min({'pass': pass, 'term_id': term_id, 'kw': kw, 'match_on': match_on}, {'pass': pass, 'priority': priority, 'row_no': row_no, 'kw_no': kw_no}) as m from hit group by 1, 2),
matched as (select n.name, n.litho, m.term_id as term_id, m.kw as keyword, case when m.pass = 2 then 'name+litho' else m.match_on end as field,
  case when m.pass is null then 'very_low' when m.pass = 2 then 'low' when m.match_on = 'name' then 'high' else 'medium' end as l1_confidence from nl n left join best b on n.name = b.name and n.litho = b.litho)"""
INFER = MATCH + """,
props as (select term_id, any_value(geological_material) as material, any_value(grain_or_rock) as grain from l1_geology_terms group by 1),
ident as (select u.name, u.litho, u.age, m.term_id, m.keyword, m.field, coalesce(p.material, 'unknown') as material, p.grain as grain0, m.l1_confidence as c0,
  regexp_matches(u.age, '更新世|鮮新世|中新世|Pleistocene|Pliocene|Miocene') as old from units u join matched m on u.name = m.name and u.litho = m.litho left join props p on p.term_id = m.term_id),
ident2 as (select name, litho, age, term_id, keyword, field, material, case when old and grain0 = 'coarse' then 'terrace_gravel' else grain0 end as grain,
  coalesce(old and grain0 in ('coarse', 'fine'), false) as age_refined, case when old and grain0 = 'coarse' then 'medium' else c0 end as l1_confidence from ident),
facts as (select distinct material, grain from ident2),
tr as (select f.material, f.grain, arg_min({'map_id': map_id, 'g': match_grain_or_rock, 'family': engineering_material_family, 'gt': engineering_ground_type}, {'p': priority, 'i': map_id}) as m
  from facts f join l2_geology_to_geotech l on f.material = l.match_geological_material and (l.match_grain_or_rock = '*' or l.match_grain_or_rock = f.grain) group by 1, 2),
full1 as (select i.*, m.map_id as map_id, m.family as family, coalesce(m.gt, 'mixed_or_uncertain_geology') as ground_type,
  case when m.map_id is null then 'very_low' when m.g = '*' then 'medium' else 'high' end as l2_confidence from ident2 i left join tr t on i.material = t.material and i.grain is not distinct from t.grain),
full2 as (select *, ['very_low', 'low', 'medium', 'high'][least(list_position(['very_low', 'low', 'medium', 'high'], l1_confidence), list_position(['very_low', 'low', 'medium', 'high'], l2_confidence))] as overall_confidence from full1),
inf as (select *, overall_confidence in ('low', 'very_low') or ground_type = 'mixed_or_uncertain_geology' or not regexp_matches(name, '[^\\s\\p{Z}]') as needs_manual_review from full2)"""
CARDS = """
f as (select coalesce(source_region, '') as source_region, coalesce(raw_unit_code, '') as raw_unit_code, coalesce(raw_unit_name_ja, '') as raw_unit_name_ja, feature_id, raw_lithology, raw_age from geology_features),
g as (select source_region, raw_unit_code, raw_unit_name_ja, min(feature_id) as first_seen, arg_min({'l': raw_lithology, 'a': raw_age}, feature_id) as m, count(*) as n_features from f group by 1, 2, 3),
cards as (select *, row_number() over (order by first_seen, source_region, raw_unit_code, raw_unit_name_ja) - 1 as seq from g),
named as (select 'UC2_' || source_region || '_' || case when raw_unit_code = '' then 'NA' else raw_unit_code end || '_' || case when seq < 1000 then lpad(seq::varchar, 3, '0') else seq::varchar end as geology_unit_card_id, * from cards)"""
RAD = "(pi() / 180)"


def segment_sql() -> str:
    k = f"({RAD} * 6371000)"
    return f"""seg as (select h.query_id, h.feature_id, (e.x1 - h.lon) * {k} * cos(h.lat * {RAD}) as ax, (e.y1 - h.lat) * {k} as ay, (e.x2 - h.lon) * {k} * cos(h.lat * {RAD}) as bx, (e.y2 - h.lat) * {k} as b_y
  from first h join edges e on e.feature_id = h.feature_id where e.v < e.n),
seg2 as (select *, bx - ax as dx, b_y - ay as dy from seg),
seg3 as (select *, case when dx * dx + dy * dy > 0 then least(1, greatest(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) else 0 end as t from seg2),
dist as (select query_id, min(sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2))) as m from seg3 group by 1)"""


READABLE = r"[^\p{L}\p{N}\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}、。・，．（）「」]"
QUALITY = f"case when length(text) > 0 then length(regexp_replace(text, '{READABLE}', '', 'g')) / length(text) else 0 end"
SNAP = "round(round_even(actual_data_bbox.{k} / {s}, 0) * {s}, 6) as {k}"

SIXTH = "(1.0::double / 6.0::double)"
GROUND = """g0 as (select engineering_ground_type as ground_type, min(geotech_term_en) as en, min(geotech_term_ja) as ja, min(trim(source_ref)) as source_ref, count(*) as n from l2_geology_to_geotech where engineering_ground_type is not null group by 1),
l3 as (select * from g0 where ground_type < 's'), l4 as (select * from g0 where ground_type > 'c')"""
CHAIN_STEPS = f"""with {INFER}, {GROUND},
p1 as (select term_id, any_value(primary_lithology_en) as lith, any_value(typical_consolidation) as cons, any_value(source_ref) as src from l1_geology_terms group by 1),
p2 as (select map_id, any_value(rationale_en) as why, any_value(source_ref) as src, any_value(geotech_term_ja) as ja from l2_geology_to_geotech group by 1),
k as (select source_id, any_value(tier) as tier from knowledge_sources group by 1),
refs as (select distinct ref from (select src as ref from p1 union all select src from p2 union all select concat_ws(';', source_ref, 'NOT_THERE') from l3) where ref <> ''),
rl as (select ref, list_filter(list_transform(string_split(ref, ';'), lambda x: trim(x)), lambda x: x <> '') as xs from refs),
re as (select ref, unnest(xs) as id, generate_subscripts(xs, 1) as pos from rl),
src as (select ref, string_agg(id, ';' order by pos) as ids, string_agg(coalesce(k.tier, 'unknown'), ';' order by pos) as tiers from re left join k on re.id = k.source_id group by 1),
u as (select i.*, p1.lith, p1.cons, p1.src as src1, p2.why, p2.src as src2, p2.ja, case when i.age_refined then 'overconsolidated (pre-Holocene)' else p1.cons end as cons2, a.ground_type as t3, a.ja as ja3, concat_ws(';', a.source_ref, 'NOT_THERE') as src3, b.ja as ja4
  from inf i left join p1 on p1.term_id = i.term_id left join p2 on p2.map_id = i.map_id left join l3 a on a.ground_type = i.ground_type left join l4 b on b.ground_type = i.ground_type),
st as (
select name, litho, age, 'L1_geology' as step, 'L1 :: ' || term_id as knowledge_ref, keyword as matched_keyword, l1_confidence as confidence,
  case when term_id is null then 'No L1 geology term matched the unit name or lithology.' else 'Matched ''' || keyword || ''' in ' || field || ' -> ' || term_id || ' (' || coalesce(lith, 'None') || ', ' || coalesce(cons, 'None') || ').' end
  || case when age_refined and grain = 'terrace_gravel' then ' | Age refinement: ''' || age || ''' is pre-Holocene -> treated as overconsolidated (diluvial) granular ground rather than soft Holocene alluvium.'
          when age_refined then ' | Age refinement: ''' || age || ''' is pre-Holocene -> fine soil likely overconsolidated/stiff rather than soft normally-consolidated clay.' else '' end as evidence,
  src1 as ref, age as given, case when term_id is not null then cons2 end as got, case when term_id is null then 1 when age_refined then 10 else 9 end as n_outputs from u
union all select name, litho, age, 'L2_geotech_translation', 'L2 :: ' || map_id, null, l2_confidence, case when map_id is null then 'No L2 mapping matched; defaulted to uncertain geology.' else coalesce(why, '') end, src2, coalesce(cons2, ''), case when map_id is not null then ja end, case when map_id is null then 2 else 5 end from u
union all select name, litho, age, 'L3_indicative_properties', case when t3 is not null then 'L3 :: ' || ground_type end, null, case when t3 is null then 'very_low' else 'medium' end, case when t3 is null then '' else 'Indicative screening bands; NOT design values (design_use: false).' end, case when t3 is not null then src3 end, ground_type, case when t3 is not null then '["' || ja3 || '"]' end, case when t3 is null then 0 else 5 end from u
union all select name, litho, age, 'L4_considerations', 'L4 :: ' || ground_type, null, 'medium', 'Conditional screening considerations (''may be relevant -> investigate''); not design conclusions.', null, ground_type, coalesce(ja4, ''), 3 from u)
select st.name, litho, age, step, knowledge_ref, matched_keyword, confidence, evidence, coalesce(src.ids, '') as source_ids, coalesce(src.tiers, '') as source_tiers, given, got, n_outputs::integer as n_outputs from st left join src on src.ref = st.ref"""

SQL = {
    "normalize_units": f"""with o as (select distinct feature_id, source_file, source_region, raw_unit_code, raw_unit_name_ja, raw_unit_name_en, raw_lithology, raw_age from geology_features where len(geom) > 0),
r as (select source_file, min(source_region) as region from geology_features group by 1)
select distinct r.region || '_A_' || case when len(i) < 4 then lpad(i, 4, '0') else i end as feature_id, o.source_file, {first_of('raw_unit_code', "source_region")} as raw_unit_code, {first_of('raw_unit_name_ja', 'raw_unit_name_en')} as raw_unit_name_ja, '' as raw_unit_name_en,
  {first_of('raw_lithology')} as raw_lithology, {join_distinct('raw_age', 'raw_unit_name_en')} as raw_age, raw_lithology as legend
from (select *, cast(cast(regexp_extract(feature_id, '([0-9]+)$', 1) as bigint) as varchar) as i from o) o join r on o.source_file = r.source_file""",
    "rule_two_pass": f"with {MATCH} select * from matched",
    "inference_chain_flat": f"with {INFER} select name, litho, age, term_id, keyword, field, material, grain, age_refined, map_id, family, ground_type, l1_confidence, l2_confidence, overall_confidence, needs_manual_review from inf",
    "chain_display_order": f"with {INFER}, {GROUND} select i.name, i.litho, i.age, 'L4 :: ' || i.ground_type || ' -> ' || case when p.ground_type is null then 'L3_indicative_properties' else 'L3 :: ' || i.ground_type end || ' -> ' || coalesce('L2 :: ' || map_id, 'L2_geotech_translation') || ' -> ' || coalesce('L1 :: ' || term_id, 'L1_geology') as chain_text from inf i left join l3 p on p.ground_type = i.ground_type",
    "manual_review": f"with {INFER} select ground_type, overall_confidence, count(*) as n_units from inf where needs_manual_review group by 1, 2",
    "wildcard_translate": """with facts as (select distinct coalesce(geological_material, '') as material, coalesce(grain_or_rock, '') as grain from l1_geology_terms),
tr as (select f.material, f.grain, arg_min({'map_id': map_id, 'g': match_grain_or_rock, 'family': engineering_material_family, 'gt': engineering_ground_type}, {'p': priority, 'i': map_id}) as m
  from facts f join l2_geology_to_geotech l on f.material = l.match_geological_material and (l.match_grain_or_rock = '*' or l.match_grain_or_rock = f.grain) group by 1, 2)
select f.material, f.grain, concat_ws('/', f.material, f.grain) as fact, m.map_id as map_id, m.family as family, coalesce(m.gt, 'mixed_or_uncertain_geology') as ground_type,
  case when m.map_id is null then 'very_low' when m.g = '*' then 'medium' else 'high' end as l2_confidence from facts f left join tr t on f.material = t.material and f.grain = t.grain""",
    "worst_confidence": """with s as (select coalesce(interpretation_confidence, '') as confidence, list_position(['very_low', 'low', 'medium', 'high'], interpretation_confidence) as a, case when needs_manual_review then 2 else 4 end as b from geotech_features)
select confidence, ['very_low', 'low', 'medium', 'high'][least(coalesce(nullif(a, 0), 9), b)] as overall, count(*) as n from s group by 1, 2""",
    "risk_flags_exploded": """with s as (select unnest(case when starts_with(trim(geotechnical_risk_flags), '[') then case when json_valid(geotechnical_risk_flags) then cast(geotechnical_risk_flags as json)::varchar[] end else string_split(trim(geotechnical_risk_flags), ';') end) as flag from geotech_features)
select trim(flag) as flag, count(*) as n from s where trim(flag) <> '' group by 1""",
    "source_refs_lookup": """with l as (select distinct map_id, source_ref from l2_geology_to_geotech),
u as (select map_id, list_filter(list_transform(string_split(source_ref, ';'), lambda x: trim(x)), lambda x: x <> '') as xs from l),
e as (select map_id, unnest(xs) as source_id, generate_subscripts(xs, 1) - 1 as pos from u), k as (select source_id, any_value(title) as title, any_value(tier) as tier from knowledge_sources group by 1)
select e.map_id, e.pos::integer as pos, e.source_id, coalesce(k.title, e.source_id) as title, coalesce(k.tier, 'unknown') as tier from e left join k on e.source_id = k.source_id""",
    "unit_cards": f"with {CARDS} select geology_unit_card_id, source_region, raw_unit_code, raw_unit_name_ja, m.l as raw_lithology, m.a as raw_age, first_seen, n_features from named",
    "feature_card_join": f"with {CARDS} select distinct f.feature_id, n.geology_unit_card_id from f join named n using (source_region, raw_unit_code, raw_unit_name_ja)",
    "card_assets_top12": """with d as (select distinct source_region, asset_id from pdf_asset_index where source_region is not null), r as (select *, row_number() over (partition by source_region order by asset_id) as n from d)
select source_region, string_agg(asset_id, ';' order by n) as asset_ids from r where n <= 12 group by 1""",
    "region_for_point": f"with {POINTS}, {REGIONS} select * from regs",
    "bbox_filter": f"with {POINTS} select r.region, count(distinct p.query_id) as n_points from pts p join region_boundaries r on p.lon between r.actual_data_bbox.lon_min and r.actual_data_bbox.lon_max and p.lat between r.actual_data_bbox.lat_min and r.actual_data_bbox.lat_max group by 1",
    "point_in_polygon": f"with {POINTS}, {VERTICES}, {HITS} select distinct query_id, feature_id from hits",
    "first_polygon": f"with {POINTS}, {VERTICES}, {HITS} select query_id, min(feature_id) as feature_id from hits group by 1",
    "points_batch_query": f"""with {POINTS}, {VERTICES}, {HITS}, {REGIONS},
first as (select query_id, any_value(lat) as lat, any_value(lon) as lon, min(feature_id) as feature_id from hits group by 1), {segment_sql()},
reg as (select query_id, string_agg(region, ';' order by region) as regions from regs group by 1), feat as (select feature_id, any_value(raw_unit_code) as raw_unit_code from geology_features group by 1)
select p.query_id, coalesce(regions, '') as regions, f.feature_id is not null as found, case when f.feature_id is not null then null when regions is not null then 'inside sheet ' || regions || ' but no polygon at point' else 'outside the mapped extent' end as message,
  f.feature_id, round(round(d.m, 1), 0) as distance_m, g.raw_unit_code from pts p left join reg using (query_id) left join first f using (query_id) left join dist d using (query_id) left join feat g on g.feature_id = f.feature_id""",
    "haversine": f"with {POINTS} select query_id, round(2 * 6371000 * asin(least(1, sqrt(power(sin((35.5 - lat) * {RAD} / 2), 2) + cos(lat * {RAD}) * cos(35.5 * {RAD}) * power(sin((139.5 - lon) * {RAD} / 2), 2)))), 2) as metres from pts",
    "polygon_area": f"""with {VERTICES}, o as (select feature_id, geom[1][1].lat as lat0 from geology_features where len(geom) > 0 group by all), s as (select feature_id, r, x from verts where v = 1),
m as (select e.*, (e.x1 - s.x) * ({RAD} * 6371000) * cos(o.lat0 * {RAD}) as px, (e.y1 - o.lat0) * ({RAD} * 6371000) as py, (e.x2 - s.x) * ({RAD} * 6371000) * cos(o.lat0 * {RAD}) as qx, (e.y2 - o.lat0) * ({RAD} * 6371000) as qy
  from edges e join o on e.feature_id = o.feature_id join s on e.feature_id = s.feature_id and e.r = s.r)
select feature_id, round(abs(sum(case when n >= 3 then px * qy - qx * py else 0 end)) / 2, 1) as area_m2 from m group by 1""",
    "vertex_centroid": f"with {VERTICES} select feature_id, round(avg(x) + 1e-9, 6) as lon, round(avg(y) + 1e-9, 6) as lat, min(x) as lon_min, min(y) as lat_min, max(x) as lon_max, max(y) as lat_max from verts group by 1",
    "region_extents": f"""with {VERTICES}, n as (select coalesce(source_region, '') as region, count(*) as n_polygons from geology_features where len(geom) > 0 group by 1), w as (select distinct feature_id, coalesce(source_region, '') as region from geology_features),
e as (select w.region, any_value(n.n_polygons)::integer as n_polygons, min(x0) as lon_min, min(y0) as lat_min, max(x1) as lon_max, max(y1) as lat_max from boxes b join w on w.feature_id = b.feature_id join n on n.region = w.region group by 1)
select region, n_polygons, {', '.join(f"round(cast(cast({k} as varchar) as decimal(18, 12)), 6)::double as data_{k}, round(round_even({k} / {q}, 0) * {q}, 6) as frame_{k}" for k, q in (('lon_min', '0.25'), ('lat_min', SIXTH), ('lon_max', '0.25'), ('lat_max', SIXTH)))} from e""",
    "snap_quad": f"select region, {', '.join(SNAP.format(k=k, s='0.25' if k.startswith('lon') else '(1.0::double / 6.0::double)') for k in ('lon_min', 'lat_min', 'lon_max', 'lat_max'))} from region_boundaries where actual_data_bbox is not null",
    "sample_line": f"""with b as (select distinct region, nominal_quadrangle.lon_min as x1, nominal_quadrangle.lat_min as y1, nominal_quadrangle.lon_max as x2, nominal_quadrangle.lat_max as y2 from region_boundaries where nominal_quadrangle is not null),
n as (select *, greatest(2, floor(2 * 6371000 * asin(least(1, sqrt(power(sin((y2 - y1) * {RAD} / 2), 2) + cos(y1 * {RAD}) * cos(y2 * {RAD}) * power(sin((x2 - x1) * {RAD} / 2), 2)))) / 5000)::integer + 1) as n from b),
e as (select *, unnest(range(0, n + 1)) as i from n) select region, i::integer as i, round(x1 + (x2 - x1) * i / n, 6) as lon, round(y1 + (y2 - y1) * i / n, 6) as lat from e""",
    "text_quality_scores": f"select doc_id, round({QUALITY}, 3) as quality from documents where text is not null",
    "text_blocks": f"select cast(doc_id as varchar) as source_pdf, coalesce(page_no, 1) as pages_est, length(text)::integer as chars, round({QUALITY}, 3) as text_quality, ({QUALITY}) >= 0.85 and length(text) > 200 as readable, substring(text, 1, 800) as text_sample from documents where text is not null",
    "dedupe_first_by_hash": "select md5(text) as hash, min(doc_id) as doc_id from documents where text is not null group by 1",
    "figure_rank_top80": "with d as (select distinct source_pdf, asset_id, coalesce(n_bytes, 0) as n_bytes from pdf_asset_index), r as (select *, row_number() over (partition by source_pdf order by n_bytes desc, asset_id) - 1 as rank from d) select source_pdf, asset_id, n_bytes, rank::integer as rank from r where rank < 80",
    "content_guess": """select asset_id, case when coalesce(width_px, 0) = 0 or coalesce(height_px, 0) = 0 then 'unknown' when width_px / height_px >= 1.8 then 'wide_figure (map/cross-section/chart?)' when width_px / height_px <= 0.6 then 'portrait_figure (column/log?)'
  when width_px / height_px between 0.8 and 1.25 and n_bytes > 40000 then 'photo (rock/outcrop/photomicrograph?)' else 'graphic_or_photo' end as guess,
  coalesce(n_bytes >= 6000 and (width_px is null or width_px = 0 or width_px >= 150) and (height_px is null or height_px = 0 or height_px >= 150), false) as kept from pdf_asset_index""",
    "page_estimate": r"""with f as (select doc_id, text, length(regexp_extract(text, '^([^0-9]*)', 1)) + 1 as k from documents where text is not null)
select doc_id, greatest(1, length(left(text, k)) - length(replace(left(text, k), chr(10), '')))::integer as page from f""",
    "marker_counts": "select distinct cast(doc_id as varchar) as source_pdf, greatest(1, doc_id % 7)::integer as pages_est, (doc_id % 5)::integer as jbig2_scanned, (doc_id % 3)::integer as ccitt_scanned, '' as text from documents where doc_id is not null",
    "curated_last_wins": """with a as (select distinct asset_id, content_type_guess from pdf_asset_index), l as (select asset_id, arg_max({'l': content_label, 'c': caption}, line_no) as m from pdf_curated_labels where asset_id is not null group by 1)
select a.asset_id, a.content_type_guess, coalesce(m.l, '') as content_label, coalesce(m.c, '') as caption, case when l.asset_id is not null then 'ai_curated' else 'pending_ai_or_manual' end as label_status from a left join l on a.asset_id = l.asset_id""",
    "count_by_region": "select coalesce(source_region, '') as region, count(*) as n from geology_features group by 1",
    "most_common": "select coalesce(content_type_guess, '') as content_type_guess, count(*) as n, min(asset_id) as first_asset from pdf_asset_index group by 1 order by 2 desc, 3",
    "value_counts": r"select engineering_ground_type, count(*) as n, count(*) filter (where needs_manual_review) as n_review from geotech_features where regexp_matches(engineering_ground_type, '[^\s\p{Z}]') group by 1",
    "labelled_count": r"select coalesce(content_label, '') as label, count(*) as n, count(*) filter (where regexp_matches(caption, '[^\s\p{Z}]')) as n_captions from pdf_curated_labels group by 1",
    "localise_codes": r"""with o as (select engineering_ground_type as code, min(geotech_term_ja) as ja, min(geotech_term_en) as en from l2_geology_to_geotech where engineering_ground_type is not null group by 1),
k as (select engineering_ground_type as code from geotech_features union select engineering_material_family from geotech_features)
select k.code, coalesce(o.ja, o.en, trim(replace(k.code, '_', ' '))) as label from k left join o on k.code = o.code where regexp_matches(k.code, '[^\s\p{Z}]')""",
    "json_props": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "union_assets": """with b as (select asset_id, 'index' as origin from pdf_asset_index union all select asset_id, 'label' from pdf_curated_labels)
select asset_id, count(*) as n, string_agg(distinct origin, ';' order by origin) as origins from b where asset_id is not null group by 1""",
    "build_summary": """select 'features' as what, count(*) as n from geology_features union all select 'cards', count(*) from inference_chains union all select 'review', count(*) filter (where needs_manual_review) from inference_chains union all select 'figures', count(*) from pdf_asset_index""",
    "chain_steps": CHAIN_STEPS,
    "unit_risk_flags": f"""with {INFER}, e as (select engineering_ground_type as ground_type, unnest(cast(geotechnical_risk_flags as json)::varchar[]) as flag from geotech_features where starts_with(geotechnical_risk_flags, '[') and json_valid(geotechnical_risk_flags) and engineering_ground_type is not null),
g as (select ground_type, string_agg(flag, ';' order by flag) as flags from (select distinct ground_type, flag from e where flag is not null) group by 1)
select i.name, i.litho, i.age, i.ground_type, coalesce(g.flags, '') as risk_flags from inf i left join g on g.ground_type = i.ground_type""",
    "points_card_query": f"""with {POINTS}, {VERTICES}, {HITS}, first as (select query_id, min(feature_id) as feature_id from hits group by 1),
l as (select feature_id, min({{'g': engineering_ground_type, 'k': geology_unit_card_id}}) as l from geotech_features group by 1), k as (select geology_unit_card_id, min(overall_confidence) as card_confidence, min(length(chain))::integer as chain_length from inference_chains group by 1)
select p.query_id, f.feature_id is not null as found, f.feature_id, l.l.g as engineering_ground_type, l.l.k as geology_unit_card_id, k.card_confidence, k.chain_length
from pts p left join first f using (query_id) left join l on l.feature_id = f.feature_id left join k on k.geology_unit_card_id = l.l.k""",
    "outer_hole_grouping": f"""with {VERTICES}, a as (select feature_id, r, sum(x1 * y2 - x2 * y1) / 2 as area from edges where n >= 3 group by 1, 2),
o as (select feature_id, r, area < 0 or row_number() over (partition by feature_id order by r) = 1 as opens from a),
s as (select feature_id, count(*) filter (where opens) as n_polygons, count(*) filter (where not opens) as n_holes from o group by 1)
select distinct f.feature_id, coalesce(s.n_polygons, 0)::integer as n_polygons, coalesce(s.n_holes, 0)::integer as n_holes from (select distinct feature_id from geology_features where len(geom) > 0) f left join s using (feature_id)""",
}
