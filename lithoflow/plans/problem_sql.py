"""DuckDB SQL for the queries of the general problems that SQL can express on whole tables."""

from __future__ import annotations

from lithoflow.functions.damage import BROKEN, FOREIGN, LIKE_LATIN, SIGNS
from lithoflow.operators.packed import CONJUNCTIONS, DELIMITERS, INVISIBLE, SPANS
from lithoflow.plans.reference_sql import HITS, POINTS, REGIONS, VERTICES, WS


def orphan_sql(child: str, record: str, ref: str, at: str, parent: str, key: str, created: str) -> str:
    norm = lambda c: f"upper(regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g'))"
    return f"""select distinct '{child}' as table_name, c.record_id, c.ref_value, case when p.k is null then 'missing' when p.deleted <= c.at then 'deleted' else 'later' end as reason
from (select cast({record} as varchar) as record_id, {norm(ref)} as ref_value, {at} as at from {child}) c
left join (select {norm(key)} as k, min({created}) as created, case when count(deleted_at) = count(*) then max(deleted_at) end as deleted from {parent} group by 1) p on p.k = c.ref_value
where c.ref_value <> '' and (p.k is null or p.deleted <= c.at or p.created > c.at)"""


NEAR = """near as (select a.query_id, b.query_id as other from pts a join pts b on b.lat between a.lat - 0.00012 and a.lat + 0.00012 and a.query_id < b.query_id
  where 2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 12)"""

def all_refs(child: str, record: str, ref: str, at: str, table: str = "") -> str:
    return f"select distinct '{child}' as table_name, cast({record} as varchar) as record_id, upper(regexp_replace({ref}, '^{WS}+|{WS}+$', '', 'g')) as ref_value, {at} as at from {table or child} where regexp_matches({ref}, '[^\\s\\p{{Z}}]')"


TERM_REFS = """(select geology_unit_card_id, built_at, unnest(regexp_extract_all(chain, '"knowledge_ref\\\\*": \\\\*"terms :: (T[0-9]+)', 1)) as term from inference_chains)"""


def direct_sql(refs: str, parent: str, key: str, created: str, deleted: str) -> str:
    return f"""select c.*, case when p.k is null then 'missing' when p.deleted <= c.at then 'deleted' else 'later' end as reason from ({refs}) c
left join (select upper(regexp_replace({key}, '^{WS}+|{WS}+$', '', 'g')) as k, min({created}) as created, case when count({deleted}) = count(*) then max({deleted}) end as deleted from {parent} group by 1) p on p.k = c.ref_value
where p.k is null or p.deleted <= c.at or p.created > c.at"""


NONE = "cast(null as timestamp)"
GEO, L2, LABELS = all_refs("geotech_features", "feature_id", "geology_unit_card_id", "built_at"), all_refs("l2_geology_to_geotech", "map_id", "source_ref", "updated_on"), all_refs("pdf_curated_labels", "line_no", "asset_id", "labelled_on")
CHAINS, L1 = all_refs("inference_chains", "geology_unit_card_id", "term", "built_at", TERM_REFS), all_refs("l1_geology_terms", "term_id", "source_ref", NONE)
P5_REPORT = f"""with geo as ({GEO}), chains as ({CHAINS}),
d as ({direct_sql(GEO, "inference_chains", "geology_unit_card_id", "built_at", "deleted_at")} union all {direct_sql(L2, "knowledge_sources", "source_id", "registered_on", "deleted_at")}
  union all {direct_sql(LABELS, "pdf_asset_index", "asset_id", "extracted_at", "deleted_at")} union all {direct_sql(CHAINS, "l1_geology_terms", "term_id", NONE, NONE)} union all {direct_sql(L1, "knowledge_sources", "source_id", "registered_on", "deleted_at")}),
dk as (select distinct table_name, record_id from d),
i1 as (select c.*, 'orphaned target' as reason from chains c where ref_value in (select upper(record_id) from d where table_name = 'l1_geology_terms') and record_id not in (select record_id from dk where table_name = 'inference_chains')),
g1 as (select c.*, 'orphaned target' as reason from geo c where ref_value in (select upper(record_id) from d where table_name = 'inference_chains') and record_id not in (select record_id from dk where table_name = 'geotech_features')),
g2 as (select c.*, 'orphaned target' as reason from geo c where ref_value in (select upper(record_id) from i1) and record_id not in (select record_id from dk where table_name = 'geotech_features') and record_id not in (select record_id from g1)),
o as (select *, 'direct' as kind from d union all select *, 'inherited' from (select * from i1 union all select * from g1 union all select * from g2))
select table_name, coalesce(strftime(o.at, '%Y-%m'), '') as period, kind, reason, count(distinct (record_id, ref_value)) as n_refs, count(distinct record_id) as n_records from o group by 1, 2, 3, 4"""


def parsed(text: str) -> str:
    """JSON of a text, also where it is JSON inside a JSON string; null where it can't be read."""
    inner = f"(cast({text} as json) ->> '$')"
    return f"case when json_valid({text}) then case when json_type(cast({text} as json)) = 'VARCHAR' then case when json_valid({inner}) then cast({inner} as json) end else cast({text} as json) end end"


def listed(x: str) -> str:
    return f"case when {x} is null or cast({x} as varchar) in ('null', '\"\"', '{{}}', '[]') then cast([] as json[]) when json_type({x}) = 'ARRAY' then cast({x} as json[]) else [{x}] end"


def elements(node: str, x: str, table: str, parent: str) -> str:
    return f"select k, '{node}' as node, {parent} as parent_pos, unnest({listed(x)}) as e, generate_subscripts({listed(x)}, 1) - 1 as pos from {table}"


P1 = f"""with s as (select distinct geology_unit_card_id as k, chain, source_evidence, risk_flags from inference_chains),
j as (select k, {parsed('chain')} as c, {parsed('source_evidence')} as v, risk_flags as f, case when json_valid(risk_flags) and json_type(cast(risk_flags as json)) <> 'VARCHAR' then cast(risk_flags as json) end as fj,
  case when json_valid(risk_flags) and json_type(cast(risk_flags as json)) = 'VARCHAR' then cast(risk_flags as json) ->> '$' when not json_valid(risk_flags) and not regexp_matches(risk_flags, '^\\s*[\\[{{"]') then risk_flags end as ft from s),
w as (select k, case when json_type(c) = 'OBJECT' and json_exists(c, '$.steps') then c -> '$.steps' else c end as c, case when json_type(v) = 'OBJECT' then v -> '$.pdf_asset_ids' end as a, case when ft is not null then to_json(list_filter(list_transform(string_split(ft, ';'), lambda x: trim(x)), lambda x: x <> '')) else fj end as f from j),
steps as ({elements('chain', 'c', 'w', '-1')}),
t as (select k, pos, e -> '$.evidence' as ev, e -> '$.sources' as so, e -> '$.outputs.recommended_investigation' as inv from steps where json_type(e) = 'OBJECT'),
u as (select * from steps union all {elements('risk_flags', 'f', 'w', '-1')} union all {elements('pdf_asset_ids', 'a', 'w', '-1')}
  union all {elements('evidence', 'ev', 't', 'pos')} union all {elements('sources', 'so', 't', 'pos')} union all {elements('investigation', 'inv', 't', 'pos')})
select distinct k as geology_unit_card_id, node, cast(parent_pos as integer) as parent_pos, cast(pos as integer) as pos from u where cast(e as varchar) not in ('null', '""', '{{}}', '[]')"""

P1_ROWS = P1[: P1.index("select distinct k as")].rstrip()


def card_sql(node: str, parent: str, at: str, **columns: str) -> str:
    """The rows of one table of the cards; ``at``: the path of its list below the parent row."""
    up = "''" if parent == "record" else f"'/{parent}/' || parent_pos"
    cols = ", ".join(f"nullif({x}, '') as {c}" for c, x in columns.items())
    return f"""{P1_ROWS}
select distinct k as geology_unit_card_id, '{parent}' as parent_table, {up} as parent_id, {up} || '{at}/' || pos as row_id, cast(parent_pos as integer) as parent_pos, cast(pos as integer) as pos, {cols}
from u where node = '{node}' and cast(e as varchar) not in ('null', '""', '{{}}', '[]')"""


PLAIN = "case when json_type(e) not in ('OBJECT', 'ARRAY') then e ->> '$' end"
P1_VERTICES = """with g as (select distinct feature_id, geom from geology_features where geom is not null),
r as (select feature_id, unnest(geom) as ring, generate_subscripts(geom, 1) - 1 as r from g), v as (select feature_id, r, unnest(ring) as p, generate_subscripts(ring, 1) - 1 as v from r)
select feature_id, '/shape/parts/0/rings/' || r as parent_id, '/shape/parts/0/rings/' || r || '/' || v as row_id, cast(r as integer) as parent_pos, cast(v as integer) as pos, p.lon as lon, p.lat as lat from v where p.lon is not null or p.lat is not null"""

# without the lookarounds that DuckDB's expressions lack; no field has what they guard against
P6_SPANS = SPANS[: SPANS.rindex("|")].replace("++", "+").replace("*+", "*").replace("'", "''")
P6_SPLIT = "[" + DELIMITERS + "]|" + "|".join([*CONJUNCTIONS[:-1], r"\s(?i:and)\s"])
P6 = f"""with f as (select feature_id as record_id, 'raw_lithology' as field_name, raw_lithology as value from geology_features union select term_id, 'match_keywords_ja', match_keywords_ja from l1_geology_terms union select map_id, 'geotech_synonyms_ja', geotech_synonyms_ja from l2_geology_to_geotech),
n as (select record_id, field_name, len(list_filter(regexp_split_to_array(regexp_replace(value, '{P6_SPANS}', 'Q', 'g'), '{P6_SPLIT}'), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}{INVISIBLE}]'))) as n
  from f where value is not null and record_id is not null and not regexp_matches(value, '{BROKEN}|{FOREIGN}|{SIGNS}') and not regexp_matches(translate(value, '{LIKE_LATIN}', ''), '[\\x{{400}}-\\x{{52F}}]'))
select record_id, field_name, cast(unnest(range(1, n + 1)) as integer) as pos from n where n > 1"""

AROUND = f"[\\s\\p{{Z}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}{INVISIBLE}]+"
# every text is cut into spans, delimiters and single characters; delimiters become a mark to split at
P6_VALUES = f"""with f as (select feature_id as record_id, 'raw_lithology' as field_name, raw_lithology as value from geology_features union select term_id, 'match_keywords_ja', match_keywords_ja from l1_geology_terms union select map_id, 'geotech_synonyms_ja', geotech_synonyms_ja from l2_geology_to_geotech),
g as (select *, regexp_matches(value, '{BROKEN}|{FOREIGN}|{SIGNS}') or regexp_matches(translate(value, '{LIKE_LATIN}', ''), '[\\x{{400}}-\\x{{52F}}]') as garbled from f where value is not null and record_id is not null),
t as (select record_id, field_name, case when garbled then [value] else string_split(array_to_string(list_transform(regexp_extract_all(value, '(?s)(?:{P6_SPANS})|{P6_SPLIT}|.'), lambda x: case when regexp_matches(x, '^(?:{P6_SPLIT})$') then chr(1) else x end), ''), chr(1)) end as xs from g),
v as (select record_id, field_name, list_transform(list_filter(xs, lambda x: regexp_matches(x, '[^\\s\\p{{Z}}\\x{{0B}}\\x{{85}}{INVISIBLE}]')), lambda x: regexp_replace(x, '^{AROUND}|{AROUND}$', '', 'g')) as items from t),
u as (select record_id, field_name, unnest(items) as item, unnest(range(1, len(items) + 1)) as pos, len(items) as n from v)
select distinct record_id, field_name, pos::integer as pos, item, n::integer as n_values from u"""

SQL = {
    "p1_found": P1,
    "p1_steps": card_sql(
        "chain", "record", "/chain", step="e ->> '$.step'", title_en="e ->> '$.title_en'", confidence="e ->> '$.confidence'", knowledge_ref="e ->> '$.knowledge_ref'", inputs_raw_unit_name_ja="e ->> '$.inputs.raw_unit_name_ja'",
        inputs_detail_age="e ->> '$.inputs.detail.age'", outputs_engineering_ground_type="e ->> '$.outputs.engineering_ground_type'", outputs_mechanical_spt_n="e ->> '$.outputs.mechanical.spt_n'", outputs_age_refined="e ->> '$.outputs.age_refined'",
    ),
    "p1_sources": card_sql("sources", "chain", "/sources", id="e ->> '$.id'", tier="e ->> '$.tier'", title="e ->> '$.title'", url="e ->> '$.url'"),
    "p1_evidence": card_sql("evidence", "chain", "/evidence", value=PLAIN),
    "p1_investigations": card_sql("investigation", "chain", "/outputs/recommended_investigation", value=PLAIN),
    "p1_flags": card_sql("risk_flags", "record", "/risk_flags", value=PLAIN),
    "p1_figures": card_sql("pdf_asset_ids", "record", "/source_evidence/pdf_asset_ids", value=PLAIN, asset_id="e ->> '$.asset_id'", page="e ->> '$.page'"),
    "p1_vertices": P1_VERTICES,
    "p5_orphan_report": P5_REPORT,
    "p6_found": P6,
    "p6_values": P6_VALUES,
    "p3_found": f"""with {POINTS}, {VERTICES}, {HITS}, {REGIONS}, {NEAR}
select 'near' as kind, query_id, cast(other as varchar) as other_id from near union all select 'sheet', query_id, region from regs union all select distinct 'feature', query_id, feature_id from hits""",
    "p5_found": " union all ".join(
        (
            orphan_sql("geotech_features", "feature_id", "geology_unit_card_id", "built_at", "inference_chains", "geology_unit_card_id", "built_at"),
            orphan_sql("l2_geology_to_geotech", "map_id", "source_ref", "updated_on", "knowledge_sources", "source_id", "registered_on"),
            orphan_sql("pdf_curated_labels", "line_no", "asset_id", "labelled_on", "pdf_asset_index", "asset_id", "extracted_at"),
        )
    ),
}
