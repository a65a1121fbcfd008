import json

from lithoflow.operators import nested as N

SCHEMA = "geology_unit_card_id string, risk_flags string, chain string, source_evidence string, node string"


def rows(spark, *cards):
    return spark.createDataFrame([(k, f, c, e, "clash") for k, f, c, e in cards], SCHEMA)


def links(spark, *cards):
    return {tuple(r) for r in N.links(rows(spark, *cards), N.CARDS).collect()}


def flat(spark, *docs):
    """Tables of documents under the keys 0, 1, ..."""
    df = spark.createDataFrame([(str(k), json.dumps(d)) for k, d in enumerate(docs)], "k string, doc string")
    return N.tables(df, N.Nested(key="k", columns=("doc",)))


def test_lists_singles_wrapped_and_text_in_text(spark):
    steps = [{"step": "L1", "evidence": "one", "sources": {"id": "s"}}, {"step": "L4", "evidence": ["a", "b"], "sources": None, "outputs": {"recommended_investigation": ["x", "y"], "deep": {"value": 3}}}]
    want = {("chain", -1, 0), ("chain", -1, 1), ("evidence", 0, 0), ("sources", 0, 0), ("evidence", 1, 0), ("evidence", 1, 1), ("investigation", 1, 0), ("investigation", 1, 1)}
    plain, wrapped = json.dumps(steps), json.dumps({"steps": steps})
    often = plain
    for _ in range(6):
        often = json.dumps(often)
    got = links(spark, ("p", None, plain, None), ("w", "", wrapped, "{}"), ("d", "null", json.dumps(plain), "null"), ("s", None, often, None), ("p", None, plain, None))
    for key in "pwds":
        assert {r[1:] for r in got if r[0] == key} == want, key


def test_flags_as_text_and_unreadable_columns(spark):
    got = links(spark, ("a", "x;y; ;z", '[{"step": "L1"', '{"pdf_asset_ids": "one"}'), ("b", '["x", "y', None, '{"pdf_asset_ids": [{"asset_id": "q", "page": 2}, "r"]}'), ("c", '"single"', "[]", "not json"), ("d", "[]", "", '{"pdf_asset_ids": ""}'))
    assert got == {("a", "risk_flags", -1, 0), ("a", "risk_flags", -1, 1), ("a", "risk_flags", -1, 2), ("a", "pdf_asset_ids", -1, 0), ("b", "pdf_asset_ids", -1, 0), ("b", "pdf_asset_ids", -1, 1), ("c", "risk_flags", -1, 0)}


def test_tables_inline_singletons_and_link_to_parents(spark):
    chain = json.dumps([{"step": "L1", "outputs": {"a": {"b": 1}}, "sources": [{"id": "s1", "tier": "t", "pos": 7}, {"id": "s2"}]}])
    t = N.tables(rows(spark, ("k", None, chain, None), ("k", None, chain, None)), N.CARDS)
    step = t["chain"].collect()
    assert len(step) == 1 and step[0].outputs_a_b == "1" and step[0].parent_table == "record" and step[0].row_id == "/chain/0"
    sources = sorted((r.parent_table, r.parent_id, r.row_id, r.parent_pos, r.pos, r.id, r.tier or "", r.pos_ or "") for r in t["sources"].collect())
    assert sources == [("chain", "/chain/0", "/chain/0/sources/0", 0, 0, "s1", "t", "7"), ("chain", "/chain/0", "/chain/0/sources/1", 0, 1, "s2", "", "")]


def test_every_level_has_its_own_parent(spark):
    t = flat(spark, {"a": [{"b": [{"c": [1, 2]}]}, {"b": [{"c": [1]}]}]}, {"a": [{"b": [{"c": [1]}]}]})
    c = sorted((r.k, r.parent_table, r.parent_id, r.pos, r.value) for r in t["c"].collect())
    assert c == [("0", "b", "/doc/a/0/b/0", 0, "1"), ("0", "b", "/doc/a/0/b/0", 1, "2"), ("0", "b", "/doc/a/1/b/0", 0, "1"), ("1", "b", "/doc/a/0/b/0", 0, "1")]
    ids = {(r.k, r.row_id) for r in t["b"].collect()}
    assert {(r.k, r.parent_id) for r in t["c"].collect()} <= ids and len(ids) == 3


def test_lists_in_lists(spark):
    t = flat(spark, {"m": [[1, 2], [3], []]}, {"m": [[[4]], 5]})
    outer = sorted((r.k, r.pos, r.value) for r in t["m"].collect() if r.value)
    inner = sorted((r.k, r.parent_table, r.parent_id, r.pos, r.value) for r in t["m_item"].collect() if r.value)
    assert outer == [("1", 1, "5")] and t["m"].count() == 4
    assert inner == [("0", "m", "/doc/m/0", 0, "1"), ("0", "m", "/doc/m/0", 1, "2"), ("0", "m", "/doc/m/1", 0, "3")]
    assert [(r.parent_id, r.value) for r in t["m_item_item"].collect()] == [("/doc/m/0/0", "4")]


def test_recursive_and_shared_elements_get_a_table(spark):
    deep = {"part": {"name": "a", "part": {"name": "b", "part": [{"name": "c"}, {"name": "d", "part": "leaf"}]}}}
    parts = flat(spark, deep)["part"].collect()
    assert sorted((r.name or "", r.value or "") for r in parts) == [("", "leaf"), ("a", ""), ("b", ""), ("c", ""), ("d", "")]
    ids = {r.row_id for r in parts}
    assert len(ids) == 5 and sum(r.parent_id in ids for r in parts) == 4
    t = flat(spark, {"home": {"geo": {"lat": 1, "lon": 2}}, "work": {"geo": {"lat": 3, "lon": 4}, "name": {"name": "x"}}})
    assert sorted((r.row_id, r.lat) for r in t["geo"].collect()) == [("/doc/home/geo/0", "1"), ("/doc/work/geo/0", "3")]
    assert t["doc"].first().work_name_name == "x"  # a plain member named like its parent is none


def test_names_that_clash(spark):
    t = flat(spark, {"rows": [{"a_b": 1, "a": {"b": 2}, "K": 3, "A_B": 4, "x.y": [5], "x": {"y": [6]}, "pos": 9}]})
    row = t["rows"].first().asDict()
    assert sorted(v for k, v in row.items() if k not in ("k", *N.FIXED)) == ["1", "2", "3", "4", "9"] and "K_" in row and "pos_" in row
    assert sum(t[n].count() for n in t if n not in ("rows", "doc")) == 2


def test_empty_table_and_null_keys(spark):
    assert N.links(rows(spark), N.CARDS).count() == 0
    assert links(spark, (None, "x", None, None)) == {(None, "risk_flags", -1, 0)}
