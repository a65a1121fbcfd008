from pyspark.sql import functions as F

from lithoflow import knowledge
from lithoflow.functions.text import first_of, join_distinct, strip, text_quality
from lithoflow.operators import cards, inference, localise, rules

UNITS = [
    ("小山田層", "礫，砂及びシルト", "後期鮮新世-前期更新世", "terrace_deposits", "medium", False),
    ("立川ローム層", "火山灰", "後期更新世", "volcanic_ash_loam", "high", False),
    ("沖積層", "泥・砂及び礫", "完新世", "alluvial_lowland_deposits", "high", False),
    ("埋立土", "砂及び泥", "完新世", "artificial_fill_reclaimed_ground", "medium", False),
    ("柿生層", "泥岩", "前期更新世", "weak_sedimentary_rock", "high", False),
    ("", "", "", "mixed_or_uncertain_geology", "very_low", True),
    ("", "泥岩", "", "weak_sedimentary_rock", "medium", True),
    ("X泥岩部", "", "", "weak_sedimentary_rock", "low", True),
    ("X礫", "", "前期更新世", "terrace_deposits", "medium", False),
]


def test_golden_units(spark):
    df = spark.createDataFrame([u[:3] for u in UNITS] * 2 + [(None, None, None)], "raw_unit_name_ja string, raw_lithology string, raw_age string")
    out = inference.infer(df, knowledge.default_l1(spark), knowledge.default_l2(spark), knowledge.risk_table(spark), "row_no", map_order="row_no")
    got = {(r["name"], r["litho"], r["age"]): r for r in inference.with_chain(out).collect()}
    assert len(got) == len(UNITS)
    for name, litho, age, ground, conf, review in UNITS:
        r = got[(name, litho, age)]
        assert (r.ground_type, r.overall_confidence, r.needs_manual_review) == (ground, conf, review), r
        assert tuple(r.risk_flags) == knowledge.RISK_FLAGS[ground]
    assert got[("埋立土", "砂及び泥", "完新世")].keyword == "埋立"
    chain = got[("柿生層", "泥岩", "前期更新世")].chain
    assert [s.step for s in chain] == list(reversed(inference.DISPLAY))
    text = out.transform(inference.with_chain).where("name = '柿生層'").select(inference.chain_text(inference.display_order(F.col("chain")))).first()[0]
    assert text == "L4 :: weak_sedimentary_rock -> L3_indicative_properties -> L2 :: L2_weak_rock -> L1 :: L1_kazusa_group"


def test_every_rule_reaches_its_ground(spark):
    l1 = knowledge.default_l1(spark)
    facts = l1.select(F.col("geological_material").alias("material"), F.col("grain_or_rock").alias("grain"), "term_id")
    assert rules.translate(facts, knowledge.default_l2(spark)).where("map_id is null").count() == 0


def test_worst(spark):
    df = spark.createDataFrame([("high", "low"), ("odd", "medium"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(rules.worst(F.col("a"), F.col("b"))).collect()] == ["low", "medium", "very_low"]


def test_texts(spark):
    df = spark.createDataFrame([("　a b ", None, " c"), (None, "", "  "), ("x", "x", "y")], "a string, b string, c string")
    got = df.select(strip("a"), first_of(F.col("b"), F.col("c")), join_distinct(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("a b", "c", "a b / c"), (None, "", ""), ("x", "x", "x / y")]
    q = spark.createDataFrame([("日本 abc、",), ("\x01\x02a",), ("",), (None,)], "t string").select(text_quality(F.col("t"))).collect()
    assert [None if r[0] is None else round(r[0], 3) for r in q] == [1.0, 0.333, 0.0, None]


def test_cards_number_by_first_appearance(spark):
    rows = [("08062", "b", "n", 5, "late"), ("08062", "a", "n", 3, "x"), ("08062", "b", "n", 1, "early"), ("08063", None, None, 9, "y")]
    f = spark.createDataFrame(rows, "source_region string, raw_unit_code string, raw_unit_name_ja string, pos int, raw_lithology string")
    c = cards.cards(f, "pos", ["raw_lithology"])
    got = {r.geology_unit_card_id: (r.raw_lithology, r.n_features) for r in c.collect()}
    assert got == {"UC2_08062_b_000": ("early", 2), "UC2_08062_a_001": ("x", 1), "UC2_08063_NA_002": ("y", 1)}
    assert cards.with_card(f, c, ["geology_unit_card_id"]).count() == 4
    many = spark.range(1000).select(F.lit("r").alias("source_region"), F.col("id").cast("string").alias("raw_unit_code"), F.lit("n").alias("raw_unit_name_ja"), F.col("id").alias("pos"))
    assert cards.numbered(many, ["pos"]).where("seq <> pos").count() == 0


def test_localise_and_sources(spark):
    labels = spark.createDataFrame([("a", "ja", "あ"), ("a", "en", "A"), ("b", "en", "B")], "code string, lang string, label string")
    codes = spark.createDataFrame([("a",), ("b",), ("c_d",), (None,)], "code string")
    assert {r.code: r.label for r in localise.localise(codes, "code", labels, "ja").collect()} == {"a": "あ", "b": "B", "c_d": "c d", None: ""}
    refs = spark.createDataFrame([("m", "S1; S9;"), ("n", None)], "k string, refs string")
    reg = spark.createDataFrame([("S1", "One", "t")], "source_id string, title string, tier string")
    assert sorted(tuple(r) for r in inference.source_refs(refs, "k", "refs", reg).collect()) == [("m", 0, "S1", "One", "", "t"), ("m", 1, "S9", "S9", "", "unknown")]


L3 = {"ground_types": {"weak_sedimentary_rock": {"summary_en": "s", "mechanical": {"spt": "5-9"}, "chemical": {}, "key_concerns_en": ["k"], "source_ref": ["S1", "S9"]}}}
L4 = {"ground_types": {"weak_sedimentary_rock": {"applications": {"slope": "check"}, "recommended_investigation": ["bore"], "residual_uncertainty": "u"}}}


def test_the_whole_chain(spark):
    df = spark.createDataFrame([("柿生層", "泥岩", "前期更新世"), ("小山田層", "礫", "後期鮮新世"), ("?", "", "")], "raw_unit_name_ja string, raw_lithology string, raw_age string")
    reg = knowledge.sources_table(spark, {"sources": {"S1": {"title": "One", "url": "u", "tier": "t"}, "OBAYASHI_KAZUSA_MUDSTONE": {"title": "O", "tier": "t"}}})
    for repaired in (False, True):
        base = knowledge.load(spark, repaired=repaired)
        out = inference.infer(df, base.l1, base.l2, base.risk, "row_no", map_order="row_no")
        got = {r["name"]: r.chain for r in inference.with_chain(out, knowledge.properties_table(spark, L3), knowledge.advice_table(spark, L4), reg, {"l3": "own.yaml"}).collect()}
        l1, l2, l3, l4 = got["柿生層"]
        # short rows put the source's id where the consolidation stands, and leave the sources empty
        said, ids = ("None", ["OBAYASHI_KAZUSA_MUDSTONE"]) if repaired else ("OBAYASHI_KAZUSA_MUDSTONE", [])
        assert l1.evidence == [f"Matched '柿生層' in name -> L1_kazusa_group (mudstone / sandstone / alternation, {said})."] and [s.id for s in l1.sources] == ids
        assert l2.inputs["grain_or_rock"] == "weak_rock" and l2.outputs["geotech_term_en"] == "Weak sedimentary rock" and [s.tier for s in l2.sources] == ["unknown"]
        assert l3.knowledge_ref == "own.yaml :: weak_sedimentary_rock" and l3.outputs["mechanical"] == '{"spt":"5-9"}' and [(s.id, s.title, s.tier) for s in l3.sources] == [("S1", "One", "t"), ("S9", "S9", "unknown")] and l3.confidence == "medium"
        assert l4.outputs == {"applications": '{"slope":"check"}', "recommended_investigation": '["bore"]', "residual_uncertainty": "u"} and l4.confidence == "medium"
        old = got["小山田層"]
        assert len(old[0].evidence) == 2 and old[0].outputs["typical_consolidation"] == inference.OLD_CONSOLIDATION and old[0].outputs["age_refined"] == "true" and old[2].outputs == {} and old[2].confidence == "very_low" and old[3].confidence == "medium"
        none = got["?"]
        assert none[0].outputs == {"geological_material": "unknown"} and none[0].evidence == [inference.NO_TERM] and none[1].knowledge_ref is None and none[1].evidence == [inference.NO_MAP]


def test_constant_and_automaton_give_the_same_matches(spark, monkeypatch):
    units = spark.createDataFrame([(u[0], u[1], str(k)) for k, u in enumerate(UNITS)], "name string, litho string, own string")
    kws = rules.keyword_rules(knowledge.default_l1(spark), "row_no")
    a = sorted(tuple(r) for r in rules.match_terms(units, kws).fillna("").collect())
    monkeypatch.setattr(rules.constant, "__defaults__", (3,))
    assert rules.constant(kws) is None
    assert sorted(tuple(r) for r in rules.match_terms(units, kws).fillna("").collect()) == a
    assert rules.match_terms(units, kws.limit(0)).where("term_id is not null").count() == 0


def test_keyword_rules(spark):
    doc = {"rules": [
        {"rule_id": "R1", "priority": 10, "match_keywords_ja": ["盛土"], "match_keywords_en": ["Fill"], "match_fields": ["name", "litho", "absent"], "engineering_ground_type": "fill", "risk_flags": ["a"], "interpretation_reason_template": "'{name}' by {kw}"},
        {"rule_id": "R2", "priority": 20, "match_keywords_en": ["sand"], "match_fields": ["litho"], "engineering_ground_type": "sand", "engineering_material_family": "soil", "risk_flags": ["b"], "interpretation_confidence_default": "low"},
        {"rule_id": "R99", "priority": 999, "match_fields": []},
    ]}
    units = spark.createDataFrame([("old FILL", "Sand"), ("x", "sandy"), ("盛土", None), ("y", ""), ("y", "")], "name string, litho string")
    got = {r["name"]: r for r in rules.match_rules(units, knowledge.rules_table(spark, doc), "name").collect()}
    assert (got["old FILL"].rule_id, got["old FILL"].keyword, got["old FILL"].engineering_material_family, got["old FILL"].reason, got["old FILL"].risk_flags) == ("R1", "fill", "soil", "'old FILL' by fill", ["a"])
    assert got["x"].rule_id == "R2" and got["盛土"].rule_id == "R1" and got["y"].rule_id is None and got["y"].risk_flags == [] and len(got) == 4
    assert {r.ground_type: r.flags for r in knowledge.risk_of_rules(knowledge.rules_table(spark, doc)).collect()}["fill"] == ["a"]


def test_knowledge_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffterm_id,priority,match_on,match_keywords_ja,geological_material\nA,5,name,砂;礫,soil\n#B,1,name,x,y\n", "utf-8")
    (tmp_path / "p.yaml").write_text("ground_types:\n  g:\n    summary_en: s\n    mechanical: {a: 1}\n", "utf-8")
    (tmp_path / "o.yaml").write_text("classes:\n  g: {x: [1]}\n", "utf-8")
    base = knowledge.load(spark, {"l1": str(tmp_path / "t.csv"), "l3": str(tmp_path / "p.yaml"), "ontology": str(tmp_path / "o.yaml")})
    row = base.l1.collect()
    assert len(row) == 1 and (row[0].term_id, row[0].priority, row[0].row_no, row[0].source_ref) == ("A", 5, 0, None)
    assert base.properties.first().mechanical == {"a": "1"} and base.ontology.first().payload == '{"x": [1]}' and base.names["l1"] == "t.csv" and base.sources.count() == 0


def test_localised_lists_and_paths(spark):
    labels = spark.createDataFrame([("a", "ja", "あ"), ("b", "en", "B")], "code string, lang string, label string")
    rows = spark.createDataFrame([("1", ["b", "a", "c_d"]), ("2", [])], "k string, codes array<string>")
    assert {r.k: r.labels for r in localise.localise_lists(rows, "k", "codes", labels, "ja").collect()} == {"1": ["B", "あ", "c d"], "2": []}
    assert [r.code for r in localise.code_lists(labels).collect()] == ["a", "b"]
    paths = spark.createDataFrame(knowledge.flatten_paths({"tabs": {"one": {"en": "One", "ja": " 一 "}}}), "path string, text string")
    assert [localise.at_path(paths, p, lang) for p, lang in (("tabs.one", "ja"), ("tabs.one", "fr"), ("tabs.two", "en"))] == ["一", "One", "tabs.two"]
