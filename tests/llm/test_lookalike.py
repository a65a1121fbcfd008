from lithoflow.llm import lookalike as L
from lithoflow.llm.folding import fold

SCHEMA = "record_id string, field_name string, value string, form string"
BASE = ["ローム層", "河口堆積物", "人工埋土", "片麻岩", "砂、礫", "砂;礫", "砂/礫", "Granite", "ガウジ", "シルト", "チャート", "斑れい岩(一部)", "sand and gravel"]
ODD = {
    "ロ一ム層": "ローム層", "口ーム層": "ローム層", "ロ─ム層": "ローム層", "河ロ堆積物": "河口堆積物", "人エ埋土": "人工埋土", "⽚⿇岩": "片麻岩", "片​麻岩": "片麻岩", "片麻︀岩": "片麻岩", "砂､礫": "砂、礫", "砂；礫": "砂;礫", "砂／礫": "砂/礫", "Ｇｒａｎｉｔｅ": "Granite",
    "Grаnite": "Granite", "ガウジ": "ガウジ", "ｶﾞｳｼﾞ": "ガウジ", "シル卜": "シルト", "ﾁｬｰﾄ": "チャート", "sand and gravel": "sand and gravel", "チャ－ト": "チャート",
}
PLAIN = ["スナ", "すな", "sandd", "斑れい岩(一部)", "櫻層", "  砂", "狐熊蟹層"]


def frame(spark, values):
    return spark.createDataFrame([(f"r{k}", "f", v, "") for k, v in enumerate(values)], SCHEMA).drop("form")


def test_odd_forms_are_found_and_rewritten(spark):
    values = BASE * 30 + list(ODD) + PLAIN + [None, "", " "]
    got = {r.value: r.form for r in L.consistent(frame(spark, values), BASE).collect()}
    assert got == ODD


def test_a_consistent_text_stays_and_long_texts_are_rewritten_whole(spark):
    long = "砂／" * 20000 + "礫"
    got = {r.value: r.form for r in L.consistent(frame(spark, BASE * 10 + [long]), BASE).collect()}
    assert got == {long: "砂/" * 20000 + "礫"}
    assert all(fold(f) == f for f in got.values())
    assert L.consistent(frame(spark, []), BASE).count() == 0


def test_classes_are_transitive_and_follow_the_corpus():
    reps = L.representatives({"；": 100, ";": 3, "ー": 5, "，": 3, ",": 1})
    assert reps[";"] == "；" and reps["\u037e"] == "；" and reps["，"] == ","
    reps = L.representatives({})
    assert reps["；"] == ";" and reps["​"] == "" and reps[" "] == " " and reps["ｶﾞ"] == "ガ" and "ー" not in reps
    assert not any(v in ("一", "口", "工") for v in reps)
