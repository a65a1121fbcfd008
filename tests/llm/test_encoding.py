import random

from lithoflow.llm import encoding as E

WORDS = ["後期更新世", "前期中新世", "片麻岩", "ホルンフェルス", "砂岩頁岩互層", "波寺沢岩層", "段丘堆積物", "粘土", "火山灰", "ローム"]
SCHEMA = "record_id string, field_name string, value string, restored string"
GARBLE = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp932"), ("utf-8", "gb18030"), ("cp932", "cp1252"), ("cp932", "cp1251"), ("euc_jp", "latin-1"), ("cp932", "utf-8"), ("euc_jp", "cp932"))


def garble(text, enc, shown):
    return text.encode(enc).decode(shown, "replace")


def corpus(spark, extra):
    rnd = random.Random(2)
    rows = [(f"r{k}", "f", rnd.choice(WORDS), None) for k in range(3000)]
    return spark.createDataFrame(rows + [(f"x{k}", "f", v, None) for k, v in enumerate(extra)], SCHEMA)


def test_round_trip_of_all_pairs(spark):
    truth = [(w, enc, shown) for w in WORDS for enc, shown in GARBLE]
    bad = [garble(*t) for t in truth]
    twice = [garble(garble(w, "utf-8", "cp1252"), "utf-8", "cp1252") for w in WORDS]
    half = [w[:2] + garble(w[2:], "utf-8", "cp1251") for w in WORDS]
    got = {r.value: r.restored for r in E.restore(corpus(spark, bad + twice + half), WORDS).collect()}
    assert [v for v in bad + twice + half if v not in got and v not in WORDS] == []
    pairs = [(v, t[0]) for v, t in zip(bad, truth)] + list(zip(twice, WORDS)) + [(v, w) for v, w in zip(half, WORDS) if v != w]
    assert sum(got.get(v) == w for v, w in pairs) > 0.85 * len(pairs)


def test_plain_odd_and_empty_values_are_left_alone(spark):
    fine = ["狐熊蘭狸蟹層", "櫻波層", "ﾎﾙﾝﾌｪﾙｽ", "福坂北槻ﾛｰﾑ層", "НОRNFELS", "片麻​岩", "⽚⿇岩", "", "  ", None, "café", "砂—泥", "片麻岩及び火山灰", "sand and gravel", "x" * 50000]
    assert {r.value for r in E.restore(corpus(spark, fine), WORDS).collect()} == set()
    assert E.restore(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_repeated_rows_once_and_lost_bytes(spark):
    bad = garble("前期中新世", "cp932", "utf-8")
    df = corpus(spark, []).unionByName(spark.createDataFrame([("a", "f", bad, None)] * 3 + [("b", "g", "�" * 9, None)], SCHEMA))
    got = {(r.record_id, r.field_name): r.restored for r in E.restore(df, WORDS).collect()}
    assert set(got) == {("a", "f"), ("b", "g")} and got[("a", "f")] == "前期中新世"


def test_a_garbled_value_of_kanji_in_a_third_of_the_rows(spark):
    ages = [w for w in WORDS if w.endswith("世")]
    for word, enc, shown in (("粘土", "utf-8", "gbk"), ("後期更新世", "cp932", "gbk"), ("片麻岩", "euc_jp", "gbk")):
        bad = garble(word, enc, shown)
        assert E.LOST not in bad and all("一" <= ch <= "鿿" for ch in bad), bad
        skewed = corpus(spark, [bad] * 1500)
        got = {r.record_id: r.restored for r in E.restore(skewed, [w for w in WORDS if w not in ages]).collect()}
        assert set(got) == {f"x{k}" for k in range(1500)} and set(got.values()) == {word}, (word, bad, len(got))


def test_a_frequent_plain_value_outside_the_reference_list_is_left_alone(spark):
    assert E.restore(corpus(spark, ["蘭狸蟹礫"] * 1500 + ["鑿岩"] * 700), WORDS[:3]).count() == 0


def read(value, words, plain=""):
    """The best reading of a value under a model in which all words are as frequent."""
    lp = -6.0
    model = E.Model({w: lp for w in words}, {c: lp for w in words for c in w}, frozenset(E.plain_chars()) | set(plain))
    return (E.read_one(value, model) or (0, None, None))[1]


def test_marks_for_two_bytes_each_and_for_one():
    shown = garble("砂岩頁岩互層", "utf-8", "gbk")
    bad = "�" + shown[1:5] + "�" + shown[6:]  # each mark stands for two bytes
    assert read(bad, ["砂岩頁岩互層", "泥岩砂岩互層", "頁岩"]) == "砂岩頁岩互層"
    for word in ("前期中新世", "片麻岩", "ホルンフェルス"):
        assert read(garble(word, "cp932", "utf-8"), ["前期中新世", "片麻岩", "ホルンフェルス", "粘土"]) == word


def test_many_characters_with_a_second_code():
    # the bytes EE F9 are a kanji in one code page and a sign with another first code in the other
    assert bytes([0xEE, 0xF9]).decode("cp932") == "￢" and "￢".encode("cp932") != bytes([0xEE, 0xF9]) and len(E.other_codes("cp932")) >= 10
    text = "銷砂銷岩銷泥銷土銷層銷"
    assert read(garble(text, "euc_jp", "cp932"), [*text]) == text


def test_long_words_and_two_spans():
    long = "後期更新世段丘堆積物砂岩頁岩互層ローム"
    assert read(garble(long, "utf-8", "cp1252"), [long, "粘土"]) == long
    bad = garble("粘土", "utf-8", "cp1251") + "と片麻岩と" + garble("火山灰", "utf-8", "cp1251")
    assert read(bad, ["粘土", "片麻岩", "火山灰", "と"], "片麻岩") == "粘土と片麻岩と火山灰"
