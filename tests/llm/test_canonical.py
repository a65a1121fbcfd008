import random

from lithoflow.llm import canonical as C

REF = [("L1", "lithology", "砂", "スナ", "sand"), ("L2", "lithology", "砂岩頁岩互層", "サガンケツガンゴソウ", "sandstone shale alternation"), ("L3", "lithology", "泥", "ドロ", "mud"), ("L4", "lithology", "片麻岩", "ヘンマガン", "gneiss"), ("L5", "lithology", "石灰岩", "セッカイガン", "limestone"), ("L6", "lithology", "苦灰岩", "クカイガン", "dolostone")]
STEMS = [("波寺沢岩", "ナミテラサワイワ", "Namiterasawaiwa"), ("笹谷雨豊", "ササタニアメトヨ", "Sasataniametoyo"), ("桑波泉藤", "クワナミイズミフジ", "Kuwanamiizumifuji"), ("秋月寺黒", "アキツキテラクロ", "Akitsukiterakuro"), ("鹿霧波雨", "シカキリナミアメ", "Shikakirinamiame"), ("原池山雨", "ハライケヤマアメ", "Haraikeyamaame")]
KINDS = [("層", "ソウ", "Formation"), ("ローム層", "ロームソウ", "Loam"), ("層群", "ソウグン", "Group")]
REF += [(f"U{k}", "unit_name", s[0] + KINDS[k % 3][0], s[1] + KINDS[k % 3][1], f"{s[2]} {KINDS[k % 3][2]}") for k, s in enumerate(STEMS)]
CASES = {
    "スナ": "L1", "すな": "L1", "SAND": "L1", "sandd": "L1", "風化砂": "L1", "砂(風化、塊状)": "L1", '"砂、細粒"': "L1", "砂主体": "L1", "mudd": "L3", "gnneiss": "L4", "geiss": "L4", "片 麻岩": "L4", "片麻岩 優勢": "L4", "pea tt": "NONE", "gn eiss": "L4",
    "砂岩・頁岩互層": "NONE", '"砂岩・頁岩互層"': "L2", "sandstone shael alternation": "L2", "灰岩": "NONE", "plastic": "NONE", "写真12参照": "NONE", "貝殻片": "NONE", "?": "NONE",
    "波蟹沢岩層": "U0", "波沢岩層": "U0", "なみてらさわいわ層": "U0", "ナミテラサワイワソウ": "U0", "波寺沢岩累層": "U0", "旧波寺沢岩層(下部)": "U0", "いわゆる笹谷雨豊のローム層": "U1", "笹谷雨豊口ーム層": "U1", "Ssaataniametoyo Loam": "U1", "SASATANIAMETOYO LOAM": "U1", "桑波泉藤層群相当": "U2", "狐熊蘭狸層": "NONE", "波狐狸岩層": "NONE",
}


def entries(spark, rows=REF):
    return spark.createDataFrame(rows, "ref_id string, term_kind string, label_ja string, label_kana string, label_en string")


def test_cases(spark):
    cases = {k: v for k, v in CASES.items() if k != "砂岩・頁岩互層"}  # unquoted, it is two values
    items = spark.createDataFrame([(k,) for k in cases], "item string")
    got = {r.item: r.ref_id for r in C.match(items, entries(spark)).collect()}
    assert got == cases


def test_every_single_error_in_a_long_label_is_repaired(spark):
    rnd = random.Random(4)
    want = {}
    for ref, kind, ja, kana, en in REF:
        if kind == "unit_name":
            for _ in range(12):
                stem, k = en.split()[0], rnd.randrange(1, 8)
                for typo in (stem[:k] + stem[k + 1 :], stem[:k] + "q" + stem[k:], stem[:k] + "q" + stem[k + 1 :], stem[:k] + stem[k + 1] + stem[k] + stem[k + 2 :]):
                    want[f"{typo} {en.split()[1]}"] = ref
    got = {r.item: r.ref_id for r in C.match(spark.createDataFrame([(k,) for k in want], "item string"), entries(spark)).collect()}
    assert got == want


def test_tokens_are_summed_over_complete_entries(spark):
    more = [("L7", "lithology", "腐植土", "フショクド", "humus soil"), ("L8", "lithology", "火山灰", "カザンバイ", "volcanic ash"), ("L9", "lithology", "マサ土", "マサド", "decomposed granite soil"), *REF, REF[0], (None, "lithology", "鉄", "テツ", "iron"), ("X1", "lithology", None, None, None)]
    want = {"sandstoen shale alternatoin": "L2", "sandstone shalealternation": "L2", "alternation shale sandstone": "L2", "soil": "NONE", "ash": "NONE", "shale": "NONE", "humus soil": "L7", "decomposde granite soli": "L9", "decomposed granite": "NONE", "iron": "NONE"}
    terrace = [(f"T{k}", "unit_name", f"{s}段丘堆積物", f"{y}ダンキュウタイセキブツ", f"{e} Terrace Deposits") for k, (s, y, e) in enumerate(STEMS[:3])]
    want |= {"波寺沢岩段丘堆積": "T0", "波寺沢岩段丘推積物": "T0", "ササタニアメトヨダンキユウタイセキブツ": "T1", "Kuwanamiizumifuji Terace Deposits": "T2", "Kuwanamizumifuji Terrace Deposts": "T2"}
    got = {r.item: r.ref_id for r in C.match(spark.createDataFrame([(k,) for k in want], "item string"), entries(spark, more + terrace)).collect()}
    assert got == want


def test_empty_list_and_no_items(spark):
    none = spark.createDataFrame([], "item string")
    assert C.match(none, entries(spark)).count() == 0
    assert [r.ref_id for r in C.match(spark.createDataFrame([("砂",)], "item string"), entries(spark, [])).collect()] == ["NONE"]
    assert C.within_one("abc", "acb") and C.within_one("abc", "ab") and not C.within_one("abc", "bcd")
