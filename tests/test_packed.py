from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithoflow.operators import packed

CASES = {
    "砂、礫;泥": ["砂", "礫", "泥"],
    "砂及び礫並びに泥": ["砂", "礫", "泥"],
    "砂及​び礫": ["砂", "礫"],
    ";;砂; ;礫;": ["砂", "礫"],
    '"砂、細粒"・礫(風化、塊状)/泥': ['"砂、細粒"', "礫(風化、塊状)", "泥"],
    "「砂;粗粒」\t礫\n泥": ["「砂;粗粒」", "礫", "泥"],
    '砂、"礫、泥': ["砂", '"礫', "泥"],
    "sand and gravel": ["sand", "gravel"],
    "Made ground": ["Made ground"],
    "砂 + 礫": ["砂", "礫"],
    "((a,b),c);d": ["((a,b),c)", "d"],
    "(1,(2,(3,(4,(5,(6,(7,(8,8)))))))),x;(y": ["(1,(2,(3,(4,(5,(6,(7,(8,8))))))))", "x", "(y"],
    "".join(map(chr, range(0xFDD0, 0xFDE0))) + "(a,b)," + chr(0xFDD1) + chr(0xFDD0) * 3 + chr(0xFDD1): ["".join(map(chr, range(0xFDD0, 0xFDE0))) + "(a,b)", chr(0xFDD1) + chr(0xFDD0) * 3 + chr(0xFDD1)],
    "﷐a,b﷐": ["﷐a", "b﷐"],
    "ﾎ�ｱ､ﾂ": ["ﾎ�ｱ､ﾂ"],
    "  ": [],
    "": [],
}


def split(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    return [r[0] for r in df.select(packed.split_values(F.col("value"))).collect()]


def test_cases(spark):
    assert split(spark, [*CASES, None]) == [*CASES.values(), None]


def test_a_long_span(spark):
    span = "(" + "x,(y);" * 30000 + ")"
    assert split(spark, [f"a,{span},b"]) == [["a", span, "b"]]


def test_long_text_and_positions(spark):
    long = ",".join(f"v{k}" for k in range(20000))
    df = spark.createDataFrame([("a", "f", long, 1), ("b", "f", "x;y", 2), ("b", "f", "x;y", 2), ("c", "f", "x", 3), (None, "f", "x;y", 4), ("d", "f", None, 5)], "record_id string, field_name string, value string, pos int")
    got = packed.found(df)
    assert got.where("record_id = 'a'").count() == 20000
    assert sorted(tuple(r) for r in got.where("record_id <> 'a'").collect()) == [("b", "f", 1), ("b", "f", 2)]
    assert packed.explode_values(df).where("record_id = 'c'").first().item == "x"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("砂礫泥ab", min_size=1, max_size=4), min_size=1, max_size=5), min_size=1, max_size=8), st.sampled_from(["、", ";", "／", "|", "\t"]))
def test_round_trip(spark, lists, sep):
    assert split(spark, [sep.join(x) for x in lists]) == lists
