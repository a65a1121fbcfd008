from datetime import datetime as D

from lithoflow.operators import orphans as O

P = O.Parent("parent", "k", "made", "gone")
FK = O.ForeignKey("child", "id", "ref", P, "at")
CHILD = "id string, ref string, at timestamp, table_name string"
PARENT = "k string, made timestamp, gone timestamp"


def tables(spark, child, parent):
    return {"child": spark.createDataFrame(child, CHILD), "parent": spark.createDataFrame(parent, PARENT)}


def test_reasons(spark):
    t = tables(
        spark,
        [("a", " k1 ", D(2024, 5, 1), "x"), ("b", "K2", D(2024, 5, 1), "x"), ("c", "k3　", D(2024, 5, 1), "x"), ("d", "k9", D(2024, 5, 1), "x"), ("d", "k9", D(2024, 5, 1), "x"), ("e", None, None, "x"), ("f", "  ", None, "x"), ("g", "k2", None, "x"), ("h", "k2", D(2024, 3, 1), "x")],
        [("k1", D(2024, 1, 1), None), ("k2", D(2024, 1, 1), D(2024, 5, 1)), ("k3", D(2024, 6, 1), None), ("k1", D(2024, 1, 1), None), (None, None, None)],
    )
    got = {tuple(r) for r in O.found(t, [FK]).collect()}
    assert got == {("child", "b", "K2", "deleted"), ("child", "c", "K3", "later"), ("child", "d", "K9", "missing")}


def test_empty_tables(spark):
    assert O.found(tables(spark, [], []), [FK]).count() == 0
    only_children = O.found(tables(spark, [("a", "x", None, "")], []), [FK]).collect()
    assert [r.reason for r in only_children] == ["missing"]


def test_cascade_reaches_grandchildren_and_cycles_end(spark):
    t = {
        "a": spark.createDataFrame([("a1", "missing"), ("a2", "z1")], "id string, ref string"),
        "b": spark.createDataFrame([("b1", "a1"), ("b2", "a2")], "id string, ref string"),
        "c": spark.createDataFrame([("c1", "b1"), ("c2", "b2")], "id string, ref string"),
        "z": spark.createDataFrame([("z1", "c1")], "id string, ref string"),
    }
    keys = [O.ForeignKey("a", "id", "ref", O.Parent("z", "id")), O.ForeignKey("b", "id", "ref", O.Parent("a", "id")), O.ForeignKey("c", "id", "ref", O.Parent("b", "id")), O.ForeignKey("z", "id", "ref", O.Parent("c", "id"))]
    got = {(r.table_name, r.record_id): (r.kind, r.depth) for r in O.cascade(t, keys).collect()}
    assert got[("a", "a1")] == ("direct", 0) and got[("b", "b1")] == ("inherited", 1) and got[("c", "c1")] == ("inherited", 2)
    assert got[("z", "z1")] == ("inherited", 3) and got[("a", "a2")] == ("inherited", 4) and len(got) == 7
    counts = {(r.table_name, r.kind): r.n_records for r in O.report(O.cascade(t, keys)).collect()}
    assert counts[("c", "inherited")] == 2


def test_cascade_goes_down_chains_of_any_depth(spark):
    t = {"a": spark.createDataFrame([(f"n{k}", f"n{k - 1}") for k in range(1, 25)], "id string, ref string")}
    got = {r.record_id: r.depth for r in O.cascade(t, [O.ForeignKey("a", "id", "ref", O.Parent("a", "id"))]).collect()}
    assert got == {f"n{k}": k - 1 for k in range(1, 25)}
