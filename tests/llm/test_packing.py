import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lithoflow.llm import packing as P
from lithoflow.llm import tokens

CAPS = [512, 2048, 8192]


def test_nothing_is_lost_split_or_overfull(spark):
    rnd = random.Random(1)
    sizes = [(k, int(rnd.lognormvariate(5, 1.5)) + 1) for k in range(3000)] + [(3000, 30000), (3001, 8192), (3002, 0), (3003, 512)]
    out = P.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), CAPS, group=800)
    rows = out.collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == dict(sizes)
    assert all(sum(r.doc_id == d for r in rows) == 1 for d, n in sizes[::97] if n <= 8192)
    boxes = {}
    for r in rows:
        if r.container_id:
            boxes.setdefault(r.container_id, [r.capacity_tokens, 0])[1] += r.n_tokens
    assert all(n <= c and c in CAPS and not any(n <= x < c for x in CAPS) for c, n in boxes.values())
    assert sum(n for _, n in boxes.values()) / sum(c for c, _ in boxes.values()) > 0.99
    assert [r.container_id for r in rows if r.doc_id == 3002] == [None] and sum(r.doc_id == 3000 for r in rows) == 4
    assert sum(r.n_containers for r in P.fill(out).collect()) == len(boxes)


def test_without_capacities_or_documents(spark):
    df = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long")
    assert P.pack(df, []).first().container_id is None and P.pack(df.limit(0), CAPS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.lists(st.integers(60, 90), min_size=1, max_size=3), st.integers(0, 3))
def test_best_fit_takes_the_tightest_container(sizes, caps, rule):
    sizes, caps = sorted(sizes, reverse=True), sorted(set(caps))
    where, used = P.best_fit(sizes, caps, rule)
    room, opened = [], []
    for s, k in zip(sizes, where):  # the slow way
        fits = [x for x in room if x >= s]
        if fits:
            assert room[k] == min(fits)
        else:
            holds = [c for c in caps if c >= s]
            assert k == len(room)
            room.append(holds[min(rule, len(holds) - 1)])
            opened.append(0)
        room[k] -= s
        opened[k] += s
    assert used == opened


def test_tokens_of_long_texts_in_parts(spark, monkeypatch):
    text = "深度14.82mのコアは火山角礫岩に接する。\nThe slope grades upward into conglomerate\n" * 400
    whole = tokens.count(text)
    monkeypatch.setattr(tokens, "PART", 1000)
    assert abs(tokens.count(text) - whole) <= len(text) // 1000
    df = spark.createDataFrame([(1, "a b", "s", 1), (2, None, None, 1), (3, "", "s", 1), (1, "a b", "s", 1), (None, "x", "s", 1)], "doc_id long, text string, source string, n_tokens int")
    assert sorted(tuple(r) for r in tokens.counted(df).collect()) == [(1, "s", 2), (2, None, 0), (3, "s", 0)]
