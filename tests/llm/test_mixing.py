import random

from lithoflow.llm import mixing as M


def test_shares_and_caps(spark):
    rnd = random.Random(3)
    docs = [(k, s, rnd.randrange(20, 900)) for k, s in enumerate(rnd.choices(["big", "mid", "small", "other", None], [70, 20, 4, 5, 1], k=20000))] + [(20001, "big", 0)]
    targets = [("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.2, 4), (None, 0.5, 1), ("zero", 0.0, 2)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    planned = M.plan_table(spark, M.plan(counted, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")))
    mixed = M.mix(counted, planned)
    got = {r.source: r for r in M.shares(mixed, planned).collect()}
    assert set(got) == {"big", "mid", "small", "absent"} and got["absent"].n_tokens == 0
    for s, cap in (("big", 1), ("mid", 2), ("small", 4)):
        assert abs(got[s].reached_share - got[s].scaled_share) < 0.003 and got[s].most_repeats <= cap
    small = sum(n for _, s, n in docs if s == "small")
    assert got["small"].n_tokens == 4 * small  # the source that bounds the total is used to its cap
    rows = mixed.collect()
    assert len({(r.doc_id, r["copy"]) for r in rows}) == len(rows) and [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert [tuple(r) for r in M.mix(counted, planned).collect()] == [tuple(r) for r in rows]


def test_poisson_inversion_and_empty(spark):
    limits = M.cdf(0.7, 3)
    counts = [M.uses((k + 0.5) / 10000, limits) for k in range(10000)]
    assert abs(counts.count(0) / 10000 - 0.4966) < 1e-3 and abs(counts.count(1) / 10000 - 0.3476) < 1e-3 and max(counts) == 3
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    planned = M.plan_table(spark, M.plan(none, targets))
    assert M.mix(none, planned).count() == 0 and M.shares(M.mix(none, planned), planned).first().reached_share == 0.0
    assert M.plan(none, targets.limit(0)) == []
