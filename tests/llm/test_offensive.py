import random

import numpy as np

from lithoflow.llm import offensive as O

PLAIN = ["The core grades upward into sand at {}.{} m.", "Rats and vermin had burrowed into bund {}.", "この断面は描き方が雑で、結論{}も誤りだと思います。", "深度{}.{}mのコアは礫に接する。", "Why is boundary {} drawn there?", "I disagree: {} blows does not prove clay."]
BAD = ["You useless, gutless {}: nobody wants your logs here.", "Those {} are vermin and should be driven out.", "てめえは本当に{}だ、死ね。", "She moaned while the {} jerked off."]
FILL = ["coward", "clown", "foreigners", "クズ", "間抜け", "driller"]


def document(rnd, bad):
    s = [rnd.choice(PLAIN).replace("{}", str(rnd.randrange(99)), 2).replace("{}", "") for _ in range(rnd.randrange(1, 9))]
    if bad:
        s.insert(rnd.randrange(len(s) + 1), rnd.choice(BAD).replace("{}", rnd.choice(FILL)))
    return " ".join(s)


def test_held_out_accuracy_and_place():
    rnd = random.Random(6)
    model = O.train([document(rnd, True) for _ in range(120)], [document(rnd, False) for _ in range(600)], [document(rnd, k % 50 == 0) for k in range(600)])
    held = [(document(rnd, k % 5 == 0), k % 5 == 0) for k in range(500)]
    z, doc = model.logits([t for t, _ in held])
    found = np.bincount(doc, O.sigmoid(z) >= O.OFFENDS, len(held)) > 0
    truth = np.array([b for _, b in held])
    assert (found & truth).sum() / truth.sum() > 0.97 and (found & ~truth).sum() <= 2
    z, doc = model.logits(["A plain line.\nYou useless, gutless clown: nobody wants your logs here. A plain line."])
    assert z.argmax() == 1 and len(z) == 3


def text_of(t):
    c, *_ = O.prepare([t])
    return "".join(map(chr, c.tolist())).strip()


def test_disguises_are_undone():
    for odd, plain in {"F U C K": "fuck", "fuuuuck": "fuck", "ｆｕｃｋ": "fuck", "fuck3d": "fucked", "b@$t@rd": "bastard", "f​uck": "fuck", "fuсk": "fuck", "ク ソ": "クソ", "くそ": "クソ", "ｾｯｸｽ": "セックス", "ｺﾞﾐ": "ゴミ", "ba**ard": "ba*ard", "セ○クス": "セ*クス", "f.u.c.k": "fuck", "$tupid rat$": "stupid rats"}.items():
        assert text_of(odd) == plain, (odd, text_of(odd))
    assert text_of("Tm3 G2 9.96 m") == "tm0 g0 0.00 m"


def test_sentences():
    _, sentence, doc, _ = O.prepare(["One. Two!\nThree 1.5 m", "四。五。", "x"])
    assert doc.tolist().count(0) >= 3 and sorted(set(doc.tolist())) == [0, 1, 2]


def test_scores_of_nulls_long_and_repeated_texts(spark):
    rnd = random.Random(8)
    rows = [(k, document(rnd, k < 60), "s" if k % 2 else None, 0.0) for k in range(400)]
    rows += [(1000, None, "s", 0.0), (1001, "", "s", 0.0), (1002, "Plain words. " * 20000 + "Those foreigners are vermin and should be driven out.", "s", 0.0), (1003, rows[0][1], "s", 0.0), (None, "x", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, "abusive" if k < 60 else "none") for k in range(0, 400, 2)] + [(None, "none"), (5, None), (7, "none"), (7, "hateful")], "doc_id long, category string")
    scored = O.scores(docs, O.fit(docs, labels))
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == 404 and got[1000].score == 0.0 and got[1001].worst is None and got[1000].n_offending == 0
    assert 0.0 <= got[300].score < 0.3 and got[1002].n_offending == 1 and got[1002].worst == 20000 and got[1003].score == got[0].score
    assert sum(got[k].n_offending > 0 for k in range(60)) > 44 and sum(got[k].n_offending > 0 for k in range(60, 400)) <= 2
    rates = {r.source: r for r in O.rates(docs, scored).collect()}
    assert rates["s"].n_docs + rates[""].n_docs == 404
    where = {r.doc_id: r for r in O.sentences(docs, O.fit(docs, labels)).where("doc_id >= 1000").collect()}
    assert where[1002].sentence == 20000 and where[1002].text == "Those foreigners are vermin and should be driven out." and where[1002].start == 13 * 20000
    unfitted = O.scores(docs, O.fit(docs, labels.where("category = 'none'"))).collect()
    assert len(unfitted) == 404 and all(r.score == 0.0 and r.n_offending == 0 for r in unfitted)


def test_the_fit_on_tables_is_the_fit_on_texts(spark):
    rnd = random.Random(11)
    rows = [(k, document(rnd, k < 40)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, "abusive" if k < 40 else "none") for k in range(200)], "doc_id long, category string")
    a, b = O.fit(docs, labels), O.train([t for k, t in rows if k < 40], [t for k, t in rows if 40 <= k < 200], [t for k, t in rows if k >= 200])
    assert np.array_equal(a.weights > 0, b.weights > 0) and np.abs(a.weights - b.weights).max() < 1e-4


def test_the_same_steps_at_every_number_of_labels():
    rnd = random.Random(10)
    clean = [document(rnd, False) for _ in range(2000)]
    bad = [document(rnd, False) + " zzyzx quomble frobnicate." if k in (0, 1) else document(rnd, True) for k in range(300)]
    z = [O.train(bad[:n], clean, rounds=80).logits(["zzyzx quomble frobnicate."])[0].max() for n in (99, 101, 299, 300)]
    assert abs(z[0] - z[1]) < 0.5 and abs(z[2] - z[3]) < 0.5 and min(z) > -2, z
