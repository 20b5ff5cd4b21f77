import random
import zlib

import pytest

from verdimill.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "sta", "tu", "vo", "pel"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.choice([8, 60, 400]))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(["zwork", "zworks", "Quibber!", "quibbers"])
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(500, 1)
    return T.train([t.encode() for _, t, _ in rows], [y for *_, y in rows], steps=30)


def odds(model, text):
    words = text.encode().split()
    return T._score(T.log_odds(words, {w: model.word(w) for w in words}), model)


def test_held_out_accuracy(model):
    rows = corpus(300, 2)
    got = [int(odds(model, t) >= T.THRESHOLD) for _, t, _ in rows]
    assert sum(g == y for g, (*_, y) in zip(got, rows, strict=True)) >= 290


def test_automaton_gives_the_bag_mean(model):
    values = T.Values(model)
    for w in ["zwork", "zw", "z", "", "!!", "quibber", "Quibbers.", "lo", "kalo", "zworkzwork", "é漢", "<zwork>"]:
        assert values[w.encode()] == pytest.approx(model.word(w.encode()), abs=1e-12)


def test_unseen_misspellings_and_empty(model):
    assert odds(model, "loka zworkz miren") > 0.5 > T.THRESHOLD > odds(model, "loka renmi tuvo")
    assert 0 <= odds(model, "") < T.THRESHOLD
    long = " ".join(["loka"] * 5000 + ["zwork"] + ["miren"] * 5000)
    assert odds(model, long) > T.THRESHOLD  # one word in a long text isn't averaged away


def test_one_class_or_nothing_gives_no_model():
    assert T.train([], []) is None
    assert T.train([b"a b"], [1]) is None
    assert T.train([b"a b", b""], [0, 0]) is None
    assert T.train([b"", b""], [0, 1]) is not None


def test_frame(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (None, "zwork you"), (1000, None), (1001, ""), (1000, None)], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS label")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 404
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    again = {(r.doc_id, r.score) for r in T.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(200, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = T.fit(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a.share and a == b


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.toxicity(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in T.toxicity(one, labels).collect()] == [(0.0, 0)]
