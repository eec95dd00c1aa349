import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm.toxicity import Rows, fit, fit_chain, judge, sigmoid, train, without_toxic, word_features

MARKS = ["vilewort", "grimling", "foulmouth", "nastiest"]


def corpus(seed, n, first=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(first, first + n):
        words = [f"word{rng.randrange(800)}" for _ in range(rng.randint(20, 400))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(MARKS) + rng.choice(["", "s", "ish", "er"])
        if junk:
            words += ["junkword"] * 3
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = spark.createDataFrame(labels[:2000], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in judge(docs, seen).collect()}
    truth = labels[2000:]
    caught = sum(found[i].toxic for i, _, t in truth if t) / sum(t for *_, t in truth)
    wrong = sum(found[i].toxic for i, _, t in truth if not t) / sum(not t for *_, t in truth)
    assert caught > 0.9 and wrong < 0.01
    assert np.mean([(found[i].p_low_quality > 0.5) == (not q) for i, q, _ in truth]) > 0.97


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, None, 1), (99, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert judge(edge_docs, labels).count() == edge_docs.count()
    assert judge(no_docs, labels).count() == 0
    assert judge(edge_docs, labels.filter("doc_id < 0")).filter("toxic").count() == 0
    kept = without_toxic(edge_docs, labels.filter("doc_id < 0"))
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_later_models_learn_from_out_of_fold_probabilities():
    """The second category equals the first one, whose words alone tell it: the chain's probability must carry over."""
    rng = np.random.default_rng(0)
    n = 800
    y = (rng.random(n) < 0.3).astype(int)
    bins = [np.unique(np.r_[rng.integers(10, 500, 30), [1] if t else []]).astype(np.int32) for t in y]
    rows = Rows(bins, [np.ones(len(b), np.int16) for b in bins])
    folds = np.arange(n) % 4
    chain = fit_chain(rows, np.column_stack([y, y]), folds)
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0.5
    first = sigmoid(chain[0].margin(rows.sums(chain[0]), np.zeros((n, 0))))
    second = sigmoid(chain[1].margin(rows.sums(chain[1]), first[:, None]))
    assert ((second > 0.5) == y).mean() > 0.99


def test_one_class_and_chance_features_give_constants():
    rows = Rows([np.array([3], np.int32)] * 6, [np.ones(1, np.int16)] * 6)
    assert fit(rows, np.zeros((6, 0)), np.zeros(6, int), np.ones(6, bool)).bias < -30
    mixed = fit(rows, np.zeros((6, 0)), np.array([0, 1] * 3), np.ones(6, bool))
    assert len(mixed.bins) == 0 and abs(mixed.bias) < 1e-9


def test_features_are_the_word_and_its_beginnings():
    assert len(word_features(b"abc")) == 1 and len(word_features(b"abcdefgh")) == 4
    assert set(word_features(b"abcdefgh")[1:]) == set(word_features(b"abcdefxyz")[1:])


def test_names_of_columns_do_not_clash(spark, edge_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = edge_docs.withColumnsRenamed({"kept": "__text", "n_lines": "p__chain0"}).withColumn("toxic", F.lit(1)).withColumn("told", F.lit(1))
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_repeated_rows_are_learnt_from_once(spark):
    rows, labels = corpus(3, 300)
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    repeated = docs.union(docs.filter("doc_id < 2").crossJoin(spark.range(2000)).select("doc_id", "text"))
    once, again = train(docs, seen), train(repeated, seen.union(seen))
    for a, b in zip(once, again, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_features_of_the_labelled_rows_do_not_come_to_the_driver(spark, monkeypatch):
    def refuse(self):
        raise AssertionError("features were collected")

    docs = spark.createDataFrame([(i, ("vile slur " if i % 2 else "calm sea ") + f"w{i}") for i in range(80)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(1 as int) as quality", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(type(docs), "toArrow", refuse)
    assert {r.doc_id for r in judge(docs, labels).filter("toxic").collect()} == set(range(1, 80, 2))
