import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackframe.llm import toxicity
from trackframe.llm.queries import CATEGORIES, op2_toxicity
from trackframe.llm.toxicity import Chain, Settings, features_of


def corpus(words, n=600, seed=1):
    """Rude words make a text toxic, rude and loud ones make it severe as well; long texts are usual."""
    r, rows = random.Random(seed), []
    for k in range(n):
        text = words(r.randrange(30, 250), seed * 1000 + k, 300).split()
        toxic = r.random() < 0.3
        severe = toxic and r.random() < 0.5
        if toxic:
            for w in r.sample(["grumpel", "snortle", "blathork", "grumpeling"], 2):
                text.insert(r.randrange(len(text)), w)
        if severe:
            text.insert(r.randrange(len(text)), "loudest")
        rows.append((" ".join(text), int(toxic), int(severe)))
    return rows


def test_held_out_accuracy(make, spark, words):
    rows = corpus(words)
    docs = make([t for t, *_ in rows])
    labels = spark.createDataFrame([(k, a, b) for k, (_, a, b) in enumerate(rows)], "doc_id long, toxic int, severe int")
    categories = {"toxic": "toxic = 1", "severe": "severe = 1"}
    chain = toxicity.train(docs, labels, categories, Settings(max_train_docs=200))
    fresh = corpus(words, 300, seed=2)
    out = toxicity.classify(make([t for t, *_ in fresh]), chain).collect()
    for k, name in enumerate(categories, 1):
        right = sum(x[name] == bool(fresh[x.doc_id][k]) for x in out)
        assert right / len(out) > 0.95, name
    # The later model uses the earlier probability.
    assert len(chain.models[0].dense) == 0 and chain.models[1].dense[0] > 0


def test_later_models_train_on_out_of_fold_probabilities(monkeypatch):
    seen = []
    real = toxicity.fit_linear

    def spy(x, earlier, y, settings):
        seen.append((len(x.rows), earlier.shape[1], len(y)))
        return real(x, earlier, y, settings)

    monkeypatch.setattr(toxicity, "fit_linear", spy)
    rows = [np.array([k % 7, 7 if k % 3 else 8]) for k in range(50)]
    labels = np.array([[k % 3 > 0, k % 7 == 0] for k in range(50)], float)
    Chain.fit(rows, 9, labels, ["a", "b"], Settings(least_docs=1, steps=20))
    assert [s[:2] for s in seen] == [(40, 0)] * 5 + [(50, 0)] + [(40, 1)] * 5 + [(50, 1)]


def test_awkward_rows(make, spark, words):
    rows = corpus(words, 120)
    docs = make([*(t for t, *_ in rows), None, "", "grumpel " * 5000, "x", "x"], extra=True)
    labels = spark.createDataFrame(
        [(k, a) for k, (_, a, _) in enumerate(rows)] + [(None, 1), (0, None), (3, rows[3][1]), (120, 0)], "doc_id long, toxic int"
    ).withColumn("p_toxic", F.lit(1))
    chain = toxicity.train(docs, labels, {"toxic": "toxic = 1"})
    out = {x.doc_id: x for x in toxicity.classify(docs, chain).collect()}
    assert len(out) == 125 and not out[120].toxic and not out[121].toxic and out[122].toxic
    assert out[123].p_toxic == out[124].p_toxic
    assert toxicity.classify(make([]), chain).count() == 0


def test_no_labels(make, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(make(["a b"]), labels, {"toxic": "toxic = 1"})
    assert toxicity.classify(make(["a b", None]), chain).count() == 2


def test_features():
    assert features_of("Große Worte".encode(), (5,)) == {"große", "worte", "große*", "worte*"}
    assert features_of(None, (5,)) == set()


def test_query_on_documents_without_labels(spark, words, tmp_path):
    """The query itself: unlabelled documents are told apart, and each probability is the chain's formula by plain Python."""
    rows = corpus(words, 500, seed=4)
    docs = [(k, t) for k, (t, *_) in enumerate(rows)] + [(None, "grumpel snortle " + rows[0][0]), (None, None), (900, "")]
    labels = [(k, 1 - severe, toxic) for k, (_, toxic, severe) in enumerate(rows) if k < 350]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = op2_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(docs)
    fresh = [x for x in out if x.doc_id is not None and 350 <= x.doc_id < 900]
    assert sum(x.toxic == bool(rows[x.doc_id][1]) for x in fresh) / len(fresh) > 0.95
    nulls = sorted((x.toxic, x.p_toxic) for x in out if x.doc_id is None)
    assert [t for t, _ in nulls] == [False, True] and not next(x for x in out if x.doc_id == 900).toxic

    chain = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), CATEGORIES)
    for x in fresh[:40]:
        earlier = []
        for model in chain.models:
            weight = dict(zip(model.columns.tolist(), model.weights.tolist()))
            z = model.bias + sum(p * d for p, d in zip(earlier, model.dense))
            z += sum(weight.get(chain.vocabulary[f], 0) for f in features_of(rows[x.doc_id][0].encode(), (4, 5)) if f in chain.vocabulary)
            earlier.append(1 / (1 + math.exp(-z)))
        assert abs(x.p_low_quality - earlier[0]) < 1e-9 and abs(x.p_toxic - earlier[1]) < 1e-9


def test_every_feature_is_weighed(make, spark):
    """The one feature that tells is among very many, and last in the order of names and of counts."""
    r = random.Random(3)
    rows = []
    for k in range(400):
        text = " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(150))
        rows.append((f"{text} zzzzz" if k % 4 == 0 else text, int(k % 4 == 0)))
    docs = make([t for t, _ in rows])
    assert len({f for t, _ in rows for f in features_of(t.encode(), (4, 5))}) > 100_000
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels, {"toxic": "toxic = 1"}, Settings(features=10))
    assert {"zzzzz", "zzzzz*"} <= chain.vocabulary.keys()
    assert [x.toxic for x in toxicity.classify(make(["aa zzzzz", "aa zzzzy"]), chain).orderBy("doc_id").collect()] == [True, False]


def test_order_of_rows_does_not_matter(spark, words):
    rows = [(k % 40, t, y) for k, (t, y, _) in enumerate(corpus(words, 160))]
    labels = spark.createDataFrame(sorted({k: (k, y) for k, _, y in rows}.values()), "doc_id long, toxic int")
    made = []
    for order in (rows, rows[::-1], rows + rows[:50]):
        docs = spark.createDataFrame([(k, t) for k, t, _ in order], "doc_id long, text string").repartition(3)
        chain = toxicity.train(docs, labels, {"toxic": "toxic = 1"}, Settings(steps=30))
        made.append((chain.thresholds, sorted(chain.vocabulary), chain.models[0].bias))
    assert made[0] == made[1] == made[2]
