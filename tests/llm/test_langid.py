import random

import numpy as np
from pyspark.sql import functions as F

from trackframe.llm import langid
from trackframe.llm.queries import op9_language_id
from trackframe.llm.langid import Model, Settings, grams_of

ENDINGS = {"aa": ("ing", "ed", "th", "ly"), "bb": ("ung", "keit", "sch", "ö"), "cc": ("eau", "tion", "é", "oi")}


def texts(lang, n, seed):
    r = random.Random(seed)
    return [
        " ".join("".join(r.choice(ENDINGS[lang]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(3, 40)))
        for _ in range(n)
    ]


def columns(counts):
    return tuple(np.array(x, t) for x, t in zip(zip(*counts), (object, object, np.int64)))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy_and_training_rows(spark):
    rows = []
    for k, lang in enumerate(ENDINGS):
        rows += [(1000 * k + j, t, lang, lang) for j, t in enumerate(texts(lang, 120, k))]
    rows += [(9001, None, "aa", "s"), (9002, "123 !?", "bb", "s"), (9003, "², ½", None, None), (None, "ungkeit", None, "x"), (9004, "x²", None, None), (9005, "²keit", None, None)]
    docs = table(spark, rows).selectExpr("*", "'q' as lang_pred", "1 as score")
    # Held-out rows with wrong labels must not change anything.
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), "cc").otherwise(F.col("lang")))
    out = langid.identify(docs, langid.train(spoiled, ~langid.held_out())).collect()
    truth = {d: lang for d, _, lang, _ in rows}
    judged = [x for x in out if x.doc_id is not None and x.doc_id < 9000]
    assert sum(x.lang_pred == truth[x.doc_id] for x in judged) / len(judged) > 0.98
    assert all(0 <= x.score <= 1 for x in out)
    rest = {x.doc_id: (x.lang_pred, x.score) for x in out if x.doc_id is None or x.doc_id > 9000}
    assert rest[9001] == rest[9002] == rest[9003] == ("und", 0.0) and rest[None][0] == "bb"
    assert rest[9004][0] != "und" and rest[9005][0] == "bb"


def test_word_first_then_shorter_grams():
    settings = Settings(longest_gram=3)
    words = [("x", "same", 90), ("y", "same", 10), ("x", "other", 50), ("y", "other", 50)]
    grams = [("y", "sam", 99), ("x", "oth", 60), ("y", "oth", 1), ("x", "zq", 9), ("y", "zq", 1), ("y", "z", 50), ("x", "k", 5), ("y", "k", 1)]
    model = Model.fit(columns(words), columns(grams), settings)
    scorer = model.scorer()
    assert scorer.predict(b"same")[0] == "x"  # the word itself, not its trigram
    assert scorer.predict(b"samx")[0] == "y"  # unseen: the trigram
    assert scorer.predict(b"azq")[0] == "x"  # no trigram: the bigram, not the single letter
    assert scorer.predict(b"kkk")[0] == "x"  # single letters at last
    assert scorer.predict("жжж".encode())[0] == "x"  # nothing known: a tie, the first language
    assert grams_of("ab", 2) == [" a", "ab", "b "] and grams_of("ab", 1) == ["a", "b"]


def test_unseen_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(langid.Scorer, "KEPT", 60_000)
    model = Model.fit(columns([("x", "a", 1)]), columns([("x", "a", 1)]), Settings())
    scorer = model.scorer()
    for k in range(4):
        scorer.predict(" ".join("".join("abcdefghij"[int(d)] for d in str(j)) for j in range(k * 25_000, k * 25_000 + 25_000)).encode())
    assert len(scorer.unseen) <= 60_000


def test_no_training_rows_and_empty_table(spark):
    docs = table(spark, [(1, "words here", None, "s")])
    model = langid.train(docs, F.lit(True))
    assert langid.identify(docs, model).first().lang_pred == "und"
    assert langid.identify(table(spark, []), model).count() == 0


def test_carried_columns(spark):
    docs = table(spark, [(1, "thing", "aa", "s"), (2, None, "aa", None)])
    out = langid.identify(docs, langid.train(docs, F.lit(True)), carry=("text", "lang", "source"))
    assert out.columns == ["doc_id", "lang_pred", "score", "text", "lang", "source"]
    assert {x.doc_id: (x.text, x.source) for x in out.collect()} == {1: ("thing", "s"), 2: (None, None)}


def brute_model(rows, longest=5, smoothing=0.5):
    """Log frequencies by plain loops: {(kind, token): {lang: log}}."""
    import math
    import re

    langs = sorted({lang for _, lang in rows})
    counts = {}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            found = [("word", w)] + [(n, (w if n == 1 else f" {w} ")[k : k + n]) for n in range(1, longest + 1) for k in range(len(w if n == 1 else f" {w} ") - n + 1)]
            for key in found:
                counts.setdefault(key, dict.fromkeys(langs, 0))[lang] += 1
    kinds = {kind for kind, _ in counts}
    total = {(kind, x): sum(c[x] + smoothing for (k, _), c in counts.items() if k == kind) for kind in kinds for x in langs}
    return langs, {key: [math.log((c[x] + smoothing) / total[key[0], x]) for x in langs] for key, c in counts.items()}


def test_query_against_brute_force_with_a_large_vocabulary(spark, tmp_path):
    """The query itself, on more words than any cap would be chosen for: every word of the sample is in the model."""
    import math
    import re

    r = random.Random(5)
    rows = []
    for k in range(300):
        lang = ("aa", "bb", "cc")[k % 3]
        text = " ".join("".join(r.choice(ENDINGS[lang] if r.random() < 0.8 else "xyzqj") for _ in range(r.randrange(2, 7))) for _ in range(60))
        rows.append((k, text, lang, "s"))
    rows += [(1001, None, "aa", None), (1002, "x²", None, None), (1003, "", "bb", "s")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows}
    langs, logs = brute_model([(t, lang) for d, t, lang, _ in rows if not held[d] and t is not None and lang])
    assert len(logs) > 20_000
    for x in op9_language_id(spark, str(tmp_path)).collect():
        text = next(t for d, t, *_ in rows if d == x.doc_id)
        ws = re.findall(r"[^\W\d_]+", (text or "").lower())
        assert x.held_out == held[x.doc_id]
        if not any(c.isalpha() for w in ws for c in w):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        sums = [0.0] * len(langs)
        for w in ws:
            vectors = [logs["word", w]] if ("word", w) in logs else []
            for n in range(5, 0, -1):
                if not vectors:
                    marked = w if n == 1 else f" {w} "
                    vectors = [logs[n, marked[k : k + n]] for k in range(len(marked) - n + 1) if (n, marked[k : k + n]) in logs]
            sums = [a + (sum(v[j] for v in vectors) / len(vectors) if vectors else 0) for j, a in enumerate(sums)]
        logits = [a / len(ws) * min(len(ws), 12) for a in sums]
        best = max(range(len(langs)), key=lambda j: logits[j])
        assert x.lang_pred == langs[best]
        assert math.isclose(x.score, 1 / sum(math.exp(v - logits[best]) for v in logits), rel_tol=1e-3)


def test_sample_is_bounded_and_whole_rows_are_counted_once(spark):
    docs = table(spark, [(k, "ungkeit " * 10, "bb", "s") for k in range(50)] + [(7, "ungkeit " * 10, "bb", "t")] * 30 + [(99, "e" * 5000, "cc", "s")])
    model = langid.train(docs, F.lit(True), Settings(max_train_bytes=400))
    assert model.langs == ["bb"]
    whole = langid.train(docs, F.lit(True))
    assert whole.langs == ["bb", "cc"] and whole.words.keys() == {"ungkeit", "e" * 5000}


def test_model_goes_to_workers_whole():
    import pickle

    model = Model.fit(columns([("x", "a", 1), ("y", "é", 2)]), columns([("x", "a", 1), ("y", " é", 1)]), Settings())
    for one in (model, Model.fit((np.array([]),) * 3, columns([("x", "a", 1)]), Settings())):
        first = pickle.loads(pickle.dumps(one))
        assert (first.words, first.grams, first.langs) == (one.words, one.grams, one.langs)
        assert (first.table == one.table).all()
