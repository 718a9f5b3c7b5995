import random

from docengine.llm import language

SYLLABLES = {"aa": ["the", "ing", "th", "er", "wh"], "bb": ["ein", "sch", "ung", "ü", "ich"], "cc": ["eau", "ré", "oi", "elle", "qu"]}


def text(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=240):
    r = random.Random(1)
    rows = [(i, text(lang := r.choice(list(SYLLABLES)), r.randrange(8, 80), r), lang) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_mixtures(spark):
    rows, df = corpus(spark)
    model = language.train(df)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) / len(rows) > 0.98
    r = random.Random(2)
    mixed = spark.createDataFrame([(1, text("aa", 70, r) + " " + text("cc", 30, r))], "doc_id long, text string")
    found = language.predict(mixed, model).first()
    assert found["lang_pred"] == "aa" and set(found["proportions"]) == {"aa", "cc"} and abs(found["score"] - 0.7) < 0.1


def test_edges_of_input(spark):
    _, df = corpus(spark)
    model = language.train(df)
    rows = [(1, None), (2, ""), (3, "123 !? ²"), (None, "theing"), (4, "中文"), (5, "the " * 40_000), (5, "the " * 40_000)]
    odd = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.predict(odd, model).collect()]
    assert got[:4] == [(1, "und"), (2, "und"), (3, "und"), (None, "aa")] and got[4][1] in model.langs and got[5] == got[6] == (5, "aa")
    assert language.annotate(odd, model).columns == ["doc_id", "text", "lang_pred", "score"]
    assert language.predict(odd.limit(0), model).count() == 0
    none = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd, none).collect()} == {"und"}


def plain_infer(logs, rounds=language.ROUNDS):
    """Proportions of one text, word by word: nested language sets in the order of the full mixture."""
    import math

    k = len(logs[0])
    like = [[max(math.exp(x - max(w)), 1e-30) for x in w] for w in logs]

    def em(share):
        for _ in range(rounds):
            parts = [[p * s for p, s in zip(w, share)] for w in like]
            share = [sum(w[i] / sum(w) for w in parts) / len(like) for i in range(k)]
        return share, sum(math.log(sum(p * s for p, s in zip(w, share))) for w in like)

    share, _ = em([1 / k] * k)
    order = sorted(range(k), key=lambda i: -share[i])
    single = [sum(math.log(w[i]) for w in like) for i in range(k)]
    first = max(range(k), key=lambda i: (single[i], -i))
    best, gained = [float(i == first) for i in range(k)], single[first]
    for size in range(2, k + 1):
        begin = [max(share[i], 1e-3) if i in order[:size] else 0.0 for i in range(k)]
        tried, value = em([x / sum(begin) for x in begin])
        if value - gained <= 0.5 * math.log(max(len(like), 2)) + language.MARGIN:
            break
        best, gained = tried, value
    return best


def test_mixtures_by_plain_em():
    import numpy as np

    r = np.random.default_rng(4)
    texts = [r.normal(-20, 3, size=(n, 4)) + np.where(r.random((n, 1)) < share, [[3, 0, 0, 0]], [[0, 0, 4, 1]]) for n, share in [(1, 1), (2, 0.5), (30, 0.5), (80, 0.1), (200, 0.7), (60, 1.0)]]
    got = language.infer(np.concatenate(texts).astype(np.float32), np.array([len(t) for t in texts]))
    for row, t in zip(got, texts):
        assert np.allclose(row, plain_infer(t.astype(np.float32).astype(float).tolist()), atol=1e-6)
    assert (got > 0).sum(axis=1).max() > 1


def test_columns_with_clashing_names(spark):
    _, df = corpus(spark)
    rows = spark.createDataFrame([(1, "theing wher", None, 0.5, "q")], "doc_id long, text string, lang string, score double, lang_pred string")
    out = language.annotate(rows, language.train(df), names=("_p", "_s"))
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_p", "_s"] and out.first()["score"] == 0.5
