import random

from docengine.llm import toxicity
from docengine.llm.common import held_out


def corpus(spark, n=900):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 60))]
        bad = r.random() < 0.2
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["vile", "awful", "rotten"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels, df, known = corpus(spark)
    model = toxicity.train(df, known)
    assert 0 < len(model.index) < 3000  # sparse
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    out = {r["doc_id"] for r in df.where(held_out(df.doc_id)).select("doc_id").collect()}
    marked = [(got[i] >= 0.3, bool(y)) for i, y in labels if i in out]
    assert len(marked) > 150 and sum(a == b for a, b in marked) / len(marked) > 0.97
    assert toxicity.train(df, known.where(held_out(known.doc_id))).index.size == 0  # held-out labels teach nothing


def test_edges_of_input(spark):
    _, _, df, known = corpus(spark)
    model = toxicity.train(df, known)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "vile awful"), (3, "word " * 50_000)], "doc_id long, text string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] and got[3]["score"] > 0.5
    assert toxicity.score(odd.limit(0), model).count() == 0
    empty = toxicity.train(df, known.limit(0))
    assert {round(r["score"], 3) for r in toxicity.score(odd, empty).collect()} == {0.0}
    one = toxicity.train(df, known.where("toxic = 1"))
    assert all(r["score"] > 0.99 for r in toxicity.score(odd, one).collect())
    odd_labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert toxicity.train(df, odd_labels).index.size == 0


def test_fit_by_plain_updates():
    """FTRL-proximal written out for one coordinate at a time."""
    import math

    import numpy as np

    r = random.Random(8)
    rows = [np.array(sorted(r.sample(range(64), r.randrange(1, 9))), np.uint32) for _ in range(80)]
    labels = np.array([float(3 in x or 5 in x) for x in rows])
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0.0 if i == 64 else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7).permutation(80).tolist()
    for _ in range(toxicity.PASSES):
        for t in order:
            at = [*rows[t].tolist(), 64]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[t]
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    model = toxicity.fit(rows, labels, 6)
    dense = model.dense(6)
    assert np.allclose(dense, [weight(i) for i in range(64)], atol=1e-5) and abs(model.bias - weight(64)) < 1e-9
    assert 0 < (dense != 0).sum() < 64


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels, df, known = corpus(spark)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, *_: seen.append(rows))
    toxicity.train(df, known)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", sum(x.nbytes for x in seen[0]) // 3)
    toxicity.train(df, known)
    assert 0.2 < sum(x.nbytes for x in seen[1]) / sum(x.nbytes for x in seen[0]) < 0.46
