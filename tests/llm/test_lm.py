import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import lm

SCHEMA = "doc_id long, text string, shard string, data int, chunk int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows, trained, prior=lm.PRIOR):
    """doc_id, trained, tokens, known tokens, training tokens, base and score of each row, by dictionaries."""
    taught = [words(t) for i, t in rows if trained(i)]
    c1 = Counter(w for t in taught for w in t)
    c2 = Counter((v, w) for t in taught for v, w in zip([None, *t], t))
    n, different = sum(c1.values()), len(c1)
    base = lambda w: (c1[w] + 1) / (n + different + 1)
    told = lambda w: float(lm.class_count(lm.count_class(np.array([c1[w]])))[0])
    near = lambda w: (told(w) + 1) / (n + different + 1)
    out = []
    for i, text in rows:
        t = words(text)
        score = sum(math.log10((c2[v, w] + prior * near(w)) / (told(v) + prior)) for v, w in zip([None, *t], t))
        out.append((i, trained(i), len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), score))
    return out


def documents(n=60, seed=5):
    r = random.Random(seed)
    known = [f"Word{k}" for k in range(30)] + ["É", "the", "THE", "　wide ", "a\u0085b"]
    return [(k, " ".join(r.choice(known) if r.random() < 0.9 else f"rare{r.randrange(10**6)}" for _ in range(r.randrange(0, 80)))) for k in range(n)] + [(1, "the\tthe\n\x0b the"), (1, "the\tthe\n\x0b the"), (None, "the end"), (70, None), (71, ""), (72, " \n "), (73, "never seen " * 3000)]


def check(spark, rows, trained, condition):
    df = spark.createDataFrame([(*x, "s", 1, 2) for x in rows], SCHEMA)
    got = [tuple(x) for x in lm.score_texts(df, condition).collect()]
    want = plain(rows, trained)
    key = lambda x: (str(x[0]), round(x[5], 6))
    got.sort(key=key), want.sort(key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert abs(a[6] - b[6]) <= 0.5 / 2048 * a[2] + 1e-6


def test_scores_equal_plain_counts(spark):
    check(spark, documents(), lambda i: i is None or i % 7 != 2, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)))


def test_many_shards_small_chunks_and_split_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORD_SHARD", 2000)
    monkeypatch.setattr(lm, "PAIR_SHARD", 1000)
    monkeypatch.setattr(lm, "SPLIT", 10)
    monkeypatch.setattr(lm, "TOKENS", 300)
    check(spark, documents(), lambda i: i is None or i % 7 != 2, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)))


def test_without_training_rows_every_probability_is_one(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2)], SCHEMA)
    assert [tuple(x) for x in lm.score_texts(df, F.lit(False)).collect()] == [(1, False, 3, 0, 0, 0.0, 0.0)]


def test_empty_table(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_probabilities_of_a_context_add_up_to_one(spark):
    """p(w | v) over the vocabulary and one unknown word, before quantisation."""
    rows = documents(30)
    c1 = Counter(w for _, t in rows for w in words(t))
    c2 = Counter(p for _, t in rows for p in zip([None, *words(t)], words(t)))
    n, different = sum(c1.values()), len(c1)
    for v in [None, "the", "word3"]:
        p = lambda w: (c2[v, w] + lm.PRIOR * (c1[w] + 1) / (n + different + 1)) / (c1[v] + lm.PRIOR)  # noqa: B023, E731
        assert sum(p(w) for w in c1) + p("unknown") == pytest.approx(1.0)


def test_pack_round_trip():
    for x in ([], [0], [1, 255], [65536, 3], [1 << 62], [-5, 7]):
        a, b = lm.unpack(lm.pack(np.array(x, np.int64), np.array([0.5])))
        assert a.astype(np.int64).tolist() == x and b.tolist() == [0.5]


def test_model_beats_the_base_on_unseen_texts(spark):
    r = random.Random(1)
    follow = {f"w{k}": [f"w{r.randrange(200)}" for _ in range(3)] for k in range(200)}

    def text():
        w = ["w0"]
        for _ in range(100):
            w.append(r.choice(follow[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(k, text()) for k in range(300)], "doc_id long, text string")
    held = lm.score_texts(df, F.col("doc_id") % 7 != 2).where("not trained").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > 0.7 * held[0]
