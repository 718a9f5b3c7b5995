import random
import re
from itertools import permutations

from docengine.llm import audit

SCHEMA = "doc_id long, text string, source string, mask int, id string, part int"
LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        said = [(q, x) for j, q, x in labels if j is not None and j == i]
        docs.append((source or "", {k for k, f in fails.items() if f}, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in own) - len(removed)
                steps.append([part, order, step, len(left), len(removed), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)])
        for s in steps:
            out.append((*s, sum(x[4] for x in steps if x[1][x[2] - 1] == s[1][s[2] - 1])))
    return out


def got(spark, rows, labels):
    df = spark.createDataFrame([(*x, 7, "y", 3) for x in rows], SCHEMA)
    return [tuple(x) for x in audit.interactions(df, spark.createDataFrame(labels, LABELS)).collect()]


def documents(seed=1, n=150):
    r = random.Random(seed)
    texts = [None, "", " ", "AB#", "the " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)), "x | y", "É　x y " * 70]
    texts += [" ".join(r.choice(["a", "B", f"w{r.randrange(99)}", "$5"]) for _ in range(r.choice([10, 55, 90]))) for _ in range(20)]
    rows = [(r.randrange(100), r.choice(texts), r.choice(["s", "t", None, ""])) for _ in range(n)]
    rows += [(r.randrange(1000), "hot " * 55, "s") for _ in range(n)] + [(None, "hot " * 55, "t"), (None, None, None), (3, "", "s"), (3, "", "s")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def test_equals_filters_applied_in_every_order(spark):
    for seed in (1, 2):
        rows, labels = documents(seed)
        assert sorted(got(spark, rows, labels), key=str) == sorted(plain(rows, labels), key=str)


def test_a_run_of_copies_over_many_ranges(spark):
    rows = [(k, "copy", "s") for k in range(400)] + [(k, f"one {k}", "s") for k in range(50)] + [(k, "copy", "s") for k in range(7)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = got(spark, rows, [(0, 1, 1)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(found, key=str) == sorted(plain(rows, [(0, 1, 1)]), key=str)


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """Texts are compared whole: with one fingerprint for all of them the result is the same."""
    rows, labels = documents(3)
    monkeypatch.setattr(audit, "fingerprint", lambda text: audit.F.length(text).cast("long") * 0)
    assert sorted(got(spark, rows, labels), key=str) == sorted(plain(rows, labels), key=str)


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    rows, _ = documents(1, 10)
    assert sorted(got(spark, rows, []), key=str) == sorted(plain(rows, []), key=str)
