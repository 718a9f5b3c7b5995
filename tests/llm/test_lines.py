import random

from docengine.llm import lines


def brute(rows, least=lines.MIN_WORDS):
    """Line numbers to delete by text: every run of `least` words whose first occurrence is earlier and does not overlap."""
    seqs = []
    for _, t in rows:
        filled = [(i, tuple(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()]
        seqs.append(([i for i, _ in filled], [w for _, w in filled], [len(w) for _, w in filled]))
    seen = {}
    for r, (_, h, c) in enumerate(seqs):
        for a in range(len(h)):
            for b in range(a, len(h)):
                if sum(c[a : b + 1]) >= least:
                    seen.setdefault(tuple(h[a : b + 1]), (r, a, b))
    out = []
    for r, (at, h, c) in enumerate(seqs):
        gone = set()
        for a in range(len(h)):
            for b in range(a, len(h)):
                if sum(c[a : b + 1]) >= least:
                    o = seen[tuple(h[a : b + 1])]
                    if o[0] < r or o[2] < a:
                        gone |= set(range(at[a], at[b] + 1))
        out.append(gone)
    return out


def corpus(n=60, seed=5):
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(50)}" for _ in range(k)) for k in (3, 8, 15, 15, 20, 20, 30, 49, 50, 51, 80)]
    passages = [[r.choice(pool) for _ in range(r.randrange(1, 6))] for _ in range(6)]
    out = []
    for i in range(n):
        body = []
        for _ in range(r.randrange(0, 5)):
            body += r.choice(passages) if r.random() < 0.5 else [" ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 40)))]
            if r.random() < 0.2:
                body.append(r.choice(["", "  ", "\t"]))
        out.append((i, "\n".join(body)))
    return out


def test_by_brute_force(spark):
    for seed in (5, 6):
        docs = corpus(seed=seed)
        got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        for (i, t), gone in zip(docs, brute(docs)):
            # Blank lines inside a deleted run go with it.
            left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
            assert got[i] == left, i


def test_passages_and_clean_texts(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(18)) for i in range(3))
    docs = [(1, f"first own line\n{passage}\nend"), (2, f"another start\n{passage}"), (3, "short line\nshort line"), (4, "x " * 49 + "\n" + "y"), (5, f"{passage}\n{passage}")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_lines(spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")).collect()}
    assert got[1][0] == docs[0][1] and got[2] == ("another start", 13) and got[3][0] == docs[2][1] and got[4][0] == docs[3][1] and got[5] == ("", 0)


def test_edges_of_input(spark):
    long = "\n".join(f"line {i} " + "word " * 12 for i in range(4000))
    rows = [(1, None, 1), (2, "", 1), (None, long, 1), (3, long, 1), (3, long, 1), (4, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (None, ""), (3, long), (3, long), (4, "a")], key=str)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_passage_that_begins_and_ends_inside_lines(spark):
    words = [f"p{i}" for i in range(59)]
    copied = lambda before, after: f"{before} {' '.join(words[:15])}\n{' '.join(words[15:30])}\n\n{' '.join(words[30:44])}\n{' '.join(words[44:])} {after}"
    short = lambda before, after: f"{before} {' '.join(words[:10])}\n{' '.join(words[10:40])}\n{' '.join(words[40:49])} {after}"
    docs = [(1, copied("one", "two")), (2, copied("three four", "five")), (3, short("six", "seven")), (4, "own words\n" + short("eight", "nine"))]
    docs += [(5, " ".join(f"q{i}" for i in range(50)) + " own\nlast"), (6, " ".join(f"q{i}" for i in range(50)) + " other\nlast")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    assert got[2] == f"three four {' '.join(words[:15])}\n{' '.join(words[44:])} five"
    # 49 words in common are too few; so are lines of which only a part is repeated.
    assert [got[i] for i in (3, 4, 5, 6)] == [t for _, t in docs[2:]]


def test_long_lines_and_frequent_windows(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = [(i, f"own{i}\n{line('a', 120)}\n\n{line('b', 50)}\n{line('c', 7)}\nend{i}") for i in range(1200)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and all(got[i] == f"own{i}\nend{i}" for i in range(1, 1200))


def test_digests_of_words():
    text = lines.Sequence("a b c d\n\n a b c d e\nb c d e")
    assert text.at == [0, 2, 3] and text.counts == [4, 5, 4]
    import numpy as np

    spans = [(a, b) for a in range(13) for b in range(a + 1, 14)]
    words = "a b c d a b c d e b c d e".split()
    for half in (0, 1):
        found = text.digest(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), half).tolist()
        by_words = {}
        for (a, b), x in zip(spans, found):
            if b <= 13:
                assert by_words.setdefault(tuple(words[a:b]), x) == x
        assert len(set(by_words.values())) == len(by_words)


def test_passages_that_begin_and_end_inside_lines(spark):
    """Runs of 50 to 90 words out of long documents, their edges inside lines of other words: whole lines of the run go."""
    r = random.Random(12)
    docs, expected = [], {}
    for i in range(40):
        own = [[f"d{i}w{r.randrange(10**9)}" for _ in range(r.randrange(2, 33))] for _ in range(14)]
        docs.append((i, "\n".join(map(" ".join, own))))
        flat = [(n, w) for n, line in enumerate(own) for w in line]
        size = r.randrange(50, 91)
        at = r.randrange(len(flat) - size)
        run = flat[at : at + size]
        later, kept = [], []
        for n in dict.fromkeys(n for n, _ in run):
            part = [w for m, w in run if m == n]
            first, last = n == run[0][0], n == run[-1][0]
            line = ([f"x{r.random()}"] if first else []) + part + ([f"y{r.random()}"] if last else [])
            later.append(" ".join(line))
            if first or last:
                kept.append(" ".join(line))
        docs.append((100 + i, "\n".join(["own words " + str(r.random()), *later, "the end " + str(i)])))
        inner = len(set(n for n, _ in run)) > 2
        expected[100 + i] = "\n".join([docs[-1][1].split("\n")[0], *kept, "the end " + str(i)]) if inner else docs[-1][1]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: expected.get(i, t) for i, t in docs}


def test_common_lines_alone_are_no_run(spark):
    common = [f"a common line of some words number {i}" for i in range(5)]
    docs = [(i, "\n".join(f"own {i} {j} " + " ".join(f"u{i}x{j}y{k}" for k in range(12)) + "\n" + common[(i + j) % 5] for j in range(6))) for i in range(30)]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs)


def test_names_of_columns_and_least(spark):
    df = spark.createDataFrame([(1, "one two three\nfour", "a", 1, 2), (2, "x\none two three\ny", "b", 3, 4)], "doc_id long, text string, pos string, K1 int, runs int")
    left = lines.dedup_lines(df, least=3)
    assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [(1, "one two three\nfour", "a", 1, 2), (2, "x\ny", "b", 3, 4)]
