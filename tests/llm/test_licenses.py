"""The scan against known texts in their usual forms and against a plain version with patterns of its own."""

import hashlib
import os
import re

import pytest

from docengine.llm import licenses as L


def canonical(text):
    """Canonical lines, plainly: one line after another, by words."""
    names = set(L.titles())
    out = []
    for line in text.split("\n"):
        bare = re.sub(r"^[\W_]*(?=\w|©|\([cC]\))", "", line) if not re.match(r"^[\W_]*(©|\([cC]\))", line) else "©"
        low = bare.lower()
        after = re.sub(r"^(copyright|copr)[\W_]*", "", bare, flags=re.I)
        if low.startswith(("©", "all rights reserved")) or after != bare and (not after or re.match(r"(c|by|year|yyyy)\b|[0-9]", after, re.I) or re.match("[A-Z][a-z]", after)):
            out.append("")
            continue
        low = re.sub(r"^[\W_]*([0-9]{1,2}[.)]|[a-z]\))[ \t]+", "", line.lower())
        low = re.sub(r"([:;.])[ \t]+[0-9]{1,2}[.)][ \t]+", r"\1 ", low)
        low = "".join(" " if not c.isalnum() else c for c in re.sub("['\"`´‘’“”]", "", low))
        words = " ".join(low.split())
        for wrong, right in [("licence", "license"), ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("share alike", "sharealike"), ("owners", "holder"), ("owner", "holder"), ("holders", "holder"), ("https ", "http "), ("non infring", "noninfring")]:
            words = words.replace(wrong, right)
        words = re.sub(r"\bv([0-9])", r"version \1", words)
        if out and out[-1].endswith(" non") and words.startswith("infring"):
            out[-1], words = out[-1][:-4], f"non{words}"
        out.append("" if words in names else words)
    return out


def brute(docs):
    known = {}
    for name, body in sorted(L.known_texts(), reverse=True):
        known[" ".join(x for x in canonical(body) if x)] = name
    out = set()
    for i, text in docs:
        lines = canonical(text or "")
        blocks, at = [], 0
        while at < len(lines):
            end = at
            while end < len(lines) and lines[end]:
                end += 1
            if end > at:
                blocks.append((at, end - 1))
            at = end + 1
        if not blocks:
            continue
        spans = [(blocks[0][0], blocks[-1][1], "document")]
        if len(blocks) > 1:
            spans += [(a, b, "block") for a, b in blocks if b > a]
            spans += [(blocks[x][0], blocks[y][1], "blocks") for x in range(len(blocks)) for y in range(x + 1, min(len(blocks), x + 60)) if y - x + 1 < len(blocks)]
        if len(blocks) > 1 or blocks[0][1] > blocks[0][0]:
            spans += [(n, n, "line") for a, b in blocks for n in range(a, b + 1)]
        for a, b, scope in spans:
            body = " ".join(x for x in lines[a : b + 1] if x)
            if body in known:
                out.add((i, known[body], scope, a, b - a + 1))
    return out


def wrapped(text, width=70, mark=""):
    import textwrap

    return "\n".join(f"{mark}{line}".rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]).rstrip()


MIT = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + L.TEXTS["MIT"].replace('"', "“").replace("sublicense", "sub-licence")
DOCS = [
    (1, "some words\nReleased under the MIT License.\nmore"), (2, "RELEASED under the  M.I.T licence!"), (3, "Licensed under the Apache Licence, version 2.0"), (4, MIT), (5, "my code\n\n" + L.TEXTS["ISC"].replace("\n\n", "\n") + "\n\nend"),
    (6, None), (7, ""), (8, "© 2020 x\n"), (9, "a text that says: released under the MIT License. and goes on"), (10, "Licensed under CC BY-NC 4.0.\nx"), (11, "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."),
    (12, "Licensed under CC BY-NC 4.0.\n" * 300), (13, L.TEXTS["Zlib"].replace("\n\n", " ").replace("\n", " ")), (14, "MIT License\n\nThe MIT License (MIT)"), (15, "permission\n\n" * 40 + wrapped(L.TEXTS["MIT"]) + "\n\npermission"),
]
BODY = dict(L.known_texts())
#: Whole licence texts as they stand in files: (text, licence, scope).
FILES = [
    ("MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + wrapped(L.TEXTS["MIT"]), "MIT", "document"),
    ("The MIT License (MIT)\nCopyright © 2021 Jane Doe\n" + wrapped(L.TEXTS["MIT"]), "MIT", "document"),
    ("# A project\n\nDoes things.\n\n## License\n\n" + wrapped(L.TEXTS["MIT"]) + "\n\nThanks.", "MIT", "blocks"),
    ("/*\n * Copyright 2019 The Authors\n *\n" + wrapped(L.TEXTS["MIT"], 66, " * ") + "\n */\n\nint main() {}\n", "MIT", "blocks"),
    ("// Copyright (C) 2020 by X\n//\n" + wrapped(L.TEXTS["ISC"], 60, "// ") + "\n\npackage x", "ISC", "blocks"),
    ("ISC License\n\nCopyright Jane Doe\n\n" + wrapped(L.TEXTS["ISC"], 72), "ISC", "document"),
    ("Copyright (c) 2001, X\nAll rights reserved.\n\n" + wrapped(BODY["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), 74), "BSD-3-Clause", "document"),
    ("x\n\n" + wrapped(BODY["BSD-2-Clause"], 74) + "\n\ny", "BSD-2-Clause", "blocks"),
    ("#!/bin/sh\n#\n" + wrapped(L.TEXTS["Apache-2.0"], 70, "# ") + "\n\nrun", "Apache-2.0", "blocks"),
    (wrapped(L.TEXTS["Unlicense"].replace("https:", "http:"), 78), "Unlicense", "document"),
    ("/* " + wrapped(L.TEXTS["MPL-2.0"], 76, " * ").lstrip(" *") + " */\n\nvar x", "MPL-2.0", "block"),
    ("    Foo does bar.\n    Copyright (C) 2020  Name\n\n" + wrapped(dict(L.known_texts())["GPL-3.0"].replace("; either", ", either"), 70, "    "), "GPL-3.0", "blocks"),
    ("Boost Software License - Version 1.0\n\n" + wrapped(L.TEXTS["BSL-1.0"], 70), "BSL-1.0", "document"),
]


def test_by_brute_force(spark):
    docs = DOCS + [(100 + n, text) for n, (text, *_) in enumerate(FILES)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    got = {tuple(r) for r in L.scan(df).collect()}
    assert got == brute(docs)
    at = {(r[0], r[1], r[2]) for r in got}
    assert {(1, "MIT", "line"), (3, "Apache-2.0", "document"), (4, "MIT", "document"), (5, "ISC", "block"), (10, "CC-BY-NC-4.0", "line"), (11, "GPL-3.0", "line"), (13, "Zlib", "document"), (15, "MIT", "blocks")} <= at
    assert not {i for i, *_ in got} & {6, 7, 8, 9, 14}
    missed = [(n, license, scope) for n, (_, license, scope) in enumerate(FILES) if (100 + n, license, scope) not in at]
    assert not missed


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = DOCS + [(100 + n, text) for n, (text, *_) in enumerate(FILES)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert set(con.execute(L.scan_sql()).fetchall()) == {tuple(r) for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_edges_of_input(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License"), (1, "ISC Notice of ours"), (1, "ISC Notice of ours")], "doc_id long, text string")
    known = spark.createDataFrame([("own", "isc notice, of OURS"), ("own", "isc notice, of OURS")], "license string, body string")
    assert sorted(((r["doc_id"], r["license"]) for r in L.scan(df, known=known).collect()), key=str) == sorted([(None, "MIT"), (1, "own"), (1, "own")], key=str)
    assert L.scan(df.limit(0)).count() == 0
    assert L.digests(spark).where("license = 'MIT'").count() > 20
    line = "released under the mit license"
    assert L.digests(spark).where(f"digest = '{hashlib.sha256(line.encode()).hexdigest()}'").count() == 1


def test_more_digests_than_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in DOCS[:5]], "doc_id long, text string")
    expected = {tuple(r) for r in L.scan(df).collect()}
    monkeypatch.setattr(L, "MOST_BROADCAST", 3)
    assert {tuple(r) for r in L.scan(df).collect()} == expected


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [sorted({(r["license"], r["scope"]) for r in rows}) for rows in (lambda got: [[r for r in got if r["doc_id"] == k] for k in range(len(texts))])(L.scan(df, **options).collect())]


def wrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_slots_and_older_forms(spark):
    bsd = "\n\n".join([L.BSD_ITEMS, L.BSD_THIRD, L.BSD_DISCLAIMER])
    acme = bsd.replace("the copyright holder nor", "Acme Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS")
    assert acme.count("REGENTS") == 2
    texts = [acme, *(f"Copyright (c) 2011, Acme Inc.\nAll rights reserved.\n\n{wrapped(acme, w)}" for w in (40, 60, 72, 79)), L.TEXTS["ISC"].replace("and/or", "and"), "code\n\n" + wrapped(L.TEXTS["ISC"].replace("and/or", "and"), 50) + "\n\nmore code"]
    assert found(spark, texts) == [[("BSD-3-Clause", "document")]] * 5 + [[("ISC", "document")], [("ISC", "blocks")]]
    # a slot is no wildcard: another disclaimer is another text
    assert found(spark, [acme.replace("INCIDENTAL", "ACCIDENTAL")]) == [[]]


def test_a_licence_with_a_blank_line_after_each_line(spark):
    import textwrap

    shapes = ("\n\n".join(textwrap.wrap(" ".join(L.TEXTS["MIT"].split()), w, break_long_words=False, break_on_hyphens=False)) for w in range(12, 30))
    narrow = next(x for x in shapes if "\ncopyright" not in x.lower())  # a line that begins so is a copyright line
    assert narrow.count("\n\n") > 45
    assert found(spark, [f"some code\n\n{narrow}\n\nsome more"]) == [[("MIT", "blocks")]]


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence files")
def test_whole_licence_files(spark):
    names = {"Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    names = {k: v for k, v in names.items() if os.path.exists(f"{FOLDER}/{k}")}
    plain = [open(f"{FOLDER}/{k}", encoding="utf-8").read() for k in names]
    commented = ["/*\n" + "".join(f" * {x.strip().upper()}\n" for x in t.split("\n")) + " */" for t in plain]
    assert [(v, "document") in x for x, v in zip(found(spark, plain), names.values())] == [True] * len(names)
    assert [(v, "document") in x for x, v in zip(found(spark, commented), names.values())] == [True] * len(names)
    inside = [f"Notes on this program.\n\n{t}\n\nThe end of the notes." for t in plain]
    assert [{i for i, _ in x} >= {v} for x, v in zip(found(spark, inside), names.values())] == [True] * len(names)
    assert [r["digest"] for r in L.made(spark.createDataFrame([("x", t) for t in plain], "license string, body string")).collect() if r["digest"] in {d for *_, d in L.DIGESTS}] != []
