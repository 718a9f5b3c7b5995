"""The pipeline against its stages done plainly, one after another."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from test_lines import brute as plain_lines  # noqa: E402
from test_similar import plain_classes  # noqa: E402

from docengine.llm import bpe, decontaminate  # noqa: E402

PASSAGE = "\n".join(" ".join(f"shared{i}x{j}" for j in range(20)) for i in range(3))
ITEM = " ".join(f"item{i}" for i in range(30))


def documents():
    unique = lambda k: " ".join(f"word{k}n{i}" for i in range(70))
    return [
        (1, unique(1), "en"), (2, unique(2) + "\n" + PASSAGE, "en"), (3, unique(3) + "\n" + PASSAGE, None), (4, unique(1).replace("word1n3 ", "edited "), "en"), (5, unique(1), "en"),
        (6, f"{unique(6)} {ITEM} end", "en"), (7, "123 456", "en"), (8, None, "en"), (9, unique(9), "de"), (9, unique(9), "de"), (10, "ünder die schöne", "de"), (11, "kurz", "de"),
    ]


def test_pipeline_by_brute_force(spark, tmp_path):
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = [(i, t) for i, t, _ in documents() if t and any(map(str.isalpha, t))]
    docs = list(dict.fromkeys(docs))
    docs = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)) for (i, t), gone in zip(docs, plain_lines(docs))]
    component = plain_classes(docs)
    docs = [(i, t) for i, t in docs if component[i] == i]
    items = decontaminate.Items([1], [ITEM])
    docs = [(i, t) for i, t in docs if not decontaminate.scan_batch(items, [t])[0]]
    encoder = bpe.Encoder(bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), public_tokenizers.PATTERN)
    assert got == {i: encoder.packed([t])[0] for i, t in docs}
    assert {1, 2, 3, 9, 10, 11} <= set(got) and not {4, 6, 7, 8} & set(got)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9, 0.5, "q", 3, 4)], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, pos int, `row` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.collect() == rows.collect()
