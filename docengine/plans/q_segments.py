"""Queries over an index kept in segments: what it ranks after appends, deletions and compaction, as if built anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docengine.operators.segments import Segments
from docengine.plans.q_search import BM25, SCORE, TOKENS, _asked
from docengine.plans.registry import query, table
from docengine.plans.search import hashed_embedding
from docengine.sources.tables import shared_folder


def new_index(spark, name: str) -> Segments:
    return Segments(spark, f"{shared_folder(spark)}/index-{name}-{uuid.uuid4().hex}")


def _ranking(rows: str) -> str:
    base = BM25.replace("FROM documents", f"FROM ({rows})")
    return f"""WITH {base}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
    scores AS (SELECT query_id, doc_id, {SCORE} AS score FROM postings JOIN q USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scores WHERE score > 0) WHERE rank < 10"""


_TEXTS = "SELECT * FROM documents WHERE text IS NOT NULL"
_LEFT = f"{_TEXTS} AND coalesce(source, '') NOT IN ('src1', 'src2')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


def _ranked(index: Segments, spark, sf_dir):
    return index.search(_asked(spark, sf_dir), 10, digits=6)[0].select("query_id", "doc_id", "score", "rank")


@query("fts3_top1_block_max", _ranking(_TEXTS))
def block_max(spark, sf_dir):
    """Each benchmark item over blocks of postings, those left out that can't reach the tenth score."""
    index = new_index(spark, "blocks")
    index.append(_docs(spark, sf_dir))
    return _ranked(index, spark, sf_dir)


@query("hyb5_append", _ranking(_TEXTS))
def append(spark, sf_dir):
    """Documents in three appended segments rank as in one."""
    index, docs = new_index(spark, "append"), _docs(spark, sf_dir)
    for part in range(3):
        index.append(docs.where(F.pmod("doc_id", F.lit(3)) == part))
    return _ranked(index, spark, sf_dir)


def _deleted(spark, sf_dir) -> Segments:
    index, docs = new_index(spark, "delete"), _docs(spark, sf_dir)
    for part in range(2):
        index.append(docs.where(F.pmod("doc_id", F.lit(2)) == part), embed=hashed_embedding(F.col("text")))
    index.delete(docs.where("source = 'src1'"))
    index.delete(docs.where("source = 'src2'"))
    return index


@query("vec5_delete", _ranking(_LEFT))
def delete(spark, sf_dir):
    """After the documents of two sources were deleted: tombstones alone, the ranking is that without them."""
    return _ranked(_deleted(spark, sf_dir), spark, sf_dir)


@query("vec5_compact", _ranking(_LEFT))
def compact(spark, sf_dir):
    """After compaction."""
    index = _deleted(spark, sf_dir)
    index.compact(2)
    return _ranked(index, spark, sf_dir)


@query("fts5_upsert", _ranking("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed ' || text ELSE text END AS text FROM documents WHERE text IS NOT NULL"))
def upsert(spark, sf_dir):
    """A fifth of the documents changed: the old rows count no more."""
    index, docs = new_index(spark, "upsert"), _docs(spark, sf_dir)
    index.append(docs)
    index.upsert(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("changed "), "text")))
    return _ranked(index, spark, sf_dir)


@query("hyb5_segment_terms", f"WITH {BM25.replace('FROM documents', f'FROM ({_LEFT})')} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM terms, stats")
def segment_terms(spark, sf_dir):
    """Document frequencies and weights after deletions: sums over segments less those of the dead."""
    return _deleted(spark, sf_dir).terms().select("term", "df", F.round("idf", 9).alias("idf"))


@query("vec5_live_vectors", f"SELECT doc_id, 32 AS dim FROM ({_LEFT})")
def live_vectors(spark, sf_dir):
    """Vectors that are left after deletions and compaction."""
    index = _deleted(spark, sf_dir)
    index.compact(2)
    return index.live("vectors").select(F.col("id").alias("doc_id"), F.size("embedding").alias("dim"))
