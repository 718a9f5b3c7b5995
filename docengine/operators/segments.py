"""An index kept in segments: append, delete, compact and search without a rebuild.

A segment is written once: bags of terms (id, dl, bag), blocks of postings, document frequencies of its terms and, if there
are any, vectors. A deletion writes tombstones: keys of rows with their lengths, and how often each term stood in
them; it reads the bags of the rows concerned, no postings. Compaction merges segments of one size tier, `fan` at a time, without
the deleted rows.

What belongs to the index is said by a manifest, a small table for each version: its segments and batches of tombstones with their
numbers of rows and tokens. A new version is written when its data are there, under a name that must not exist: of two
writers one fails, and readers see whole versions. Statistics (rows, average length, document frequencies) are sums
over segments less those over tombstones, so a search ranks as one over an index built anew.

Ids are unique among live rows: an id that is appended again must be deleted first (`upsert` does both).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import blockmax, fulltext, vectors
from docengine.operators.fulltext import small
from docengine.sources.tables import kept

_MANIFEST = "kind string, name string, rows long, tokens long"


@dataclass
class Manifest:
    """Version, and (rows, tokens) of each segment and each batch of tombstones."""

    version: int = 0
    segments: dict[str, tuple[int, int]] = field(default_factory=dict)
    graves: dict[str, tuple[int, int]] = field(default_factory=dict)


class Segments:
    """The index in a folder (on any file system that Spark knows)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._latest()

    def _latest(self) -> Manifest:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return Manifest()
        every = self.spark.read.schema(f"{_MANIFEST}, version int").json(f"{self.path}/manifest")
        version = every.agg(F.max("version")).first()[0] or 0
        out = Manifest(version)
        for r in every.where(F.col("version") == version).collect():  # a row for each segment and batch
            {"segment": out.segments, "grave": out.graves}.get(r.kind, {})[r.name] = (r.rows, r.tokens)
        return out

    def _commit(self, segments: dict, graves: dict) -> None:
        rows = [("segment", n, *c) for n, c in segments.items()] + [("grave", n, *c) for n, c in graves.items()] or [("none", "", 0, 0)]
        version = self.manifest.version + 1
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/version={version}")
        self.manifest = Manifest(version, segments, graves)

    def table(self, part: str, names=None) -> DataFrame:
        """`part` (bags, blocks, terms, vectors) of the segments, with the column segment; folders of others are not read."""
        names = list(self.manifest.segments if names is None else names)
        frame = self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*[f"{self.path}/{part}/segment={n}" for n in names])
        return frame.withColumn("segment", F.col("segment").cast("string"))

    def graves(self, part: str = "graves") -> DataFrame | None:
        """Tombstones (segment, id, dl) or, of `dead`, how often terms stood in their rows (segment, term, n); None without any."""
        names = list(self.manifest.graves)
        if not names:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{part}/batch={n}" for n in names])
        return rows.where(F.col("segment").isin(list(self.manifest.segments)))

    def live(self, part: str, names=None) -> DataFrame:
        """Rows of `part` (with an id) that are not deleted."""
        rows, gone = self.table(part, names), self.graves()
        return rows if gone is None else rows.join(small(gone.select("segment", "id")), ["segment", "id"], "left_anti")

    def _write(self, bags: DataFrame, vector: DataFrame | None) -> tuple[str, tuple[int, int]]:
        """A segment of bags (id, dl, bag) and vectors (id, embedding): its name, rows and tokens."""
        name = uuid.uuid4().hex
        at = lambda part: f"{self.path}/{part}/segment={name}"
        bags.write.parquet(at("bags"))
        held = self.spark.read.parquet(at("bags"))
        held.select(F.explode("bag.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(at("terms"))
        blockmax.blocks(held, self.spark.read.parquet(at("terms")), "id").repartition("term").sortWithinPartitions("term", "shard", "block").write.parquet(at("blocks"))
        if vector is not None:
            vector.write.parquet(at("vectors"))
        n = held.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return name, (int(n[0]), int(n[1]))

    def append(self, df: DataFrame, id: str = "doc_id", text: str = "text", embed: Column | None = None) -> str:
        """A segment of the rows of df, whose ids no live row has; embed: an expression for their vectors."""
        name, counts = self._write(fulltext.bags(df.select(F.col(id).alias("id"), F.col(text).alias("body")), "id", "body"), None if embed is None else df.select(F.col(id).alias("id"), embed.alias("embedding")))
        self._commit({**self.manifest.segments, name: counts}, self.manifest.graves)
        return name

    def delete(self, ids: DataFrame, id: str = "doc_id") -> int:
        """Tombstones for the live rows among `ids`; their number. Only bags whose ids lie between the least and the largest are read."""
        asked = kept(ids.select(F.col(id).alias("id")).where("id is not null").distinct(), "deleted")
        low, high = asked.agg(F.min("id"), F.max("id")).first()
        if low is None or not self.manifest.segments:
            return 0
        gone = kept(self.live("bags").where(F.col("id").between(low, high)).join(small(asked), "id", "left_semi"), "gone")
        rows, tokens = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if rows:
            name = uuid.uuid4().hex
            gone.select("segment", "id", "dl").write.parquet(f"{self.path}/graves/batch={name}")
            gone.select("segment", F.explode("bag.term").alias("term")).groupBy("segment", "term").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/dead/batch={name}")
            self._commit(self.manifest.segments, {**self.manifest.graves, name: (int(rows), int(tokens))})
        return int(rows)

    def upsert(self, df: DataFrame, id: str = "doc_id", text: str = "text", embed: Column | None = None) -> str:
        self.delete(df, id)
        return self.append(df, id, text, embed)

    def tiers(self, fan: int = 4) -> list[list[str]]:
        """Groups of `fan` or more segments whose numbers of rows have one logarithm to the base `fan`."""
        by: dict[int, list[str]] = {}
        for name, (rows, _) in sorted(self.manifest.segments.items()):
            tier = 0
            while rows >= fan ** (tier + 1):
                tier += 1
            by.setdefault(tier, []).append(name)
        return [names for _, names in sorted(by.items()) if len(names) >= fan]

    def compact(self, fan: int = 4) -> int:
        """Merges the segments of each full tier into one, without deleted rows; the number of merges."""
        merges = self.tiers(fan)
        for names in merges:
            with_vectors = self._has_vectors(names)
            bags = self.live("bags", names).select("id", "dl", "bag")
            merged, counts = self._write(bags, self.live("vectors", names).select("id", "embedding") if with_vectors else None)
            segments = {n: c for n, c in self.manifest.segments.items() if n not in names} | {merged: counts}
            self._commit(segments, self._graves_of(segments))
        return len(merges)

    def _graves_of(self, segments: dict) -> dict:
        """Batches that still concern one of the segments, with what they hold of these."""
        gone = self.graves()
        if gone is None:
            return {}
        rows = self.spark.read.option("basePath", f"{self.path}/graves").parquet(*[f"{self.path}/graves/batch={n}" for n in self.manifest.graves])
        found = rows.where(F.col("segment").isin(list(segments))).groupBy("batch").agg(F.count("*").alias("rows"), F.sum("dl").alias("tokens"))
        return {str(r["batch"]): (int(r["rows"]), int(r["tokens"])) for r in found.collect()}

    def _has_vectors(self, names) -> bool:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = [fs(f"{self.path}/vectors/segment={n}") for n in names]
        return bool(at) and all(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in at)

    def counts(self) -> tuple[int, float]:
        """Live rows and their average number of tokens, from the manifest alone."""
        sums = [sum(c[k] for c in self.manifest.segments.values()) - sum(c[k] for c in self.manifest.graves.values()) for k in (0, 1)]
        return sums[0], sums[1] / sums[0] if sums[0] else 0.0

    def terms(self, wanted: DataFrame | None = None) -> DataFrame:
        """term, df, idf of live rows; wanted: only these terms (term)."""
        rows = self.table("terms").select("term", "df")
        dead = self.graves("dead")
        if dead is not None:
            rows = rows.unionByName(dead.select("term", (-F.col("n")).alias("df")))
        if wanted is not None:
            rows = rows.join(small(wanted), "term", "left_semi")
        n = self.counts()[0]
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").withColumn("idf", fulltext.idf(F.lit(n), F.col("df")))

    def search(self, queries: DataFrame, k: int, id: str = "doc_id", digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score, rank of the k best rows of each query, counters), as `blockmax.search`."""
        wanted = kept(fulltext._wanted(queries), "wanted")
        known = self.terms(kept(wanted.select("term").distinct(), "words"))
        asked = kept(wanted.join(known.select("term", "idf"), "term"), "asked")
        best, counters = blockmax.search(self.table("blocks"), self.table("bags"), asked, self.counts()[1], k, "id", digits, self.graves(), ("segment",))
        return best.withColumnRenamed("id", id), counters

    def nearest(self, queries: DataFrame, k: int, id: str = "doc_id", digits: int | None = None) -> DataFrame:
        """query_id, id, score, rank: the k nearest live vectors of each query (query_id, query_vec)."""
        return vectors.nearest(self.live("vectors").select(F.col("id").alias(id), "embedding"), queries, k, id=id, digits=digits)
