"""Hybrid retrieval over an archive: BM25 and latent vectors, fused with entity overlap and reliability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab
from foliant.operators import inverted, lexical, vector


class Retriever:
    """Searches chunks.  Without vectors, or when they fail, the lexical order stands alone and ``vector`` is no channel.

    With a stored ``index`` no text is read to rank chunks; without one, all are."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, space: DataFrame | None = None, weights=vocab.FUSION, index: inverted.Index | None = None):
        self.chunks = chunks.withColumn("reliability", C.reliability(F.col("source_class")))
        self.vectors, self.weights, self.failure = vectors, weights, None
        rows = space.orderBy("term").collect() if space is not None else []  # a vocabulary's cap of rows
        self.stored = index
        self.index = {r.term: k for k, r in enumerate(rows)}
        self.idf = np.array([r.idf for r in rows])
        self.parts = np.array([r.component for r in rows])

    @property
    def semantic(self) -> bool:
        return self.vectors is not None and bool(self.index)

    def _lexical(self, asked: list[tuple[int, str]], depth: int) -> DataFrame:
        spark = self.chunks.sparkSession
        rows, phrases = [], []
        for query, text in asked:
            terms, joint = lexical.query_terms(text)
            rows += [(query, t) for t in terms]
            phrases += [(query, p) for p in joint]
        terms = spark.createDataFrame(rows, "query_id bigint, term string")
        stored = self.stored
        if stored is not None and not phrases:
            pool = stored.top(terms, vocab.POOL * depth).withColumnRenamed("key", "chunk_id")
            return lexical.reranked(pool, self.chunks.select("chunk_id", "reliability"), depth)
        scored = lexical.bm25(self.chunks, terms) if stored is None else stored.scores(terms).withColumnRenamed("key", "chunk_id")
        for query, words in phrases:  # a hyphenated term also finds its parts side by side
            found = lexical.phrase(self.chunks, words) if stored is None else stored.phrase(words).withColumnRenamed("key", "chunk_id")
            found = found.select(F.lit(query).cast("bigint").alias("query_id"), "chunk_id", F.col("hits").cast("double").alias("score"))
            scored = scored.unionByName(found).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
        return lexical.reranked(lexical.top(scored, vocab.POOL * depth), self.chunks.select("chunk_id", "reliability"), depth)

    def _semantic(self, asked: list[tuple[int, str]], depth: int) -> DataFrame | None:
        if not self.semantic:
            return None
        try:
            points = vector.embed([text for _, text in asked], self.index, self.idf, self.parts)
            known = [(query, p.tolist()) for (query, _), p in zip(asked, points, strict=True) if p.any()]
            if not known:
                return None
            return vector.cosine_topk(self.vectors, self.chunks.sparkSession.createDataFrame(known, "query_id bigint, embedding array<double>"), depth, "chunk_id")
        except Exception as e:  # vectors add recall; losing them must not lose the search
            self.failure = f"{type(e).__name__}: {e}"
            return None

    def search(self, asked: list[tuple[int, str]], limit: int = 8, names: list[str] | dict[int, list[str]] = [], mode: str = "hybrid") -> DataFrame:  # noqa: B006
        """query_id, rank, chunk_id, score, channels and the chunk's columns, of queries (id, text); mode: hybrid, keyword or vector.

        ``names`` of entities, of all queries or by query, raise chunks that mention them."""
        words = self._lexical(asked, vocab.DEPTH if mode == "hybrid" else limit).select("query_id", "chunk_id", F.col("blend").alias("norm")) if mode != "vector" else None
        near = self._semantic(asked, vocab.DEPTH if mode == "hybrid" else limit) if mode != "keyword" else None
        empty = self.chunks.sparkSession.createDataFrame([], "query_id bigint, chunk_id string, cosine double, norm double")
        words = empty.select("query_id", "chunk_id", "norm") if words is None else words
        near = empty.select("query_id", "chunk_id", "cosine") if near is None else near
        own = names if isinstance(names, dict) else {query: names for query, _ in asked}
        named = self.chunks.sparkSession.createDataFrame([(query, [n.lower() for n in of]) for query, of in own.items() if of], "query_id bigint, names array<string>")
        parts = vector.candidates(words, near, self.chunks.select("chunk_id", "reliability", F.lower("content").alias("low")), "chunk_id").join(F.broadcast(named), "query_id", "left")
        share = F.size(F.filter("names", lambda n: F.contains(F.col("low"), n))) / F.size("names")
        hits = lexical.top(vector.blended(parts.withColumn("entity_overlap", F.when(F.size("names") > 0, share).otherwise(0.0)), "chunk_id", self.weights), limit)
        return hits.join(self.chunks, "chunk_id")


def of(archive, weights=vocab.FUSION) -> Retriever:
    """A retriever over the newest version of an archive."""
    return Retriever(archive.table("chunks"), archive.table("vectors"), archive.table("vector_space"), weights, archive.index())
