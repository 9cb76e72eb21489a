"""The engine as one object: ingest turns, search chunks, read the transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.sentences import english_sentences
from turnlake.functions.text import terms
from turnlake.operators import chunking, replay, retrieval
from turnlake.operators.inverted_file import InvertedFile
from turnlake.operators.term_index import TermIndex, hybrid
from turnlake.schemas import ChunkerConfig
from turnlake.sources import store
from turnlake.sources.shared import exists, written


#: Queries with at most so many terms together go to the chunks; those of more meet them by a shuffle on terms.
FEW_TERMS = 100_000


class Memory:
    """A store with its chunker and, if given, an encoder of texts.

    encoder: (function without arguments that builds the encoder, vector size).
    With an encoder search() compares vectors; without one it compares terms.
    lexical: a text's column to a map of terms and weights, kept with each chunk.
    splitter: a text's column to its sentences.
    Turns and chunks are on disk when a call returns. rebuild_index() and
    rebuild_terms() derive an index of vectors and one of terms from them and save
    it; from then on ingest() files new chunks in it, so that they are found at once,
    and later sessions find it again.
    """

    def __init__(self, spark: SparkSession, path: str, config: ChunkerConfig = ChunkerConfig(), encoder=None, lexical=None, splitter=english_sentences):
        self.store, self.config, self.encoder, self.lexical, self.splitter = store.Store(spark, path), config, encoder, lexical, splitter

    def __enter__(self) -> Memory:
        return self

    def __exit__(self, *ended) -> None:
        self.close()

    def close(self) -> None:
        pass

    @property
    def transcript(self) -> DataFrame:
        return self.store.turns

    def ingest(self, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stores turns (conv_id, turn, role, text) and their chunks; returns what was new of both."""
        fresh = self.store.append_turns(turns)
        chunks = chunking.chunk(fresh, self.config, splitter=self.splitter).withColumn("turn_id", store.turn_id(F.col("conv_id"), F.col("turn")))
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        chunks = chunks.withColumn("lexical_weights", (self.lexical(F.col("text")) if self.lexical else F.lit(None)).cast("map<string,double>"))
        if self.encoder:
            chunks = retrieval.embed(chunks, *self.encoder)
        added = self.store.append_chunks(chunks)
        if index := self.index():
            index.add(added.select("chunk_id", "embedding"))
        if index := self.term_index():
            index.add(added.select("chunk_id", "text"))
        return fresh, added

    def search(self, queries: DataFrame, k: int = 10, index: InvertedFile | None = None, ef_search: int = 50) -> DataFrame:
        """query_id, rk, score and the chunk's and turn's columns for queries (query_id, text); over all conversations.

        With an index vectors are searched there, in the lists of the ef_search nearest centroids.
        Without an encoder a saved index of terms answers by BM25; where there is none, the cosine of terms is taken over all chunks.
        """
        chunks = self.store.chunks
        turns = self.transcript.select("turn_id", "role", F.col("text").alias("turn_text"), "created_at")
        if self.encoder:
            # written, so that each text is encoded once
            asked = written(retrieval.embed(queries, *self.encoder).select("query_id", "embedding"))
            if index:
                hits = index.search(asked, k, ef_search)
            else:
                held = self.vectors().withColumnRenamed("chunk_id", "vec_id")
                hits = retrieval.top_k(asked.withColumnRenamed("query_id", "vec_id"), held, k).withColumnRenamed("vec_id", "chunk_id")
            return retrieval.hydrated(hits, chunks, turns, "chunk_id")
        if terms_ := self.term_index():
            return retrieval.hydrated(terms_.search(queries, k), chunks, turns, "chunk_id")
        # terms: one scope for all, and every chunk is earlier than every query
        asked = queries.select(F.lit(0).alias("conv_id"), F.col("query_id").alias("turn"), F.col("text").alias("user_text"))
        held = chunks.select(F.lit(0).alias("conv_id"), F.lit(-(2**62)).alias("turn"), "chunk_id", "text")
        few = asked.select(F.explode(terms(F.col("user_text")))).limit(FEW_TERMS + 1).count() <= FEW_TERMS
        hits = replay.prior_retrieval(asked.withColumn("turn", F.col("turn").cast("long")), held, k, ("turn", "chunk_id"), few)
        hits = hits.select(F.col("turn").alias("query_id"), "rk", F.col("m_chunk_id").alias("chunk_id"), "score")
        return retrieval.hydrated(hits, chunks, turns, "chunk_id")

    def candidates(self, queries: DataFrame, n: int = 100, ef_search: int = 50) -> DataFrame:
        """query_id, chunk_id and the place and score of all chunks that are among the n best by vectors or by terms; needs an encoder and both saved indexes."""
        asked = written(retrieval.embed(queries, *self.encoder).select("query_id", "text", "embedding"))
        return hybrid(self.index().search(asked, n, ef_search), self.term_index().search(asked, n), "chunk_id")

    def vectors(self) -> DataFrame:
        """All stored vectors."""
        return self.store.chunks.where("embedding IS NOT NULL").select("chunk_id", "embedding")

    def rebuild_index(self, lists: int | None = None, parts: int = 16) -> InvertedFile:
        """An index of all stored vectors, fitted anew and saved with the store in place of an older one."""
        return InvertedFile.build(self.vectors(), self._index_path(), "chunk_id", lists, parts)

    def index(self) -> InvertedFile | None:
        """The saved index; None if none was built."""
        found = exists(self.store.spark, f"{self._index_path()}/base")
        return InvertedFile(self.store.spark, self._index_path(), "chunk_id") if found else None

    def rebuild_terms(self) -> TermIndex:
        """An index of the terms of all stored chunks, saved with the store in place of an older one."""
        return TermIndex.build(self.store.chunks.select("chunk_id", "text"), f"{self.store.path}/terms", "chunk_id")

    def term_index(self) -> TermIndex | None:
        """The saved index of terms; None if none was built."""
        found = exists(self.store.spark, f"{self.store.path}/terms/base/postings/_SUCCESS")
        return TermIndex(self.store.spark, f"{self.store.path}/terms", "chunk_id") if found else None

    def _index_path(self) -> str:
        return f"{self.store.path}/index"
