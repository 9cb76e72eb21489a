"""All queries of the engine and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions import text as text_
from turnlake.functions import vectors
from turnlake.functions.sentences import english_sentences
from turnlake.functions.text import sentences, terms, token_count
from turnlake.operators import chunking, heat, judging, memory_ops, metrics, packing, prompting, replay, retrieval
from turnlake.operators.inverted_file import InvertedFile
from turnlake.operators.term_index import TermIndex, hybrid
from turnlake.plans import evaluation
from turnlake.schemas import ROLES, ChunkerConfig
from turnlake.sources import shared, store, transcripts
from turnlake.streaming import ingest, online

#: Chunk sizes that cut the given conversations, whose turns are short, often enough.
SMALL, TINY = 40, 12


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations")


def transcript_all(spark, sf_dir):
    return store.in_order(_turns(spark, sf_dir), "conv_id")


def transcript_recent(spark, sf_dir):
    return store.recent(_read(spark, sf_dir, "events"), 20, "ts", "event_id").select("event_id", "user_id", "event_type")


def transcript_count(spark, sf_dir):
    return store.counted(_turns(spark, sf_dir))


def turn_lookup(spark, sf_dir):
    """Every conversation's opening turn, found by its number."""
    turns = _turns(spark, sf_dir).withColumn("turn_id", store.turn_id(F.col("conv_id"), F.col("turn")))
    wanted = turns.select("conv_id").distinct().select(store.turn_id(F.col("conv_id"), F.lit(0)).alias("turn_id"))
    return turns.join(wanted, "turn_id").select("turn_id", "conv_id", "role", "text")


def role_validation(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n_turns")).withColumn("valid", F.col("role").isin(*ROLES))


def fk_check(spark, sf_dir):
    """Labels with and without their document."""
    known, unknown = store.referenced(_read(spark, sf_dir, "labels"), _read(spark, sf_dir, "documents"), "doc_id")
    rows = known.select("doc_id", F.lit(True).alias("accepted")).unionByName(unknown.select("doc_id", F.lit(False).alias("accepted")))
    return rows


def _roundtrip(markdown: bool):
    parse = transcripts.parse_md if markdown else transcripts.parse_txt

    def query(spark, sf_dir):
        exports = transcripts.rendered(_turns(spark, sf_dir), markdown)
        return exports.select("conv_id", F.posexplode(parse(F.col("content"))).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")

    return query


def token_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).cast("long").alias("n_tokens"))


def sentence_split(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def english_segments(spark, sf_dir):
    """English sentences of every turn: abbreviations, initials, numbers, quotes and lists do not end them."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(english_sentences(F.col("text"))).alias("pos", "sentence"))


def english_chunks(spark, sf_dir):
    chunks = chunking.chunk(_turns(spark, sf_dir), ChunkerConfig(10, SMALL), splitter=english_sentences)
    return chunks.select("conv_id", "turn", "pos", "text", "start_char", "end_char", "token_count")


def chunk_hardsplit(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(chunking.hard_split(F.col("text"), F.lit(TINY))).alias("pos", "piece"))


def chunk_subsplit(spark, sf_dir):
    """Sentences of documents cut at clauses or, where these are too long, between words: pieces and the longest one's tokens."""
    parts = chunking.split_sentences(F.col("text"), F.lit(TINY))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(parts).alias("pos", "piece"))
    return rows.withColumn("n_tokens", token_count(F.col("piece")).cast("long"))


def chunk_merge(spark, sf_dir):
    return chunking.chunk(_turns(spark, sf_dir), ChunkerConfig(10, SMALL)).select("conv_id", "turn", "pos", "text", "start_char", "end_char", "token_count")


def chunk_stats(spark, sf_dir):
    return chunking.chunk_counts(chunking.chunk(_turns(spark, sf_dir), ChunkerConfig(10, SMALL)))


def document_chunks(spark, sf_dir):
    """Whole documents in chunks of the usual size."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    return chunking.chunk(docs).select(F.col("conv_id").alias("doc_id"), "pos", "start_char", "end_char", "token_count", F.md5("text").alias("text_md5"))


def vector_norms(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def _hits(spark, sf_dir, k):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.top_k(rows.where("vec_id % 100 = 0"), rows, k)


def cosine_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 10).select("query_id", "rk", "vec_id", F.round("score", 6).alias("score"))


def hydrate_hits(spark, sf_dir):
    """Hits with their vectors' labels and, where there is one, the document of that number."""
    labels = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").alias("doc_id"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return retrieval.hydrated(_hits(spark, sf_dir, 5), labels, docs, "vec_id", "doc_id").select("query_id", "rk", "vec_id", "label", "source")


def lsh_topk(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.ApproximateIndex(rows).top_k(rows.where("vec_id % 100 = 0"), 10).select("query_id", "rk", "vec_id", F.round("score", 6).alias("score"))


def ann_topk(spark, sf_dir):
    """Ten nearest vectors by an inverted file whose ef is tuned on the table, with what each query read."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = InvertedFile.build(rows, shared.folder(spark, "index"))
    hits = index.search(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10, index.tuned(10), counted=True)
    return hits.select("query_id", "rk", "vec_id", F.round("score", 6).alias("score"), "n_codes", "n_vectors")


def ann_upkeep(spark, sf_dir):
    """An index of the vectors with an even label to which the others are added: each asked vector's own nearest, before and after the lists are rewritten."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    index = InvertedFile.build(rows.where("label % 2 = 0"), shared.folder(spark, "index"))
    index.add(rows)
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    before = shared.written(index.search(asked, 1))
    index.compact()
    after = index.search(asked, 1)
    return before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after"))).select("stage", "query_id", "vec_id", F.round("score", 6).alias("score"))


def add_idempotent(spark, sf_dir):
    """All vectors added to a store that holds those with an even label."""
    rows = _read(spark, sf_dir, "embeddings")
    batch = rows.unionByName(rows).withColumnRenamed("vec_id", "chunk_id")
    return retrieval.new_chunks(batch, rows.where("label % 2 = 0").select(F.col("vec_id").alias("chunk_id"))).select("chunk_id", "label")


def label_assignment(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("kind"))
    held = rows.where("kind % 2 = 0").withColumn("label", F.col("vec_id"))
    return retrieval.labelled(rows.where("kind % 2 = 1"), held, "vec_id").select("vec_id", "label")


def scored_turns(spark, sf_dir):
    return replay.scored_turns(_turns(spark, sf_dir))


def replay_roles(spark, sf_dir):
    return replay.ingested(_turns(spark, sf_dir)).groupBy("conv_id", "role").agg(F.count("*").alias("n_turns"))


def _window(n):
    def query(spark, sf_dir):
        text = F.array_join(F.transform("recent", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n")
        return replay.recent_window(_turns(spark, sf_dir), n).select("conv_id", "turn", F.size("recent").cast("long").alias("n_recent"), F.md5(text).alias("recent_md5"))

    return query


def prior_retrieval(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    hits = replay.prior_retrieval(replay.scored_turns(turns), replay.ingested(turns), 3)
    return hits.select("conv_id", "turn", "rk", "m_turn", F.round("score", 6).alias("score"))


def _numbered(spark, sf_dir):
    """Every turn with a number of its own."""
    return _turns(spark, sf_dir).select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "conv_id", "role", "text")


def _term_hits(spark, sf_dir, k):
    """BM25 over all turns, asked with the user's turns of every hundredth conversation."""
    turns = _numbered(spark, sf_dir)
    index = TermIndex.build(turns, shared.folder(spark, "terms"))
    return index, turns.where("conv_id % 100 = 0 AND role = 'user'").withColumnRenamed("doc_id", "query_id")


def bm25_topk(spark, sf_dir):
    index, asked = _term_hits(spark, sf_dir, 10)
    return index.search(asked, 10).select("query_id", "rk", "doc_id", F.round("score", 6).alias("score"))


def hybrid_candidates(spark, sf_dir):
    """Fifty nearest turns by hashed vectors and fifty best by BM25, united: what a reranker gets."""
    index, asked = _term_hits(spark, sf_dir, 50)
    vector = vectors.hashed(F.coalesce(terms(F.col("text")), F.array().cast("array<string>"))).alias("embedding")
    rows = shared.written(_numbered(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "conv_id", "role", vector))
    near = retrieval.top_k(rows.where("conv_id % 100 = 0 AND role = 'user'"), rows, 50).withColumnRenamed("vec_id", "doc_id")
    found = hybrid(near, index.search(asked, 50))
    return found.select("query_id", "doc_id", "dense_rk", F.round("dense_score", 6).alias("dense_score"), "term_rk", F.round("term_score", 6).alias("term_score"))


def build_prompt(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    asked = replay.scored_turns(turns)
    hits = replay.prior_retrieval(asked, replay.ingested(turns), 3)
    texts = turns.select("conv_id", F.col("turn").alias("m_turn"), F.col("text").alias("hit"))
    found = hits.join(texts, ["conv_id", "m_turn"]).groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "hit"))), lambda x: x["hit"]).alias("hits"))
    rows = asked.join(found, ["conv_id", "turn"], "left").join(replay.recent_window(turns), ["conv_id", "turn"])
    messages = rows.select("conv_id", "turn", prompting.prompt(F.col("user_text"), F.col("hits"), F.col("recent"), "SYSTEM").alias("m"))
    joined = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("> "), x["content"])), "\n")
    return messages.select("conv_id", "turn", F.size("m").cast("long").alias("n_messages"), joined.alias("prompt"))


def _operations(turns):
    """Two operations on memory items for each turn, of all kinds, made of the turns; every tenth turn's quote is missing."""
    size, turn = F.length(F.coalesce("text", F.lit(""))), F.col("turn")
    picks = F.array(*(F.struct(F.lit(seq).alias("seq"), pick.alias("pick"), item.alias("mem_id")) for seq, pick, item in ((0, (size + turn) % 10, (size + turn * 5) % 6), (1, (size * 7 + turn * 3) % 10, (size * 3 + turn) % 6))))
    rows = turns.select(F.col("conv_id").alias("scope"), turn.alias("at"), "text", F.explode(picks).alias("p")).select("scope", "at", "text", "p.*")
    op = F.when(F.col("pick") < 4, "create").when(F.col("pick") < 6, "update").when(F.col("pick") < 8, "supersede").when(F.col("pick") < 9, "pin").otherwise("delete")
    # a sixth of the successors are one that no conversation has
    successor = F.when(F.col("at") % 6 == 5, F.lit(6)).otherwise((F.col("mem_id") + 1 + F.col("at") % 3) % 6)
    return rows.select(
        "scope", "at", F.col("seq").cast("long").alias("seq"), op.alias("op"), F.when(op == "supersede", successor).otherwise(F.col("mem_id")).cast("long").alias("mem_id"),
        F.lit("Decision").alias("kind"), F.concat_ws(":", F.col("at"), F.col("seq"), F.substring("text", 1, 20)).alias("content"), F.when(op == "pin", F.when(F.col("at") % 2 == 0, "user_pinned").otherwise("none")).alias("pin"),
        F.when(op == "supersede", F.col("mem_id")).cast("long").alias("old"), F.array("at").alias("turn_ids"), F.when(F.col("at") % 10 != 9, F.substring("text", 1, 20)).alias("quote"),
    )


def memory_verdicts(spark, sf_dir):
    """What becomes of each operation: ok, or why it is refused."""
    return memory_ops.judged(_operations(_turns(spark, sf_dir))).select(F.col("scope").alias("conv_id"), F.col("at").alias("turn"), "seq", "op", "item", "verdict")


def memory_state(spark, sf_dir):
    """Every memory item as the whole log leaves it, with the end of its chain of supersession."""
    items = memory_ops.heads(memory_ops.state(memory_ops.judged(_operations(_turns(spark, sf_dir)))))
    return items.withColumnRenamed("scope", "conv_id")


def memory_as_of(spark, sf_dir):
    """For every turn how many items were active, pinned, superseded and deleted right after it."""
    turns = _turns(spark, sf_dir)
    held = shared.written(memory_ops.versions(memory_ops.judged(_operations(turns))))
    rows = memory_ops.as_of(held, turns.select(F.col("conv_id").alias("scope"), F.col("turn").alias("at")))
    counts = [F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("active", "superseded", "deleted")]
    return rows.groupBy(F.col("scope").alias("conv_id"), F.col("at").alias("turn")).agg(*counts, F.count_if((F.col("status") == "active") & (F.col("pin") == "user_pinned")).alias("n_pinned"))


def memory_heat(spark, sf_dir):
    """Energy and tier of every item under the operations on it; 97 users share the conversations, and each has five hot items at most."""
    log = _operations(_turns(spark, sf_dir)).where("op <> 'delete'")
    user, hour = F.col("scope") % 97, F.floor(F.col("scope") / 97) * 3 + F.col("at")
    item = F.col("scope") * 8 + F.coalesce("old", "mem_id")
    accesses = log.select(user.alias("scope"), item.alias("item"), hour.alias("at"), F.when(F.col("op") == "pin", 0.5).otherwise(0.3).alias("weight"))
    now = _turns(spark, sf_dir).agg(F.max(F.floor(F.col("conv_id") / 97) * 3 + F.col("turn")).alias("now")).first()["now"] or 0
    return heat.tiers(accesses, 6.0, float(now), 5).select(F.col("scope").alias("user_id"), "item", F.round("energy", 6).alias("energy"), "n_accesses", "tier")


def memory_quotes(spark, sf_dir):
    """Where a quote with other capitals and blanks than the text stands in its turn, and one that stands nowhere."""
    turns = _turns(spark, sf_dir).withColumnRenamed("conv_id", "scope")
    letters = "abcdefghijklmnopqrstuvwxyz"
    said = F.regexp_replace(F.translate(F.substring("text", 11, 30), letters, letters.upper()), " ", " \n ")
    log = turns.select("scope", F.array("turn").alias("turn_ids"), F.explode(F.array(said, F.concat(said, F.lit("#")))).alias("quote"), F.col("turn").alias("at"))
    return memory_ops.quoted(log, turns).select(F.col("scope").alias("conv_id"), F.col("at").alias("turn"), F.col("quote").endswith("#").alias("altered"), "first", "last")


def context_packing(spark, sf_dir):
    """Each scored turn's prompt under small budgets: its hits as header, the turns before it, the sentences of its best hit."""
    turns = _turns(spark, sf_dir)
    asked = replay.scored_turns(turns)
    item = lambda x: F.struct(token_count(x).alias("n"), x.alias("text"))
    texts = turns.select("conv_id", F.col("turn").alias("m_turn"), F.col("text").alias("hit"))
    hits = replay.prior_retrieval(asked, replay.ingested(turns), 5).join(texts, ["conv_id", "m_turn"])
    found = hits.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "hit"))), lambda x: x["hit"]).alias("hits"))
    rows = asked.select("conv_id", "turn").join(found, ["conv_id", "turn"], "left").join(replay.recent_window(turns, 8), ["conv_id", "turn"])
    best = sentences(F.get("hits", 0))
    packed = packing.context(F.transform("hits", item), F.transform("recent", lambda r: item(r["text"])), F.transform(best, item), packing.Budgets(90, 60, 15))
    rows = rows.select("conv_id", "turn", packed.alias("c"))
    parts = ("header", "recent", "snippets")
    size = lambda p: F.coalesce(packing.tokens(F.col(f"c.{p}")), F.lit(0))
    text = lambda p: F.coalesce(F.md5(F.array_join(F.transform(F.col(f"c.{p}"), lambda x: x["text"]), "|")), F.md5(F.lit("")))
    return rows.select("conv_id", "turn", *(size(p).alias(f"{p}_tokens") for p in parts), *(text(p).alias(f"{p}_md5") for p in parts))


def _answers(turns):
    """Judges' answers of all kinds, made of the turns."""
    kind = F.col("turn") % 6
    good = lambda score: F.concat(F.lit('{"score": '), score, F.lit(', "reasoning": "fine"}'))
    answer = (
        F.when(kind == 0, good((F.col("conv_id") % 9).cast("string")))
        .when(kind == 1, F.lit('{"reasoning": "fine"}'))
        .when(kind == 2, F.concat(good(F.lit("4")), F.lit(" and more")))
        .when(kind == 3, F.lit("{'score': 4}"))
        .when(kind == 4, F.lit('{"score": null}'))
        .otherwise(F.substring(F.regexp_replace("text", r"[^A-Za-z .]", ""), 1, 300))
    )
    return turns.withColumn("answer", answer)


def judge_parse(spark, sf_dir):
    rows = _answers(_turns(spark, sf_dir)).withColumn("j", judging.parsed(F.col("answer")))
    return rows.select("conv_id", "turn", "j.score", "j.reasoning")


def _proxy(turns):
    """Scores 1 to 5 that follow from the texts' lengths."""
    return replay.scored_turns(turns).select("conv_id", "turn", (F.length("user_text") % 5 + 1).alias("score"))


def conversation_scores(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    rows = metrics.conversation_scores(turns, _proxy(turns))
    return rows.select("conv_id", "num_turns", "n_scored", F.round("mean_score", 6).alias("mean_score"), F.array_join("scores_by_position", ",").alias("scores_by_position"))


def run_metrics(spark, sf_dir):
    rows = metrics.run_metrics(_proxy(_turns(spark, sf_dir)))
    return rows.select("n_scored", F.round("mean_score", 6).alias("mean_score"), F.round("recall_at_4", 6).alias("recall_at_4"))


def _proxy_board(spark, sf_dir):
    """The default configurations, scored as if a wider search found more."""
    table = evaluation.config_table(spark, evaluation.sweep_configs())
    asked = replay.scored_turns(_turns(spark, sf_dir)).select(F.length("user_text").alias("n"))
    scores = asked.join(F.broadcast(table.select("config_idx", "k", "max_tokens"))).select("config_idx", F.least(F.lit(5), (F.col("n") + F.col("k") * F.col("max_tokens") / 100).cast("int") % 5 + 1).alias("score"))
    return evaluation.leaderboard(table.join(metrics.run_metrics(scores, ["config_idx"]), "config_idx"))


def sweep_leaderboard(spark, sf_dir):
    board = _proxy_board(spark, sf_dir)
    return board.select("place", "config_idx", "min_tokens", "max_tokens", "k", "ef_search", "n_scored", F.round("mean_score", 6).alias("mean_score"), F.round("recall_at_4", 6).alias("recall_at_4"))


def best_config(spark, sf_dir):
    return _proxy_board(spark, sf_dir).where("is_best").select("config_idx", "min_tokens", "max_tokens", "k", "ef_search")


def replay_eval(spark, sf_dir):
    """The whole evaluation with the default responder and judge."""
    results, _, _ = evaluation.run_eval(_turns(spark, sf_dir))
    return results.select("conv_id", "turn", "score", F.size("retrieved").cast("long").alias("n_retrieved"), F.md5("reply").alias("reply_md5"))


def replay_sweep(spark, sf_dir):
    """A grid of eight configurations over all conversations."""
    grid = evaluation.sweep_configs(chunker_grid={"min_tokens": [10], "max_tokens": [20, SMALL]}, retrieval_grid={"k": [1, 5], "ef_search": [50, 100]})
    board = evaluation.run_sweep(_turns(spark, sf_dir), grid)
    return board.select("place", "config_idx", "max_tokens", "k", "ef_search", "n_scored", F.round("mean_score", 6).alias("mean_score"), F.round("recall_at_4", 6).alias("recall_at_4"), "is_best")


def default_sweep(spark, sf_dir):
    """The default grid of 54 configurations, replayed over all conversations."""
    board = evaluation.run_sweep(_turns(spark, sf_dir), evaluation.sweep_configs())
    return board.select("place", "config_idx", "min_tokens", "max_tokens", "k", "ef_search", "n_scored", F.round("mean_score", 6).alias("mean_score"), F.round("recall_at_4", 6).alias("recall_at_4"), "is_best")


def first_conversations(spark, sf_dir):
    """The turns of the ten first conversations: a limit that is the feature."""
    return replay.first_conversations(_turns(spark, sf_dir), 10).select("conv_id", "turn", "role")


def term_weights(spark, sf_dir):
    """Lexical weights of every turn, a row for each term."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode(text_.term_weights(F.col("text"))).alias("term", "weight")).withColumn("weight", F.round("weight", 6))


def truncate_results(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents")
    text, hits = replay.truncated(F.col("text"), sentences(F.col("text")))
    return rows.select("doc_id", text.alias("head"), F.array_join(hits, "\n").alias("first_five"))


def ingest_counters(spark, sf_dir):
    """Turns and chunks of each conversation and, in a row without conv_id, of all."""
    turns = _turns(spark, sf_dir)
    chunks = chunking.chunk(turns, ChunkerConfig(10, SMALL)).groupBy("conv_id").agg(F.count("*").alias("n_chunks"))
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")).join(chunks, "conv_id", "left").fillna(0, ["n_chunks"])
    return rows.rollup("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_chunks").alias("n_chunks"))


def stream_chunks(spark, sf_dir):
    """Conversations read as a stream, each turn once, chunked and landed batch by batch."""
    path = f"{sf_dir}/conversations.parquet"
    turns = ingest.read_turns(spark, path, spark.read.parquet(path).schema)
    out = shared.folder(spark, "stream")
    ingest.chunk_stream(ingest.deduplicated(turns), f"{out}/chunks", f"{out}/state", ChunkerConfig(10, SMALL)).awaitTermination()
    return ingest.landed(spark, f"{out}/chunks").select("conv_id", "turn", "pos", "token_count")


def online_replay(spark, sf_dir):
    """What was known before each turn and which question it answers, found turn by turn on a stream of conversations."""
    path = f"{sf_dir}/conversations.parquet"
    turns = ingest.read_turns(spark, path, spark.read.parquet(path).schema)
    out = shared.folder(spark, "online")
    online.replay_stream(turns, f"{out}/turns", f"{out}/state").awaitTermination()
    said = F.transform("recent", lambda r: F.concat(r["role"], F.lit(":"), F.coalesce(r["text"], F.lit(""))))
    rows = spark.read.parquet(f"{out}/turns")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.size("recent").cast("long").alias("n_recent"), F.md5(F.array_join(said, "|")).alias("recent_md5"), F.md5("asked").alias("asked_md5"))


def event_windows(spark, sf_dir):
    found = ingest.activity(_read(spark, sf_dir, "events"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n_events", F.round("value", 4).alias("value"))


def role_adjacency(spark, sf_dir):
    """How often which role follows which."""
    order = W.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, sf_dir).withColumn("next_role", F.lead("role").over(order)).groupBy("role", "next_role").agg(F.count("*").alias("n"))


def queries() -> dict:
    plain = (transcript_all, transcript_recent, transcript_count, turn_lookup, role_validation, fk_check, token_counts, sentence_split, english_segments, english_chunks, chunk_hardsplit, chunk_subsplit, chunk_merge, chunk_stats, document_chunks)
    plain += (vector_norms, cosine_topk, hydrate_hits, lsh_topk, ann_topk, ann_upkeep, add_idempotent, label_assignment, scored_turns, replay_roles, prior_retrieval, bm25_topk, hybrid_candidates, build_prompt, judge_parse, conversation_scores, run_metrics)
    plain += (sweep_leaderboard, best_config, replay_eval, replay_sweep, default_sweep, first_conversations, term_weights, memory_verdicts, memory_state, memory_as_of, memory_heat, memory_quotes, context_packing, truncate_results, ingest_counters, stream_chunks, online_replay, event_windows, role_adjacency)
    found = {f.__name__: f for f in plain}
    return found | {"parse_txt_roundtrip": _roundtrip(False), "parse_md_roundtrip": _roundtrip(True), "recent_window_4": _window(4), "recent_window_all": _window(0)}


def oracle_sql() -> dict:
    from turnlake.oracles import SQL

    return dict(SQL)
