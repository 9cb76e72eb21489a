import json

from pyspark.sql import functions as F

from turnlake.functions.text import term_weights
from turnlake.operators import judging, metrics, prompting, replay
from turnlake.plans import evaluation
from turnlake.plans.engine import Memory
from turnlake.schemas import ChunkerConfig, EvalConfig, RetrievalConfig
from turnlake.streaming import ingest

SCHEMA = "conv_id long, turn long, role string, text string"


def talk(spark, *rows, conv=1):
    return spark.createDataFrame([(conv, i, r, t) for i, (r, t) in enumerate(rows)], SCHEMA)


def test_scored_turns(spark):
    rows = talk(spark, ("assistant", "hi"), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("system", "s"), ("user", "q3"), ("assistant", ""), ("user", "q4"))
    assert [r["turn"] for r in replay.scored_turns(rows).collect()] == [1]
    assert {r["role"] for r in replay.ingested(rows).collect()} == {"user", "assistant"}


def test_recent_window(spark):
    rows = talk(spark, ("user", "a"), ("system", "b"), ("user", "c"), ("user", "d"))
    last = lambda n: [x["text"] for x in replay.recent_window(rows, n).where("turn = 3").first()["recent"]]
    assert last(2) == ["b", "c"] and last(0) == ["a", "b", "c"]


def test_only_earlier_turns_are_found(spark):
    rows = talk(spark, ("user", "apple pie"), ("assistant", "x"), ("user", "apple pie"), ("assistant", "apple"))
    hits = replay.prior_retrieval(replay.scored_turns(rows), rows, 5).collect()
    assert [(h["turn"], h["m_turn"], h["rk"]) for h in hits] == [(2, 0, 1)] and abs(hits[0]["score"] - 1) < 1e-9


def test_prompt_lengths(spark):
    recent = F.array(F.struct(F.lit("user").alias("role"), F.lit("t").alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit("u").alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    empty, one = F.array().cast("array<string>"), F.array(F.lit("m"))
    got = spark.range(1).select(*(prompting.prompt(F.lit("q"), h, r).alias(n) for n, h, r in (("a", empty, none), ("b", one, none), ("c", empty, recent)))).first()
    assert [len(got[x]) for x in "abc"] == [2, 3, 4]
    assert got["b"][1]["content"] == "Relevant memory context:\n[Memory 1]: m"


def test_judge(spark):
    answers = ['{"score": 4, "reasoning": "r"}', '{"score": 10}', '{"score": -3}', "not valid json", '{"score": null}', "[1]", "{'score': 4}", '{"score": "5"}', None, "{}"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", judging.parsed(F.col("a")).alias("j")).orderBy("i").collect()
    assert [r["j"]["score"] for r in rows] == [4, 5, 1, 1, 1, 1, 1, 5, 1, 1]
    assert rows[3]["j"]["reasoning"] == "Failed to parse judge response: not valid json" and rows[0]["j"]["reasoning"] == "r"


def test_metrics(spark):
    turns = talk(spark, ("user", "a"), ("assistant", "b")).unionByName(talk(spark, ("system", "x"), conv=2))
    scores = spark.createDataFrame([(1, 2, 5), (1, 0, 2)], "conv_id long, turn long, score int")
    rows = {r["conv_id"]: r for r in metrics.conversation_scores(turns, scores).collect()}
    assert rows[1]["scores_by_position"] == [2, 5] and rows[1]["mean_score"] == 3.5 and rows[1]["num_turns"] == 2
    assert rows[2]["mean_score"] == 0.0 and rows[2]["scores_by_position"] == []
    assert tuple(metrics.run_metrics(scores).first()) == (2, 3.5, 0.5)
    assert tuple(metrics.run_metrics(scores.where("false")).first()) == (0, 0.0, 0.0)


def test_configs():
    assert len(evaluation.sweep_configs()) == 54
    assert len(evaluation.sweep_configs(chunker_grid={"min_tokens": [100], "max_tokens": [200]}, retrieval_grid={"k": [5], "ef_search": [50]})) == 1
    assert evaluation.sweep_configs(chunker_grid={"min_tokens": [300], "max_tokens": [200]}) == []
    only = evaluation.sweep_configs(chunker_grid={"min_tokens": [100]}, retrieval_grid={"k": [3]})
    assert [(c.chunker.max_tokens, c.retrieval.ef_search) for c in only] == [(250, 50)]


def test_first_of_equal_runs_is_best(spark):
    runs = spark.createDataFrame([(0, 1, 9, 1, 1, 3.0), (1, 2, 9, 1, 1, 4.0), (2, 3, 9, 1, 1, 4.0)], "config_idx int, min_tokens int, max_tokens int, k int, ef_search int, mean_score double")
    rows = evaluation.leaderboard(runs).orderBy("place").collect()
    assert [r["config_idx"] for r in rows] == [1, 2, 0] and [r["is_best"] for r in rows] == [True, False, False]


def test_run_and_sweep(spark, tmp_path):
    rows = talk(spark, ("user", "I like green tea"), ("assistant", "Noted: green tea."), ("user", "Which tea do I like?"), ("assistant", "You like green tea")).unionByName(talk(spark, ("system", "x"), conv=2))
    config = EvalConfig(ChunkerConfig(1, 50))
    results, conversations, run = evaluation.run_eval(rows, config)
    assert results.count() == 2 and conversations.where("conv_id = 1").first()["num_turns"] == 4 and run.first()["n_scored"] == 2
    board = evaluation.run_sweep(rows, evaluation.sweep_configs(chunker_grid={"min_tokens": [1], "max_tokens": [20, 50]}, retrieval_grid={"k": [1, 2]}))
    text = evaluation.report(board)
    assert board.count() == 4 and "*" in text and text.splitlines()[-1].startswith("Best: chunks of 1 to ")
    assert spark.read.json(evaluation.save_sweep(board, str(tmp_path))).count() == 4
    lines = [json.loads(r["value"]) for r in spark.read.text(evaluation.save_run(results, conversations, run, config, str(tmp_path))).collect()]
    saved = {x.get("conv_id"): json.loads(x["result"]) for x in lines}
    assert set(saved) == {None, "1", "2"} and saved[None]["n_scored"] == 2 and "run_timestamp" in saved[None]
    assert [t["turn"] for t in saved["1"]["turn_results"]] == [0, 2] and saved["1"]["turn_results"][1]["user_text"] == "Which tea do I like?"
    assert saved["2"]["num_turns"] == 1 and not saved["2"].get("turn_results")
    assert json.loads(lines[0]["config"])["chunker"]["max_tokens"] == 50
    told = list(evaluation.summary(conversations, run, config))
    assert told[1].startswith("Mean score") and told[2].startswith("  1: ") and told[3] == "  2: 0.00 (0 of 1 turns scored)"
    assert evaluation.report(evaluation.run_sweep(rows, [])) == "Nothing was run."


def models():
    """(encoder, responder, judge): stand-ins that travel to the workers by value."""

    def letters():
        return lambda texts: [[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    def parrot():
        """Says how many messages it got, and the first memory."""
        return lambda messages: f"  {len(messages)} {[m['content'] for m in messages if 'Memory 1' in m['content']]}  "

    def strict():
        """Gives 4 if the reply tells of five messages, and talks nonsense of others."""
        return lambda messages: '{"score": 4, "reasoning": "five"}' if messages[1]["content"].split("Reply to score:\n")[1].startswith("5 ") else "well"

    return (letters, 26), parrot, strict


def test_models_are_parameters(spark):
    rows = talk(spark, ("user", "abc abc"), ("assistant", "zzz"), ("user", "abc"), ("assistant", "abc"), ("user", "zz"), ("assistant", "ok"))
    results, conversations, run = evaluation.run_eval(rows, EvalConfig(ChunkerConfig(1, 50), RetrievalConfig(1, 50), recent_window=2), *models())
    found = {r["turn"]: r for r in results.collect()}
    assert found[0]["reply"] == "2 []" and found[0]["score"] == 1 and found[0]["reasoning"].startswith("Failed to parse") and found[0]["retrieved"] == []
    assert found[2]["reply"].startswith("5 ") and found[2]["retrieved"] == ["abc abc"] and found[2]["score"] == 4 and found[2]["reasoning"] == "five"
    assert found[4]["retrieved"] == ["zzz"]
    assert conversations.first()["scores_by_position"] == [1, 4, 4] and run.first()["mean_score"] == 3.0
    board = evaluation.run_sweep(rows, evaluation.sweep_configs(EvalConfig(recent_window=2), {"min_tokens": [1], "max_tokens": [50]}, {"k": [1, 2]}), *models())
    assert [r["mean_score"] for r in board.orderBy("place").collect()] == [3.0, 3.0]


def test_no_more_conversations_than_asked_for(spark):
    rows = talk(spark, ("user", "a"), ("assistant", "a"), conv=3).unionByName(talk(spark, ("user", "b"), ("assistant", "b"), conv=1)).unionByName(talk(spark, ("user", "c"), ("assistant", "c"), conv=2))
    ids = lambda n: {r["conv_id"] for r in evaluation.run_eval(rows, EvalConfig(max_conversations=n))[1].collect()}
    assert ids(2) == {1, 2} and ids(0) == ids(None) == {1, 2, 3}


def test_memory(spark, tmp_path):
    rows = talk(spark, ("user", "My name is Ada."), ("assistant", "Nice to meet you."), ("user", "The weather is fine."))
    asked = spark.createDataFrame([(7, "what is my name")], "query_id long, text string")
    with Memory(spark, str(tmp_path / "m"), lexical=term_weights) as memory:
        assert [x.count() for x in memory.ingest(rows)] == [3, 3]
        assert [x.count() for x in memory.ingest(rows)] == [0, 0]
        found = memory.search(asked, 2).orderBy("rk").first()
        assert "Ada" in found["text"] and found["lexical_weights"] == {"my": 0.25, "name": 0.25, "is": 0.25, "ada": 0.25}
    with Memory(spark, str(tmp_path / "v"), encoder=models()[0]) as memory:
        assert memory.search(asked, 2).count() == 0 and memory.index() is None
        memory.ingest(rows)
        found = memory.search(asked, 2).orderBy("rk").collect()
        assert len(found) == 2 and found[0]["score"] >= found[1]["score"] and memory.vectors().count() == 3
        memory.rebuild_index()
    with Memory(spark, str(tmp_path / "v"), encoder=models()[0]) as memory:  # as a later session finds it
        again = memory.search(asked, 2, memory.index()).orderBy("rk").collect()
        assert [r["chunk_id"] for r in again] == [r["chunk_id"] for r in found]
        memory.ingest(talk(spark, ("user", "what is my name"), conv=2))  # found at once, without a new index
        new = memory.search(asked, 1, memory.index()).first()
        assert new["text"] == "what is my name" and new["score"] > 0.99
        assert [x.count() for x in memory.ingest(rows)] == [0, 0] and memory.index().entries.count() == 4
        memory.rebuild_terms()
        memory.ingest(talk(spark, ("user", "Ada likes zebras"), conv=3))
        both = {r["chunk_id"]: (r["dense_rk"], r["term_rk"]) for r in memory.candidates(spark.createDataFrame([(1, "zebras")], "query_id long, text string"), 50).collect()}
        assert len(both) == 5 and sorted(x[1] for x in both.values() if x[1]) == [1]
    with Memory(spark, str(tmp_path / "v")) as memory:  # without an encoder terms answer
        assert [r["text"] for r in memory.search(spark.createDataFrame([(1, "the zebras")], "query_id long, text string"), 1).collect()] == ["Ada likes zebras"]


def test_stream(spark, tmp_path):
    rows = talk(spark, ("user", "One. Two."), ("assistant", "Three."))
    rows.unionByName(rows).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.read_turns(spark, str(tmp_path / "in"), rows.schema, 1))
    for _ in range(2):  # the second run finds nothing new
        ingest.chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), ChunkerConfig(1, 3)).awaitTermination()
    assert ingest.landed(spark, str(tmp_path / "out")).count() == 3


def test_late_turns_and_windows_on_streams(spark, tmp_path):
    at = lambda minute: F.timestamp_add("MINUTE", F.lit(minute), F.lit("2024-01-01 10:00:00").cast("timestamp"))
    for n, (turn, minute) in enumerate([(0, 0), (0, 1), (1, 300), (1, 302), (0, 301)]):
        rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), at(minute).alias("created_at"), at(minute).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.read_turns(spark, f"{tmp_path}/in", rows.schema, 1)
    ingest.deduplicated(stream, "10 minutes").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start().awaitTermination()
    found = [(r["turn"], r["created_at"].hour) for r in spark.table("once").collect()]
    assert sorted(t for t, _ in found) in ([0, 0, 1], [0, 1])  # turn 0 comes back only after its state has gone
    ingest.activity(stream).writeStream.format("memory").queryName("active").outputMode("append").option("checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).start().awaitTermination()
    assert [r["n_events"] for r in spark.table("active").collect()] == [2]  # the later window is open still


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from turnlake import cli

    (tmp_path / "t").mkdir()
    assert cli.main(["--conversation-dir", str(tmp_path / "t")], spark) == 1
    (tmp_path / "t" / "a.txt").write_text("User:\nI like tea\n\nClaude:\nTea it is\n")
    assert cli.main(["--conversation-dir", str(tmp_path / "t"), "--results-dir", str(tmp_path / "r")], spark) == 0
    out = capsys.readouterr().out
    assert "recall@4" in out and "  a.txt: " in out
    lines = [json.loads(x) for f in (tmp_path / "r").glob("eval_120-250_k10_ef50_*/part-*") for x in f.read_text().splitlines()]
    assert {x.get("conv_id") for x in lines} == {None, "a.txt"}
    (tmp_path / "models.py").write_text("def talker():\n    return lambda messages: 'Tea it is'\n\n\ndef judge():\n    return lambda messages: '{\"score\": 3}'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "models.py"))
    assert cli.main(["--conversation-dir", str(tmp_path / "t"), "--results-dir", str(tmp_path / "r2"), "--responder-model", "models:talker", "--judge-model", "models:judge"], spark) == 0
    assert "Mean score 3.00" in capsys.readouterr().out


def test_a_sweep_replays_what_greater_chunks_do_not_change_once(spark, monkeypatch):
    long = "Blue birds sing; red ones do not, or so they say. " * 3
    texts = [[("user", "tell me of birds"), ("assistant", "birds sing"), ("user", "which birds"), ("assistant", "birds sing loudly")]]
    texts += [[("user", long), ("assistant", long + "indeed"), ("user", "do birds sing"), ("assistant", "so they say; red ones do not")]]
    texts += [[("user", None), ("assistant", "a b c"), ("user", "a " * 25), ("assistant", "a, b")]]
    rows = spark.createDataFrame([(c, i, role, text) for c, turns in enumerate(texts) for i, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    grid = evaluation.sweep_configs(chunker_grid={"min_tokens": [1], "max_tokens": [30, 8, 60]}, retrieval_grid={"k": [1, 3], "ef_search": [50]})
    seen = {}
    chunk = evaluation.chunking.chunk
    monkeypatch.setattr(evaluation.chunking, "chunk", lambda turns, config: seen.update({config.max_tokens: turns.count()}) or chunk(turns, config))
    board = {r["config_idx"]: (r["n_scored"], r["mean_score"], r["recall_at_4"]) for r in evaluation.run_sweep(rows, grid).collect()}
    assert seen == {8: 12, 30: 8, 60: 4}
    for i, config in enumerate(grid):
        r = evaluation.run_eval(rows, config)[2].first()
        assert board[i] == (r["n_scored"], r["mean_score"], r["recall_at_4"])
