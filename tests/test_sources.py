from pyspark.sql import functions as F

from turnlake.sources import store, transcripts


def turns_of(spark, text, parse):
    rows = spark.createDataFrame([(text,)], "t string").select(parse(F.col("t")).alias("x")).first()["x"]
    return [(r["role"], r["text"]) for r in rows]


def test_text_export(spark):
    text = "lost\nUser:\nHello world\n\nClaude:\n Hi there! User: inline\n\nUser:\nBye\n"
    assert turns_of(spark, text, transcripts.parse_txt) == [("user", "Hello world"), ("assistant", "Hi there! User: inline"), ("user", "Bye")]


def test_blank_bodies_vanish(spark):
    assert turns_of(spark, "User:\n\nClaude:\n \n\nUser:\nActual content\n", transcripts.parse_txt) == [("user", "Actual content")]
    assert turns_of(spark, "**User:**\n\n**Assistant:**\n\n**Assistant:**\n\nYes\n", transcripts.parse_md) == [("assistant", "Yes")]
    assert turns_of(spark, "", transcripts.parse_txt) == []


def test_directory(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes(b"User:\r\nHi \xff\r\nClaude:\r\nYo")
    (tmp_path / "b.md").write_text("**User:**\n\nHello\n")
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.MD").write_text("**User:**\n\nHello\n")
    (tmp_path / "e.txt").write_text("nothing")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.txt").write_text("User:\nHi")
    rows = transcripts.load_directory(spark, str(tmp_path)).orderBy("filename", "turn").collect()
    assert [tuple(r) for r in rows] == [("a b.txt", 0, "user", "Hi �"), ("a b.txt", 1, "assistant", "Yo"), ("b.md", 0, "user", "Hello")]


def test_one_export(spark, tmp_path):
    (tmp_path / "my talk.log").write_bytes(b"before\nUser:\r\nOne\r\n\r\nClaude: \nTwo\nUser: no header\n")
    (tmp_path / "c.md").write_text("User:\nplain\n**Assistant:**\nfine\n**User:**")
    rows = lambda name: [tuple(r) for r in transcripts.load_conversation(spark, str(tmp_path / name)).orderBy("turn").collect()]
    assert rows("my talk.log") == [("my talk.log", 0, "user", "One"), ("my talk.log", 1, "assistant", "Two\nUser: no header")]
    assert rows("c.md") == [("c.md", 0, "assistant", "fine")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.turns.count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "first"), (1, 1, "assistant", ""), (1, 2, "robot", "no"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    assert s.append_turns(rows).count() == 2
    assert s.append_turns(rows).count() == 0  # appended twice, there once
    assert s.turns.count() == 2
    assert s.sql("SELECT text FROM turns WHERE turn = :n", n=0).first()["text"] == "first"
    number = s.turns.where("turn = 0").first()["turn_id"]
    assert store.get_turn(s.turns, number).count() == 1 and store.get_turn(s.turns, "nonexistent").isEmpty()


def test_recent_is_oldest_first(spark):
    rows = spark.createDataFrame([(i, f"2024-01-0{i}") for i in (1, 2, 3)], "turn long, created_at string")
    assert [r["turn"] for r in store.recent(rows, 2).collect()] == [2, 3]


def test_references(spark):
    chunks, turns = spark.createDataFrame([("a",), ("b",)], "turn_id string"), spark.createDataFrame([("a",)], "turn_id string")
    good, bad = store.referenced(chunks, turns)
    assert [r[0] for r in good.collect()] == ["a"] and [r[0] for r in bad.collect()] == ["b"]
